"""Branches of rules that the driver's tables don't reach, and properties of operators."""

import random

from pyspark.sql import functions as F

from factloom.functions import labels as L
from factloom.operators import checks, facts, learning, reviews, rollups, structure, tagging, timelines


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_amounts(spark):
    cases = {"(1.234,5)": -1234.5, "–": 0.0, "n/a": None, "1.234.567": 1234567.0, "12,5": 12.5, "1,234": 1234.0, "7 %": 7.0, "1,234.5": 1234.5, "-3": -3.0, "−4,25": -4.25, "1e5": None, "NaN": None, "": None, "1.234": 1.234, "1,234,567": 1234567.0, None: None, "12 000": 12000.0}
    df = facts.parse_amounts(spark.createDataFrame(list(cases.items()), "text string, want double"))
    assert all(r["parsed"] == r["want"] for r in df.collect()), df.collect()


def test_labels(spark):
    df = spark.createDataFrame([("Revenue (see note 12)",), ("Costs** (3)",), ("Loans b)",), (None,)], "c string").select(L.clean_label(F.col("c")).alias("x")).select("x.*")
    assert [tuple(r) for r in df.collect()][:3] == [("Revenue", "", 12), ("Costs", "3", None), ("Loans", "b", None)]
    u = spark.createDataFrame([(x,) for x in ("31.12.2024", "2024", "1.234", "Note 5", "IFRS 16", "in TEUR", "", "Umsatzerlöse")], "c string").select(L.is_untaggable(F.col("c")).alias("u"))
    assert [r["u"] for r in u.collect()] == [True] * 7 + [False]


def test_arithmetic_flips_when_a_child_changes(spark):
    rows = spark.createDataFrame([(1, 1, 10, None), (1, 1, 11, 10), (1, 1, 12, 10)], "doc_id long, table_id long, row_id long, parent_id long")
    cell = lambda v: spark.createDataFrame([(1, 10, 1, 100.0), (1, 11, 1, 60.0), (1, 12, 1, v)], "table_id long, row_id long, col_idx int, value double")
    assert values(structure.table_arithmetic(rows, cell(40.0)), "passed") == [(True,)] and values(structure.table_arithmetic(rows, cell(41.0)), "passed") == [(False,)]
    assert values(structure.table_arithmetic(rows, cell(None)), "n_children") == [(1,)]


def test_scale_and_sign(spark):
    df = spark.createDataFrame([(5000.0, 5.0), (5.0, 5000.0), (5e6, 5.0), (5.0, 5.0), (0.0, 5.0)], "a double, b double").select(checks.scale_mismatch(F.col("a"), F.col("b")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1e3, 1e-3, 1e6, None, None]
    rows = [("NATURAL_DRCR", "PNL", "credit"), ("PRESENTATION", "PNL", "credit"), ("PRESENTATION", "SFP", "credit"), ("PRESENTATION", "SFP", "debit"), ("PRESENTATION", "SFP", None)]
    df = spark.createDataFrame([(5.0, *r) for r in rows], "v double, c string, x string, b string").select(facts.normalize_sign(F.col("v"), F.col("c"), F.col("x"), F.col("b")).alias("s"))
    assert [r["s"] for r in df.collect()] == [5.0, -5.0, -5.0, 5.0, 5.0]


def test_additive_columns(spark):
    cells = [(1, r, c, v) for r in range(6) for c, v in ((1, r + 1.0), (2, 10.0 * r + 3), (3, 11.0 * r + 4 if r else 900.0), (4, 77.0 + r * r))]
    got = structure.additive_columns(spark.createDataFrame(cells, "table_id long, row_id long, col_idx int, value double"))
    assert values(got, "total", "parts") == [(3, "1,2")]


def test_recent_periods(spark):
    f = spark.createDataFrame([(1, p) for p in ("Y2020", "Y2022", "Y2021", "CURRENT")] + [(2, p) for p in ("ord_1", "COMPARATIVE", "CURRENT", "COMPARATIVE_2")], "doc_id long, period_key string")
    assert values(facts.recent_periods(f), "doc_id", "rank", "period_key") == [(1, 1, "Y2022"), (1, 2, "Y2021"), (2, 1, "CURRENT"), (2, 2, "COMPARATIVE")]


def test_sections_round_trip(spark):
    r = random.Random(1)
    rows = [(d, p, r.choice(["PNL", "SFP", "TOC"])) for d in range(5) for p in sorted(r.sample(range(1, 40), 6))]
    t, docs = spark.createDataFrame(rows, "doc_id long, page int, section_type string"), spark.createDataFrame([(d, 45) for d in range(5)], "doc_id long, n_pages int")
    assert values(timelines.sections_to_transitions(timelines.transitions_to_sections(t, docs)), "doc_id", "page", "section_type") == sorted(rows)


def test_asof_section(spark):
    starts = spark.createDataFrame([(1, 3, "PNL"), (1, 6, "NOTES"), (1, 9, "SFP")], "doc_id long, page int, section_type string")
    tables = spark.createDataFrame([(1, k, p) for k, p in enumerate((1, 3, 5, 6, 7, 9, 28, 29))], "doc_id long, table_id long, page_no int")
    assert [x[1] for x in values(timelines.asof_section(tables, starts).fillna("-"), "table_id", "section_type")] == ["-", "PNL", "PNL", "NOTES", "-", "SFP", "SFP", "-"]


def test_cascade_stops_and_never_overwrites(spark):
    rows = [(1, 1, 100 + i, i, label, "DATA" if i else "TOTAL_EXPLICIT", 100 if i else None, tag) for i, (label, tag) in enumerate([("Total", "T"), ("a", None), ("b", None), ("c", "C")])]
    r = spark.createDataFrame(rows, "doc_id long, table_id long, row_id long, row_idx int, label string, row_type string, parent_id long, tag string")
    cells = spark.createDataFrame([(1, 100, 1, 6.0), (1, 101, 1, 1.0), (1, 102, 1, 2.0), (1, 103, 1, 3.0)], "table_id long, row_id long, col_idx int, value double")
    tables = spark.createDataFrame([(1, 1, "PNL")], "doc_id long, table_id long, context string")
    index, tree = spark.createDataFrame([("a", "A")], "norm string, concept_id string"), spark.createDataFrame([("T", "A", 1, False, True), ("T", "B", 2, False, True), ("T", "C", 3, False, True)], "concept_id string, member string, ord int, partial boolean, ordered boolean")
    assert values(tagging.cascade(r, cells, tables, index, tree), "row_id", "concept_id", "round") == [(101, "A", 0), (102, "B", 1)]


def test_consensus_order_does_not_matter(spark):
    r = random.Random(2)
    votes = [("d", i % 4, r.choice("ab"), r.choice(["human", "mlp", "rule"]), r.choice(["tag", "tag", "dissent"]), str(i % 5), i) for i in range(60)]
    cols = "dimension string, target_id int, value string, source string, action string, voter string, ts int"
    one = values(rollups.consensus(spark.createDataFrame(votes, cols)), "target_id", "value", "weight", "confidence")
    r.shuffle(votes)
    assert one == values(rollups.consensus(spark.createDataFrame(votes, cols)), "target_id", "value", "weight", "confidence")


def test_expected_findings_wildcards(spark):
    f = spark.createDataFrame([("e1", "c1", "ERROR"), ("e2", "c2", "ERROR"), ("e3", "c3", "OK")], "edge_name string, concept_id string, severity string")
    e = spark.createDataFrame([("e1", None), (None, "c9")], "edge_name string, concept_id string")
    assert [x[2] for x in sorted(values(reviews.expected_findings(f, e).fillna("*"), "edge_name", "concept_id", "outcome"))] == ["missing", "found", "unexpected"]


def test_balance_and_grid(spark):
    df = learning.balance_classes(spark.createDataFrame([(i, int(i < 5)) for i in range(40)], "id long, y int"), "y")
    assert {r["y"]: r["count"] for r in df.groupBy("y").count().collect()} == {0: 35, 1: 35}
    boxes = spark.createDataFrame([(1, "t", 0.0, 0.0, 0.5, 0.25), (1, "t", 0.9, 0.9, 1.0, 1.0)], "page_id long, kind string, x0 double, y0 double, x1 double, y1 double")
    assert learning.layout_rows(boxes, 4, 4).agg({"n_cells": "sum"}).first()[0] == 2 + 1


def test_entry_without_the_training_data_subpackage(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ModuleNotFoundError(name, name=name)) if name.startswith(("factloom.llm", "corpus_pipeline")) else real(name, *a, **k))
    assert "d5_table_arithmetic" in e.queries() and not any(n.startswith("op") for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
