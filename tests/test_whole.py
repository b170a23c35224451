"""Queries and operators that do the whole of their job, against brute force on the smallest driver tables or a small fixture."""

import math
import os

import pytest

from factloom.plans import shapes
from factloom.plans.catalog import registry

DIR = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not there")


@driver_tables
def test_every_page_gets_its_grid(spark):
    want = {}
    for r in shapes.Inputs(spark, DIR).lineitem.select("l_orderkey", "l_returnflag", "l_discount", "l_tax").collect():
        x0, y0 = r["l_discount"] * 5, r["l_tax"] * 5
        clip = lambda v, n: min(max(v, 0), n - 1)
        xa, ya = clip(math.floor(x0 * 48), 48), clip(math.floor(y0 * 64), 64)
        xb, yb = clip(math.ceil(min(x0 + 0.25, 1.0) * 48) - 1, 48), clip(math.ceil(min(y0 + 0.125, 1.0) * 64) - 1, 64)
        for y in range(ya, max(ya, yb) + 1):
            for x in range(xa, max(xa, xb) + 1):
                key = (r["l_orderkey"], r["l_returnflag"], y)
                want[key] = want.get(key, 0) | 1 << x
    rows = [(r["page_id"], r["kind"], r["gy"], r["n_cells"], r["cells"]) for r in registry.QUERIES["j10_layout_grid"](spark, DIR).collect()]
    assert sorted(rows) == sorted((*k, v.bit_count(), v) for k, v in want.items())


def test_top_down_cases(spark):
    """Each of I2's cases: single, equal numbers, a partial tree with one row too many."""
    from factloom.operators import tagging

    tree = [("T", "A", 1, True, True), ("T", "B", 2, True, True), ("T", "C", 3, True, True), ("U", "X", 1, True, False), ("U", "Y", 2, True, False)]
    tables = {
        1: ("T", ["A", None, "C"], [(10, 1), (20, 2), (30, 3)], (60, 7)),  # one row, one member, at its place
        2: ("T", [None, None, "A"], [(1, 1), (2, 1), (3, 1)], (6, 3)),  # two and two, the sum agrees
        3: ("T", [None, None, "A"], [(1, 1), (2, 1), (3, 1)], (90000, 3)),  # it doesn't
        4: ("T", ["A", "C", None, None], [(1, 1)] * 4, (4, 4)),  # one member, two rows: the one at the member's place
        5: ("T", [None, None, None, "C"], [(5000, 1), (9000, 1), (2000, 1), (1, 1)], (14001, 3)),  # the last row that can be left out
        6: ("U", ["Y", None, None], [(1, 1), (None, None), (3, 1)], (4, 2)),  # not ordered: the only one with values
        7: ("U", [None, None], [(1, 1), (2, 1)], (3, 2)),  # not ordered: ambiguous
    }
    rows, cells = [], []
    for t, (tag, tags, values, own) in tables.items():
        rows.append((1, t, t * 100, 0, "Total", "TOTAL_EXPLICIT", None, tag))
        rows += [(1, t, t * 100 + i, i, "x", "DATA", t * 100, k) for i, k in enumerate(tags, 1)]
        cells += [(t, t * 100 + i, c, None if v is None else float(v)) for i, pair in enumerate([own, *values]) for c, v in enumerate(pair, 1)]
    r = spark.createDataFrame(rows, "doc_id long, table_id long, row_id long, row_idx int, label string, row_type string, parent_id long, tag string")
    c = spark.createDataFrame(cells, "table_id long, row_id long, col_idx int, value double")
    got = sorted((x["row_id"], x["concept_id"], x["confidence"]) for x in tagging.tag_top_down(r, c, spark.createDataFrame(tree, "concept_id string, member string, ord int, partial boolean, ordered boolean")).collect())
    assert got == [(102, "B", 0.9), (201, "B", 0.75), (202, "C", 0.75), (404, "B", 0.75), (501, "A", 0.65), (502, "B", 0.65), (603, "X", 0.75)]


def test_cascade_runs_every_rule_in_each_round(spark):
    from factloom.operators import tagging

    row = "doc_id long, table_id long, row_id long, row_idx int, label string, row_type string, parent_id long, tag string"
    made = [
        (1, 1, 10, 0, "Sales", "DATA", None, "S"), (1, 1, 11, 1, "Per share", "DATA", None, "P"), (1, 1, 12, 2, "Shares", "DATA", None, None), (1, 1, 13, 3, "Other", "DATA", None, None),
        (1, 2, 20, 0, "Total", "TOTAL_EXPLICIT", None, None), (1, 2, 21, 1, "North", "DATA", 20, "N"), (1, 2, 22, 2, "South", "DATA", 20, None),
        (1, 3, 30, 0, "Total", "TOTAL_EXPLICIT", None, None),
        (1, 4, 40, 0, "Sum", "TOTAL_EXPLICIT", None, None), (1, 4, 41, 1, "x", "DATA", 40, "X"), (1, 4, 42, 2, "y", "DATA", 40, "Y"),
        (1, 5, 50, 0, "Sum", "TOTAL_EXPLICIT", None, None), (1, 5, 51, 1, "x", "DATA", 50, "X"), (1, 5, 52, 2, "y", "DATA", 50, "Y"),
        (1, 6, 60, 0, "Sum", "TOTAL_EXPLICIT", None, None), (1, 6, 61, 1, "x", "DATA", 60, "X"), (1, 6, 62, 2, "y", "DATA", 60, "Y"),
    ]
    rows = spark.createDataFrame(made, row)
    values = {10: (90000.0, 80000.0), 11: (3.0, 2.0), 12: (30000.0, 40000.0), 13: (30000.0, 7.0), 20: (90400.0, 80000.0), 21: (50000.0, 30000.0), 22: (40000.0, 50000.0), 30: (90400.0, 80000.0)}
    values |= {40: (9000.0, None), 41: (4000.0, 1.0), 42: (5000.0, 1.0), 50: (99000.0, None), 51: (4000.0, 1.0), 52: (5000.0, 1.0)}
    cells = spark.createDataFrame([(r // 10, r, c, v) for r, pair in values.items() for c, v in enumerate(pair, 1)], "table_id long, row_id long, col_idx int, value double")
    tables = spark.createDataFrame([(1, 1, "PNL"), (1, 2, "NOTE"), (1, 3, "ELSE"), (1, 4, "ELSE"), (1, 5, "ELSE"), (1, 6, "ELSE")], "doc_id long, table_id long, context string")
    index = spark.createDataFrame([], "norm string, concept_id string")
    tree = spark.createDataFrame([("S.NOTE", "N", 1, False, False), ("S.NOTE", "M", 2, False, False), ("XY", "X", 1, False, False), ("XY", "Y", 2, False, False)], "concept_id string, member string, ord int, partial boolean, ordered boolean")
    ties = spark.createDataFrame([("S", "S.NOTE", "NOTE")], "face_concept string, note_concept string, context string")
    rules = spark.createDataFrame([("SHARES", "S", "P")], "result string, numerator string, denominator string")
    got = sorted((r["row_id"], r["concept_id"], r["rule"], r["confidence"], r["round"]) for r in tagging.cascade(rows, cells, tables, index, tree, ties=ties, rules=rules).collect())
    assert got == [
        (12, "SHARES", "ratio", 0.6, 1), (20, "S.NOTE", "cross_table", 0.7, 1), (22, "M", "top_down", 0.85, 2),
        (40, "XY", "bottom_up", 0.95, 1), (50, "XY", "bottom_up", 0.7, 1), (60, "XY", "bottom_up", 0.9, 1),
    ]


@driver_tables
def test_ties_and_ratios_agree_in_every_column(spark):
    from collections import defaultdict

    from factloom.plans.classes import ratio_inputs
    from factloom.plans.reviews import face_amounts

    t = shapes.Inputs(spark, DIR)
    rows, cells = ([r.asDict() for r in x.collect()] for x in ratio_inputs(t))
    value, sides = defaultdict(dict), defaultdict(list)
    for c in cells:
        if c["value"] is not None:
            value[c["row_id"]][c["col_idx"]] = c["value"]
    for r in rows:
        for col, v in value[r["row_id"]].items():
            sides[r["table_id"], r["tag"], col].append(v)
    ratio = set()
    for r in (r for r in rows if r["tag"] is None):
        q = {c: min(sides[r["table_id"], "LARGE", c]) / min(sides[r["table_id"], "SMALL", c]) for c in value[r["row_id"]] if sides[r["table_id"], "LARGE", c] and sides[r["table_id"], "SMALL", c] and min(sides[r["table_id"], "SMALL", c])}
        if q and all(abs(value[r["row_id"]][c] - x) <= 0.001 * abs(x) for c, x in q.items()):
            ratio.add(r["row_id"])
    got = {r["row_id"] for r in registry.QUERIES["i5_tag_ratio"](spark, DIR).collect()}
    assert got == ratio and any(r % 100 == 98 for r in got) and not any(r % 100 == 99 and 2 in value[r] for r in got)

    face = defaultdict(dict)
    for f in face_amounts(t).collect():
        face[f["doc_id"], f["concept_id"]][f["col_idx"]] = f["amount"]
    ties = defaultdict(set)
    for r in (r for r in rows if r["tag"] is None and r["row_type"] == "TOTAL_EXPLICIT"):
        for (doc, concept), amounts in face.items():
            both = amounts.keys() & value[r["row_id"]].keys()
            if doc == r["doc_id"] and both and all(abs(value[r["row_id"]][c] - amounts[c]) <= 1000 for c in both):
                ties[r["row_id"]].add(concept)
    assert {(r["row_id"], r["concept_id"]) for r in registry.QUERIES["i4_tag_cross_table"](spark, DIR).collect()} == {(k, min(v)) for k, v in ties.items()}
