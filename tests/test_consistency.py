"""The run of all passes on statements written by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import checks
from factloom.plans import consistency, shapes

NAMES = {1: "PNL", 2: "SFP", 3: "OCI", 4: "DISC.SEGMENTS", 5: "DISC.REVENUE"}
SCHEMA = "doc_id long, y int, table_id long, row_id long, k int, row_idx int, parent int, concept_id string, context string, label string, value double"
ROWS = [
    (1, 0, None, "REVENUE", 60000.0), (1, 1, 0, "REV.A", 10000.0), (1, 2, 0, "REV.R", 20000.0), (1, 3, 0, "REV.N", 30000.0), (1, 4, None, "MARGIN", 6.0), (1, 5, None, "STAFF", 444.0), (2, 0, None, "ASSETS", 30000.0), (2, 1, 0, "CASH", 11000.0),
    (2, 2, 0, "STOCK", 19000.0), (2, 3, None, "RETAINED", 60000.0), (3, 0, None, "FLOW.A", -10000.0), (4, 0, None, "SEGREV", 15000.0), (4, 1, None, "SEGREV", 45000.0), (5, 0, None, "NOTE.CASH", 11000.0), (5, 1, None, "NOTE.REV1", 25000.0), (5, 2, None, "NOTE.REV2", 35000.0),
]


CHANGES = {
    1: ("REV.A", 17000.0, {"rev_sum", "flow_tie", "margin_of"}), 2: ("SEGREV", 99000.0, {"seg_detail"}), 3: ("RETAINED", 1.0, {"result_tie"}),
    4: ("NOTE.CASH", 500.0, {"cash_note"}), 5: ("STOCK", 1.0, {"assets_parts"}), 6: ("STAFF", 5.0, set()), 7: (None, 0.0, set()),
}


def statements(spark, changes):
    """Seven documents of two years; changes: the concept and value of a cell of 2001."""
    lines = []
    for doc in CHANGES:
        for y in (2000, 2001):
            for k, i, parent, concept, value in ROWS:
                table = (doc * 100 + y - 1990) * 10 + k
                new = changes[doc][1] if doc in changes and y == 2001 and changes[doc][0] == concept else value
                lines.append((doc, y, table, table * 100 + i, k, i, parent, concept, NAMES[k], concept.lower(), new))
    t = shapes.Inputs(spark, "")
    t._made["s_lines"] = spark.createDataFrame(lines, SCHEMA)
    return consistency.Run(t)


def by_fact(df):
    return {(r["doc_id"], r["table_id"], r["concept_id"]): (r["status"], r["n_passed"], r["n_failed"]) for r in df.collect()}


@pytest.fixture(scope="module")
def runs(spark):
    return statements(spark, {}), statements(spark, CHANGES)


def test_sound_statements(runs):
    found = runs[0].found.collect()
    assert {r["category"] for r in found if r["pass_no"] == 1} == {"VALID_DISAGGREGATION", "VALID_TIE"} and len([r for r in found if r["pass_no"] == 1]) == 14 * 9
    assert sorted((r["doc_id"], r["context"], r["concepts"]) for r in found if r["pass_no"] == 3) == [(d, "PNL", ["STAFF"]) for d in CHANGES]


def test_a_changed_cell_flips_the_facts_that_depend_on_it(runs):
    """Exactly the facts of the findings, and of the table's sums, in which the cell takes part get other scores."""
    before, after = (by_fact(r.scores_by_fact()) for r in runs)
    lines = [r for r in runs[1].lineage().collect() if r["period_key"] == "Y2001"]
    bad = runs[1].found.where("category in ('BROKEN_RELATIONSHIP', 'DECOMPOSITION_RESIDUAL')").collect()
    assert not any(failed for _, _, failed in before.values())
    for doc, (concept, _, edges) in CHANGES.items():
        depend = {(doc, r["table_id"], r["concept_id"]) for r in lines if r["doc_id"] == doc and r["edge_name"] in edges}
        table = (doc * 100 + 11) * 10  # where the cell is part of a sum in its table, pass 0 fails too
        depend |= {(doc, table + 1, c) for c in ("REVENUE", "REV.A", "REV.R", "REV.N")} if concept == "REV.A" else {(doc, table + 2, c) for c in ("ASSETS", "CASH", "STOCK")} if concept == "STOCK" else set()
        assert {k for k in before if k[0] == doc and before[k] != after[k]} == depend
        assert {r["edge_name"] for r in bad if r["doc_id"] == doc} == edges


def test_named_concepts_count_everywhere(runs):
    """Scores by concept reach a concept's facts wherever they stand; scores by fact only those that took part."""
    named, part = by_fact(runs[1].scores()), by_fact(runs[1].scores_by_fact())
    assert named[3, 3111, "REVENUE"][0] == part[3, 3111, "REVENUE"][0] == "CONTRADICTED" and named[3, 3101, "REVENUE"][0] == "CONFIRMED"
    note = (3, 3115, "NOTE.REV1")  # of a sum of notes only the face is named
    assert part[note][1] == 1 and named[note][1] == 0


def test_findings_stay_dealt_by_document(runs):
    """What the run writes lies in buckets of doc_id: grouping it by document and more takes no shuffle."""
    plan = runs[0].found.groupBy("doc_id", "edge_name").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_keys_of_mismatches_and_collisions(spark):
    """The keys that the run works with are those of D11 and D12, nulls included."""
    rows = [(1, 1, "A", "Y1", 100.0), (1, 2, "A", "Y1", 200.0), (1, 2, "B", "Y1", 200.0), (1, 3, "B", "Y1", 200.0), (1, 3, "A", "Y0", 100.0), (1, 4, "A", "Y0", None), (2, 1, "A", "Y1", 100.0), (2, 1, "B", "Y1", 100.0), (2, 3, "A", "Y2", 500.0), (2, 4, "A", "Y2", 500.0)]
    facts = spark.createDataFrame(rows, "doc_id long, table_id long, concept_id string, period_key string, amount double")
    pairs = ((checks.first_mismatches(facts), checks.concept_mismatches(facts), ["doc_id", "concept_id", "period_key"]), (checks.collided(facts), checks.amount_collisions(facts), ["doc_id", "amount"]))
    for keys, full, by in pairs:
        got, want = (sorted(map(tuple, df.select(by).collect())) for df in (keys, full))
        assert got == want and got


def test_scores_join_dealt_checks_without_a_shuffle(spark):
    """Sets of checks given apart count as their union does, and facts and checks in buckets of doc_id stay in them."""
    from factloom.operators import consistency as K
    from factloom.operators import tagging as A

    facts = A.bucketed_table(spark.createDataFrame([(d, 1, r, c, 2, p) for d in range(9) for r, (c, p) in enumerate((("A", "Y1"), ("B", "Y1"), ("A", "Y2")))], "doc_id long, table_id long, row_id long, concept_id string, col_idx int, period_key string"), "facts", "doc_id", 4)
    found = [(d, 1, 1, ["VALID_TIE", "BROKEN_RELATIONSHIP"][d % 2], "SUM", "e", "Y1", ["A", "B"]) for d in range(9)] + [(d, 3, 1, "UNEXPLAINED_INCONSISTENCY", "U", "U", None, ["A"]) for d in range(5)]
    found = A.bucketed_table(spark.createDataFrame(found, "doc_id long, pass_no int, nth int, category string, check_type string, edge_name string, period_key string, concepts array<string>"), "found", "doc_id", 4)
    more = A.bucketed_table(K.checks_by_concept(found, facts).where("concept_id = 'B'").withColumn("check_type", F.lit("MORE")), "more", "doc_id", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with A.one_key(spark):
            plan = checks.score_facts(facts, K.checks_by_concept(found, facts), more)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    apart, union = (sorted(map(tuple, df.collect())) for df in (checks.score_facts(facts, K.checks_by_concept(found, facts), more), checks.score_facts(facts, K.checks_by_concept(found, facts).unionByName(more))))
    assert apart == union and {r[-1] for r in apart} == {"CONTRADICTED", "CONFIRMED", "CORROBORATED"}
    assert [r[5:8] for r in apart if r[0] == 0 and r[2] == "A"] == [(1, 0, 1)]
