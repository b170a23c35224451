"""Shapes dealt by table once: the same rows, and queries on them that shuffle nothing more."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import tagging as A
from factloom.plans import dealt, shapes
from factloom.plans.catalog import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not there")


def test_dealt_shapes_hold_the_same_rows_and_join_without_a_shuffle(spark):
    t, plain = shapes.Inputs(spark, DIR), shapes.Inputs(spark, DIR)
    dealt.by_table(t, "r_tables", "r_rows")
    for name in ("r_lines", "r_tables", "r_rows", "r_cells"):
        a, b = getattr(t, name), getattr(plain, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with A.one_key(spark):
        plan = t.r_rows.hint("merge").join(t.r_cells, ["table_id", "row_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.mark.parametrize("name", ["d1_index_facts", "i2_tag_top_down", "i3_tag_bottom_up"])
def test_results_are_made_from_dealt_shapes(spark, name):
    assert "Exchange" not in registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_the_cascade_joins_tags_and_rows_without_a_shuffle(spark, monkeypatch):
    """Each round's rows, which are the rows before with new tags, are made without an exchange of more than tags."""
    plans, keep = [], A.bucketed_table

    def seen(df, name, key, n):
        if name == "cascade-rows":
            with A.one_key(spark):
                plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, key, n)

    monkeypatch.setattr(A, "bucketed_table", seen)
    registry.QUERIES["i6_cascade"](spark, DIR)
    assert plans and all("hashpartitioning" not in p for p in plans)


def test_pages_are_made_once_and_models_meet_them_in_buckets(spark):
    """Page features are written once, by document: neither models nor pages are shuffled again, and a model is worked out for a fold, not for each page."""
    df = registry.QUERIES["j8_leave_one_out"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "factloom_pages" in plan and "Exchange hashpartitioning" not in plan


def test_parts_of_a_table_are_written_to_one_without_a_shuffle(spark):
    """Parts dealt alike, of any column order, are appended as they lie; what is read has all rows and is dealt by the key."""
    a = A.bucketed_table(spark.range(100).selectExpr("id as doc_id", "'a' as kind"), "part-a", "doc_id", 5)
    b = A.bucketed_table(spark.range(50, 150).selectExpr("'b' as kind", "id as doc_id"), "part-b", "doc_id", 5)
    both = A.bucketed_table([a, b], "both", "doc_id", 5)
    assert sorted(map(tuple, both.collect())) == sorted([(i, "a") for i in range(100)] + [(i, "b") for i in range(50, 150)])
    assert "Exchange" not in both.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()


def test_scores_shuffle_no_findings_and_hold_one_set_of_checks_at_a_time(spark, monkeypatch):
    """Findings are made, and met with facts, where the facts lie; the last step joins sums that are written."""
    plans, keep = {}, A.bucketed_table

    def seen(df, name, key, n):
        with A.one_key(spark):
            for one in df if isinstance(df, list) else [df]:
                plans.setdefault(name, []).append(one._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, key, n)

    monkeypatch.setattr(A, "bucketed_table", seen)
    registry.QUERIES["d17_score_facts"](spark, DIR)
    assert len(plans["declared"]) == 6 and len(plans["findings"]) == 3 and len(plans["sums"]) == 2
    assert [name for name in ("findings", "sums", "scores") for p in plans[name] if "Exchange hashpartitioning(doc_id" in p] == []
    assert plans["scores"][0].count("Aggregate(") <= 2


def test_facts_are_grouped_in_as_many_partitions_as_the_orders_ask_for(spark, monkeypatch):
    monkeypatch.setattr(dealt, "BUCKET", 100)
    df = registry.QUERIES["d42_fact_uniqueness"](spark, DIR)
    n = spark.read.parquet(f"{DIR}/orders.parquet").count() // 100 + 8
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and f", {n}), REPARTITION_BY_NUM" in plan
    plain = shapes.Inputs(spark, DIR).r_facts.groupBy("doc_id", "context", "concept_id", "period_key").count().where("count > 1")
    assert df.exceptAll(plain).isEmpty() and plain.exceptAll(df).isEmpty()


def test_lineage_sorts_and_shuffles_neither_facts_nor_findings(spark, monkeypatch):
    """Declared relations come to the findings, not findings to the relations; lineage is written in parts that stay dealt by document, and facts are looked up, not sorted."""
    plans, keep = {}, A.bucketed_table

    def seen(df, name, key, n):
        with A.one_key(spark):
            for one in df if isinstance(df, list) else [df]:
                plans.setdefault(name, []).append(one._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, key, n)

    monkeypatch.setattr(A, "bucketed_table", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        registry.QUERIES["d17_score_by_lineage"](spark, DIR)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans["best"]) == 1 and len(plans["lineage"]) == 2
    assert [p for p in plans["lineage"] + plans["sums"] + plans["scores"] if "Sort " in p or "Exchange hashpartitioning(doc_id" in p] == []
    assert [p for p in plans["declared"] if "SortMergeJoin [edge_name" in p or "SortMergeJoin [concept_id" in p or "NestedLoopJoin BuildLeft" in p] == []


def test_nested_documents_are_made_without_shuffling_cells(spark, monkeypatch):
    """Lines go to their documents once; rows come out of the files with what stands beside them. A table without lines keeps its total, without cells."""
    from factloom.plans import classes

    plans, pack = [], classes.pack_table_graphs

    def seen(df, *more, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        pack(df, *more, **named)

    monkeypatch.setattr(classes, "pack_table_graphs", seen)
    t, plain = shapes.Inputs(spark, DIR), shapes.Inputs(spark, DIR)
    for i in (t, plain):
        i._made["orders"] = i.orders.unionByName(i.orders.limit(1).withColumn("o_orderkey", F.lit(10**9).cast("long")))
    got = classes.shred_cells(t)
    want = plain.r_rows.join(plain.r_cells.select("table_id", "row_id", "col_idx", "value"), ["table_id", "row_id"], "left").select("doc_id", "table_id", "row_id", "col_idx", "value")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.where("table_id = 1000000000 and col_idx is null").count() == 1
    assert plans[0].count("Exchange hashpartitioning(") <= 3 and "Exchange hashpartitioning(table_id" not in plans[0]
    assert "Exchange" not in registry.QUERIES["a2_shred_rows"](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_each_stage_of_the_fit_reads_classes_balanced_once(spark, monkeypatch):
    """Classes are balanced, and their rows repeated, when the training rows are written, not each time that a stage reads them."""
    from factloom.operators import learning as M

    class Read(Exception):
        pass

    def seen(train, features, label):
        raise Read(train._jdf.queryExecution().executedPlan().toString(), train.columns == [label, *features])

    monkeypatch.setattr(M, "train_page_classifier", seen)
    with pytest.raises(Read) as got:
        registry.QUERIES["j7_page_classifier"](spark, DIR)
    plan, columns = got.value.args
    assert columns and "FileScan" in plan and "Generate" not in plan and "Join" not in plan and "md5" not in plan
