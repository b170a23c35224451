"""Files are written and read again."""

import json

from factloom.sources import reports


def test_table_graphs(spark, tmp_path):
    doc = {"gaap": "IFRS", "pages": {"1": {"width": 10.0, "height": 20.0}}, "tables": [{"tableId": "t1", "pageNo": 1, "columns": [{"colIdx": 1, "role": "VALUE", "headerLabel": "2024", "detectedAxes": {"AXIS.PERIOD": "PERIOD.Y2024"}}], "rows": [{"rowId": "r1", "rowIdx": 0, "label": "Cash", "rowType": "DATA", "cells": [{"colIdx": 1, "text": "5", "parsedValue": 5.0}], "preTagged": {"conceptId": "SFP.CASH"}}, {"rowId": "r2", "rowIdx": 1, "label": "", "rowType": "SEPARATOR"}]}, {"tableId": "t2", "pageNo": 2}]}
    (tmp_path / "acme").mkdir()
    (tmp_path / "acme" / "table_graphs.json").write_text(json.dumps(doc, indent=1))
    shapes = reports.shred_table_graphs(reports.read_table_graphs(spark, f"{tmp_path}/*/table_graphs.json"))
    assert [(r["doc_id"], r["table_id"], r["table_ord"]) for r in shapes["tables"].orderBy("table_ord").collect()] == [("acme", "t1", 0), ("acme", "t2", 1)]
    assert [r["text"] for r in shapes["cells"].where("text is not null").collect()] == ["5"]
    assert [r["concept_id"] for r in shapes["tags"].collect()] == ["SFP.CASH"] and shapes["rows"].where("label is not null").count() == 2
    assert [(r["page_no"], r["height"]) for r in shapes["pages"].collect()] == [(1, 20.0)] and shapes["columns"].where("role = 'VALUE'").count() == 1


def test_page_elements(spark):
    df = spark.createDataFrame([(1, [("a", "text", [(1,), (2,)]), ("b", "caption", [])])], "doc_id long, texts array<struct<text:string,label:string,prov:array<struct<page_no:int>>>>")
    assert [(r["text"], r["page_no"]) for r in reports.page_elements(df).collect()] == [("a", 1)]
    assert sorted(r["page_no"] for r in reports.page_elements(df, "all").collect()) == [1, 2]


def test_ledger_log_and_runs(spark, tmp_path):
    (tmp_path / "ledger.csv").write_text("Konto;Bezeichnung;Soll;Haben;Saldo\n0100;Grund;1.234,50;0,00;1.234,50\n4000;Erlöse;;5.000,00;-5.000,00\n")
    assert [tuple(r) for r in reports.read_trial_balance(spark, f"{tmp_path}/ledger.csv").orderBy("account").collect()] == [("0100", "Grund", 1234.5, 0.0, 1234.5), ("4000", "Erlöse", None, 5000.0, -5000.0)]
    for k in range(2):
        reports.append_log(spark.createDataFrame([(k, "x")], "n int, s string"), f"{tmp_path}/log")
    assert reports.read_event_log(spark, f"{tmp_path}/log", "n int, s string").count() == 2
    for run, n in (("a", 3), ("b", 2), ("a", 1)):
        reports.write_run(spark.range(n).withColumnRenamed("id", "doc_id"), f"{tmp_path}/runs", run)
    assert sorted((r["run_id"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/runs").groupBy("run_id").count().collect()) == [("a", 1), ("b", 2)]
    more = spark.createDataFrame([(5, "x")], "id long, s string")
    assert reports.chunk_union([spark.range(2).toDF("id"), more]).where("s is null").count() == 2


def test_packed_documents_are_compressed(spark, tmp_path):
    """Documents come back as they were, from compressed files, dealt anew or not."""
    docs = spark.range(50).selectExpr("cast(id as string) as docId", "'IFRS' as gaap", "array(struct('t' || id as tableId, cast(id as int) as pageNo)) as tables")
    for dealt in (False, True):
        reports.pack_table_graphs(docs, f"{tmp_path}/{dealt}", dealt)
        back = reports.read_packed_graphs(spark, f"{tmp_path}/{dealt}")
        assert sorted(r["tables"][0]["tableId"] for r in back.collect()) == sorted(f"t{i}" for i in range(50))
        assert all(x.name.endswith(".json.gz") for x in (tmp_path / str(dealt)).glob("part-*"))
