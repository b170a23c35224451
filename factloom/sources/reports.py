"""Readers and writers: nested extraction files, page elements, ledgers, logs, runs, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A1: shape of an extraction file; fields that files lack are null.
CELL = "struct<colIdx:int,text:string,parsedValue:double,isNegative:boolean>"
ROW = f"struct<rowId:string,rowIdx:int,label:string,rowType:string,parentId:string,childIds:array<string>,noteRef:string,cells:array<{CELL}>,preTagged:struct<conceptId:string,method:string,confidence:double>>"
COLUMN = "struct<colIdx:int,role:string,headerLabel:string,detectedAxes:map<string,string>>"
META = "struct<statementComponent:string,sectionPath:array<string>,detectedUnit:string,detectedCurrency:string,signConvention:string,scaleFactor:bigint>"
TABLE_GRAPHS = f"gaap string, pages map<string,struct<width:double,height:double>>, tables array<struct<tableId:string,pageNo:int,columns:array<{COLUMN}>,rows:array<{ROW}>,metadata:{META}>>"


def read_table_graphs(spark: SparkSession, path: str) -> DataFrame:
    """A1: one nested JSON file for each document, in a folder named after it; the schema is given, so nothing is inferred."""
    df = spark.read.schema(TABLE_GRAPHS).option("multiLine", True).json(path)
    return df.withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def pack_table_graphs(nested: DataFrame, path: str, dealt: bool = False) -> None:
    """A1: documents (docId and the fields of an extraction file) as compressed lines of JSON, in files that Spark sizes, however many documents there are.
    dealt: a shuffle that made the documents has sized their partitions already, so they aren't shuffled once more."""
    (nested if dealt else nested.hint("rebalance")).write.option("compression", "gzip").json(path)


def read_packed_graphs(spark: SparkSession, path: str) -> DataFrame:
    """A1: packed documents, as read_table_graphs gives them; a file is read line by line."""
    df = spark.read.schema(f"docId string, {TABLE_GRAPHS}").json(path)
    return df.withColumnRenamed("docId", "doc_id")


def shred_table_graphs(nested: DataFrame) -> dict[str, DataFrame]:
    """A2: pages, tables, columns, rows, cells and tags of A1's documents, with ordinals. A row has its table's place and context and its own tag beside it, as it lies
    in them: nobody needs to join them again."""
    t = nested.select("doc_id", F.posexplode_outer("tables").alias("table_ord", "t"))
    r = t.select("doc_id", F.col("t.tableId").alias("table_id"), "table_ord", F.col("t.metadata.statementComponent").alias("context"), F.posexplode_outer("t.rows").alias("row_ord", "r"))
    key = ["doc_id", "table_id", F.col("r.rowId").alias("row_id")]
    return {
        "pages": nested.select("doc_id", F.explode_outer("pages").alias("page_no", "size")).select("doc_id", F.col("page_no").cast("int").alias("page_no"), "size.*"),
        "tables": t.select("doc_id", F.col("t.tableId").alias("table_id"), "table_ord", F.col("t.pageNo").alias("page_no"), F.col("t.metadata").alias("metadata")),
        "columns": t.select("doc_id", F.col("t.tableId").alias("table_id"), F.explode_outer("t.columns").alias("c")).select("doc_id", "table_id", F.col("c.colIdx").alias("col_idx"), F.col("c.role").alias("role"), F.col("c.headerLabel").alias("header"), F.col("c.detectedAxes").alias("axes")),
        "rows": r.select(*key, F.col("r.rowIdx").alias("row_idx"), F.col("r.label").alias("label"), F.col("r.rowType").alias("row_type"), F.col("r.parentId").alias("parent_id"), F.col("r.childIds").alias("child_ids"), "table_ord", "context", F.col("r.preTagged.conceptId").alias("tag")),
        "cells": r.select(*key, F.explode_outer("r.cells").alias("c")).select("doc_id", "table_id", "row_id", F.col("c.colIdx").alias("col_idx"), F.col("c.text").alias("text"), F.col("c.parsedValue").alias("parsed_value")),
        "tags": r.where("r.preTagged.conceptId is not null").select(*key, F.col("r.preTagged.conceptId").alias("concept_id"), F.col("r.preTagged.method").alias("method"), F.col("r.preTagged.confidence").alias("confidence")),
    }


def page_elements(elements: DataFrame, mode: str = "first") -> DataFrame:
    """A3: text elements by page: the page of the first provenance only, or one row for every provenance. elements: doc_id, texts."""
    t = elements.select("doc_id", F.posexplode("texts").alias("ord", "x"))
    if mode == "first":
        return t.select("doc_id", "ord", F.get("x.prov", F.lit(0))["page_no"].alias("page_no"), F.col("x.label").alias("label"), F.col("x.text").alias("text")).where("page_no is not null")
    return t.select("doc_id", "ord", F.explode("x.prov").alias("p"), F.col("x.label").alias("label"), F.col("x.text").alias("text")).select("doc_id", "ord", F.col("p.page_no").alias("page_no"), "label", "text")


def read_trial_balance(spark: SparkSession, path: str) -> DataFrame:
    """A ledger separated by semicolons, with European numbers: account, name, debit, credit, balance."""
    from ..operators.facts import parse_amounts

    raw = spark.read.csv(path, sep=";", header=True, schema="account string, name string, debit_text string, credit_text string, balance_text string")
    for c in ("debit", "credit", "balance"):
        raw = parse_amounts(raw, f"{c}_text", c).drop(f"{c}_text")
    return raw


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines."""
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A run's results in a partition of its own; a run that is written again replaces only itself. Documents are sorted within files, not
    partitioned by, which would make a file for each."""
    df.withColumn("run_id", F.lit(run_id)).sortWithinPartitions("doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def chunk_union(chunks: list[DataFrame]) -> DataFrame:
    """Parts of one extraction, of which some may lack columns."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
