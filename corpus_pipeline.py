"""A corpus pipeline of five of the training-data operators, each a stage over what the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and reads it again for the next. All but the last return the columns of documents.

Defined results: a null, empty or letterless text goes at language_id (`und`); a null key is kept by near_dedup and placed as
"null key"; rows that repeat a key and text, or are near copies of a smaller key, leave one row; a null source is a source
of its own in the mix; empty tables give empty results; further columns of documents pass through unchanged, except that shard
replaces columns named slot and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontamination, language, mixing, neardup, shared, sharding


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or torn between languages, go."""
    return language.accepted(docs, language.fit(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.repeat(docs, mixing.decide(mixing.sized(docs)))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the slot and shard that they go to."""
    return sharding.place(docs, "doc_id", sharding.names())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

def over(sql: str, table: str) -> str:
    """A query of documents as one of the rows that `table` has of them."""
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(head):
            return f"{head}documents AS (SELECT * FROM {table}), {sql.lstrip()[len(head):]}"
    raise ValueError("a query that begins with WITH is expected")


#: run()'s rows in DuckDB: each stage's twin over what the one before has kept.
ORACLE_SQL = f"""
WITH known AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({language.oracle(split=False)}) WHERE lang_pred <> 'und' AND score >= 0.5)),
single AS MATERIALIZED (SELECT * FROM known WHERE doc_id IN (SELECT doc_id FROM ({over(neardup.ORACLE, "known")}) WHERE kept)),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM ({over(decontamination.oracle(), "single")}))),
taken AS MATERIALIZED (SELECT doc_id, unnest(range(taken // size)) AS copy FROM ({over(mixing.ORACLE, "clean")}) WHERE taken > 0),
placed AS MATERIALIZED (SELECT * FROM ({over(sharding.oracle(), "clean")}))
SELECT c.*, p.slot, p.shard FROM clean c JOIN taken t USING (doc_id) JOIN placed p USING (doc_id)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
