"""Helpers shared by the training-data operators: inputs, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a kernel takes at once; keeps its arrays inside the CPU caches and memory bounded.
CHUNK_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it again, which cuts its lineage. The table lies in a folder
    of the application; its path is added to `scratch`, for drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Removes tables that written() made and that nothing will read any more."""
    while scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ddl(df: DataFrame, keep: list[str]) -> str:
    """The columns of a schema string, each followed by a comma."""
    return "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def columns(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in names]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each holds about `limit` bytes of `text`, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(text)
        if pa.types.is_large_string(col.type) or pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
            at = np.frombuffer(col.buffers()[1], kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
        else:
            at = np.concatenate([[0], np.cumsum([len(x or "") for x in col.to_pylist()])])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, also where names of columns have dots or backticks in them."""
    names = df.columns
    if not any(c in name for name in names for c in ".`"):
        return df.mapInArrow(run, schema)
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lambda batches: run(x.rename_columns(names) for x in batches), schema)
