"""Every registered query and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Inputs as a query, with its twin in SQL."""

    def add(f: Callable[[shapes.Inputs], DataFrame]) -> Callable[[shapes.Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(shapes.Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = shapes.oracle(sql)
        return f

    return add
