"""Every registered query with a twin in SQL gives the twin's rows, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import shapes
from factloom.plans.catalog import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in shapes.TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    res = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
