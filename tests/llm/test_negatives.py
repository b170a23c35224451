"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, `rank.x` int"


def slow(rows, anchor, k=5, low=80, high=100, scale=256):
    """Every score of every anchor, in whole numbers."""
    ok = [(i, y, v) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, _, v in ok), default=0)
    most = math.isqrt((1 << 62) // max(dims, 1))
    ok = [(i, y, [max(-most, min(most, math.floor(scale * float(np.float32(x))))) for x in v]) for i, y, v in ok]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v in ok:
        if not anchor(i):
            continue
        scores = [(dot(v, w), j, z) for j, z, w in ok if j != i]
        for s, j, _ in sorted((x for x in scores if x[2] == y), key=lambda x: (-x[0], x[1]))[:k]:
            inside = sorted((x for x in scores if x[2] != y and low * s <= 100 * x[0] <= high * s), key=lambda x: (-x[0], x[1]))[:k]
            out += [(i, j, r, x[1], s, x[0]) for r, x in enumerate(inside, 1)]
    return out


def rows(r):
    centre = [[r.gauss(0, 1) for _ in range(12)] for _ in range(3)]
    out = [(i, [c + r.gauss(0, 0.7) for c in centre[i % 3]], i % 4) for i in range(160)]
    out += [(200 + i, [0.5] * 12, i % 2) for i in range(40)]  # ties of one vector in two labels
    out += [(300, [0.5] * 12, 0), (300, [0.25] * 12, 0), (300, [0.5] * 12, 1), (310, None, 1), (320, [0.1] * 12, None), (None, [0.5] * 12, 1)]
    out += [(330, [math.nan] + [0.5] * 11, 1), (340, [math.inf] + [0.5] * 11, 1), (350, [None] + [0.5] * 11, 1), (360, [0.5] * 5, 1), (370, [], 1), (380, [3e38, -3e38] + [0.5] * 10, 2), (390, [-1.0] * 12, 3)]
    return [(*x, "clash", 1) for x in out]


@pytest.mark.parametrize("block, per, step, few", [(4096, 1024, 4, 64), (16, 3, 1, 2), (50, 1000, 5, 1)])
def test_negatives_against_all_scores(spark, block, per, step, few, monkeypatch):
    monkeypatch.setattr(negatives, "STEP", step)
    monkeypatch.setattr(negatives, "FEW", few)
    data = rows(random.Random(4))
    df = spark.createDataFrame(data, SCHEMA)
    got = negatives.mined(df, F.col("vec_id") % 10 == 0, block=block, per=per)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = slow(data, lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_and_single(spark):
    df = spark.createDataFrame(rows(random.Random(4)), SCHEMA)
    assert negatives.mined(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mined(df, F.col("vec_id") < 0).collect() == []
    assert negatives.mined(df.where("vec_id = 10"), F.col("vec_id") % 10 == 0).collect() == []


def test_bitmaps_shrink():
    """Few rows of a block are read to the last dimension."""
    r = np.random.default_rng(1)
    own = negatives.Block(np.arange(4096), np.zeros(4096, np.int64), r.integers(-256, 256, (4096, 64)))
    anchor = (256 * r.standard_normal(64) * np.linspace(3, 0, 64)).astype(np.int64)
    seen = []

    def useful(low, high):
        seen.append(len(low))
        return high >= np.partition(low, len(low) - 5)[len(low) - 5] if len(low) > 5 else np.ones(len(low), bool)

    at, score = own.scan(anchor, np.arange(4096), useful)
    exact = own.column.T @ anchor
    assert sorted(score.tolist())[-5:] == sorted(exact.tolist())[-5:] and seen[-1] < 400
    assert negatives.whole(pa.array([[0.5, -0.001], [1.0], []], pa.list_(pa.float32())), 2).tolist() == [[128, -1], [256, 0], [0, 0]]


def test_query(spark, tmp_path):
    r = random.Random(8)
    data = [(i, [r.gauss(0, 1) + 1 for _ in range(8)], r.randrange(10)) for i in range(450)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = slow([(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in data], lambda i: i % 100 == 0)
    assert want and sorted(map(tuple, negatives.query(spark, str(tmp_path)).collect())) == sorted(want)
