"""Hard-negative mining by a vertical scan with shrinking bitmaps (branch and bound on decomposed data).

An anchor's positives are the rows of its label with the highest inner products; its hard negatives are rows of other labels whose scores lie
in a window below a positive's. Both are searched block by block: a block holds its rows as columns, one for each dimension, with the least and greatest
value of each. An anchor reads the columns in the order of its own magnitudes, the largest first, `STEP` at a time. What the
dimensions not yet read can still add to a row lies between two sums known beforehand (each dimension's least and greatest contribution), so every
row has a lower and an upper bound of its score, and rows leave the candidates' bitmap

* in the search for positives, when their upper bound is below the k-th highest lower bound;
* in the search for negatives, when for each window either they can't reach it, or must lie above it, or k rows certain to lie in it are better.

Once `FEW` rows are left, their remaining dimensions are read at once. All scores that decide are exact integers.

The query set (a stated share of the rows) is searched against all rows, in blocks: rows are dealt into blocks of about `BLOCK` by a hash of their row number, anchors
into blocks of about `ANCHORS`, each block of anchors is sent to each block of rows, and a task gets one pair of them. A pair returns k rows for each
anchor (or window) at most; the best of all blocks are a ranked window over these, which Spark limits before it shuffles. Nothing goes through the driver but two counts.
Work and rows sent grow with anchors times rows, as in any exact search of a share of the rows.

Defined results: rows with a null key, label or vector, or a null, NaN or infinite component, take no part; shorter vectors count as if they ended in zeros;
components are scaled, rounded down, and held within +-floor(sqrt(2**62 / dimensions)), so that no score overflows; equal scores are ordered by key; rows that
share a key are rows of their own, but none is a positive or negative of an anchor of that key; an anchor without positives, or a positive without negatives,
gives no row; an empty table gives an empty result. Further columns are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256
BLOCK = 4096
ANCHORS = 1024
STEP = 4
FEW = 64


def whole(vectors: pa.ListArray, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * component) of each vector (rows x dims, 64-bit whole numbers), zeros behind the end of shorter ones."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = vectors.value_lengths().to_numpy().astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = int(np.floor(np.sqrt(2.0**62 / max(dims, 1))))
    flat = np.clip(np.floor(scale * flat), -most, most).astype(np.int64)
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Block:
    """Rows as columns, with bounds of each dimension."""

    def __init__(self, key: np.ndarray, label: np.ndarray, rows: np.ndarray):
        self.key, self.label = key, label
        self.column = np.ascontiguousarray(rows.T)
        self.least, self.most = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (rows.sum(axis=0), rows.sum(axis=0))

    def scan(self, anchor: np.ndarray, at: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates `at`, those that useful(least scores, greatest scores) keeps to the end, and their exact scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.least, anchor * self.most])[:, order]
        least, most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(axis=0), ends.max(axis=0)))
        score, read = np.zeros(len(at), np.int64), 0
        while read < len(order) and len(at):
            step = order[read:] if len(at) <= FEW else order[read : read + STEP]
            for d in step.tolist():
                if anchor[d]:
                    score += anchor[d] * (self.column[d] if len(at) == len(self.key) else self.column[d][at])
            read += len(step)
            left = useful(score + least[read], score + most[read])
            if not left.all():
                at, score = at[left], score[left]
        return at, score


def ranked(score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, equal ones by key."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((key[at], -score[at]))[:k]]
    return np.lexsort((key, -score))


def best(block: Block, anchor: np.ndarray, key: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and scores of the block's k best rows of the anchor's label."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

    at, score = block.scan(anchor, np.flatnonzero((block.label == label) & (block.key != key)), useful)
    top = ranked(score, block.key[at], k)
    return block.key[at[top]], score[top]


def between(block: Block, anchor: np.ndarray, key: int, label: int, windows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least and greatest score) keys and scores of the block's k best rows of other labels inside it."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), bool)
        for a, b in windows:
            inside = low[(low >= a) & (high <= b)]
            floor = max(a, np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) > k else a
            keep |= (high >= floor) & (low <= b)
        return keep

    at, score = block.scan(anchor, np.flatnonzero((block.label != label) & (block.key != key)), useful)
    out = []
    for a, b in windows:
        inside = np.flatnonzero((score >= a) & (score <= b))
        top = inside[ranked(score[inside], block.key[at[inside]], k)]
        out.append((block.key[at[top]], score[top]))
    return out


def taking_part(df: DataFrame, anchor: Column, key: str, label: str, vector: str) -> DataFrame:
    """row (a number), key, label, vector and anchor (whether the condition holds) of the rows that take part, written."""
    k, y, v = shared.columns([key, label, vector])
    v = v if df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>") else v.cast("array<double>")
    rows = df.select(k.cast("long").alias("key"), y.cast("long").alias("label"), v.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return shared.written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def met(anchors: DataFrame, rows: DataFrame, f, schema: str, n_anchors: int, n_rows: int) -> DataFrame:
    """f(anchors, rows), two Arrow tables, for each pair of a block of anchors and a block of rows."""
    of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("i", of(n_anchors)).withColumn("j", every(n_rows))
    right = rows.select("row", "key", "label", "vector").withColumn("j", of(n_rows)).withColumn("i", every(n_anchors))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(f, schema)


def first(df: DataFrame, by: list[str], score: str, key: str, k: int, name: str) -> DataFrame:
    """The k rows of each group with the highest scores, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number x with low * score <= 100 * x <= high * score."""
    return max(-((-low * score) // 100), -(1 << 63)), min(high * score // 100, (1 << 63) - 1)


def mined(
    df: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK, per: int = ANCHORS,
) -> DataFrame:
    """A row for each anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a
    condition on df's columns; keys and labels are whole numbers; low, high: a negative's score in per cent of its positive's."""
    rows = taking_part(df, anchor, key, label, vector)
    n, chosen, dims = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vector"))).first()
    blocks = (max(1, -(-chosen // per)), max(1, -(-n // block)))
    anchors = rows.where("anchor").select("row", "key", "label", "vector")

    def sides(left: pa.Table, right: pa.Table):
        """The block of rows, and each anchor with its key, label and place in `left`."""
        if not left.num_rows or not right.num_rows:
            return
        own = Block(right.column("key").to_numpy(), right.column("label").to_numpy(), whole(right.column("vector"), dims, scale))
        for at, (vec, k, y) in enumerate(zip(whole(left.column("vector"), dims, scale), left.column("key").to_pylist(), left.column("label").to_pylist(), strict=True)):
            yield at, own, vec, k, y

    def search_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        row, keys, scores = left.column("row").to_numpy(), [], []
        of = []
        for at, own, vec, k, y in sides(left, right):
            got, score = best(own, vec, k, y, positives)
            keys.append(got)
            scores.append(score)
            of.append(np.full(len(got), row[at]))
        cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return pa.table({"row": cat(of), "positive_id": cat(keys), "positive_score": cat(scores)})

    found = met(anchors, rows, search_positives, "row long, positive_id long, positive_score long", *blocks)
    found = first(found, ["row"], "positive_score", "positive_id", positives, "nth")
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("found"))  # `positives` at most
    anchors = shared.written(anchors.join(found, "row"), "anchors")

    def search_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        row, found = left.column("row").to_numpy(), left.column("found").to_pylist()
        out = [[] for _ in range(7)]
        for at, own, vec, k, y in sides(left, right):
            spans = [window(p["positive_score"], low, high) for p in found[at]]
            open_ = [i for i, (a, b) in enumerate(spans) if a <= b]
            for i, (got, score) in zip(open_, between(own, vec, k, y, np.array([spans[i] for i in open_], np.int64).reshape(-1, 2), negatives) if open_ else [], strict=True):
                p = found[at][i]
                for col, x in zip(out, (row[at], p["nth"], k, p["positive_id"], p["positive_score"]), strict=False):
                    col += [x] * len(got)
                out[5] += got.tolist()
                out[6] += score.tolist()
        names = ["row", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table({c: pa.array(x, pa.int32() if c == "nth" else pa.int64()) for c, x in zip(names, out, strict=True)})

    out = met(anchors, rows, search_negatives, "row long, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", *blocks)
    out = first(out, ["row", "nth"], "negative_score", "negative_id", negatives, "rank")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


#: Every anchor's score with every row.
ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM pair WHERE alike) WHERE nth <= {POSITIVES}
), negative AS (
  SELECT anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN pair n USING (anchor_id) WHERE NOT n.alike AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= {NEGATIVES}
"""
