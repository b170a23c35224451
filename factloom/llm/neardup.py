"""Near-duplicate detection with BagMinHash signatures over bags of word shingles.

A document is the bag of its shingles of `SHINGLE` words (one shingle of all its words, if it has fewer), a shingle's weight being its count.
Each shingle's weight axis is cut into the intervals [0,1), [1,2), [2,4), [4,8) and so on, a hierarchy in which every
weight up to 2**k needs k + 1 processes. In each interval that the
weight reaches runs a Poisson process over time, seeded by shingle and interval, with a rate equal to the
interval's width; a point counts if its place on the weight axis lies below the weight, and each point belongs to
one position of the signature. The first point of each position is kept. Since low intervals are shared by all weights,
two documents keep the same point with a probability equal to their weighted Jaccard similarity, and processes
are only followed up to the time by which all positions are likely to be filled.

Signatures are cut into bands; documents that agree on a band meet in a bucket. First each bucket's members are compared
with one of them, and the links found are joined into classes, which leaves most buckets with one class. In the
others, members outside the largest class are compared with all members in blocks of bounded size: a task gets the bags
of two blocks, intersects all of them at once as a matrix product, and returns a spanning forest of the links that it
finds. So no pair that could still join two classes is left out, and pairs are never emitted. In the first step,
pairs whose sizes or signatures rule out `SIMILARITY` are dropped before bags are compared; in both, links are
verified on whole bags. Exact copies are represented by one of them from the start.

Hot groups: a bucket's members meet their pivot, and nodes their hub, in merge joins of two written tables, which Spark splits where
they are skewed, and whose plan is the same at every size; counts and minima are combined before they are shuffled.

Defined results: a class is named by its smallest key; texts without words (null ones count as empty) are classes of their own, unless
their text is the same; a row with a null key has no class (null) and links nothing; rows that share a key are one document, whose
text is the one with the smallest digest; an empty table gives an empty result. `classes` returns only key, class_id and copy, a row for each
input row; `one_of_each` keeps all columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: A pair is compared in full if this share of its signatures' bytes agree; at a similarity of 0.8 fewer do so about once in 10**8.
MIN_AGREE = 0.6
CHUNK = 1 << 19
#: Documents, and shingles of them all, in a block.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20


def bags(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all rows: row, hash, weight; and each row's total weight."""
    word, before = words.word_hashes(data, at)
    n = np.diff(before)
    total = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), total)
    first = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    h = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        inside = first + k < before[row + 1]
        h = np.where(inside, (h ^ word[np.minimum(first + k, max(0, len(word) - 1))]) * words.MIX1 + np.uint64(k + 1), h) if len(word) else h
    h = words.mix(h)
    key = h + row.astype(np.uint64) * words.BASE  # tells rows apart
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    return row[at], h[at], count, total


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """BagMinHash signatures (rows x SIZE, 64-bit names of the kept points; rows without shingles have zeros)."""
    out = np.zeros((rows, SIZE), np.uint64)
    total = np.bincount(row, weight, minlength=rows)
    todo, span = np.flatnonzero(total > 0), np.log(SIZE) + 5
    while len(todo):
        pick = np.isin(row, todo) if len(todo) < rows else slice(None)
        got, filled = poisson(row[pick], h[pick], weight[pick], np.where(total > 0, span * SIZE / np.maximum(total, 1), 0), rows)
        done = todo[filled[todo].all(axis=1)]
        out[done] = got[done]
        todo = np.setdiff1d(todo, done)
        span *= 2  # the few rows with empty positions follow their processes for longer
    return out


def poisson(row: np.ndarray, h: np.ndarray, weight: np.ndarray, until: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # intervals that the weight reaches
    unit = np.repeat(np.arange(len(row)), depth)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(depth) - depth, depth)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(float)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(float)
    seed = words.mix(h[unit] + level.astype(np.uint64) * words.BASE)
    of, cap, end = row[unit], weight[unit].astype(float), until[row[unit]]
    t, places, times, names, step = np.zeros(len(unit)), [], [], [], 0
    while len(t):
        step += 1
        u = words.mix(seed + np.uint64(step * int(words.MIX2) % (1 << 64)))
        t = t - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
        on = t <= end
        if not on.all():
            t, seed, of, cap, end, width, low, u = (x[on] for x in (t, seed, of, cap, end, width, low, u))
        v = words.mix(u ^ words.BASE)
        spot = (v >> np.uint64(40)).astype(np.int64) % SIZE
        if (width > 1).any():
            ok = low + np.floor((v & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width) < cap
            places.append((of * SIZE + spot)[ok])
            times.append(t[ok])
            names.append(v[ok])
        else:
            places.append(of * SIZE + spot)
            times.append(t)
            names.append(v)
    place, time, name = map(np.concatenate, (places, times, names))
    least = np.full(rows * SIZE, np.inf)
    np.minimum.at(least, place, time)
    out = np.zeros(rows * SIZE, np.uint64)
    win = time == least[place]
    out[place[win]] = name[win]
    return out.reshape(rows, SIZE), np.isfinite(least).reshape(rows, SIZE)


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of the text, n (total weight), sig (a byte of each position), bands (a bucket number each)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for part in shared.chunks(batches, "text", CHUNK):
            col = part.column("text")
            data, at = words.flat(col)
            raw, n = data.tobytes(), len(at) - 1
            digest = [hashlib.blake2b(raw[at[i] : at[i + 1]], digest_size=16).digest() for i in range(n)]
            row, h, weight, total = bags(data, at)
            sig = signatures(row, h, weight, n)
            b = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                b = words.mix(b + sig.reshape(n, BANDS, ROWS)[:, :, k])
            b = words.mix(b + np.arange(1, BANDS + 1, dtype=np.uint64) * words.BASE)
            ends = np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(b[total > 0].ravel().view(np.int64)))
            low = (sig & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(digest, pa.binary()), pa.array(total, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary()), bands], names=["key", "digest", "n", "sig", "bands"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, digest binary, n long, sig binary, bands array<long>")


def shingle_sets(df: DataFrame) -> DataFrame:
    """node, bag: a 64-bit hash of each shingle and its number among equal ones, so that bags intersect as sets."""
    kind = df.schema["node"].dataType.simpleString()

    def run(batches):
        for part in shared.chunks(batches, "text", CHUNK):
            row, h, weight, _ = bags(*words.flat(part.column("text")))
            owner = np.repeat(row, weight)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(weight) - weight, weight)
            h = words.mix(np.repeat(h, weight) + nth.astype(np.uint64) * words.BASE).view(np.int64)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[order]))], names=["node", "bag"])

    return df.select("node", "text").mapInArrow(run, f"node {kind}, bag array<long>")


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow SIMILARITY and whose signatures agree enough."""
    one = lambda x: sigs.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")).hint("merge")
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for part in batches:
            if part.num_rows:
                x, y = (np.frombuffer(b"".join(part.column(f"sig_{s}").to_pylist()), np.uint8).reshape(-1, SIZE) for s in "ab")
                yield part.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= MIN_AGREE))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def shared_shingles(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, i (shingles in both bags), t (of both together)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")).hint("merge"), "b")
    return both.select("a", "b", F.size(F.array_intersect("bag_a", "bag_b")).alias("i"), (F.size("bag_a") + F.size("bag_b")).alias("t"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose bags have a weighted Jaccard similarity of SIMILARITY or more."""
    return shared_shingles(pairs, sets).where(F.col("i") >= F.lit(SIMILARITY) * (F.col("t") - F.col("i"))).select("a", "b")


def components(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, label: the smallest node that it is linked with, directly or not. labels: of links found before. A round's tables are
    removed once the next one is written."""
    spark, old, new_, kept = links.sparkSession, [], [], []
    edges = links if labels is None else links.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b")))
    edges = shared.written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges", kept)
    label = shared.written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels", old)
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = label.join(near.hint("merge"), "node").select("node", "label", F.least("label", "near").alias("low"))
        # and on to what the label itself is labelled with
        new = new.join(label.select(F.col("node").alias("low"), F.col("label").alias("lower")).hint("merge"), "low").select("node", F.least("low", "lower").alias("new"), "label")
        new = shared.written(new, "labels", new_)
        shared.drop(spark, old)
        old, new_ = new_, []
        label = new.select("node", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            shared.drop(spark, kept)
            return label


def forest(nodes: list, bags: list[np.ndarray]) -> list[tuple]:
    """Links (a, b) that join what verified similarities join, among the documents of two blocks."""
    size = np.array([len(x) for x in bags], np.float32)
    shingle, column = np.unique(np.concatenate(bags), return_inverse=True)
    row = np.repeat(np.arange(len(bags)), size.astype(np.int64))
    often = np.bincount(column, minlength=len(shingle)) > 1
    new = np.cumsum(often) - 1
    row, column = row[often[column]], new[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(bags), len(bags)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        at = slice(*np.searchsorted(column, [lo, lo + 4096]))
        has = np.zeros((len(bags), 4096), np.float32)
        has[row[at], column[at] - lo] = 1
        both += has @ has.T
    linked = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-4
    left, out = np.ones(len(bags), bool), []
    for i in range(len(bags)):
        if not left[i]:
            continue
        left[i], edge = False, [i]
        while edge:
            k = edge.pop()
            found = np.flatnonzero(linked[k] & left)
            left[found] = False
            edge += found.tolist()
            out += [(nodes[k], nodes[j]) for j in found]
    return out


def block_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among members (bucket, node, label, n) of buckets with several classes."""
    kind = open_.schema["node"].dataType.simpleString()
    per_class = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"))
    per_bucket = per_class.groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("size").alias("most"))
    once = per_bucket.groupBy("size", "h").agg(F.min("bucket").alias("bucket")).select("bucket")  # many bands have the same members
    b = per_bucket.join(once, "bucket", "left_semi")
    fit = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")  # blocks for all members
    b = b.select("bucket", "main", fit.alias("fit"), F.ceil(fit * (F.col("size") - F.col("most")) / F.col("size")).cast("int").alias("few"))
    rows = open_.join(b.hint("merge"), "bucket").withColumn("out", F.col("label") != F.col("main"))
    # blocks 0 .. few-1 hold members outside the main class, the next `fit` ones those inside it
    own = F.when(F.col("out"), F.pmod(F.xxhash64("node"), F.col("few").cast("long"))).otherwise(F.col("few") + F.pmod(F.xxhash64("node"), F.col("fit").cast("long"))).cast("int")
    rows = rows.withColumn("own", own)
    meets = F.when(F.col("out"), F.sequence(F.lit(0), F.col("few") + F.col("fit") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    rows = rows.withColumn("other", F.explode(meets)).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    rows = rows.join(sets.hint("merge"), "node")

    def links(table: pa.Table) -> pa.Table:
        bag = table.column("bag").combine_chunks()
        values, ends = bag.flatten().to_numpy(), np.concatenate([[0], np.cumsum(bag.value_lengths().to_numpy())])
        found = forest(table.column("node").to_pylist(), [values[x:y] for x, y in zip(ends, ends[1:], strict=False)])
        return pa.table({"a": pa.array([x for x, _ in found], table.schema.field("node").type), "b": pa.array([y for _, y in found], table.schema.field("node").type)})

    return rows.groupBy("bucket", "i", "j").applyInArrow(links, f"a {kind}, b {kind}")


def repeats_keys(df: DataFrame, key: str) -> bool:
    (k,) = shared.columns([key])
    return not df.where(k.isNotNull()).groupBy(k).count().where("count > 1").isEmpty()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", measured: bool = False) -> DataFrame:
    """key and class_id of each row, with copy (the text equals that of another row with a smaller key); if measured, also similarity: the weighted Jaccard
    similarity with the text that names the class, which is below SIMILARITY where only a chain of links leads there."""
    spark, gone = df.sparkSession, []
    k, t = shared.columns([key, text])
    rows = df.where(k.isNotNull()).select(k.alias("key"), t.alias("text"))
    if repeats_keys(df, key):
        rows = shared.written(rows.groupBy("key").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text")), "texts")
    sigs = shared.written(signed(rows, "key", "text"), "signatures", gone)
    twice = shared.written(sigs.groupBy("digest").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "node"), "copies", gone)
    both = sigs.join(twice.hint("merge"), "digest", "left").withColumn("node", F.coalesce("node", "key"))
    members = shared.written(both.select("key", "node"), "members")
    own = shared.written(both.where("key = node").select("key", "n", "sig", "bands"), "nodes")
    shared.drop(spark, gone)
    bands = own.select(F.col("key").alias("node"), "n", F.explode("bands").alias("bucket"))
    pivots = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1").select("bucket", "pivot")
    buckets = shared.written(bands.join(shared.written(pivots, "pivots", gone).hint("merge"), "bucket"), "buckets")
    shared.drop(spark, gone)
    label = None
    if not buckets.isEmpty():
        pairs = buckets.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        pairs = shared.written(agreeing(shared.written(pairs, "met", gone), own.select("key", "n", "sig")), "pairs", gone)
        texts = rows.withColumnRenamed("key", "node").join(buckets.select("node").distinct().hint("merge"), "node")
        sets = shared.written(shingle_sets(texts), "bags")
        label = components(verified(pairs, sets), None)
        shared.drop(spark, gone)
        labelled = buckets.select("bucket", "node", "n").join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        labelled = shared.written(labelled, "labelled", gone)
        several = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
        open_ = shared.written(labelled.join(shared.written(several, "several", gone).hint("merge"), "bucket", "left_semi"), "open")
        shared.drop(spark, gone)
        if not open_.isEmpty():
            label = components(shared.written(block_links(open_, sets), "links"), label)
    out = members if label is None else members.join(label.hint("merge"), "node", "left")
    extra = []
    if measured:
        extra = [F.lit(1.0).alias("similarity")]
        if label is not None:
            like = shared_shingles(label.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")), sets)
            like = shared.written(like.select(F.col("b").alias("node"), (F.col("i") / (F.col("t") - F.col("i"))).alias("like")), "alike")
            out, extra = out.join(like.hint("merge"), "node", "left"), [F.coalesce("like", F.lit(1.0)).alias("similarity")]
    out = out.select("key", (F.col("node") if label is None else F.coalesce("label", "node")).alias("class_id"), (F.col("key") != F.col("node")).alias("copy"), *extra)
    if repeats_keys(df, key) or not df.where(k.isNull()).isEmpty():
        out = df.select(k.alias("key")).join(out, "key", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    return out.withColumnRenamed("key", key)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each class: the one that names it. Rows without a key stay; of rows that share a key, the one with the
    smallest digest of its text, then of all its columns, stays."""
    (k,), name = shared.columns([key]), shared.fresh(df, "__class")
    named = classes(df, key, text)
    names = named.where(F.col(f"`{key}`") == F.col("class_id")).select(F.col(f"`{key}`").alias(name)).distinct()
    out = df.join(names, k == F.col(name), "left_semi")
    if repeats_keys(df, key):
        nth = shared.fresh(df, "__nth")
        order = Window.partitionBy(k).orderBy(F.sha2(F.coalesce(*shared.columns([text]), F.lit("")), 256), F.sha2(F.to_json(F.struct(*shared.columns(df.columns))), 256))
        out = out.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return out.unionByName(df.where(k.isNull())).select(*shared.columns(df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(shared.documents(spark, sf_dir).select("doc_id", "text"), measured=True)
    return out.select("doc_id", "class_id", "copy", (F.col("doc_id") == F.col("class_id")).alias("kept"), F.round("similarity", 6).alias("similarity"))


#: All pairs that share a shingle, compared in full, and what they join.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), shingle AS (
  SELECT doc_id, unnest(list_transform(range(greatest(len(ws) - {SHINGLE - 1}, least(len(ws), 1))), lambda i: array_to_string(ws[i + 1:i + {SHINGLE}], ' '))) AS s FROM d
), bag AS (
  SELECT doc_id, s, count(*) AS c FROM shingle GROUP BY doc_id, s
), total AS (
  SELECT doc_id, sum(c) AS n FROM bag GROUP BY doc_id
), alike AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS i FROM bag a JOIN bag b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM alike JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE i >= {SIMILARITY}::DOUBLE * (x.n + y.n - i)
  UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM d
), arc AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, arc.b FROM reach r JOIN arc ON arc.a = r.b
), class AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
), first AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS node FROM d
)
SELECT doc_id, class_id, doc_id <> node AS copy, doc_id = class_id AS kept, round(CASE WHEN node = class_id THEN 1 ELSE coalesce(i / (x.n + y.n - i), 0) END, 6)::DOUBLE AS similarity
FROM first JOIN class USING (doc_id) LEFT JOIN total x USING (doc_id) LEFT JOIN total y ON y.doc_id = class_id LEFT JOIN alike ON a = class_id AND b = node
"""
