"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has 64 bits: bit i is 1 if it is set in over half the hashes of its word shingles, repeats included. Fingerprints that
differ in `RADIUS` bits or fewer are linked. Rows with the same fingerprint are one node from the start.

Nodes are compared in tiles: a tile's fingerprints against another's by exclusive-or and bit counts, in numpy. Two fingerprints differ in at
least as many bits as their population counts do, so tiles hold fingerprints of neighbouring population counts and pairs of tiles that are further apart
than the radius are never made; inside a pair of tiles the same is done with strips of `STRIP` fingerprints.

All fingerprints against all would be a square of the corpus at every size. So tiles are filled by pieces: the bits are cut into RADIUS + 1 pieces,
of which linked fingerprints share one at least, and only those that share a piece meet (each row is sent RADIUS + 1 times). A pair is
counted in the first piece that it shares. That is exact, and takes about 1/1600 of the comparisons.
A piece's value that more than `TILE` fingerprints share (a hot one) is cut into tiles by population count, and a count that fills more than one tile
by hash; its rows go to those tiles that they can be linked with. Values with fewer rows are packed together, so that a task's group has about `GROUP` rows.

No pair leaves its task: a pair of tiles returns a forest of its links, and how many rows each fingerprint is linked with there. Forests are
joined into components by rounds of minimum labels over written tables.

Defined results: letters A-Z are lower-cased, words are runs of other than blanks; a text of fewer words than a shingle is one shingle, a text
without words (null ones too) has fingerprint zero, which is linked like any other; rows that repeat, or share a key, are rows of their own; a component
is named by its smallest key, null keys aside (null if it has no other); an empty table gives an empty result. `linked` returns the key, fingerprint,
component_id and n_links (other rows within the radius, by whatever text). A text is one row and takes some 60 bytes of arrays for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, words
from .neardup import components

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 4096
STRIP = 512
GROUP = 1 << 16
SLICE = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text (uint64)."""
    data, at = words.flat(texts)
    raw = data.tobytes().translate(LOWER)
    lines = [b" ".join(raw[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    ends = np.cumsum([0, *(len(x) for x in lines)])
    flat = b"".join(lines)
    start, end, before = words.bounds(np.frombuffer(flat, np.uint8), ends)
    n = np.diff(before)
    total = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), total)
    first = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    last = np.minimum(first + shingle, before[row + 1]) - 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    ones = np.zeros((len(n), 64), np.int64)
    for lo in range(0, len(h), SLICE):
        part, of = h[lo : lo + SLICE], row[lo : lo + SLICE]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel() if len(n) else np.zeros(0, np.uint64)


def printed(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """key, fp (the fingerprint's bits as a long)."""
    k, t = shared.columns([key, text])

    def run(batches):
        for part in shared.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fingerprints(part.column("text"), shingle).view(np.int64))], names=["key", "fp"])

    return df.select(k.alias("key"), t.alias("text")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, fp long")


def pieces(radius: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each piece; all 64 in radius + 1 pieces."""
    cut = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def dealt(nodes: DataFrame, radius: int, tile: int, group: int) -> DataFrame:
    """Rows (fp, n) sent to the groups in which they are compared: grp, i, j (a pair of tiles), piece, bucket, and right (whether a row is of tile j only)."""
    values = [F.struct(F.lit(p).alias("piece"), F.shiftrightunsigned("fp", a).bitwiseAND((1 << width) - 1 if width < 64 else -1).alias("value")) for p, (a, width) in enumerate(pieces(radius))]
    bands = nodes.withColumn("v", F.explode(F.array(*values))).select("fp", "n", "pop", "v.piece", (F.col("v.value") * (radius + 1) + F.col("v.piece")).alias("bucket"))
    # a row for each bucket and population count: at most 65 for each of the buckets
    counts = bands.groupBy("bucket", "pop").agg(F.count(F.lit(1)).alias("c"))
    by_pop = Window.partitionBy("bucket").orderBy("pop")
    counts = counts.withColumn("size", F.sum("c").over(Window.partitionBy("bucket"))).where("size > 1")
    counts = counts.withColumn("before", F.sum("c").over(by_pop) - F.col("c"))
    counts = counts.withColumn("first", F.floor(F.col("before") / tile)).withColumn("last", F.floor((F.col("before") + F.col("c") - 1) / tile))
    near = by_pop.rangeBetween(-radius, radius)
    spots = counts.select("bucket", "pop", "size", "first", "last", F.min("first").over(near).alias("lo"), F.max("last").over(near).alias("hi"))
    spots = shared.written(spots, "spots")
    groups = max(1, -(-nodes.count() * (radius + 1) // group))
    rows = bands.join(spots.hint("merge"), ["bucket", "pop"])
    own = F.col("first") + F.pmod(F.xxhash64("fp"), F.col("last") - F.col("first") + 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence("lo", "hi")))
    packed = F.col("size") <= tile
    grp = F.when(packed, -1 - F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket"))
    return rows.select(grp.alias("grp"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "piece", "bucket", "fp", "n", (F.col("own") > F.col("other")).alias("right"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked with, directly or not, by links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare(x: np.ndarray, y: np.ndarray | None, n_x: np.ndarray, n_y: np.ndarray | None, earlier: list[int], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compares tile x with tile y, or with itself if y is None. earlier: masks of the pieces before the one that brought them together.
    Returns links as indexes into x followed by y, a forest of them, and for each of x and of y the rows that it is linked with."""
    alone = y is None
    orders = [np.argsort(np.bitwise_count(t), kind="stable") for t in ([x] if alone else [x, y])]
    ox, oy = orders[0], orders[-1]
    sx, sy = x[ox], (x if alone else y)[oy]
    wx, wy = n_x[ox], (n_x if alone else n_y)[oy]
    px, py = np.bitwise_count(sx).astype(np.int64), np.bitwise_count(sy).astype(np.int64)
    got_x, got_y = np.zeros(len(sx), np.int64), np.zeros(len(sy), np.int64)
    left, right, shift = [], [], 0 if alone else len(sx)
    for lo in range(0, len(sx), STRIP):
        hi = min(lo + STRIP, len(sx))
        to = np.searchsorted(py, px[hi - 1] + radius, side="right")
        for at in range(lo if alone else int(np.searchsorted(py, px[lo] - radius, side="left")), int(to), STRIP):
            end = min(at + STRIP, int(to))
            differ = sx[lo:hi, None] ^ sy[None, at:end]
            i, j = np.nonzero(np.bitwise_count(differ) <= radius)
            if alone and at < hi:
                i, j = i[ok := i + lo < j + at], j[ok]
            if not len(i):
                continue
            bits, first = differ[i, j], np.ones(len(i), bool)
            for mask in earlier:
                first &= (bits & np.uint64(mask)) != 0
            i, j = i[first] + lo, j[first] + at
            if not len(i):
                continue
            got_x += np.bincount(i, wy[j], len(sx)).astype(np.int64)
            got_y += np.bincount(j, wx[i], len(sy)).astype(np.int64)
            label = forest(len(sx) + (0 if alone else len(sy)), i, j + shift)
            moved = np.flatnonzero(label != np.arange(len(label)))
            left.append(moved)
            right.append(label[moved])
    back_x, back_y = np.zeros(len(sx), np.int64), np.zeros(len(sy), np.int64)
    back_x[ox] = got_x
    back_y[oy] = got_y
    if alone:
        back_x[oy] += got_y
    a, b = (np.concatenate(t) if t else np.zeros(0, np.int64) for t in (left, right))
    label = forest(len(sx) + (0 if alone else len(sy)), a, b)
    moved = np.flatnonzero(label != np.arange(len(label)))
    place = ox if alone else np.concatenate([ox, oy + len(sx)])
    return place[moved], place[label[moved]], back_x, back_y


def compared(rows: DataFrame, radius: int) -> DataFrame:
    """fp, other: links that join what is linked; fp, rows: how many rows fp is linked with (a part of them each)."""
    masks = [((1 << width) - 1) << a for a, width in pieces(radius)]

    def run(table: pa.Table) -> pa.Table:
        fp, n, bucket, piece = (table.column(c).to_numpy() for c in ("fp", "n", "bucket", "piece"))
        fp, right = fp.view(np.uint64), table.column("right").to_numpy()
        two = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        a, b, owner, count = [], [], [], []
        for at in np.split(order, cuts):
            earlier = masks[: int(piece[at[0]])]
            if two:
                one, other = at[~right[at]], at[right[at]]
                u, v, n_one, n_other = compare(fp[one], fp[other], n[one], n[other], earlier, radius)
                at, got = np.concatenate([one, other]), np.concatenate([n_one, n_other])
            else:
                u, v, got, _ = compare(fp[at], None, n[at], None, earlier, radius)
            a.append(fp[at[u]])
            b.append(fp[at[v]])
            owner.append(fp[at[got > 0]])
            count.append(got[got > 0])
        a, b, owner, count = map(np.concatenate, (a, b, owner, count))
        owner, of = np.unique(owner, return_inverse=True)
        count = np.bincount(of, count, len(owner)).astype(np.int64)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({
            "fp": np.concatenate([a, owner]).view(np.int64), "other": pa.concat_arrays([pa.array(b.view(np.int64)), none(len(owner))]),
            "rows": pa.concat_arrays([none(len(a)), pa.array(count)]),
        })

    return rows.groupBy("grp", "i", "j").applyInArrow(run, "fp long, other long, rows long")


def joined(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """key, fp, component_id and n_links of each row (key, fp) of a written table."""
    spark, gone = prints.sparkSession, []
    nodes = prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("pop", F.bit_count("fp").cast("int"))
    nodes = shared.written(nodes, "nodes")
    found = shared.written(compared(dealt(nodes, radius, tile, group), radius), "found", gone)
    links = found.where("other IS NOT NULL").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    counted = found.where("rows IS NOT NULL").groupBy("fp").agg(F.sum("rows").alias("rows"))
    out = nodes.join(counted.hint("merge"), "fp", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("rows", F.lit(0)))
    if links.isEmpty():
        out = out.withColumn("root", F.col("fp"))
    else:
        label = components(links, None).select(F.col("node").alias("fp"), "label")
        out = out.join(label.hint("merge"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    out = shared.written(out.select("fp", "root", "least", "n_links"), "rooted")
    shared.drop(spark, gone)
    named = shared.written(out.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    out = shared.written(out.join(named.hint("merge"), "root").select("fp", "component_id", "n_links"), "components")
    return prints.join(out.hint("merge"), "fp")


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row for each row of df: key, fingerprint (16 hexadecimal digits), component_id, n_links."""
    out = joined(shared.written(printed(df, key, text, shingle), "prints"), radius)
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(shared.documents(spark, sf_dir).select("doc_id", "text"))
