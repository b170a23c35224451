"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

Every string of `LENGTH` bytes that starts earlier elsewhere (in a document with a smaller key, or earlier in the
same one) makes the bytes it covers repeated. Suffix arrays are built where strings can be equal at all:

1. Each string chooses an anchor, its first gram of GRAMS[0] bytes with the smallest hash. Equal strings choose equal grams at
   equal offsets. The strings that chose one anchor form a context: the bytes from the first of them to the end
   of the last. Contexts are named by a hash of their bytes (with the anchor's own, 128 bits): in every task those of one name are
   combined before the shuffle, then all are dealt by their anchor's hash. A later place of a context named before is repeated
   in all its bytes, as one copy stands for all in what follows.
2. Where different contexts share an anchor, each is fetched once, cut into blocks that are aligned to the anchor, and the
   blocks of a batch of contexts form one sequence, whose suffixes are sorted by grouping: groups of suffixes with the same
   Lyndon prefix are processed in descending order, each splitting the groups of its previous smaller suffixes
   by how often they are followed by it; a last scan emits the order inside the groups. Nothing is renamed or sorted again.
3. Neighbouring suffixes that agree on as many blocks as any string of LENGTH bytes holds are candidates; their strings are compared byte by byte,
   and all but the earliest of equal ones are repeated.

A short line that very many documents have in different surroundings makes a hot anchor. In a task with over `HOT` contexts of it they are
dealt one by one and a marker tells the anchor's partition; those contexts, and anchors with over `MANY` in all, choose new
anchors inside their strings from longer grams (the next of GRAMS) and go through the three steps again, where surroundings
tell them apart. Grams of LENGTH bytes are whole strings, so nothing is left after them, and no task sorts more than MANY contexts of an anchor.

Defined results: null or short texts have nothing removed; a row with a null key keeps all bytes and isn't searched; rows
that repeat a key and text all count as that document; different texts under one key are documents in the order of their digests;
keys may be of any type that sorts; an empty table gives an empty result; extra columns are kept by `cut`, except those named as its outputs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

LENGTH = 100
GRAMS = (32, 64, 96, LENGTH)
BLOCK = 10
#: Full blocks in any string of LENGTH bytes, wherever the block grid lies.
RUN = (LENGTH - BLOCK + 1) // BLOCK
MANY, HOT = 2_000, 16
#: Anchors that a task combines at once, and bytes of contexts whose suffixes are sorted at once.
COMBINE = 400_000
SORT_BYTES = 1 << 20
CHUNK = 1 << 20
OTHER_BASE = np.uint64(0xD1342543DE82EF95)


def sort_suffixes(s: list[int]) -> list[int]:
    """Suffix array of s, whose last symbol must be smaller than all others, by grouping in linear time."""
    n = len(s)
    order = np.argsort(np.array(s), kind="stable")
    sa, at = order.tolist(), [0] * n
    group, size = [0] * n, [0] * (n + 1)
    last = start = -1
    for k, i in enumerate(sa):
        at[i] = k
        if s[i] != last:
            last, start = s[i], k
        group[i] = start
        size[start] += 1
    prev = list(range(-1, n - 1))
    end = n
    while end:
        g = group[sa[end - 1]]
        follows: dict[int, int] = {}
        for i in sa[g:end]:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                follows[p] = follows.get(p, 0) + 1
        if len(follows) == 1:
            rounds = [list(follows)]
        else:
            by: dict[int, list[int]] = {}
            for p, k in follows.items():
                by.setdefault(k, []).append(p)
            rounds = [by[k] for k in sorted(by, reverse=True)]
        for moved in rounds:  # those followed most often go to the end of their group, as a group of their own
            for p in moved:
                old = group[p]
                size[old] -= 1
                to, here = old + size[old], at[p]
                if to != here:
                    other = sa[to]
                    sa[to], sa[here], at[p], at[other] = p, other, to, here
            new = [group[p] + size[group[p]] for p in moved]
            for k in new:
                size[k] = 0
            for p, k in zip(moved, new, strict=True):
                group[p] = k
                size[k] += 1
        end = g
    out, free, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = prev[i]
    return out


def sliding(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    step = 1
    while step * 2 <= width:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    return np.minimum(a[: len(a) - (width - step)], a[width - step :]) if width > step else a


def other_prefix(data: np.ndarray) -> np.ndarray:
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * words.powers(OTHER_BASE, len(data)), out=h[1:])
    return h


OTHER_INVERSE = np.uint64(pow(int(OTHER_BASE), -1, 1 << 64))


def contexts(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of all rows: row, start, length, place of the anchor (a gram of `width` bytes) in it, the anchor's hash and the context's."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    n = len(data)
    if n < LENGTH:
        return none
    h = words.prefix(data)
    inverse = words.powers(words.INVERSE, n + 1)
    gram = words.mix((h[width:] - h[:-width]) * inverse[: n - width + 1])
    least = sliding((gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64), LENGTH - width + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(row[: n - LENGTH + 1] == row[LENGTH - 1 :])  # strings that lie in one row
    if not len(start):
        return none
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(start)]]) - 1
    lo, end, anchor = start[first], start[last] + LENGTH, anchor[first]
    h2 = other_prefix(data)
    one = words.span_hash(h, lo, end)
    two = (h2[end] - h2[lo]) * words.powers(OTHER_INVERSE, n + 1)[lo]
    whole = words.mix(one ^ (two >> np.uint64(7)) * words.MIX1 ^ (anchor - lo).astype(np.uint64))
    r = row[lo]
    return r, lo - at[r], end - lo, anchor - lo, gram[anchor], whole


def merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, sorted, with overlapping and touching ones joined."""
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    if not len(doc):
        return doc, lo, end
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    rank = np.cumsum(new_doc) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * wide) - rank * wide  # the furthest end so far in the document
    new = np.concatenate([[True], new_doc[1:] | (lo[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.concatenate([first[1:], [len(doc)]]) - 1]


ANCHORS = "deal long, akey long, ckey long, doc long, lo int, len int, rel int, hot boolean"
FOUND = "akey long, doc long, lo int, len int, rel int, repeated boolean, hot boolean"
#: Values of rel: an interval that is repeated as a whole; a marker of an anchor whose contexts some task has dealt one by one.
WHOLE, MARK = -1, -2
LOWEST = np.iinfo(np.int64).min  # sorts a marker before its anchor's contexts


def record(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=[c.split()[0] for c in schema.split(", ")])


def anchors(df: DataFrame, width: int) -> DataFrame:
    """A row for each context of df (akey, doc, lo, text: bytes that begin at `lo` and share the anchor akey, if not 0), intervals whose
    contexts an earlier row of the task has too, and markers."""

    def emit(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, lo, size, rel, akey, ckey = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((lo, doc, ckey, akey))
        doc, lo, size, rel, akey, ckey = (x[order] for x in (doc, lo, size, rel, akey, ckey))
        new_a = np.concatenate([[True], akey[1:] != akey[:-1]])
        new = new_a | np.concatenate([[True], ckey[1:] != ckey[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (doc != doc[first]) | (lo != lo[first])
        d, a, b = merged(doc[again], lo[again], lo[again] + size[again])
        group = (np.cumsum(new_a) - 1)[new]
        hot = np.bincount(group)[group] > HOT
        a_of, c_of = akey[new], ckey[new]
        mark = np.unique(a_of[hot])
        deal = np.where(hot, words.mix(a_of ^ words.mix(c_of)), a_of)
        fill, m = np.zeros(len(d), np.int64), len(mark)
        one = lambda *parts: np.concatenate([x.view(np.int64) if x.dtype == np.uint64 else x for x in parts])
        low = np.full(m, LOWEST)
        cols = [one(deal, words.mix(d.astype(np.uint64)), mark), one(a_of, fill, mark), one(c_of, fill, low), one(doc[new], d, low)]
        cols += [one(x, y, np.zeros(m, np.int64)).astype(np.int32) for x, y in ((lo[new], a), (size[new], b - a))]
        cols += [one(rel[new], fill + WHOLE, np.full(m, MARK)).astype(np.int32), np.concatenate([hot, np.zeros(len(d) + m, bool)])]
        return record(cols, ANCHORS)

    def run(batches):
        held, n = [], 0
        for part in shared.chunks(batches, limit=CHUNK):
            row, lo, size, rel, akey, ckey = contexts(*words.flat(part.column("text")), width)
            doc, base, above = (part.column(c).to_numpy()[row] for c in ("doc", "lo", "akey"))
            akey = np.where(above == 0, akey, words.mix(akey ^ above.view(np.uint64)))
            held.append((doc, lo + base, size, rel, akey, ckey))
            n += len(row)
            if n >= COMBINE:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return df.mapInArrow(run, ANCHORS)


def grouped(dealt: DataFrame) -> DataFrame:
    """From rows sorted by anchor, context and place: repeated intervals, and one copy of each context of anchors that
    have several here or are marked. Only the first row of the anchor at hand is held."""

    def run(batches):
        akey0 = ckey0 = doc0 = lo0 = held = None  # of the row before; doc0, lo0: its context's first place; held: the anchor's only context so far
        count0, hot0 = 0, False  # of the anchor at hand: contexts, and whether it is hot
        for part in batches:
            n = part.num_rows
            if not n:
                continue
            akey, ckey, doc, lo, size, rel = (part.column(c).to_numpy() for c in ("akey", "ckey", "doc", "lo", "len", "rel"))
            whole, mark, hot = rel == WHOLE, rel == MARK, part.column("hot").to_numpy(zero_copy_only=False)
            new_a = np.concatenate([[akey[0] != akey0], akey[1:] != akey[:-1]])
            new_c = new_a | np.concatenate([[ckey[0] != ckey0], ckey[1:] != ckey[:-1]])
            k = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            first_doc, first_lo = (np.where(k < 0, v0 or 0, v[k]) for v, v0 in ((doc, doc0), (lo, lo0)))
            repeated = whole | (~new_c & ~mark & ((doc != first_doc) | (lo != first_lo)))
            fresh = new_c & ~whole & ~mark  # the first copy of a context
            of = np.cumsum(new_a)  # 0: the anchor of the batch before
            count, is_hot = np.bincount(of, fresh), np.bincount(of, mark | (hot & fresh)) > 0
            count[0] += count0
            is_hot[0] |= hot0
            several = (count > 1) | is_hot
            keep = repeated | (fresh & several[of])
            out = [(akey[keep], doc[keep], lo[keep], size[keep], rel[keep], repeated[keep], is_hot[of][keep])]
            if held is not None and several[0]:
                out.append((*held, np.array([is_hot[0]])))
                held = None
            if of[-1]:
                held = None
            alone = np.flatnonzero(fresh & (of == of[-1])) if not several[-1] else []
            if len(alone):
                s = alone[:1]
                held = (akey[s], doc[s], lo[s], size[s], rel[s], repeated[s])
            akey0, ckey0, doc0, lo0, count0, hot0 = akey[-1], ckey[-1], first_doc[-1], first_lo[-1], count[-1], is_hot[-1]
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(cols[0]):
                yield record(cols, FOUND)

    return dealt.select("akey", "ckey", "doc", "lo", "len", "rel", "hot").mapInArrow(run, FOUND)


def fetched(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of contexts: akey, doc, lo, rel, bytes."""
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("akey", "lo", "len", "rel")).alias("asked"))  # no more than the document has

    def run(batches):
        for part in shared.chunks(batches):
            data, at = words.flat(part.column("text"))
            raw, asked = data.tobytes(), part.column("asked")
            ends, x = asked.offsets.to_numpy(), asked.values
            pick = slice(ends[0], ends[-1])
            akey, lo, size, rel = (x.field(k).to_numpy(zero_copy_only=False)[pick] for k in range(4))
            row = np.repeat(np.arange(part.num_rows), np.diff(ends))
            begin = at[row] + lo
            pieces = [raw[b : b + s] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(akey), part.column("doc").take(pa.array(row)), pa.array(lo), pa.array(rel), pa.array(pieces, pa.binary())], names=["akey", "doc", "lo", "rel", "bytes"])

    return docs.join(asked, "doc").mapInArrow(run, "akey long, doc long, lo int, rel int, bytes binary")


def repeats_in(akey: list[int], doc: list[int], lo: list[int], rel: list[int], piece: list[bytes]) -> list[tuple[int, int, int]]:
    """(doc, start, end) of repeated bytes among contexts that share anchors."""
    grid = [r % BLOCK for r in rel]
    count = [(len(b) - g) // BLOCK for b, g in zip(piece, grid, strict=True)]
    blocks = np.frombuffer(b"".join(b[g : g + n * BLOCK] for b, g, n in zip(piece, grid, count, strict=True)), f"V{BLOCK}")
    owner = np.repeat(np.arange(len(piece)), count)
    symbol = np.unique(blocks.view(np.uint8).reshape(-1, BLOCK).view(f"V{BLOCK}").ravel(), return_inverse=True)[1] if len(blocks) else np.zeros(0, np.int64)
    # a sequence of blocks, each context closed by a symbol of its own, and one that is smaller than all at the end
    place = np.arange(len(blocks)) + owner
    text = np.zeros(len(blocks) + len(piece) + 1, np.int64)
    text[np.cumsum(count) + np.arange(len(piece))] = np.arange(1, len(piece) + 1)
    text[place] = symbol + len(piece) + 1
    of = np.full(len(text) + RUN, -1)
    of[place] = owner
    nth = np.zeros(len(text), np.int64)
    nth[place] = np.arange(len(blocks)) - np.repeat(np.cumsum(count) - count, count)
    sa = np.array(sort_suffixes(text.tolist()))
    wide = np.concatenate([text, np.zeros(RUN, np.int64)])
    inside = of[sa] >= 0
    same = inside[1:] & (of[sa[1:] + RUN - 1] == of[sa[1:]])
    for k in range(RUN):
        same &= wide[sa[1:] + k] == wide[sa[:-1] + k]
    first: dict[tuple[int, int, bytes], tuple[int, int]] = {}
    hits: list[tuple[int, int, tuple[int, int, bytes]]] = []
    edge = np.concatenate([[False], same, [False]])
    for p in sa[edge[1:] | edge[:-1]].tolist():
        c = of[p]
        b, q = piece[c], grid[c] + nth[p] * BLOCK
        for s in range(max(0, q - BLOCK + 1), min(q, len(b) - LENGTH) + 1):  # strings whose first whole block is this one
            key = (akey[c], s - rel[c], b[s : s + LENGTH])
            own = (doc[c], lo[c] + s)
            if key not in first or own < first[key]:
                first[key] = own
            hits.append((c, s, key))
    again: dict[int, list[int]] = {}
    for c, s, key in hits:
        if first[key] < (doc[c], lo[c] + s):
            again.setdefault(c, []).append(s)
    out = []
    for c, starts in again.items():
        starts = np.sort(starts)
        cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
        for a, b in zip(starts[np.concatenate([[0], cut])], starts[np.concatenate([cut, [len(starts)]]) - 1], strict=True):
            out.append((doc[c], lo[c] + int(a), lo[c] + int(b) + LENGTH))
    return out


def by_suffixes(rows: DataFrame) -> DataFrame:
    """Repeated intervals among contexts, which come sorted by anchor; whole anchors are handled together."""

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        total, last = 0, None

        def emit():
            found = repeats_in(*held)
            for x in held:
                x.clear()
            doc, lo, end = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), pa.array((end - lo).astype(np.int32))], names=["doc", "lo", "len"])

        for part in batches:
            cols = [part.column(c).to_pylist() for c in ("akey", "doc", "lo", "rel", "bytes")]
            for row in zip(*cols, strict=True):
                if total >= SORT_BYTES and row[0] != last:
                    yield emit()
                    total = 0
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                total, last = total + len(row[4]), row[0]
        if total:
            yield emit()

    return rows.select("akey", "doc", "lo", "rel", "bytes").mapInArrow(run, "doc long, lo int, len int")


def numbered(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """df with a number for each document in column `name`, in the order of keys: whole-number keys that aren't repeated themselves,
    else the places of distinct keys and texts in a table sorted by key and digest. Null for null keys."""
    (k,) = shared.columns([key])
    if df.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") and df.where(k.isNotNull()).groupBy(k).count().where("count > 1").isEmpty():
        return df.withColumn(name, k.cast("long"))
    a, b = shared.fresh(df, "__key"), shared.fresh(df, "__text_digest")
    one = df.withColumns({a: k, b: F.sha2(F.coalesce(F.col(text), F.lit("")), 256)})
    place = one.select(a, b).where(F.col(a).isNotNull()).distinct().repartitionByRange(a, b).sortWithinPartitions(a, b)
    place = shared.written(place.withColumn(name, F.monotonically_increasing_id()), "places")  # grows with key and digest: ranges are in order
    return one.join(place, [a, b], "left").drop(a, b)


def repeated(docs: DataFrame) -> DataFrame:
    """doc, spans (array of start and length): the repeated bytes of each document (doc long, text) that has some."""
    level = docs.select(F.lit(0).cast("long").alias("akey"), "doc", F.lit(0).alias("lo"), "text")
    spans = []
    for width in GRAMS:
        found = shared.written(grouped(anchors(level, width).repartition("deal").sortWithinPartitions("akey", "ckey", "doc", "lo")), "anchors")
        wanted = found.where("not repeated")
        many = shared.written(wanted.where("not hot").groupBy("akey").count().where(F.col("count") > MANY).select("akey", F.lit(True).alias("many")), "many")
        if not many.isEmpty():  # Spark broadcasts it if it is small, else splits its skewed side
            wanted = wanted.join(many, "akey", "left").withColumn("hot", F.col("hot") | F.col("many").isNotNull())
        few = by_suffixes(fetched(wanted.where("not hot"), docs).repartition("akey").sortWithinPartitions("akey"))
        spans += [found.where("repeated").select("doc", "lo", "len"), few]
        if wanted.where("hot").isEmpty():
            break
        level = fetched(wanted.where("hot"), docs).select("akey", "doc", "lo", F.col("bytes").alias("text"))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc").agg(F.collect_list(F.struct("lo", "len")).alias("spans"))


def cut(df: DataFrame, key: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """df without `text`, with n_bytes, n_removed, n_spans and kept_sha256; if `kept`, also kept_bytes (a cut may part a character)."""
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * kept
    keep = [c for c in df.columns if c not in (text, *made)]
    doc, body, gone = (shared.fresh(df, x) for x in ("__doc", "__text", "__spans"))
    rows = numbered(df, key, text, doc)
    spans = repeated(rows.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    both = rows.select(*shared.columns(keep), F.col(text).alias(body), doc).join(spans.select(F.col("doc").alias(doc), F.col("spans").alias(gone)), doc, "left").select(*shared.columns(keep), body, gone)

    def run(batches):
        for part in shared.chunks(batches, body):
            data, at = words.flat(part.column(body))
            lists, rows = part.column(gone).to_pylist(), []
            for i, spans in enumerate(lists):
                own = data[at[i] : at[i + 1]]
                if not spans:
                    rows.append((len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest(), *[own.tobytes()] * kept))
                    continue
                cover = np.zeros(len(own) + 1, np.int32)
                lo = np.array([s["lo"] for s in spans])
                np.add.at(cover, np.minimum(lo, len(own)), 1)
                np.add.at(cover, np.minimum(lo + np.array([s["len"] for s in spans]), len(own)), -1)
                out = np.cumsum(cover)[:-1] > 0
                runs = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                left = own[~out].tobytes()
                rows.append((len(own), int(out.sum()), runs, hashlib.sha256(left).hexdigest(), *[left] * kept))
            types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * kept
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), types, strict=True))], names=[*keep, *made])

    return shared.in_arrow(both, run, f"{shared.ddl(df, keep)}n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept_bytes binary' * kept}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(shared.documents(spark, sf_dir).select("doc_id", "text"))
