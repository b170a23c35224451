"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; positions marked 0 are ignored, so a substituted word there doesn't
change the hash. Every mask is hashed at every word of the benchmark items and of the documents, and the two sets of
hashes are joined. Each hit names an item and an alignment; around it, the segment with the best score (a
match counts 1, a substitution -`PENALTY`) decides. A document holds an item if that segment matches
`MIN_SHARE` of the item's words, or `LONG_MATCH` words.

The join sends the items' hashes to the documents, in blocks of bounded size: items are dealt into as many
blocks as their characters need, and each block in turn is broadcast, scanned over all documents and dropped, so neither the driver
nor an executor holds more than one. The document side, which has hashes of every word and mask, is never shuffled. One block holds about 700,000 words of items; a larger
benchmark takes one more scan for each.

Hot seeds: a hash that more than `HOT` places of the items have (a prompt or notice that they share) isn't expanded into alignments. Hashes of the same items at the
same relative places are one class, found once wherever a document holds any of them. There, the items that have the document's words at the same
distances are counted with postings by distance and word; where most items agree on a word, only those that differ are listed. Items whose count is below
what they ask for can't match and leave; the few others are aligned as all are, so results are exact. A place in a document costs its words and the items
that differ, about a microsecond for each hundred items (2,000 items and 2,000 texts with one phrase of 18 words: 2 s).

Defined results: letters are compared without regard to case, punctuation is blank; items shorter than the longest mask
must match as wholes, and items of under `min_words` words identify nothing (with min_words=1 every item is matched); null texts hold
and identify nothing; several items with the same text are all reported; of alignments that match as many words the first counts;
repeated rows are reported each; empty tables give an empty result. `contained` drops the text and replaces columns named as its
outputs; `without` keeps all columns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import shared, words
from .toxicity import FOLD

#: Zeros that are two to six places apart, so substitutions at any such distance are passed over.
MASKS = ("11101011", "1101100111", "1101111011", "101110111")
MIN_WORDS = 5
MIN_SHARE = 0.5
LONG_MATCH = 20
PENALTY = 2
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
#: A seed hash at more places of the items than this isn't expanded: its items are counted together.
HOT = 64
#: Words of alignments that are compared at once.
CELLS = 1 << 21

FACTORS = words.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def masks_for(lengths: set[int], min_words: int) -> list[tuple[int, ...]]:
    """Positions of each mask; for items shorter than the longest mask, one that covers all of their words."""
    longest = max(map(len, MASKS))
    short = [tuple(range(n)) for n in sorted(lengths) if min_words <= n < longest]
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS] + short


def seeds(word: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of the mask laid at each word; the last ones reach beyond the end and are left out."""
    n = len(word) - mask[-1]
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt * 0x9E3779B9, np.uint64)
    for k in mask:
        h += word[k : k + n] * FACTORS[k]
    return h ^ (h >> np.uint64(32))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each row."""
    data, at = words.flat(col)
    return words.word_hashes(FOLD[data], at)


@dataclass
class Index:
    ids: list
    word: np.ndarray
    before: np.ndarray
    least: np.ndarray  # matched words that an item asks for
    masks: list[tuple[int, ...]]
    key: np.ndarray  # sorted hashes
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray  # which low bits of a hash occur at all
    hot: np.ndarray  # hashes of more than HOT places
    hot_class: np.ndarray
    hot_shift: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray]]  # items of a class, and where they lie relative to the first
    made: dict  # postings of classes, made when a document first needs them

    def postings(self, k: int) -> Postings:
        if k not in self.made:
            self.made[k] = Postings(self, *self.classes[k])
        return self.made[k]


class Postings:
    """Which items of a class have a word at a distance from where the class is found. At a distance where most have the same word, only the others are listed."""

    def __init__(self, index: Index, item: np.ndarray, place: np.ndarray):
        n = index.before[item + 1] - index.before[item]
        entry = np.repeat(np.arange(len(item)), n)
        q = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        far = q - place[entry]
        self.item, self.place, self.least = item, place, index.least[item]
        self.low, self.high = int(far.min()), int(far.max()) + 1
        key = index.word[index.before[item][entry] + q] + (far - self.low).astype(np.uint64) * words.BASE
        order = np.argsort(key, kind="stable")
        key, entry, far = key[order], entry[order], far[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.key, self.entry, self.at = key[heads], entry, np.append(heads, len(key))
        size, far = np.diff(self.at), far[heads]
        self.common, others = np.zeros(len(heads), bool), []
        for k in np.flatnonzero(2 * size > len(item)).tolist():
            self.common[k] = True
            others.append((k, np.setdiff1d(np.arange(len(item)), entry[self.at[k] : self.at[k + 1]], assume_unique=True)))
        self.others = dict(others)

    def hopeful(self, word: np.ndarray, base: int, lo: int, hi: int) -> np.ndarray:
        """Entries that have as many words as they ask for where the class is found at `base` in a text at lo..hi."""
        a, b = max(self.low, lo - base), min(self.high, hi - base)
        key = word[base + a : base + b] + np.arange(a - self.low, b - self.low).astype(np.uint64) * words.BASE
        spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        spot = spot[self.key[spot] == key]
        often = spot[self.common[spot]]
        rare = spot[~self.common[spot]]
        start, n = self.at[rare], self.at[rare + 1] - self.at[rare]
        got = np.bincount(self.entry[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(self.item)) + len(often)
        for k in often.tolist():
            got[self.others[k]] -= 1
        return np.flatnonzero(got >= self.least)


def build(ids: list, texts: list[str | None], min_words: int = MIN_WORDS) -> Index:
    word, before = tokens(pa.array(texts, pa.string()))
    n = np.diff(before)
    masks = masks_for(set(n.tolist()), min_words)
    keys, items, places = [], [], []
    for salt, mask in enumerate(masks):
        h = seeds(word, mask, salt)
        at = np.arange(len(h))
        item = np.searchsorted(before, at, side="right") - 1
        ok = (at + mask[-1] < before[item + 1]) & (n[item] >= min_words)
        if salt >= len(MASKS):
            ok &= n[item] == mask[-1] + 1
        keys.append(h[ok])
        items.append(item[ok])
        places.append((at - before[item])[ok])
    key, item, place = map(np.concatenate, (keys, items, places))
    order = np.argsort(key, kind="stable")
    key, item, place = key[order], item[order], place[order]
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(key)))
    known, classes, of, shift = {}, [], [], []
    for a, c in zip(heads[size > HOT].tolist(), size[size > HOT].tolist(), strict=True):
        own, relative = item[a : a + c], place[a : a + c] - place[a]
        name = hashlib.blake2b(own.tobytes() + relative.tobytes(), digest_size=16).digest()
        if name not in known:
            known[name] = len(classes)
            classes.append((own, relative))
        of.append(known[name])
        shift.append(place[a])
    least = np.maximum(np.minimum(min_words, n), np.minimum(np.ceil(MIN_SHARE * n).astype(np.int64), LONG_MATCH))
    hot = key[heads[size > HOT]]
    return Index(ids, word, before, least, masks, key, item, place, bits, hot, np.array(of, np.int64), np.array(shift, np.int64), classes, {})


def best_segments(same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a matrix of matches: matches, start and end of the segment with the highest score, the longest of the first such.
    Places beyond the end are no matches."""
    gain = np.zeros((len(same), same.shape[1] + 1), np.int32)
    np.cumsum(np.where(same, 1, -PENALTY), axis=1, out=gain[:, 1:])
    low = np.minimum.accumulate(gain, axis=1)
    end = (gain - low).argmax(axis=1)
    own = np.arange(len(same))
    start = (gain == low[own, end][:, None]).argmax(axis=1)
    return (gain[own, end] - gain[own, start] + PENALTY * (end - start)) // (1 + PENALTY), start, end


def aligned(index: Index, word: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """row, item, first, matched words, words of the segment and its first word in the text, of those alignments (row, item, first) that match enough."""
    row, item, first = at.T
    lo = np.maximum(first, before[row])
    n = np.minimum(first + index.before[item + 1] - index.before[item], before[row + 1]) - lo
    order, out, i = np.argsort(n, kind="stable"), [], 0
    while i < len(order):
        width = n[order[i:]]
        take = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, side="right")))
        own = order[i : i + take]
        i += take
        step = np.arange(int(n[own].max()))
        inside = step[None, :] < n[own][:, None]
        text = word[np.where(inside, lo[own][:, None] + step, 0)]
        wanted = index.word[np.where(inside, (index.before[item[own]] + lo[own] - first[own])[:, None] + step, 0)]
        same = inside & (text == wanted)
        own, same = own[ok := same.sum(axis=1) >= index.least[item[own]]], same[ok]
        matched, s, e = best_segments(same)
        good = matched >= index.least[item[own]]
        own, matched, s, e = own[good], matched[good], s[good], e[good]
        out.append(np.stack([row[own], item[own], first[own], matched, e - s, lo[own] + s - before[row[own]]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 6), np.int64)


def find(index: Index, col: pa.Array) -> np.ndarray:
    """row, item, matched words, words of the segment and first word in the text: the best alignment of each row and item that match enough."""
    word, before = tokens(col)
    low, near, found = np.uint64((1 << FILTER_BITS) - 1), [], []
    for salt, mask in enumerate(index.masks):
        h = seeds(word, mask, salt)
        at = np.flatnonzero(index.bits[(h & low).astype(np.int64)])
        lo, hi = np.searchsorted(index.key, h[at], side="left"), np.searchsorted(index.key, h[at], side="right")
        n = hi - lo
        often = np.flatnonzero(n > HOT)
        k = np.searchsorted(index.hot, h[at[often]])
        near.append(np.stack([np.searchsorted(before, at[often], side="right") - 1, index.hot_class[k], at[often] - index.hot_shift[k]], axis=1))
        some = np.flatnonzero((n > 0) & (n <= HOT))
        for part in np.array_split(some, max(1, -(-int(n[some].sum()) // CELLS))):
            m = n[part]
            got = np.repeat(lo[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            spot = np.repeat(at[part], m)
            one = np.stack([np.searchsorted(before, spot, side="right") - 1, index.item[got], spot - index.place[got]], axis=1)
            found.append(aligned(index, word, before, np.unique(one, axis=0)))
    for r, c, base in np.unique(np.concatenate(near), axis=0).tolist():
        own = index.postings(c)
        at = own.hopeful(word, base, int(before[r]), int(before[r + 1]))
        if len(at):
            found.append(aligned(index, word, before, np.stack([np.full(len(at), r), own.item[at], base - own.place[at]], axis=1)))
    found = np.concatenate([np.zeros((0, 6), np.int64), *found])
    found = found[np.lexsort((found[:, 2], -found[:, 3], found[:, 1], found[:, 0]))]
    one = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)]) if len(found) else np.zeros(0, bool)
    return found[one][:, [0, 1, 3, 4, 5]]


def blocks(items: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS, min_words: int = MIN_WORDS):
    """Indexes of the items, each of about block_chars characters, made one after the other."""
    k, t = shared.columns([key, text])
    total = items.agg(F.sum(F.length(t))).first()[0] or 0
    n = -(-total // block_chars)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(k), F.lit(n)) == i)
        rows = part.select(k, t).collect()
        if rows:
            yield build([r[0] for r in rows], [r[1] for r in rows], min_words), n


MADE = "matched_words int, segment_words int, item_words int, first_word int"


def contained(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document and benchmark item that it holds: docs' columns but `text`, then item_key, matched_words,
    segment_words, item_words and first_word."""
    made = [x.split()[0] for x in MADE.split(", ")]
    keep, body = [c for c in docs.columns if c not in (text, item_key, *made)], shared.fresh(docs, "__text")
    schema = f"{shared.ddl(docs, keep)}{shared.ddl(items, [item_key])}{MADE}"
    kind = to_arrow_type(items.schema[item_key].dataType)
    source, out = docs.select(*shared.columns(keep), F.col(f"`{text}`").alias(body)), None
    for index, n in blocks(items, item_key, item_text, block_chars, min_words):
        shipped = docs.sparkSession.sparkContext.broadcast(index)  # bounded by block_chars

        def run(batches, shipped=shipped):
            for part in shared.chunks(batches, body):
                index = shipped.value
                rows, item, matched, segment, first = find(index, part.column(body)).T
                if not len(rows):
                    continue
                size = index.before[item + 1] - index.before[item]
                cols = [part.column(c).take(pa.array(rows)) for c in keep] + [pa.array([index.ids[i] for i in item.tolist()], kind)]
                cols += [pa.array(x.astype(np.int32)) for x in (matched, segment, size, first)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, item_key, *made])

        one = shared.in_arrow(source, run, schema)
        if n > 1:
            one = shared.written(one, "hits")
            shipped.destroy()
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without those that hold an item; texts stay where they are."""
    out, old = docs, []
    for index, n in blocks(items, item_key, item_text, block_chars, min_words):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            for part in shared.chunks(batches, text):
                clean = np.ones(part.num_rows, bool)
                clean[find(shipped.value, part.column(text))[:, 0]] = False
                yield part.filter(pa.array(clean))

        out = shared.in_arrow(out, run, docs.schema)
        if n > 1:
            out = shared.written(out, "clean", new := [])
            shared.drop(docs.sparkSession, old)
            old = new
            shipped.destroy()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(shared.documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """The same in DuckDB: seeds as strings of words, every hit's alignment compared word by word, its best segment by running sums."""
    longest = max(map(len, MASKS))
    word = "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: true)"

    def seed(table: str) -> str:
        rows = []
        for salt, mask in enumerate(MASKS):
            at = [i for i, c in enumerate(mask) if c == "1"]
            key = " || ' ' || ".join(f"ws[i + {k + 1}]" for k in at)
            rows.append(f"SELECT r, i, {salt} AS salt, {key} AS key FROM (SELECT r, ws, unnest(range(len(ws) - {at[-1]})) AS i FROM {table} WHERE len(ws) >= {MIN_WORDS})")
        return " UNION ALL ".join(rows)

    return rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {word} AS ws FROM documents
), item AS (
  SELECT row_number() OVER () AS r, item_id, {word} AS ws FROM benchmark
), hit AS (
  SELECT d.r AS d, m.r AS m, d.i - m.i AS first FROM ({seed("doc")}) d JOIN ({seed("item")}) m USING (salt, key)
  UNION SELECT d.r, m.r, d.i FROM (SELECT r, unnest(range(len(ws))) AS i, ws FROM doc) d JOIN item m ON len(m.ws) BETWEEN {MIN_WORDS} AND {longest - 1} AND d.ws[d.i + 1] = m.ws[1] AND d.ws[d.i + 1:d.i + len(m.ws)] = m.ws
), aligned AS (
  SELECT h.*, greatest(first, 0) AS lo, least(first + len(item.ws), len(doc.ws)) AS hi, doc.ws AS a, item.ws AS b FROM hit h JOIN doc ON doc.r = d JOIN item ON item.r = m
), step AS (
  SELECT d, m, first, lo, 0 AS j, 0 AS v FROM aligned
  UNION ALL SELECT d, m, first, lo, j + 1, CASE WHEN a[lo + j + 1] = b[lo - first + j + 1] THEN 1 ELSE -{PENALTY} END FROM (SELECT *, unnest(range(hi - lo)) AS j FROM aligned)
), gain AS (
  SELECT *, sum(v) OVER (PARTITION BY d, m, first ORDER BY j) AS g FROM step
), low AS (
  SELECT *, min(g) OVER (PARTITION BY d, m, first ORDER BY j) AS l FROM gain
), last AS (
  SELECT d, m, first, arg_max(j, {{'x': g - l, 'y': -j}}) AS e, arg_max(g, {{'x': g - l, 'y': -j}}) AS g_end, arg_max(l, {{'x': g - l, 'y': -j}}) AS g_start FROM low GROUP BY d, m, first
), segment AS (
  SELECT x.*, (SELECT min(j) FROM gain y WHERE y.d = x.d AND y.m = x.m AND y.first = x.first AND y.g = x.g_start) AS s FROM last x
), matched AS (
  SELECT d, m, first, s, e, ((g_end - g_start + {PENALTY} * (e - s)) / {1 + PENALTY})::INT AS n FROM segment
), enough AS (
  SELECT x.*, doc.doc_id, item.item_id, len(item.ws) AS item_words FROM matched x JOIN doc ON doc.r = d JOIN item ON item.r = m WHERE n >= {MIN_WORDS} AND (n >= {MIN_SHARE} * len(item.ws) OR n >= {LONG_MATCH})
)
SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, max(n) AS matched_words, arg_max(e - s, {{'n': n, 'f': -first}})::INT AS segment_words,
       any_value(item_words)::INT AS item_words, arg_max(greatest(first, 0) + s, {{'n': n, 'f': -first}})::INT AS first_word
FROM enough GROUP BY d, m
"""
