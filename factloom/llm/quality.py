"""Quality rules with cross-document line frequency.

Each text is split into lines; a line is normalised (A-Z lower-cased, blanks squeezed, digits made 0) and
hashed. Lines that occur in more than `max_docs` documents of one host are removed from them, and a document left with
under `min_share` of its words is rejected as depleted. Rules on single texts (too short, too repetitive)
come beside it. One pass over the texts makes counts and distinct line hashes for each row; they are
written, so that the counting join reads hashes instead of texts. Counts are combined before the shuffle,
so a line or host that a third of all rows share costs one row a task.

Defined results: a null text has no lines and fails the length rule; a null host is a host of its own; lines are told apart by a 64-bit hash of their normalised bytes, which is not checked; every
row counts as one document, also when keys repeat; a line in exactly `max_docs` documents stays; an empty table gives an empty
result; extra columns are kept by `rules`, except those named as its outputs (the counts, removed_words, base_failed, kept and clean_text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

MAX_DOCS = 20
MIN_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words inside repeated three-word windows
WINDOW = 3

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that stand in a window of `width` words that the text holds twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    top = int(ids.max()) + 1
    key = ids[:n].astype(np.uint64)
    for k in range(1, width):
        if top ** (k + 1) >= 1 << 63:  # number the pairs anew before they overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = key * np.uint64(top) + ids[k : n + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + width - 1, bool)
    for k in range(width):
        cover[k : n + k] |= twice
    return int(cover.sum())


def line_stats(text: bytes) -> tuple[int, list[int], list[int]]:
    """Lines equal to an earlier one, then hash and words of each distinct normalised line (words of all its places)."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    norm: dict[bytes, int] = {}
    for x in lines:
        parts = x.translate(LOWER).split()
        x = b" ".join(parts)
        norm[x] = norm.get(x, 0) + len(parts)
    return len(lines) - len(set(lines)), list(norm), list(norm.values())


def measure(df: DataFrame, text: str, lines_out: str) -> DataFrame:
    """One row for each row of df: its columns but `text`, the counts, and `lines_out` (hash, words)."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep, body = [c for c in df.columns if c not in (text, *made)], shared.fresh(df, "__text")
    line = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))

    def run(batches):
        for part in shared.chunks(batches, body):
            data, at = words.flat(part.column(body))
            _, _, before = words.bounds(data, at)
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
            chars = total(~words.BLANK[data] & ((data & 0xC0) != 0x80))
            symbols = total(SYMBOL[data])
            raw, dup, rep, flat, count, ends = data.tobytes(), [], [], [], [], [0]
            for i in range(len(at) - 1):
                one = raw[at[i] : at[i + 1]]
                seen: dict[bytes, int] = {}
                rep.append(repeated_words(np.array([seen.setdefault(w, len(seen)) for w in one.split()], np.int64)))
                n, lines, ns = line_stats(one)
                dup.append(n)
                flat += lines
                count += ns
                ends.append(len(flat))
            sizes = np.array([0, *map(len, flat)], np.int64).cumsum()
            hashes = words.span_hash(words.prefix(np.frombuffer(b"".join(flat), np.uint8)), sizes[:-1], sizes[1:]) if flat else np.zeros(0, np.uint64)
            pairs = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(count, pa.int64())], ["h", "w"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(line)
            numbers = [np.diff(before), chars, symbols, np.array(dup), np.array(rep)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in numbers), lists], names=[*keep, *made, lines_out])

    schema = shared.ddl(df, keep) + ", ".join([*(f"{c} long" for c in made), f"`{lines_out}` array<struct<h: long, w: long>>"])
    return shared.in_arrow(df.select(*shared.columns(keep), F.col(f"`{text}`").alias(body)), run, schema)


def without_lines(df: DataFrame, body: str, lost: str) -> DataFrame:
    """df with `clean_text`: column `body` without the lines whose hashes are in column `lost`; blank lines stay."""
    keep = [c for c in df.columns if c not in (body, lost, "clean_text")]

    def run(batches):
        for part in shared.chunks(batches, body):
            out = []
            for text, gone in zip(part.column(body).to_pylist(), part.column(lost).to_pylist(), strict=True):
                if gone:
                    lines = text.encode().split(b"\n")
                    norm = [b" ".join(x.translate(LOWER).split()) for x in lines]
                    ends = np.array([0, *map(len, norm)], np.int64).cumsum()
                    hashes = words.span_hash(words.prefix(np.frombuffer(b"".join(norm), np.uint8)), ends[:-1], ends[1:]).view(np.int64)
                    drop = set(gone)
                    text = b"\n".join(x for x, n, h in zip(lines, norm, hashes.tolist(), strict=True) if not n or h not in drop).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "clean_text"])

    return shared.in_arrow(df, run, f"{shared.ddl(df, keep)}clean_text string")


def rules(df: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, cleaned: bool = False) -> DataFrame:
    """df without `text`, with counts, `removed_words` (words of lines that too many documents of the host have),
    `base_failed` and `kept`; if `cleaned`, also `clean_text`, the text without those lines."""
    row, found, body, lost, own_host = (shared.fresh(df, f"__quality_{x}") for x in ("row", "lines", "text", "gone", "host"))
    df = df.withColumn(own_host, F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("null")))
    df = df.withColumn(body, F.col(f"`{text}`")) if cleaned else df
    table = shared.written(measure(df, text, found).withColumn(row, F.monotonically_increasing_id()), "quality")
    lines = table.select(F.col(row).alias("row"), F.col(own_host).alias("host"), F.explode(found).alias("l")).select("row", "host", "l.h", "l.w")
    common = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).select("host", "h")
    common = shared.written(common, "common").hint("merge")  # two tables, so that Spark splits the rows of a hot line
    gone = [F.collect_list("h").alias(lost)] if cleaned else []
    removed = lines.join(common, ["host", "h"]).groupBy(F.col("row").alias(row)).agg(F.sum("w").alias("removed_words"), *gone)
    out = table.drop(found, own_host, "removed_words", "base_failed", "kept").join(removed, row, "left").drop(row).fillna(0, ["removed_words"])
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.lit(min_share) * F.col("n_words")))
    return without_lines(out, body, lost) if cleaned else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules(shared.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT r, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS g
  FROM (SELECT r, ws, unnest(range(len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)
), twice AS (
  SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r
), line AS (
  SELECT r, source, line, regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM line GROUP BY r
), common AS (
  SELECT source, norm FROM line GROUP BY source, norm HAVING count(DISTINCT r) > {MAX_DOCS}
), gone AS (
  SELECT l.r, sum(l.nw) AS n FROM line l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY l.r
), f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND n_words - removed_words >= {MIN_SHARE} * n_words AS kept FROM f
"""
