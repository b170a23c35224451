"""Periodic runs of words by a sparse diagonal scan.

Reading a text word by word, an earlier occurrence of the word at lag d continues the diagonal of lag d or opens it; a diagonal that
the next word doesn't continue ends, and if its match is long enough it is a run: length words of which those d apart are identical.
Taken literally this looks at every earlier occurrence of every word, a square of the text's length where few words are used. Three
facts keep it sparse, and exact:

* Only runs of `EXPONENT` periods or more count, so inside a run of period d the next (EXPONENT - 1) * d words match at lag d as well. Lags are
  taken in levels b..(3b + 2) / 2 (1-2, 3-5, 6-10, 11-17 and so on); at a level an occurrence of a word is told apart by the 3b words that begin with it.
* Of all earlier occurrences only the latest can continue a run whose smallest period is d. Were the latest at lag p < d, the 3b words would have
  the periods p and d; p + d is at most 3b + gcd(p, d), so by the theorem of Fine and Wilf they, and the run with them, have the period
  gcd(p, d). So one lag is active for each word and level, the work is n log n at worst, and runs of multiples of a period never appear.
* A diagonal is as long as consecutive words keep the same lag; it is emitted where the lag changes.

Occurrences are found for a batch of texts at once, by 64-bit hashes of the words that follow; those without a partner leave before they are
sorted, and the words of a run are compared at its lag before it is emitted. A text is one row and never cut: it takes about 100 bytes of arrays for each
byte (5 MB of text: half a GB).

Defined results: a null text has no words, so no run and an empty collapsed text; runs are ordered by start, then period; a text that is one
long run of one word has a single run of period 1; rows that repeat are measured each; an empty table gives an empty result; further columns
stay, except those named as the outputs. In the query, a row without a key is not made periodic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

EXPONENT = 4
LEAST = 6
SLOTS = 22
WORD = r"[^\x20\x09-\x0D]+"


def levels(longest: int, exponent: int = EXPONENT):
    """(least lag, greatest lag, words that tell an occurrence apart) of each level that a text of `longest` words can need."""
    low = 1
    while low * exponent <= longest:
        wide = (exponent - 1) * low
        yield low, (wide + 2) // 2, wide
        low = (wide + 2) // 2 + 1


def latest(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes whose key stands earlier too, and the index of its latest earlier place."""
    at = np.arange(len(key), dtype=np.int32)
    slot = (key >> np.uint64(64 - SLOTS)).astype(np.int32)
    last, shared_slot = np.empty(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, bool)
    last[slot] = at
    shared_slot[slot[last[slot] != at]] = True
    at = at[shared_slot[slot]]
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    now, before = order[1:][same], order[:-1][same]
    back = np.argsort(now)
    return now[back], before[back]


def find(word: np.ndarray, before: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start (from 0 in its row), length and period of all runs, ordered by row, start and period. word: a hash of each word;
    before: the words before each row."""
    if exponent < 4:
        raise ValueError("levels grow by a factor for exponents of 4 or more")
    n = np.diff(before)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * words.powers(words.BASE, len(word)))])
    inverse = words.powers(words.INVERSE, len(word) + 1)
    row = np.repeat(np.arange(len(n)), n)
    end = before[row + 1]
    at, found = np.arange(len(word)), []
    for low, high, wide in levels(int(n.max(initial=0)), exponent):
        at = at[n[row[at]] >= max(least, exponent * low)]
        first = at[at + wide <= end[at]]
        if not len(first):
            continue
        key = words.mix((total[first + wide] - total[first]) * inverse[first] + row[first].astype(np.uint64) * words.MIX1)
        now, then = latest(key)
        now, lag = first[now], first[now] - first[then]
        active = (lag >= low) & (lag <= high)
        now, lag = now[active], lag[active]
        if not len(now):
            continue
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(now) != 1) | (np.diff(lag) != 0)]))
        closes = np.append(opens[1:], len(now)) - 1
        start, stop, period = now[opens] - lag[opens], now[closes] + wide, lag[opens]
        enough = stop - start >= np.maximum(least, exponent * period)
        for s, e, q in zip(start[enough].tolist(), stop[enough].tolist(), period[enough].tolist(), strict=True):
            if np.array_equal(word[s + q : e], word[s : e - q]):
                found.append((s, e - s, q))
    found = np.array(sorted(found), np.int64).reshape(-1, 3)
    of = row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    return of, found[:, 0] - before[of], found[:, 1], found[:, 2]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs(df: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """df without `text`, with `runs` (start, length and period of each, by start and period) and `collapsed`: the words that no run
    contains beyond its first period, joined by single spaces."""
    keep, body = [c for c in df.columns if c not in (text, "runs", "collapsed")], shared.fresh(df, "__text")

    def run(batches):
        for part in shared.chunks(batches, body):
            data, at = words.flat(part.column(body))
            word, before = words.word_hashes(data, at)
            row, start, length, period = find(word, before, exponent, least)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            gone = np.zeros(len(word) + 1, np.int64)
            np.add.at(gone, before[row] + start + period, 1)
            np.add.at(gone, before[row] + start + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            raw, out = data.tobytes(), []
            for i in range(part.num_rows):
                own = raw[at[i] : at[i + 1]].split()
                if ends[i] < ends[i + 1]:
                    own = [own[k] for k in np.flatnonzero(kept[before[i] : before[i + 1]]).tolist()]
                out.append(b" ".join(own))
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(out, pa.binary()).cast(pa.string())], names=[*keep, "runs", "collapsed"])

    schema = f"{shared.ddl(df, keep)}runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return shared.in_arrow(df.select(*shared.columns(keep), F.col(f"`{text}`").alias(body)), run, schema)


def periodic(key: str, text: str) -> Column:
    """The text; where crc32(key) is divisible by 10, its words from some place on repeat with a period, as the crc32 says."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    ws = F.regexp_extract_all(text, F.lit(WORD), 0)
    n = F.size(ws)
    a = F.pmod(g, n).cast("long")
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))

    def joined(s: Column) -> Column:
        at = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(s["ws"]) - 1), lambda i: F.get(s["ws"], at(i))), " ")

    one = F.array(F.struct(ws.alias("ws"), a.alias("a"), p.alias("p")))  # named once, worked out once
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.col(text).rlike(WORD), F.transform(one, joined)[0]).otherwise(F.col(text))


def best(spans: str) -> Column:
    """The run with the greatest length / period, the first of such; null without runs."""
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    return F.reduce(F.col(spans), F.get(spans, F.lit(0)), lambda acc, x: F.when(better(x, acc), x).otherwise(acc))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    out = runs(docs.select("doc_id", periodic("doc_id", "text").alias("text"))).withColumn("best", best("runs"))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of the key's decimal digits, worked out bit by bit.
CRC32 = """xor(list_reduce(flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: [ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda x, v: CASE WHEN v >= 0 THEN xor(x, v) ELSE xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT), 4294967295)"""

#: The same in DuckDB: a lag is looked at where words at three multiples of it are followed by themselves, as they are in any run of four periods.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0, {CRC32} AS h FROM documents
), s AS (
  SELECT *, len(w0) AS n, (h // 10) % greatest(len(w0), 1) AS a, (h // 10) % 8 + 3 AS k FROM d
), doc AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w0 END AS ws FROM s
), lag AS (
  SELECT r, n, ws, unnest(range(1, n // {EXPONENT} + 1)) AS q FROM doc WHERE n >= {LEAST}
), spot AS (
  SELECT r, n, ws, q, unnest(range(0, n - 3 * q, q)) AS i FROM lag
), hopeful AS (
  SELECT DISTINCT r, q FROM spot WHERE ws[i + 1] = ws[i + q + 1] AND ws[i + q + 1] = ws[i + 2 * q + 1] AND ws[i + 2 * q + 1] = ws[i + 3 * q + 1]
), same AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g
  FROM (SELECT r, q, ws, unnest(range(n - q)) AS i FROM hopeful JOIN doc USING (r)) WHERE ws[i + 1] = ws[i + q + 1]
), stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY r, q, g HAVING count(*) + q >= greatest({LEAST}, {EXPONENT} * q)
), run AS (
  SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.r = x.r AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS runs FROM run GROUP BY r
), top AS (
  SELECT * FROM (SELECT r, start, length, q, row_number() OVER (PARTITION BY r ORDER BY length / q DESC, start, q) AS nth FROM run) WHERE nth = 1
), gone AS (
  SELECT r, list(DISTINCT i) AS lost FROM (SELECT r, unnest(range(start + q, start + length)) AS i FROM run) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, t.start::BIGINT AS start, t.length::BIGINT AS length, t.q::BIGINT AS period, (1000 * t.length // t.q)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(array_to_string(list_filter(ws, lambda x, i: lost IS NULL OR NOT list_contains(lost, i - 1)), ' ')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (r) LEFT JOIN top t USING (r) LEFT JOIN gone USING (r)
"""
