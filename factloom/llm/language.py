"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and n-grams of 1 to 3 characters are hashed
into `BUCKETS`. Counts by language and bucket are summed by Spark from the training rows; their smoothed log
probabilities form a matrix of languages times buckets, half a megabyte a language. It is broadcast in blocks of
`LANGUAGES` languages: with more of them the texts are scored in several passes, each with one block, that carry the best language and the
sum of probabilities along. Scoring adds up matrix entries for whole texts in numpy.

The fit reads at most about `FIT_ROWS` labelled rows, drawn by a digest of the key; further rows no longer
change what it predicts. Everything else covers all rows.

Defined results: a text that is null or has no letters is `und` with score 0; without training rows every
text is `und`; equal scores go to the language that sorts first; repeated rows count and are scored each; an empty
table gives an empty result; extra columns are kept by `predict`, except those named as its outputs, and all columns by `accepted`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
SMOOTHING = 0.5
FIT_ROWS = 20_000
LANGUAGES = 100
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)

CHUNK = 1 << 20

_letters = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram (a row for each length; BUCKETS where there is none), the place where each text begins,
    and whether it has letters."""
    low = [(t or "").lower() for t in texts]
    at = np.cumsum([0, *(len(t) + 3 for t in low)])
    code = np.frombuffer("".join(t + "\0\0\0" for t in low).encode("utf-32-le", "replace"), np.uint32).copy()
    letter = letters()[code]
    code[~letter] = 32
    for k in (1, 2, 3):
        code[at[1:] - k] = 0
    has = np.add.reduceat(letter, at[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    out = np.full((len(LENGTHS), len(code)), BUCKETS, np.int32)
    gap, ink = code == 0, letter
    for row, n in enumerate(LENGTHS):
        m = len(code) - n + 1
        if m < 1:
            continue
        h, void, any_ink = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32), np.zeros(m, bool), np.zeros(m, bool)
        for k in range(n):
            h += code[k : k + m] * FACTORS[k]
            void |= gap[k : k + m]
            any_ink |= ink[k : k + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        bucket = (h >> np.uint32(16)).astype(np.int32)
        bucket[void | ~any_ink] = BUCKETS
        out[row, :m] = bucket
    return out, at[:-1], has


def counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """n by language and bucket; bucket -1 has the number of texts."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for part in shared.chunks(batches, "text"):
            langs = part.column("lang").to_pylist()
            buckets, at, _ = grams(part.column("text").to_pylist())
            names = sorted(set(langs))
            which = np.repeat(np.array([names.index(x) for x in langs]), np.diff([*at, buckets.shape[1]]))
            for row in buckets:
                n = np.bincount(which * (BUCKETS + 1) + row, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                for k, name in enumerate(names):
                    total.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[:BUCKETS] += n[k, :BUCKETS]
            for name in langs:
                total[name][BUCKETS] += 1
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in order and their log probabilities by bucket, centred over languages, with a last column of log priors."""

    names: list[str]
    matrix: np.ndarray

    def blocks(self) -> list["Model"]:
        return [Model(self.names[i : i + LANGUAGES], self.matrix[i : i + LANGUAGES]) for i in range(0, max(1, len(self.names)), LANGUAGES)]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    k, la = shared.columns([key, lang])
    n = df.where(la.isNotNull()).count()
    if n > fit_rows:
        df = df.where(F.pmod(F.xxhash64(k), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    rows = counts(df, text, lang).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = {}
    for r in rows.toLocalIterator():  # a row for each language, of BUCKETS + 1 numbers at most
        found[r["lang"]] = own = np.zeros(BUCKETS + 1)
        own[r["bucket"]] = r["n"]  # -1 is the last column
    names = sorted(found)
    model = np.stack([found[x] for x in names]) if names else np.zeros((0, BUCKETS + 1))
    if names:
        docs = model[:, -1].copy()
        model[:, :-1] += SMOOTHING
        model[:, :-1] = np.log(model[:, :-1] / model[:, :-1].sum(axis=1, keepdims=True))
        model[:, :-1] -= model[:, :-1].mean(axis=0)
        model[:, -1] = np.log((docs + 1) / (docs + 1).sum())
    return Model(names, model)


class Scorer:
    """Scores batches with one block of the matrix."""

    def __init__(self, names: list[str], matrix: np.ndarray):
        self.names, self.prior, self.logs = names, matrix[:, -1].copy(), matrix.copy()
        self.logs[:, -1] = 0  # the column that n-grams outside a text fall on

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The best language of each text ("und" without letters), its log probability, and the sum of all relative to it."""
        buckets, at, has = grams(texts)
        if not self.names:
            return ["und"] * len(at), np.full(len(at), -np.inf), np.ones(len(at))
        total = np.zeros((len(self.names), len(at)))
        for k, logs in enumerate(self.logs):
            own = logs[buckets[0]]
            for row in buckets[1:]:
                own += logs[row]
            total[k] = np.add.reduceat(own, at) + self.prior[k]
        best, top = total.argmax(axis=0), total.max(axis=0)
        return [self.names[b] if h else "und" for b, h in zip(best, has, strict=True)], top, np.exp(total - top).sum(axis=0)


def scored(df: DataFrame, model: Model, text: str) -> tuple[DataFrame, str, str]:
    """df with the predicted language and its posterior, and the names of these two columns."""
    made = lang, top, rest = tuple(shared.fresh(df, x) for x in ("__lang", "__top", "__rest"))
    kinds = f"{shared.ddl(df, df.columns)}`{lang}` string, `{top}` double, `{rest}` double"
    blocks, out, keep = model.blocks(), df, df.columns
    for i, block in enumerate(blocks):
        names, shipped = block.names, df.sparkSession.sparkContext.broadcast(block.matrix)  # LANGUAGES rows at most

        def run(batches, names=names, shipped=shipped, first=i == 0):
            scorer = Scorer(names, shipped.value)
            for part in shared.chunks(batches, text, CHUNK):
                pred, best, total = scorer(part.column(text).to_pylist())
                if not first:
                    old, before, sums = part.column(lang).to_pylist(), part.column(top).to_numpy(), part.column(rest).to_numpy()
                    high = np.maximum(best, before)
                    pred = [p if b > a else o for p, o, b, a in zip(pred, old, best, before, strict=True)]  # languages come in order
                    total, best = total * np.exp(best - high) + sums * np.exp(before - high), high
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(best), pa.array(total)], names=[*keep, *made])

        out = shared.in_arrow(out, run, kinds)
        if i + 1 < len(blocks):
            out = shared.written(out, "languages")
    share = F.when(F.col(lang) == "und", 0.0).otherwise(1 / F.col(rest))
    return out.withColumn(top, share).drop(rest), lang, top


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without `text`, with lang_pred and score (the posterior of the predicted language)."""
    out, lang, score = scored(df, model, text)
    keep = [c for c in df.columns if c not in (text, "lang_pred", "score")]
    return out.select(*shared.columns(keep), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def accepted(df: DataFrame, model: Model, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Rows of df whose language is known with a score of min_score at least."""
    out, lang, score = scored(df, model, text)
    return out.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*shared.columns(df.columns))


def remainder(key: str, n: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    model = fit(docs.where(remainder("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text"), model).withColumn("score", F.round("score", 6))


def oracle(split: bool = True) -> str:
    """The same in DuckDB, where the training rows are fewer than FIT_ROWS; without split it learns from all rows. CRC-32 is worked out bit by bit."""
    a, b, c = (int(x) for x in FACTORS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text IS NOT NULL AS has, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]', ' ', 'g') AS t,
         xor(list_reduce(flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: [ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1])),
             lambda x, v: xor(xor(x, greatest(v, 0)) >> 1, CASE WHEN xor(x, greatest(v, 0)) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295) % 3 AS m
  FROM documents
), one AS (
  SELECT r, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM d WHERE t <> ''
), code AS (
  SELECT r, i, ord(ch)::BIGINT AS x, ch <> ' ' AS ink FROM one
), gram AS (
  SELECT r, i, x, ink, lead(x) OVER w AS y, lead(ink) OVER w AS ink2, lead(x, 2) OVER w AS z, lead(ink, 2) OVER w AS ink3 FROM code WINDOW w AS (PARTITION BY r ORDER BY i)
), hashed AS (
  SELECT r, (1 * 668265263 + x * {a}) % 4294967296 AS h FROM gram WHERE ink
  UNION ALL SELECT r, (2 * 668265263 + x * {a} + y * {b}) % 4294967296 FROM gram WHERE y IS NOT NULL AND (ink OR ink2)
  UNION ALL SELECT r, (3 * 668265263 + x * {a} + y * {b} + z * {c}) % 4294967296 FROM gram WHERE z IS NOT NULL AND (ink OR ink2 OR ink3)
), own AS (
  SELECT r, (xor(h, h >> 15) * 739982445) % 4294967296 >> 16 AS bucket, count(*) AS n FROM hashed GROUP BY ALL
), train AS (
  SELECT r, lang FROM d WHERE {'m <> 1' if split else 'true'} AND lang IS NOT NULL AND has
), prior AS (
  SELECT lang, ln((count(*) + 1) / (SELECT count(*) + count(DISTINCT lang) FROM train)) AS p FROM train GROUP BY lang
), counted AS (
  SELECT lang, bucket, sum(n) AS n FROM own JOIN train USING (r) GROUP BY ALL
), size AS (
  SELECT lang, sum(n) + {SMOOTHING * BUCKETS} AS total FROM counted GROUP BY lang
), score AS (
  SELECT o.r, p.lang, any_value(p.p) + sum(o.n * ln((coalesce(c.n, 0) + {SMOOTHING}) / s.total)) AS s
  FROM own o CROSS JOIN prior p JOIN size s USING (lang) LEFT JOIN counted c ON c.lang = p.lang AND c.bucket = o.bucket GROUP BY o.r, p.lang
), best AS (
  SELECT r, max(s) AS top, arg_max(lang, s) AS lang_pred FROM score GROUP BY r
), share AS (
  SELECT r, any_value(lang_pred) AS lang_pred, 1 / sum(exp(s - top)) AS score FROM score JOIN best USING (r) GROUP BY r
)
SELECT d.doc_id, coalesce(d.m = 1, false) AS held_out, coalesce(lang_pred, 'und') AS lang_pred, round(coalesce(score, 0), 6)::DOUBLE AS score FROM d LEFT JOIN share USING (r)
"""
