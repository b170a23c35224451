"""Periodic runs of words against brute force."""

import hashlib
import random
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import runs, words


def slow(ws, exponent=4, least=6):
    """All runs: every lag, every stretch, its smallest period."""
    out, n = [], len(ws)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            size = j + q - i
            own = ws[i : i + size]
            if j > i and size >= max(least, exponent * q) and not any(own[k:] == own[:-k] for k in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out)


def texts(n, r):
    for _ in range(n):
        few, size = r.choice([1, 2, 2, 3, 5]), r.randrange(0, 90)
        ws = [r.choice("abcde"[:few]) for _ in range(size)]
        if r.random() < 0.6 and size:
            a = r.randrange(size)
            p = r.randrange(1, max(2, (size - a) // 3 + 1))
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(size)]
            if r.random() < 0.5:
                ws[r.randrange(size)] = "z"
        yield " ".join(ws)


@pytest.mark.parametrize("exponent, least", [(4, 6), (5, 12), (4, 1)])
def test_runs_against_every_lag(exponent, least):
    batch = list(texts(600, random.Random(exponent)))
    row, start, length, period = runs.find(*words.word_hashes(*words.flat(pa.array(batch))), exponent, least)
    got = [[] for _ in batch]
    for r, *run in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[r].append(tuple(run))
    assert got == [slow(t.split(), exponent, least) for t in batch]


def test_levels_follow_on():
    got = list(runs.levels(40_000))
    assert got[0] == (1, 2, 3) and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:], strict=False)) and got[-1][1] >= 10_000
    with pytest.raises(ValueError):
        runs.find(*words.word_hashes(*words.flat(pa.array(["a"]))), exponent=3)


def test_long_texts_of_few_words():
    """5 MB of text: one word, two words in turn, and two words at random."""
    r, began = random.Random(1), time.time()
    for text in ("a " * 2_500_000, "a b " * 1_250_000, "".join(r.choice(("a ", "b ")) for _ in range(2_500_000))):
        row, start, length, period = runs.find(*words.word_hashes(*words.flat(pa.array([text]))))
        if text[:8] == text[-8:]:
            assert (start.tolist(), period.tolist()) == ([0], [len(set(text)) - 1])
    assert time.time() - began < 60


ROWS = [(10, "x a b a b a b a b a b y", 1), (11, None, 2), (12, "", 3), (13, " \n\t", 4), (14, "a a a a a a", 5), (14, "a a a a a a", 5), (None, "b b b b b b b", 6), (15, "one  two\nthree", 7), (16, "ü é ü é ü é ü é ü", 8)]


def test_runs_of_rows(spark):
    df = spark.createDataFrame([(a, b, c, "kept", b) for a, b, c in ROWS], "doc_id long, text string, runs long, `a.b` string, collapsed string")
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.runs(df).collect()]
    assert got == [
        (10, [(1, 10, 2)], "x a b y"), (11, [], ""), (12, [], ""), (13, [], ""), (14, [(0, 6, 1)], "a"), (14, [(0, 6, 1)], "a"), (None, [(0, 7, 1)], "b"), (15, [], "one two three"), (16, [(0, 9, 2)], "ü é"),
    ]
    assert runs.runs(df).columns == ["doc_id", "a.b", "runs", "collapsed"]
    assert runs.runs(df.limit(0)).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, t) for i, t in enumerate(texts(300, r))] + [(1000, None), (1001, ""), (None, "c c c c c c c"), (5, "a b c"), (5, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in rows:
        ws = (text or "").split()
        h = 1 if key is None else zlib.crc32(str(key).encode())
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        found = slow(ws)
        lost = {i for s, size, q in found for i in range(s + q, s + size)}
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        milli = None if top[0] is None else 1000 * top[1] // top[2]
        want.append((key, len(found), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in lost).encode()).hexdigest()))
    got = runs.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows if k is not None) > 20
    assert got.where(F.col("n_runs") > 0).count() > 50
