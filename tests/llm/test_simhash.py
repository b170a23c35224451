"""SimHash components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from factloom.llm import shared, simhash


def slow_print(text, k=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    grams = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_joined(rows, radius=4):
    """{row: (component, links)} over all pairs."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [(key, least.get(top(i)), links[i]) for i, (key, _) in enumerate(rows)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = ["", None, " \n ", "one", "One  TWO\tthree", "one two three", "a b c d", "a b c d e", "É é Ü ü ß x", "A b C d A b C d A b C d", "x " * 30_000, "a b c d\x1c e f\x85g h"]


def test_fingerprints_bit_by_bit():
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(r.randrange(60))) for _ in range(200)]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [slow_print(t) for t in texts]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


def test_pieces_cover_all_bits():
    for radius in (0, 1, 4, 6):
        assert sorted(b for a, n in simhash.pieces(radius) for b in range(a, a + n)) == list(range(64)) and len(simhash.pieces(radius)) == radius + 1


def near(base, r, bits):
    return base ^ sum(1 << b for b in r.sample(range(64), bits))


def cases():
    r = random.Random(7)
    centres = [r.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    some = [near(c, r, r.randrange(0, 6)) for c in centres for _ in range(25)] + [r.getrandbits(64) for _ in range(60)]
    low = r.getrandbits(40)  # three pieces and part of a fourth that all of these share
    hot = [low | r.getrandbits(24) << 40 for _ in range(150)]
    fps = some + hot + hot[:20] + [hot[0]] * 30
    r.shuffle(fps)
    keys = [None if r.random() < 0.03 else r.randrange(10_000) for _ in fps]
    return list(zip(keys, fps, strict=True))


@pytest.mark.parametrize("radius, tile, group, strip", [(4, 4096, 1 << 16, 512), (4, 16, 200, 8), (4, 5, 1, 3), (2, 8, 50, 4), (0, 8, 50, 4)])
def test_components_against_all_pairs(spark, radius, tile, group, strip, monkeypatch):
    """Also where a piece is shared by more rows than a tile holds, and a population count fills several tiles."""
    monkeypatch.setattr(simhash, "STRIP", strip)
    rows = cases()
    df = shared.written(spark.createDataFrame([(k, signed(f)) for k, f in rows], "key long, fp long"), "prints")
    got = [(r["key"], r["component_id"], r["n_links"]) for r in simhash.joined(df, radius, tile, group).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow_joined(rows, radius)))


def test_no_pairs_leave_a_tile(monkeypatch):
    """2,000 fingerprints within two bits of one: a forest of under 2,000 links."""
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = np.array(sorted({near(base, r, 2) for _ in range(3000)})[:1900], np.uint64)
    a, b, got, _ = simhash.compare(fps, None, np.ones(len(fps), np.int64), None, [])
    assert len(a) == len(fps) - 1 and (got == len(fps) - 1).all()


def test_linked_rows(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(50, "the quick brown fox jumps over the lazy dog", ""), (40, "THE quick brown  fox jumps over the lazy dog", ""), (50, "the quick brown fox jumps over the lazy dog", ""), (None, "one", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = simhash.linked(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id", "n_links"]
    prints = [(k, slow_print(t)) for k, t, _ in rows]
    want = [(k, f"{f:016x}", c, n) for (k, f), (_, c, n) in zip(prints, slow_joined(prints), strict=True)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert simhash.linked(df.limit(0)).collect() == []
