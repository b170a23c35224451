"""Each operator against brute force and on rows that are null, empty, long, tied or repeated."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, language, licenses, mixing, neardup, pii, quality, shared, sharding, suffixes, toxicity, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"
rng = random.Random(3)
EN = "the cat and the dog went over hills to see what there was in that house by water".split()
DE = "der hund und die katze gingen über den hügel weil das haus nicht mehr dort am wasser stand".split()


def prose(vocab, n, r=rng):
    return " ".join(r.choice(vocab) for _ in range(n))


def rows():
    base = prose(EN, 120, random.Random(1))
    out = [(i, prose(EN if i % 2 else DE, 40), "en" if i % 2 else "de", f"s{i % 3}", 1, "x", "y") for i in range(24)]
    out += [(100, base, "en", "s0", 1, None, None), (101, base, "en", "s1", 1, None, None), (102, base.replace("cat", "cow", 1), "en", None, 1, None, None)]
    out += [(200, None, None, None, None, None, None), (201, "", "en", "s1", 0, "", ""), (202, " \n\t ", "de", "s1", 3, "", ""), (203, "123 456 !!", None, "s0", 1, "", "")]
    out += [(300, prose(EN, 20_000), "en", "s2", 1, "", ""), (None, "a text without a key", "en", "s0", 1, "", ""), (5, out[5][1], out[5][2], out[5][3], 1, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_word_kernels():
    texts = ["a  b\nc", None, "", " x ", "über\x0bcafé\x1cz"]
    data, at = words.flat(pa.array(texts))
    start, end, before = words.bounds(data, at)
    got = [[data[s:e].tobytes().decode() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(before, before[1:], strict=False)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    h, before = words.word_hashes(*words.flat(pa.array(["ab cd", "cd ab ab"])))
    assert h[0] == h[3] == h[4] and h[1] == h[2] and h[0] != h[1]
    sliced = pa.array(["skip", "a b", "c"]).slice(1)
    assert words.bounds(*words.flat(sliced))[2].tolist() == [0, 2, 3]


def test_language(docs, empty):
    model = language.fit(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert model.names == ["de", "en"]
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(24))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (200, 201, 202, 203))
    assert got[300]["lang_pred"] == "en" and got[300]["label"] == ""
    assert language.predict(empty, model).count() == 0
    none = language.fit(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    kept = {r["doc_id"] for r in language.accepted(docs, model).collect()}
    assert kept == {r[0] for r in rows()} - {200, 201, 202, 203}
    buckets, at, has = language.grams(["ab", None])
    assert has.tolist() == [True, False] and (buckets[0] < language.BUCKETS).sum() == 2 and (buckets[1] < language.BUCKETS).sum() == 1


def test_language_passes_over_many_languages(spark, docs, monkeypatch):
    """Blocks of one or two languages give what a single matrix gives."""
    table = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 1, "en2").otherwise(F.col("lang")))
    model = language.fit(table.select("doc_id", "text", "lang"))
    assert model.names == ["de", "en", "en2"]
    rows = lambda: sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in language.predict(table, model).collect())
    want = rows()
    for n in (1, 2):
        monkeypatch.setattr(language, "LANGUAGES", n)
        assert rows() == want
        assert language.accepted(table, model).columns == table.columns


def test_language_against_plain_counts():
    """The matrix and scores against counters over strings."""
    r = random.Random(21)
    texts = [(prose(EN, 8, r), "en") for _ in range(6)] + [(prose(DE, 8, r), "de") for _ in range(5)] + [("Größe 12 a\n!b", "de"), ("\U0001d400é x", "en")]

    def plain(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        out = Counter()
        for n in language.LENGTHS:
            for i in range(len(t) - n + 1):
                if t[i : i + n].strip():
                    h = (n * 0x27D4EB2F + sum(ord(c) * int(f) for c, f in zip(t[i : i + n], language.FACTORS, strict=False))) % 2**32
                    h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                    out[h >> 16] += 1
        return out

    buckets, at, has = language.grams([t for t, _ in texts])
    assert has.all()
    for k, (t, _) in enumerate(texts):
        got = Counter(buckets[:, at[k] : [*at, buckets.shape[1]][k + 1]].ravel().tolist())
        got.pop(language.BUCKETS, None)
        assert got == plain(t)


def slow_toxicity(net, text):
    """A document's score word by word and step by step."""
    low = bytes(toxicity.FOLD[b] for b in (text or "").encode())
    tokens = low.split()
    vocab = {int(h): i for i, h in enumerate(net["vocab"])}

    def one(w):
        h = int(words.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
        wide, grams = b" " + w + b" ", []
        for i in range(len(w)):
            g = (wide[i] * 0x9E3779B1 + wide[i + 1] * 0x85EBCA77 + wide[i + 2] * 0xC2B2AE3D) % 2**32 ^ 0x27D4EB2F
            grams.append(g * 0x2C1B3C6D % 2**32 >> 32 - toxicity.GRAM_BITS)
        return np.concatenate([net["word"][vocab.get(h, len(vocab))], net["gram"][grams].mean(axis=0)])

    def side(xs, s):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            a, g = net[f"in_{s}"] @ x + net[f"add_{s}"], net[f"rec_{s}"] @ h
            z, r = (1 / (1 + np.exp(-(a[k * n : k * n + n] + g[k * n : k * n + n]))) for k in (0, 1))
            new = np.tanh(a[2 * n :] + r * g[2 * n :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    best, count, start = -np.inf, 0, 0
    while tokens and (start == 0 or start + toxicity.WIDTH - toxicity.STRIDE < len(tokens)):
        part = [one(w) for w in tokens[start : start + toxicity.WIDTH]]
        pad = [np.zeros(2 * toxicity.EMBED)] * (toxicity.WIDTH - len(part))
        f, b = side(part + pad, "f"), side((part + pad)[::-1], "b")[::-1]
        states = [np.concatenate(x) for x in zip(f, b, strict=True)][: len(part)]
        e = np.array([net["att"] @ x for x in states])
        w = np.exp(e - e.max())
        best = max(best, sum(w * [net["out"] @ x for x in states]) / w.sum() + net["bias"][0])
        count, start = count + 1, start + toxicity.STRIDE
    return 0.0 if not count else 1 / (1 + np.exp(-(net["cal"] @ [best, np.log(count), 1])))


def test_toxicity_scores_against_plain_steps():
    r = random.Random(8)
    texts = [prose(EN, n, r) for n in (1, 5, 31, 32, 33, 48, 49, 100)] + ["Ü ber-Idiot! IDIOT 99", "", None]
    vocab = np.sort(words.word_hashes(*words.flat(pa.array([" ".join(EN[:8])])))[0])
    net = toxicity.new_network(np.unique(vocab), 3)
    net["cal"] = np.array([1.5, -0.2, 0.1])
    got = toxicity.document_scores(net, pa.array(texts))
    assert np.allclose(got, [slow_toxicity(net, t) for t in texts], atol=1e-5)


def test_toxicity_gradients():
    t = toxicity.tokens(*words.flat(pa.array(["a bb ccc dd e a bb you are", "z y x w a"])))
    net = {k: v.astype(float) if v.dtype != np.uint64 else v for k, v in toxicity.new_network(np.sort(t.word)[:4]).items()}
    start, row = toxicity.windows(t.before)
    ids, x, d = toxicity.take(t.ids, start, t.before[row + 1], len(t.word)), toxicity.inputs(net, t).astype(float), np.array([0.7, -1.3])
    toxicity.forward(net, x, ids, len(t.word), keep := {})
    grad = toxicity.backward(net, x, ids, len(t.word), keep, d)
    for name in ("att", "out", "in_f", "in_b", "rec_f", "rec_b", "add_f", "add_b"):
        at = tuple(n // 2 for n in net[name].shape)
        old, two = net[name][at], []
        for e in (1e-5, -1e-5):
            net[name][at] = old + e
            two.append(float((toxicity.forward(net, x, ids, len(t.word)) * d).sum()))
        net[name][at] = old
        assert abs((two[0] - two[1]) / 2e-5 - grad[name][at]) < 1e-6


def test_toxicity_windows_cover_all():
    before = np.array([0, 0, 1, 33, 33 + 65])
    start, row = toxicity.windows(before)
    for r in range(4):
        covered = {w for s in start[row == r] for w in range(s, min(s + toxicity.WIDTH, before[r + 1]))}
        assert covered == set(range(before[r], before[r + 1]))


def test_toxicity(spark, docs, empty):
    r = random.Random(5)
    made = [(i, prose(EN, 60, r) if i % 4 else " ".join([prose(EN, 30, r), "idiot", prose(EN, 10, r), "scum", prose(EN, 20, r)])) for i in range(240)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(240)] + [(0, 1, 1), (None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    net = toxicity.fit(table.where("doc_id < 180"), labels)
    got = toxicity.score(table.where("doc_id >= 180"), net).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got]) > 0.95
    odd = {r["doc_id"]: r for r in toxicity.score(docs, net).collect()}
    assert odd[200]["score"] == odd[201]["score"] == odd[202]["score"] == 0 and 0 <= odd[300]["score"] <= 1
    assert toxicity.score(empty, net).count() == 0
    assert toxicity.fit(empty.select("doc_id", "text"), labels) is None
    twice = table.where("doc_id < 60").unionByName(table.where("doc_id < 60").withColumn("text", F.lit("another text")))
    a, b = (toxicity.fit(twice.repartition(n), labels) for n in (1, 5))
    assert all(np.array_equal(a[k], b[k]) for k in a)
    few = toxicity.fit(table.where("doc_id < 4"), labels)  # one toxic row: nothing to calibrate with, but a network
    assert few is None or len(few["cal"]) == 3
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_licenses(spark, docs, empty):
    texts = ["Released under the MIT License.", "mit-license MIT\nLICENSE gnu General public LICENSE, version 3", "CC BY-NC 4.0 cc by", "the gnu general license", None, "", "Apache license " * 3, "émit license"]
    table = spark.createDataFrame([(i, t, "z", "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string, extra string")
    got = {r["doc_id"]: r for r in licenses.scan(table, licenses.index(*licenses.document_frequency(table))).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        want = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(want), ",".join(sorted({x for _, x in want})))
        assert (r["first_word"], r["last_word"]) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "gpl-3.0" in got[1]["labels"] and "cc-by-nc" in got[2]["labels"]
    assert licenses.scan(empty, licenses.index(*licenses.document_frequency(empty))).count() == 0
    assert licenses.scan(docs, licenses.index(0, {})).count() == docs.count()


def test_sharding(spark, docs, empty):
    names = sharding.names(7)
    table = sharding.fill_table(names, 101)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 40
    got = sharding.place(docs, "doc_id", names, 101).collect()
    assert len(got) == docs.count() and all(r["shard"] == names[table[r["slot"]]] for r in got)
    assert all(r["slot"] == sharding.digest(sharding.NULL_KEY if r["doc_id"] is None else str(r["doc_id"])) % 101 for r in got)
    clash = spark.createDataFrame([("a", 1), ("b", 2)], "shard string, slot int")
    assert sharding.place(clash, "shard", names, 101).columns == ["slot", "shard"]
    assert sharding.place(empty, "doc_id", names, 101).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, docs, empty):
    texts = [
        "mail a.b@c.d.e, x@y z@w.q a@b.c_d@e.f ü@x.y", "1.2.3.4.5.6.7.8 300.1.1.1 é 10.0.0.255", "card 4539 1488 0343 6467, 4539-1488-0343-6468 12345", "+1 (743) 555-3824 tel +49 30 1234567890 +12",
        "IBAN DE89 3704 0044 0532 0130 00 ok", "social security 123-45-6789", None, "", "\x01a@b.c\x02\x01 d@e.f", "9" * 5000 + " " + "a" * 5000 + "@", "x" + " 1.2.3.4" * 300,
    ]
    table = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: [tuple(x) for x in r["pii"]] for r in pii.detect(table).collect()}
    plain = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    ]
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(plain) for m in re.finditer(p, t or "") if ok(m.group()))
        assert [x[:4] for x in got[i] if x[3] in pii.BASE] == want, t
    assert [x[3] for x in got[4]] == ["iban"] and [x[3] for x in got[5]] == ["ssn"]
    assert pii.detect(empty).count() == 0 and pii.detect(docs).count() == docs.count()
    clash = pii.detect(table.withColumns({"pii": F.lit(1), "__email": F.lit(2)}))
    assert clash.columns == ["doc_id", "text", "spans", "pii", "__email"] and [tuple(x) for x in clash.where("doc_id = 0").first()["pii"]] == got[0]


def test_pii_in_long_dense_texts(spark):
    """Places and scores over many blocks of pieces, and in a time that grows with the text."""
    one = "contact a@b.c, server 10.0.0.1 x 123-45-6789 ssn "
    texts = [one * 3000, "".join(f"u{i}@h.org" + " " * (i % 90) for i in range(2000)), "5@a.b " * 40_000]
    began = time.time()
    got = [[tuple(x) for x in r["pii"]] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()]
    assert time.time() - began < 60
    single = [(8, 0, 13, "email"), (22, 1, 30, "ip"), (33, 5, 44, "ssn")]
    assert [x[:4] for x in got[0]] == [(s + k * len(one), o, e + k * len(one), kind) for k in range(3000) for s, o, e, kind in single]
    assert [x[:4] for x in got[1]] == [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts[1])]
    assert len(got[2]) == 40_000 and {x[4] for x in got[2]} == {0.9}


def test_suffix_sorting():
    r = random.Random(1)
    for _ in range(400):
        s = [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(1, 40))] + [0]
        assert suffixes.sort_suffixes(s) == sorted(range(len(s)), key=lambda i: s[i:])


def cut_by_hand(pairs):
    seen, out = {}, {}
    for k, t in sorted((k, t or "") for k, t in pairs if k is not None):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if seen.setdefault(w, (k, i)) != (k, i):
                gone[i : i + 100] = b"\1" * 100
        out[k] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("many", "hot"), [(1, 1), (3, 2), (2_000, 64), (1, 64)])
def test_suffix_dedup(spark, empty, many, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", many)
    monkeypatch.setattr(suffixes, "HOT", hot)
    r = random.Random(9)
    passage, short = prose(EN, 60, r), "a line of under a hundred bytes that many documents have around it"
    made = [(i, " ".join([prose(EN, 30, r), passage if i % 3 else passage[:150], short, prose(DE, 30, r)])) for i in range(30)]
    made += [(50, made[3][1]), (51, made[3][1][:200] + "X" + made[3][1][201:]), (52, "ab" * 300), (53, "x" * 99), (54, "x" * 250), (55, None), (56, ""), (57, "ü" * 120 + "é" * 3), (58, "ü" * 120)]
    made += [(60 + i, f"{i % 5}" * 20 + short + f"{i % 3}" * 25) for i in range(40)]
    table = spark.createDataFrame([(*x, "e", "f", "g") for x in made] + [(None, passage, "e", "f", "g")], "doc_id long, text string, n_bytes string, doc string, spans string").repartition(5)
    cut = suffixes.cut(table)
    assert cut.columns == ["doc_id", "doc", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {x["doc_id"]: tuple(x[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for x in cut.collect()}
    assert got.pop(None)[1] == 0
    assert got == cut_by_hand(made)
    assert suffixes.cut(empty.select("doc_id", "text")).count() == 0


def test_suffix_dedup_keys(spark):
    r = random.Random(11)
    long, again = prose(EN, 20_000, r), prose(DE, 40, r)
    rows = [("k2", again), ("k1", f"{again} tail"), ("k1", f"{again} tail"), ("k3", f"head {again}"), ("k3", long), ("k4", long[5_000:40_000])]
    got = {(x["k"], x["n_bytes"], x["n_removed"]) for x in suffixes.cut(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    order = sorted({k: None for k in rows}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    want = cut_by_hand([(i, t) for i, (_, t) in enumerate(order)])
    assert got == {(k, *want[i][:2]) for i, (k, _) in enumerate(order)}


def test_context_rows_in_small_batches():
    """grouped() gives the same rows however its input is cut into batches."""
    r = random.Random(12)
    rows = []
    for a in range(12):
        if a % 4 == 0:
            rows.append((a, suffixes.LOWEST, suffixes.LOWEST, 0, 0, suffixes.MARK, False))
        for c in range(r.randint(1, 3)):
            rows += [(a, c, d, d, 5, 0, a % 5 == 1) for d in range(r.randint(1, 3))]
    rows.append((99, 0, 7, 1, 2, suffixes.WHOLE, False))
    names = ["akey", "ckey", "doc", "lo", "len", "rel", "hot"]

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

    def found(sizes):
        batches, at = [], 0
        while at < len(rows):
            n = sizes()
            part = rows[at : at + n]
            at += n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            batches.append(pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], kind) for k, kind in enumerate(kinds)], names=names))
        return sorted(tuple(x.values()) for b in suffixes.grouped(Frame()).run(iter(batches)) for x in b.to_pylist())

    want = found(lambda: len(rows))
    anchors = {a: {x[1] for x in rows if x[0] == a and x[5] >= 0} for a in range(12)}
    assert {x[0] for x in want if not x[5]} == {a for a, c in anchors.items() if len(c) > 1 or a % 4 == 0 or a % 5 == 1}
    assert {x[0] for x in want if not x[5] and x[6]} == {a for a in anchors if a % 4 == 0 or a % 5 == 1}
    for _ in range(30):
        assert found(lambda: r.randint(1, 4)) == want


def bag(t):
    w = (t or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    i = sum((a & b).values())
    return i / max(1, sum(a.values()) + sum(b.values()) - i)


def test_bagminhash_is_unbiased():
    for a, b in (("a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s X"), ("x y z w v " * 30 + "q r s t u m", "x y z w v " * 20 + "q r s t u m l k")):
        found = []
        for k in range(40):
            x, y = (" ".join(w + str(k) for w in t.split()) for t in (a, b))
            row, h, w, _ = neardup.bags(*words.flat(pa.array([x, y])))
            s = neardup.signatures(row, h, w, 2)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - jaccard(bag(a), bag(b))) < 4 * np.std(found) / 40**0.5 + 0.005


def test_near_duplicates(spark, docs, empty):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    made = [(i, prose(vocab, 150, r)) for i in range(30)]
    for g in range(6):  # chains of edits: the ends may only be linked through the middle
        w = prose(vocab, 150, r).split()
        for k in range(8):
            made.append((100 + 10 * g + k, " ".join(w)))
            w[r.randrange(150)] = "edit"
            w[r.randrange(150)] = f"edit{k}"
    made += [(300, made[0][1]), (301, ""), (302, None), (303, "one"), (304, "one"), (305, "two words"), (306, "rep " * 400), (307, "rep " * 420), (308, "rep " * 200)]
    table = spark.createDataFrame([(*x, "c") for x in made] + [(None, made[1][1], "c")], "doc_id long, text string, node string").repartition(3)
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(table).collect()}
    parent = {k: k for k, _ in made}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {k: bag(t) for k, t in made}
    for x, y in ((x, y) for x in bags for y in bags if x < y):
        if jaccard(bags[x], bags[y]) >= 0.8 or (not bags[x] and not bags[y]):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    assert {k: got[k] for k in bags} == {k: root(k) for k in bags} and got[None] is None
    assert neardup.classes(empty).count() == 0
    kept = neardup.one_of_each(table).collect()
    assert sorted(x["doc_id"] for x in kept if x["doc_id"] is not None) == sorted({root(k) for k in bags}) and neardup.one_of_each(docs).columns == docs.columns


def test_near_duplicates_of_repeated_keys(spark):
    r = random.Random(14)
    vocab = [f"w{i}" for i in range(400)]
    a, b, c = (prose(vocab, 60, r) for _ in range(3))
    first, second = sorted((a, b), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = [("k1", first, "x"), ("k1", second, "y"), ("k2", second, "z"), ("k3", f"{first} end", "u"), (None, first, "v"), ("k4", c, "w"), ("k4", c, "w2"), ("k4", c, "w")]
    table = spark.createDataFrame(rows, "k string, text string, class_id string")
    for n in (1, 7):
        got = sorted((str(x["k"]), x["class_id"]) for x in neardup.classes(table.repartition(n), "k").collect())
        assert got == [("None", None), ("k1", "k1"), ("k1", "k1"), ("k2", "k2"), ("k3", "k1")] + [("k4", "k4")] * 3
        kept = neardup.one_of_each(table.repartition(n), "k").collect()
        assert sorted((str(x["k"]), x["text"]) for x in kept) == [("None", first), ("k1", first), ("k2", second), ("k4", c)]
    assert len({x["class_id"] for n in (1, 4) for x in neardup.one_of_each(table.repartition(n), "k").where("k = 'k4'").collect()}) == 1


def test_decontamination(spark, docs, empty):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, prose(vocab, 30, r)) for i in range(8)] + [(20, "just six words in this item"), (21, "too short"), (22, None), (23, "")]
    made = [(i, prose(vocab, 100, r)) for i in range(10)]
    w = items[3][1].split()
    made += [(50, f"x y {items[0][1].upper()}, z"), (51, prose(vocab, 9, r) + " " + " ".join("sub" if k % 6 == 5 else v for k, v in enumerate(w)) + " tail"), (52, " ".join(items[4][1].split()[:18])), (53, " ".join(items[5][1].split()[:6])), (54, "a just six words in this item b"), (55, None), (56, "too short")]
    table = spark.createDataFrame([(*x, "c") for x in made + made[10:11]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"]) for x in decontamination.contained(table, bench).collect())
    assert got == [(50, 0), (50, 0), (51, 3), (52, 4), (54, 20)]
    assert sorted((x["doc_id"], x["item_id"]) for x in decontamination.contained(table, bench, block_chars=300).collect()) == got
    assert sorted(x["doc_id"] for x in decontamination.without(table, bench).collect()) == sorted({k for k, _ in made} - {50, 51, 52, 54})
    assert decontamination.contained(table, bench.limit(0)).count() == 0 and decontamination.contained(empty, bench).count() == 0
    assert decontamination.without(docs, bench).count() == docs.count()


def slow_contained(texts, items, min_words):
    """{(text, item): (matched, segment, first)} by laying each item at every place where a mask agrees."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = {}
    for i, t in enumerate(texts):
        a = split(t)
        for j, x in enumerate(items):
            b = split(x)
            if len(b) < min_words:
                continue
            masks = [[k for k, c in enumerate(m) if c == "1"] for m in decontamination.MASKS] + [list(range(len(b)))] * (len(b) < 10)
            for first in range(-len(b) + 1, len(a)):
                same = {k: a[first + k] == b[k] for k in range(len(b)) if 0 <= first + k < len(a)}
                if not any(all(same.get(p + k, False) for k in m) for m in masks for p in range(len(b) - m[-1])):
                    continue
                places, best = sorted(same), (0, 0, 0, 0)
                for s in range(len(places)):
                    for e in range(s, len(places)):
                        n = sum(same[k] for k in places[s : e + 1])
                        score = n - decontamination.PENALTY * (e + 1 - s - n)
                        if score > best[0] or (score == best[0] and best[0] and e + 1 == best[2] and s < best[1]):
                            best = (score, s, e + 1, n)
                n = best[3]
                if n >= min(min_words, len(b)) and (2 * n >= len(b) or n >= decontamination.LONG_MATCH) and n > out.get((i, j), (0,))[0]:
                    out[i, j] = (n, best[2] - best[1], max(first, 0) + best[1])
    return out


def test_decontamination_against_all_alignments(spark):
    r = random.Random(17)
    vocab = [f"w{i}" for i in range(40)]
    items = [prose(vocab, n, r) for n in (3, 5, 8, 12, 25, 40)] + [None, "w1"]
    texts = [prose(vocab, 60, r) for _ in range(4)] + [None, ""]
    for x in items[:6]:
        for share in (0.0, 0.1, 0.25, 0.4):
            w = ["sub" if r.random() < share else v for v in x.split()]
            texts.append(f"{prose(vocab, 10, r)} {' '.join(w)} {prose(vocab, 10, r)}")
            texts.append(" ".join(w[len(w) // 3 :]).upper() + "! tail")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    table = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_words string, extra int")
    for min_words, chars in ((5, 10**6), (1, 10**6), (5, 200)):
        found = decontamination.contained(table, bench, min_words=min_words, block_chars=chars)
        assert found.columns == ["doc_id", "extra", "item_id", "matched_words", "segment_words", "item_words", "first_word"]
        got = {(x["doc_id"], x["item_id"]): (x["matched_words"], x["segment_words"], x["first_word"]) for x in found.collect()}
        assert got == slow_contained(texts, items, min_words)
        clean = {x["doc_id"] for x in decontamination.without(table, bench, min_words=min_words, block_chars=chars).collect()}
        assert clean == set(range(len(texts))) - {i for i, _ in got}


@pytest.mark.parametrize("hot, cells", [(2, 1 << 21), (1, 300), (0, 1 << 21)])
def test_decontamination_of_hot_seeds(hot, cells, monkeypatch):
    """Items that share phrases, also twice in one item, in parts, in all of an item, and as whole items, give what all alignments give."""
    monkeypatch.setattr(decontamination, "HOT", hot)
    monkeypatch.setattr(decontamination, "CELLS", cells)
    r = random.Random(23)
    vocab = [f"w{i}" for i in range(60)]
    phrase, other = prose(vocab, 14, r), prose(vocab, 11, r)
    half = " ".join(phrase.split()[:10])
    items = [f"{prose(vocab, r.randrange(12), r)} {phrase} {prose(vocab, r.randrange(25), r)}" for _ in range(8)]
    items += [f"{phrase} {prose(vocab, 4, r)} {phrase}", f"{half} {prose(vocab, 20, r)}", f"{other} {phrase}", f"{prose(vocab, 9, r)} {other}", phrase, phrase, "six words that five items have", "six words that five items have", "six words that five items have", "", None]
    texts = [f"{prose(vocab, 10, r)} {phrase} {prose(vocab, 10, r)}", f"{half} {prose(vocab, 30, r)}", f"{prose(vocab, 5, r)} {other}", f"{phrase} {phrase} {other} {phrase}", "the six words that five items have here", None, phrase]
    for x in items[:12]:
        texts += [f"{prose(vocab, 6, r)} {x}", " ".join("sub" if r.random() < 0.15 else v for v in x.split()), " ".join(x.split()[5:])]
    index = decontamination.build(list(range(len(items))), items)
    got = {(a, b): (m, n, f) for a, b, m, n, f in decontamination.find(index, pa.array(texts)).tolist()}
    assert got == slow_contained(texts, items, decontamination.MIN_WORDS) and len(got) > 60


def test_decontamination_of_a_phrase_in_all_items():
    """One phrase of 14 words in 2,000 items and 2,000 texts, 40 of which hold an item."""
    r, began = random.Random(1), time.time()
    vocab = [f"w{i}" for i in range(3000)]
    phrase = prose(vocab, 14, r)
    items = [f"{prose(vocab, 15, r)} {phrase} {prose(vocab, 12, r)}" for _ in range(2000)]
    texts = [f"{prose(vocab, 60, r)} {phrase} {prose(vocab, 60, r)}" for _ in range(1960)] + [f"x {items[7 * i]} y" for i in range(40)]
    index = decontamination.build(list(range(2000)), items)
    got = decontamination.find(index, pa.array(texts))
    assert got[:, :3].tolist() == [[1960 + i, 7 * i, 41] for i in range(40)] and len(index.classes) == 1
    assert time.time() - began < 20


def test_targets():
    for sizes in ({"a": 10, "b": 100, None: 5}, {"a": 1, "b": 1000, "c": 0}, {}, {"a": 7}, {f"s{i}": (i * 37) % 91 for i in range(40)}):
        got = mixing.targets(sizes)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 and all(got[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert mixing.targets({"a": 100, "b": 10, "c": 100}) == {"a": 180 / 4, "b": 30.0, "c": 180 * 3 / 4}


def test_flow_prefers_unused_words():
    # b's quota could take the shared documents, but then a would have to repeat its own
    got = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10})
    used = {p: sum(v for (q, _), v in got.items() if q == p) for p in [("a",), ("a", "b"), ("b",)]}
    assert all(abs(v - 10) < 1e-6 for v in used.values())
    more = mixing.min_cost_flow({("a",): 10, ("b",): 10}, {"a": 25, "b": 5})
    assert abs(more[("a",), "a"] - 25) < 1e-6 and abs(more[("b",), "b"] - 5) < 1e-6
    assert mixing.min_cost_flow({("a",): 10}, {"a": 99})[("a",), "a"] == 30


def slow_flow(supply, quotas, costs=mixing.COSTS):
    """Largest flow at the least cost by single shortest augmenting paths; returns (words, cost)."""
    arcs = {}
    for p, n in supply.items():
        for k, c in enumerate(costs):
            arcs["from", (p, k)], arcs[(p, k), p] = [n, c], [n, 0]
            arcs[(p, k), "from"], arcs[p, (p, k)] = [0, -c], [0, 0]
        for s in p:
            arcs[p, ("s", s)], arcs[("s", s), p] = [float("inf"), 0], [0, 0]
    for s, q in quotas.items():
        arcs[("s", s), "to"], arcs["to", ("s", s)] = [q, 0], [0, 0]
    words_, cost = 0, 0
    while True:
        best, back = {"from": 0}, {}
        for _ in range(len(arcs)):
            for (a, b), (cap, c) in arcs.items():
                if cap > 1e-9 and a in best and best[a] + c < best.get(b, float("inf")) - 1e-9:
                    best[b], back[b] = best[a] + c, a
        if "to" not in best:
            return words_, cost
        path, b = [], "to"
        while b != "from":
            path.append((back[b], b))
            b = back[b]
        push = min(arcs[e][0] for e in path)
        for a, b in path:
            arcs[a, b][0] -= push
            arcs[b, a][0] += push
        words_, cost = words_ + push, cost + push * best["to"]


def test_flow_against_single_paths():
    r = random.Random(6)
    for _ in range(60):
        names = "abcde"[: r.randint(1, 5)]
        supply = {tuple(sorted(r.sample(names, r.randint(1, len(names))))): r.randint(0, 20) for _ in range(r.randint(1, 8))}
        quotas = {s: r.randint(0, 60) for s in names}
        got = mixing.min_cost_flow(supply, quotas)
        of = {p: sum(x for (q, _), x in got.items() if q == p) for p in supply}
        assert all(x >= -1e-9 for x in got.values())
        assert all(sum(x for (_, t), x in got.items() if t == s) <= q + 1e-6 for s, q in quotas.items())
        cost = sum(sum(c * min(max(x - k * supply[p], 0), supply[p]) for k, c in enumerate(mixing.COSTS)) for p, x in of.items())
        assert (round(sum(of.values()), 4), round(cost, 4)) == tuple(round(v, 4) for v in slow_flow(supply, quotas))


def test_flow_of_many_patterns():
    r = random.Random(7)
    names = [f"s{i}" for i in range(300)]
    supply = {tuple(sorted(r.sample(names, r.randint(1, 4)))): r.randint(1, 1000) for _ in range(100_000)}
    quotas = {s: r.randint(1, 600_000) for s in names}
    began = time.time()
    got = mixing.min_cost_flow(supply, quotas)
    assert time.time() - began < 60
    total, of = defaultdict(float), defaultdict(float)
    for (p, s), x in got.items():
        total[s] += x
        of[p] += x
    assert all(total[s] <= quotas[s] + 1e-3 for s in names) and all(of[p] <= 3 * n + 1e-3 for p, n in supply.items())


def test_mixing_keeps_clashing_columns(spark):
    names = ["pattern", "copies", "pattern_size", "flow", "__h", "__pattern", "whole", "cut"]
    made = [(i, "one two three", f"s{i % 2}", *["mine"] * len(names)) for i in range(40)] + [(7, None, None, *["mine"] * len(names))] * 2
    table = spark.createDataFrame(made, f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in names)}")
    out = mixing.repeat(table, mixing.decide(mixing.sized(table)))
    assert out.columns == table.columns and all(r[c] == "mine" for r in out.collect() for c in names)
    whole = mixing.mix(table.withColumns({"sources": F.array("source"), "size": F.lit(3)}))
    assert whole.count() == 42 and all(r["cut"] == "mine" and r["pattern"] != "mine" and r["taken"] == 3 * r["copies"] for r in whole.collect())


def test_mixing(docs, empty):
    table = mixing.sized(docs)
    got = mixing.mix(table).collect()
    assert len(got) == docs.count()
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    total, flow = defaultdict(int), {}
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        total[r["source"]] += r["taken"]
        flow[r["source"]] = r["flow"]
    assert all(abs(total[s] - flow[s]) <= 60 for s in total if s != "s2")
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table).collect()))
    assert mixing.mix(mixing.sized(empty)).count() == 0


def test_overlapping_sources(spark):
    made = [(i, 10, [["a"], ["b"], ["a", "b"], ["b", "a", "a"]][i % 4]) for i in range(400)]
    table = shared.written(spark.createDataFrame(made, "doc_id long, size long, sources array<string>"), "t")
    got = mixing.mix(table, quotas={"a": 1500.0, "b": 2500.0}).collect()
    assert sum(r["taken"] for r in got) == 4000 and {r["copies"] for r in got} == {1}


def test_quality(docs, empty, spark):
    line = "this very line is everywhere"
    made = [(i, line + "\n" + prose(EN, 60), f"h{i % 2}") for i in range(60)] + [(100 + i, (line + "\n") * 12 + "own words here", "h0") for i in range(3)] + [(200, None, None), (201, "", "h0"), (202, "a b c " * 30, "h1")]
    table = spark.createDataFrame([(*x, 1) for x in made], "doc_id long, text string, source string, kept int")
    got = {r["doc_id"]: r for r in quality.rules(table, max_docs=20).collect()}
    for i, t, _ in made:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(repeated), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    assert all(got[i]["kept"] and got[i]["removed_words"] == 5 for i in range(60))
    assert not any(got[i]["kept"] for i in (100, 101, 102, 200, 201, 202))
    assert quality.rules(empty).count() == 0 and quality.rules(docs).count() == docs.count()
    clash = table.withColumns({c: F.lit("mine") for c in ("removed_words", "__lines", "__row", "base_failed", "host", "h", "clean_text", "__text_in", "__gone")})
    both = {r["doc_id"]: r for r in quality.rules(clash, max_docs=20, cleaned=True).collect()}
    assert all((both[i]["kept"], both[i]["removed_words"], both[i]["host"], both[i]["__lines"]) == (got[i]["kept"], got[i]["removed_words"], "mine", "mine") for i, _, _ in made)
    assert both[0]["clean_text"] == made[0][1].split("\n")[1] and both[200]["clean_text"] is None


def test_quality_gives_the_text_without_common_lines(spark):
    made = [(i, f"own line {'abcdefg'[i]}\n\nThis  LINE 7 is\tshared\nEnd ü {'abcdefg'[i]}", "h") for i in range(4)] + [(9, "This line 1 is shared\nx", "other"), (10, None, "h"), (11, "", None)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: (r["clean_text"], r["removed_words"]) for r in quality.rules(table, max_docs=3, cleaned=True).collect()}
    assert got == {i: (f"own line {'abcdefg'[i]}\n\nEnd ü {'abcdefg'[i]}", 5) for i in range(4)} | {9: (made[4][1], 0), 10: (None, 0), 11: ("", 0)}
    assert "clean_text" not in quality.rules(table).columns


def test_suffix_dedup_gives_the_kept_bytes(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    table = spark.createDataFrame([(1, passage), (2, "before it " + passage + " and after"), (3, "ü"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixes.cut(table, kept=True).collect()}
    assert {k: bytes(r["kept_bytes"]) for k, r in got.items()} == {1: passage.encode(), 2: b"before it  and after", 3: "ü".encode(), 4: b""}
    assert all(hashlib.sha256(r["kept_bytes"]).hexdigest() == r["kept_sha256"] for r in got.values())


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    made = [(i, prose(vocab, 80, r), "en", f"s{i % 3}", 1) for i in range(60)]
    leak = prose(vocab, 30, r)
    made += [(100, made[0][1], "en", "s0", 1), (101, made[1][1] + " end", "en", "s1", 1), (102, f"{prose(vocab, 50, r)} {leak}", "en", "s2", 1), (103, "12 34", "en", "s0", 1), (104, None, "en", "s0", 1)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = shared.documents(spark, str(tmp_path)), []
    for name, stage in pipeline.STAGES:
        docs = shared.written(stage(spark, docs, str(tmp_path)), name)
        kept.append({x["doc_id"] for x in docs.select("doc_id").collect()})
        assert name == "shard" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept[0] == {x[0] for x in made} - {103, 104}
    assert kept[1] == kept[0] - {100, 101} and kept[2] == kept[1] - {102} and kept[3] == kept[4] <= kept[2]
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_columns_with_dots(spark, tmp_path):
    """Names with dots and backticks, and names like the outputs', pass through every operator that keeps columns."""
    rows = [(i, prose(EN, 60, random.Random(i)), "en", "s", 1.5, "x", 7) for i in range(6)]
    df = spark.createDataFrame(rows, "`doc.id` long, text string, lang string, source string, `a.b` double, `c``d` string, slot int")
    keep = lambda out: {c for c in out.columns} >= {"doc.id", "a.b", "c`d"} and out.count() == 6
    assert keep(sharding.place(df, "doc.id", sharding.names(4))) and sharding.place(df, "doc.id", sharding.names(4)).columns[-2:] == ["slot", "shard"]
    assert keep(licenses.scan(df, licenses.index(*licenses.document_frequency(df)))) and keep(quality.rules(df))
    assert keep(decontamination.without(df, spark.createDataFrame([(1, "no such item in here")], "item_id int, text string")))
    assert keep(language.accepted(df, language.fit(df.select(F.col("`doc.id`").alias("doc_id"), "text", "lang"))))


def test_licenses_against_every_alignment():
    """Templates with words changed, cut and moved: the index finds what laying each template at every place finds."""
    r = random.Random(31)
    frequency = {w: r.randrange(0, 500) for w in licenses.vocabulary()}
    found = licenses.index(500, frequency)
    vocab = sorted(w.decode() for w in licenses.vocabulary())
    for e in found.entries * 3:
        own = [w.decode() for w in e.words]
        ws = [r.choice(vocab) if r.random() < r.choice((0, 0.1, 0.4)) else w for w in own[r.choice((0, 0, len(own) // 3)) :]]
        text = [w.encode() for w in f"{prose(vocab, 20, r)} {' '.join(ws)} {prose(vocab, 15, r)}".split()]
        base, more = [], {}
        for x in found.entries:
            for s in range(-len(x.words), len(text)):
                hit = [0 <= s + k < len(text) and text[s + k] == w for k, w in enumerate(x.words)]
                share = sum(w for w, h in zip(x.weights, hit, strict=True) if h) / x.total
                if all(hit[x.key : x.key + x.key_len]) and (x.base or share >= licenses.MIN_SHARE):
                    base += [(s, x.label)] if x.base else []
                    more |= {} if x.base else {x.label: max(share, more.get(x.label, 0))}
        assert licenses.scan_words(text, found) == (sorted(base), more)


def test_similarity_with_the_text_that_names_the_class(spark):
    """A chain: each text is like the next, the last is less like the first."""
    ws = [f"w{i}" for i in range(100)]
    texts = [" ".join(ws[:k] + [f"x{i}" for i in range(k, 100)]) for k in (100, 94, 88)] + ["other words than these"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[1]])], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["copy"], round(r["similarity"], 9)) for r in neardup.classes(df, measured=True).collect()}
    like = lambda i, j: round(jaccard(bag(texts[i]), bag(texts[j])), 9)
    assert got == {0: (0, False, 1.0), 1: (0, False, like(0, 1)), 2: (0, False, like(0, 2)), 3: (3, False, 1.0), 4: (0, True, like(0, 1))} and like(0, 2) < 0.8 <= like(1, 2)
