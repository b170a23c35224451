"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input joins an embedding of the word, if at least `MIN_DOCS` training rows have it, and the mean
embedding of its hashed character trigrams, so rare, misspelt and inflected forms have an input too. Two gated recurrent layers read each window of
`WIDTH` words forwards and backwards, attention pools their states, and a linear layer gives the window's logit. Windows
overlap by half and cover the whole text; a document's score is its highest window's logit, calibrated with
the number of windows.

Training reads at most about `FIT_TOXIC` toxic and `FIT_CLEAN` other labelled rows and `FIT_BYTES` bytes of each kind (drawn by a digest of the
key; rows of over `FIT_TEXT` bytes aren't drawn), in whole texts. Weights begin at random; the vocabulary keeps the most frequent words of the drawn rows, whatever their labels. Rows are
labelled as wholes: the first `WARM` epochs read random windows of either kind, then the network itself chooses, anew each epoch, the window of each row that it scores highest, and some random
windows of rows that aren't toxic. Scores are calibrated by cross-fitting, at every size: each of
`FOLDS` networks scores the rows that it wasn't trained on, and the network that is kept is trained on all drawn rows; the networks are
trained in tasks of their own. Scoring runs over all rows with the trained weights broadcast, whose size is fixed.

Defined results: a null text, or one without words, has score 0; without both kinds of labels every score is 0; where a key
has several labels it counts as toxic if one says so, where it has several texts training takes the one with the smallest digest;
repeated rows are scored each; an empty table gives an empty result;
extra columns are kept by `score`, except those named as its outputs.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .language import remainder

WIDTH, STRIDE = 32, 16
EMBED, HIDDEN = 8, 8
GRAM_BITS, MIN_DOCS = 12, 4
MAX_WORDS = 50_000  # the vocabulary keeps its most frequent words
FIT_TOXIC, FIT_CLEAN = 1500, 2500
FIT_BYTES, FIT_TEXT = 1 << 25, 1 << 20
FOLDS = 3
EPOCHS, BATCH, RATE = 8, 256, 0.02
#: Epochs that train on any windows, and windows of each kind in one of them (the sample of documents is bounded already).
WARM, WARM_WINDOWS = 2, 12_000
CHUNK = 1 << 20

#: A-Z becomes a-z, other ASCII that isn't a digit or letter becomes a blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Tokens:
    """Distinct words of some texts: ids of each word in reading order, buckets of the distinct words and of their trigrams."""

    ids: np.ndarray
    before: np.ndarray  # words before each row
    word: np.ndarray  # 64-bit hash of each distinct word
    gram: np.ndarray
    gram_at: np.ndarray


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    data = FOLD[data]
    start, end, before = words.bounds(data, at)
    hashes = words.span_hash(words.prefix(data), start, end)
    distinct, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size = (end - start)[first]
    gram_at = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start[first] - gram_at[:-1], size) + np.arange(gram_at[-1])  # each byte of each distinct word
    wide = np.concatenate([[32], data, [32]]).astype(np.uint32)
    left, mid, right = wide[place], wide[place + 1], wide[place + 2]
    left[gram_at[:-1]] = right[gram_at[1:] - 1] = 32  # also where one text meets another
    gram = (left * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F)
    gram = (gram * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - GRAM_BITS)
    return Tokens(ids, before, distinct, gram.astype(np.int32), gram_at)


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window and its row; rows without words have none."""
    n = np.diff(before)
    count = np.where(n > 0, np.maximum(0, -(-(n - WIDTH) // STRIDE)) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return before[row] + step * STRIDE, row


def take(ids: np.ndarray, start: np.ndarray, end: np.ndarray, none: int) -> np.ndarray:
    """WIDTH word ids for each window, as columns; `none` after the end of the text."""
    at = start + np.arange(WIDTH)[:, None]
    return np.where(at < end, ids[np.minimum(at, len(ids) - 1)], none)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


def new_network(vocab: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights; units run along the first axis of what the network computes. vocab: sorted hashes of the words
    that have an embedding; the last row of "word" stands for all others."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = {"vocab": vocab, "word": draw(len(vocab) + 1, EMBED, scale=0.1), "gram": draw(1 << GRAM_BITS, EMBED, scale=0.1), "att": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    for side in "fb":
        net |= {f"in_{side}": draw(3 * HIDDEN, 2 * EMBED, scale=0.3), f"rec_{side}": draw(3 * HIDDEN, HIDDEN, scale=0.3), f"add_{side}": np.zeros(3 * HIDDEN, np.float32)}
    return net


def lookup(vocab: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Row of each word in "word"."""
    at = np.searchsorted(vocab, word)
    known = at < len(vocab)
    known[known] = vocab[at[known]] == word[known]
    return np.where(known, at, len(vocab))


def inputs(net: dict, t: Tokens) -> np.ndarray:
    """Input of each distinct word, and of none (zeros): 2 * EMBED rows."""
    out = np.zeros((2 * EMBED, len(t.word) + 1), np.float32)
    out[:EMBED, :-1] = net["word"][lookup(net["vocab"], t.word)].T
    if len(t.word):
        out[EMBED:, :-1] = (np.add.reduceat(net["gram"][t.gram], t.gram_at[:-1]) / np.diff(t.gram_at)[:, None]).T
    return out


def run_side(net: dict, side: str, x: np.ndarray, ids: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """States of one direction for each step. x: 3 * HIDDEN rows of gate inputs by distinct word."""
    rec, h, out, n = net[f"rec_{side}"], np.zeros((HIDDEN, ids.shape[1]), x.dtype), [None] * len(ids), 2 * HIDDEN
    for t in range(len(ids)) if side == "f" else range(len(ids) - 1, -1, -1):
        a, g = x[:, ids[t]], rec @ h
        zr = sigmoid(a[:n] + g[:n])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        new = np.tanh(a[n:] + r * g[n:])
        if keep is not None:
            keep.append((t, h, z, r, new, g[n:]))
        h = new + z * (h - new)
        out[t] = h
    return out


def forward(net: dict, x: np.ndarray, ids: np.ndarray, none: int, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    sides = {s: run_side(net, s, net[f"in_{s}"] @ x + net[f"add_{s}"][:, None], ids, None if keep is None else keep.setdefault(s, [])) for s in "fb"}
    e = np.stack([net["att"][:HIDDEN] @ f + net["att"][HIDDEN:] @ b for f, b in zip(sides["f"], sides["b"], strict=True)])
    v = np.stack([net["out"][:HIDDEN] @ f + net["out"][HIDDEN:] @ b for f, b in zip(sides["f"], sides["b"], strict=True)])
    e = np.where(ids == none, -30, e)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    if keep is not None:
        keep |= {"w": w, "v": v, "states": sides}
    return (w * v).sum(axis=0) + net["bias"]


def backward(net: dict, x: np.ndarray, ids: np.ndarray, none: int, keep: dict, d: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of sum(d * logit), with that of x under "x"."""
    w, v, grad = keep["w"], keep["v"], {"bias": d.sum(keepdims=True), "x": np.zeros_like(x)}
    dv = w * d
    de = np.where(ids == none, 0, w * (v - (w * v).sum(axis=0)) * d)
    grad["att"], grad["out"] = np.zeros_like(net["att"]), np.zeros_like(net["out"])
    for k, side in enumerate("fb"):
        part = slice(k * HIDDEN, (k + 1) * HIDDEN)
        states, rec = keep["states"][side], net[f"rec_{side}"]
        for t, h in enumerate(states):
            grad["att"][part] += h @ de[t]
            grad["out"][part] += h @ dv[t]
        back, d_rec, d_gate = np.zeros_like(states[0]), np.zeros_like(rec), np.zeros((3 * HIDDEN, x.shape[1]), x.dtype)
        for t, h0, z, r, new, g in reversed(keep[side]):
            dh = back + net["att"][part, None] * de[t] + net["out"][part, None] * dv[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h0 - new) * z * (1 - z)
            dr = dn * g * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r])
            d_rec += dg @ h0.T
            back = dh * z + rec.T @ dg
            da = np.concatenate([dz, dr, dn])
            for row in range(3 * HIDDEN):
                d_gate[row] += np.bincount(ids[t], da[row], minlength=x.shape[1]).astype(x.dtype)
        grad[f"rec_{side}"], grad[f"add_{side}"] = d_rec, d_gate.sum(axis=1)
        grad[f"in_{side}"] = d_gate @ x.T
        grad["x"] += net[f"in_{side}"].T @ d_gate
    return grad


def sub_tokens(t: Tokens, used: np.ndarray) -> Tokens:
    size = np.diff(t.gram_at)[used]
    at = np.concatenate([[0], np.cumsum(size)])
    gram = t.gram[np.repeat(t.gram_at[:-1][used] - at[:-1], size) + np.arange(at[-1])]
    return Tokens(np.zeros(0, np.int64), np.zeros(1, np.int64), t.word[used], gram, at)


def train_step(net: dict, state: dict, t: Tokens, ids: np.ndarray, label: np.ndarray, rate: float) -> float:
    used, local = np.unique(ids, return_inverse=True)
    local, none = local.reshape(ids.shape), len(t.word)
    if len(used) and used[-1] == none:
        used = used[:-1]
    sub = sub_tokens(t, used)
    x, keep = inputs(net, sub), {}
    logit = forward(net, x, local, len(used), keep)
    p = sigmoid(logit)
    grad = backward(net, x, local, len(used), keep, ((p - label) / len(label)).astype(np.float32))
    dx = grad.pop("x")[:, :-1].T
    size = np.diff(sub.gram_at)
    for name, rows, d in (("word", lookup(net["vocab"], sub.word), dx[:, :EMBED]), ("gram", sub.gram, np.repeat(dx[:, EMBED:] / size[:, None], size, axis=0))):
        at, inv = np.unique(rows, return_inverse=True)
        total = np.zeros((len(at), EMBED), np.float32)
        np.add.at(total, inv, d)
        state[name][at] += total**2
        net[name][at] -= rate * total / (np.sqrt(state[name][at]) + 1e-4)
    state["step"] += 1
    for name, g in grad.items():
        m, s = state.setdefault(("m", name), np.zeros_like(g)), state.setdefault(("s", name), np.zeros_like(g))
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        k = state["step"]
        net[name] -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return float(-np.mean(np.log(np.where(label > 0, p, 1 - p) + 1e-7)))


def window_logits(net: dict, t: Tokens, start: np.ndarray, row: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    x, none = inputs(net, t), len(t.word)
    parts = [forward(net, x, take(t.ids, start[i : i + block], t.before[row[i : i + block] + 1], none), none) for i in range(0, len(start), block)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def folds(label: np.ndarray) -> np.ndarray:
    """The fold of each row; the rows of a label are dealt in turn."""
    out = np.zeros(len(label), np.int64)
    for v in (0, 1):
        at = np.flatnonzero(label == v)
        out[at] = np.arange(len(at)) % FOLDS
    return out


def calibration(top: np.ndarray, count: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of logit, log windows and one, from rows that their network hasn't seen."""
    has = count > 0
    if not has.any():
        return np.array([1.0, 0.0, 0.0])
    features = np.stack([top[has], np.log(count[has]), np.ones(has.sum())], axis=1).astype(float)
    return logistic(features, label[has], weight[has])


def top_windows(net: dict, texts: list[str], chunk: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The highest logit of each text's windows, and their number."""
    top, count = [], []
    for i in range(0, len(texts), chunk):
        t = tokens(*words.flat(pa.array(texts[i : i + chunk], pa.string())))
        start, row = windows(t.before)
        logit, n = window_logits(net, t, start, row), np.bincount(row, minlength=len(t.before) - 1)
        best = np.zeros(len(n))
        has = np.flatnonzero(n)
        if len(has):
            best[has] = np.maximum.reduceat(logit, (np.cumsum(n) - n)[has])
        top.append(best)
        count.append(n)
    return np.concatenate(top), np.concatenate(count)


def all_tokens(texts: list[str], chunk: int = 100) -> Tokens:
    """tokens() of many texts, some at a time, so that arrays over bytes stay small."""
    parts = [tokens(*words.flat(pa.array(texts[i : i + chunk], pa.string()))) for i in range(0, len(texts), chunk)]
    at = np.cumsum([0, *(len(p.word) for p in parts)])
    word, first, new = np.unique(np.concatenate([p.word for p in parts]), return_index=True, return_inverse=True)
    ids = np.concatenate([new[a:b][p.ids] for p, a, b in zip(parts, at, at[1:], strict=False)]).astype(np.int32)
    before = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.before) for p in parts]))])
    size = np.concatenate([np.diff(p.gram_at) for p in parts])
    grams, begin = np.concatenate([p.gram for p in parts]), np.concatenate([[0], np.cumsum(size)])[:-1]
    gram_at = np.concatenate([[0], np.cumsum(size[first])])
    return Tokens(ids, before, word, grams[np.repeat(begin[first] - gram_at[:-1], size[first]) + np.arange(gram_at[-1])], gram_at)


def block_logits(net: dict, t: Tokens, start: np.ndarray, row: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """window_logits() with inputs of only the words that some windows at a time have."""
    out, none = [np.zeros(0, np.float32)], len(t.word)
    for i in range(0, len(start), block):
        ids = take(t.ids, start[i : i + block], t.before[row[i : i + block] + 1], none)
        used, local = np.unique(ids, return_inverse=True)
        used = used[:-1] if len(used) and used[-1] == none else used
        out.append(forward(net, inputs(net, sub_tokens(t, used)), local.reshape(ids.shape), len(used)))
    return np.concatenate(out)


def learn(texts: list[str], label: np.ndarray, seed: int) -> dict[str, np.ndarray] | None:
    """Trained weights without calibration."""
    t = all_tokens(texts)
    start, row = windows(t.before)
    if not len(start):
        return None
    doc = np.repeat(np.arange(len(texts)), np.diff(t.before))
    held = np.bincount(np.unique(doc * np.int64(len(t.word)) + t.ids) % len(t.word), minlength=len(t.word))  # documents of each word, whatever their labels
    known = np.flatnonzero(held >= MIN_DOCS)
    known = np.sort(known[np.argsort(-held[known], kind="stable")][:MAX_WORDS])  # distinct words stand in the order of their hashes
    rng, net = np.random.default_rng(seed), new_network(t.word[known], seed)
    state = {"step": 0, "word": np.full_like(net["word"], 1e-4), "gram": np.full_like(net["gram"], 1e-4)}
    at = np.searchsorted(row, np.arange(len(texts)))
    has = np.flatnonzero(np.diff([*at, len(row)]) > 0)
    other = np.flatnonzero(label[row] == 0)
    for epoch in range(EPOCHS):
        if epoch < WARM:  # any windows of either kind
            toxic = np.flatnonzero(label[row] == 1)
            toxic = rng.choice(toxic, min(len(toxic), WARM_WINDOWS), replace=False)
            clean = rng.choice(other, min(len(other), len(toxic)), replace=False)
        else:  # each document's window that the network thinks worst, and other clean ones
            order = np.lexsort((-block_logits(net, t, start, row), row))
            best = order[at[has]]
            toxic, clean = best[label[has] == 1], best[label[has] == 0]
            clean = np.concatenate([clean, rng.choice(other, min(len(other), 2 * len(clean)), replace=False)])
        pick = rng.permutation(np.concatenate([toxic, clean]))
        size = int(np.clip(len(pick) // 24, 16, BATCH))  # some 24 steps an epoch, however few rows there are
        for i in range(0, len(pick), size):
            b = pick[i : i + size]
            train_step(net, state, t, take(t.ids, start[b], t.before[row[b] + 1], len(t.word)), label[row[b]], RATE * (0.5 if epoch >= EPOCHS - 2 else 1))
    return net


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a little shrinkage."""
    c = np.array([1.0, 0.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * c
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        c = c - np.clip(np.linalg.solve(hess, g), -2, 2)
    c[0] = max(c[0], 1e-3)
    return c


def document_scores(net: dict | None, col: pa.Array) -> np.ndarray:
    data, at = words.flat(col)
    out = np.zeros(len(at) - 1)
    t = tokens(data, at) if net is not None and len(data) else None
    if t is None or not len(t.ids):
        return out
    start, row = windows(t.before)
    logit = window_logits(net, t, start, row)
    has, first, n = np.unique(row, return_index=True, return_counts=True)
    x = np.stack([np.maximum.reduceat(logit, first), np.log(n), np.ones(len(n))], axis=1)
    out[has] = 1 / (1 + np.exp(-np.clip(x @ net["cal"], -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> dict[str, np.ndarray] | None:
    """docs: the rows that may be learned from. The drawn keys number about fit_toxic + fit_clean and are broadcast."""
    k, t = shared.columns([key, text])
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    sizes = docs.where(k.isNotNull()).select(k.alias("key"), F.coalesce(F.octet_length(t), F.lit(0)).alias("n")).where(F.col("n") <= FIT_TEXT)
    marks = marks.join(sizes.groupBy("key").agg(F.max("n").alias("n")), "key")
    total = {r["y"]: r for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).collect()}  # a row for each label
    share = {y: min(1.0, most / total[y]["c"], FIT_BYTES / max(1, total[y]["n"])) if y in total else 1.0 for y, most in ((1, fit_toxic), (0, fit_clean))}
    chance = F.pmod(F.xxhash64(F.col("key")), F.lit(1 << 30))
    drawn = marks.where(F.when(F.col("y") == 1, chance < int(share[1] * (1 << 30))).otherwise(chance < int(share[0] * (1 << 30)))).select("key", "y")
    rows = docs.select(k.alias("key"), t.alias("text")).join(F.broadcast(drawn), "key").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_TEXT)
    rows = rows.groupBy("key", "y").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    weight = {1: 1 / share[1], 0: 1 / share[0]}

    def train(table: pa.Table) -> pa.Table:
        """Of the part numbered FOLDS: the network trained on all rows. Of others: logits of the rows of the fold of that number."""
        part = table.column("part")[0].as_py()
        table = table.sort_by("key")
        y, texts = table.column("y").to_numpy().astype(np.float32), [x or "" for x in table.column("text").to_pylist()]
        own = np.flatnonzero(folds(y) == part)
        rest = np.setdiff1d(np.arange(len(y)), own)
        net = learn([texts[i] for i in rest], y[rest], 7) if 0 < y[rest].sum() < len(rest) else None
        blob, top, count = b"", np.zeros(0), np.zeros(0, np.int64)
        if net is not None and part == FOLDS:
            np.savez(out := io.BytesIO(), **net)
            blob = out.getvalue()
        elif net is not None and len(own):
            top, count = top_windows(net, [texts[i] for i in own])
        seen = y[own] if len(top) else np.zeros(0)
        columns = [pa.array([part], pa.int32()), pa.array([blob], pa.binary()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (top, count, seen))]
        return pa.Table.from_arrays(columns, names=["part", "net", "top", "windows", "y"])

    parts = rows.withColumn("part", F.explode(F.array(*map(F.lit, range(FOLDS + 1))))).repartitionByRange(FOLDS + 1, "part")
    found = {r["part"]: r for r in parts.groupBy("part").applyInArrow(train, "part int, net binary, top array<double>, windows array<double>, y array<double>").collect()}
    if FOLDS not in found or not found[FOLDS]["net"]:
        return None
    net = dict(np.load(io.BytesIO(found[FOLDS]["net"])))
    top, count, y = (np.concatenate([found[p][c] for p in sorted(found)]) for c in ("top", "windows", "y"))
    net["cal"] = calibration(top, count, y, np.where(y == 1, weight[1], weight[0]))
    return net


def score(df: DataFrame, net: dict | None, text: str = "text") -> DataFrame:
    """df without `text`, with score (0 to 1) and predicted."""
    keep, body = [c for c in df.columns if c not in (text, "score", "predicted")], shared.fresh(df, "__text")
    shipped = df.sparkSession.sparkContext.broadcast(net)  # fixed size

    def run(batches):
        for part in shared.chunks(batches, body, CHUNK):
            p = document_scores(shipped.value, part.column(body))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return shared.in_arrow(df.select(*shared.columns(keep), *(c.alias(body) for c in shared.columns([text]))), run, f"{shared.ddl(df, keep)}score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    net = fit(docs.where(remainder("doc_id", 5) != 0).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text"), net)
