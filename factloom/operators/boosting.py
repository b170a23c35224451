"""Classifiers whose training is sums over rows: out-of-fold discriminants from sufficient statistics, and boosted trees from histograms."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def fold_statistics(df: DataFrame, fold: str, label: str, features: list[str]) -> DataFrame:
    """J8, first step: rows, sums and sums of squares of each fold and class: fold, label, n, s and q (arrays in the order of features)."""
    one = [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)] + [F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q{i}") for i, c in enumerate(features)]
    g = df.where(F.col(label).isNotNull()).groupBy(fold, label).agg(F.count(F.lit(1)).cast("double").alias("n"), *one)
    return g.select(fold, label, "n", *[F.array(*[F.col(f"{x}{i}") for i in range(len(features))]).alias(x) for x in "sq"])


def discriminant(total: Row, own: Column, k: int, rows: float, floor: float, nth: int, label: str) -> Column:
    """A class whose sums are the totals less a fold's own, as its weight and each feature's mean, variance and log variance; null where nothing is left."""
    left = lambda name, i: F.get(F.lit(list(total[name])), i) - F.coalesce(F.get(own[name], i), F.lit(0.0))
    n = F.lit(total["n"]) - F.coalesce(own["n"], F.lit(0.0))
    moments = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct((left("s", i) / n).alias("m"), (left("q", i) / n).alias("e")))
    spread = F.transform(moments, lambda t: F.struct(t["m"].alias("m"), F.greatest(t["e"] - t["m"] * t["m"], F.lit(floor)).alias("v")))
    parts = F.transform(spread, lambda t: F.struct(t["m"].alias("m"), t["v"].alias("v"), F.log(t["v"]).alias("l")))
    return F.when(n > 0, F.struct(F.log(n / rows).alias("w"), F.lit(-nth).alias("o"), F.lit(total[label]).alias("cls"), parts.alias("parts")))


def density(model: Column, k: int) -> Column:
    """The log density of `__x` under a class."""
    fit = F.lit(0.0)
    for i in range(k):
        part = F.get(model["parts"], F.lit(i))
        d = F.get("__x", F.lit(i)) - part["m"]
        fit = fit - 0.5 * (part["l"] + d * d / part["v"])
    return model["w"] + fit


def out_of_fold(df: DataFrame, fold: str, label: str, features: list[str], floor: float = 1e-3) -> DataFrame:
    """Df with `predicted`, the class of each row by a model that has not seen its fold, and its `margin` over the second. The model is a Gaussian discriminant with a variance
    for each class and feature (at least `floor`), so a fold's model is the totals less the fold's own sums: one pass gives all of them, a million documents
    as easily as four, and a model is worked out once for each fold. Rows whose label is null are predicted, and teach nothing; ties go to the first class; the totals (classes times
    features) are one small row. df is read three times; in buckets of the fold it is not shuffled."""
    stats = fold_statistics(df, fold, label, features)
    k = len(features)
    total = stats.groupBy(label).agg(F.sum("n").alias("n"), *[F.array(*[F.sum(F.col(x)[i]) for i in range(k)]).alias(x) for x in "sq"]).orderBy(label).collect()
    if not total:
        return df.withColumns({"predicted": F.lit(None).cast(df.schema[label].dataType), "margin": F.lit(None).cast("double")})
    own = stats.groupBy(fold).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), F.struct("n", "s", "q")))).alias("own"))  # classes at most
    all_n = sum(r["n"] for r in total)
    models = lambda sums: F.array(*[discriminant(r, sums(r[label]), k, all_n, floor, i, label) for i, r in enumerate(total)])
    none = F.lit(None).cast("struct<n: double, s: array<double>, q: array<double>>")
    out = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in features])).join(own.select(fold, models(lambda c: F.col("own")[F.lit(c)]).alias("__own")), fold, "left")
    known = F.filter(F.coalesce("__own", models(lambda c: none)), lambda m: m.isNotNull())
    scores = F.filter(F.transform(known, lambda m: F.struct(density(m, k).alias("score"), m["o"].alias("o"), m["cls"].alias("cls"))), lambda s: s["score"].isNotNull())
    out = out.withColumn("__best", F.slice(F.reverse(F.array_sort(scores)), 1, 2))
    return out.withColumns({"predicted": F.get("__best", F.lit(0))["cls"], "margin": F.get("__best", F.lit(0))["score"] - F.get("__best", F.lit(1))["score"]}).drop("__x", "__best", "__own")


#: Gradients are summed as whole multiples of this, so that sums don't depend on their order.
UNIT = 2.0**-24


@dataclass
class Trees:
    """Boosted trees of all classes: a round has a tree for each class, a tree a feature and a bin for each inner node, and a value for each leaf."""

    edges: list[np.ndarray]  # of each feature's bins
    classes: list
    depth: int
    rate: float
    feature: list[np.ndarray] = field(default_factory=list)  # a round: classes x inner nodes
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)  # classes x leaves

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def nodes(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after some levels, for one class (nodes of a level are numbered from 0)."""
        at = np.zeros(len(b), np.int64)
        for level in range(levels):
            inner = (1 << level) - 1 + at
            at = 2 * at + (b[np.arange(len(b)), feature[inner]] > cut[inner])
        return at

    def scores(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(b), len(self.classes)))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            for k in range(len(self.classes)):
                out[:, k] += leaf[k][self.nodes(b, feature[k], cut[k], self.depth)]
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histogram(model: Trees, b: np.ndarray, y: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, bins: int) -> np.ndarray:
    """Sums of gradients and curvatures (2, in units) by class, node, feature and bin."""
    p = softmax(model.scores(b))
    k, n = p.shape[1], b.shape[1]
    out = np.zeros((2, k, 1 << level, n, bins), np.int64)
    for c in range(k):
        at = model.nodes(b, feature[c], cut[c], level)
        g = np.rint((p[:, c] - (y == c)) / UNIT).astype(np.int64)
        h = np.rint(p[:, c] * (1 - p[:, c]) / UNIT).astype(np.int64)
        for j in range(n):
            np.add.at(out[0, c, :, j], (at, b[:, j]), g)
            np.add.at(out[1, c, :, j], (at, b[:, j]), h)
    return out


def best_cuts(sums: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin of the best cut of each class and node: the highest gain, the first of such."""
    g, h = (np.cumsum(x * UNIT, axis=-1) for x in sums)
    all_g, all_h = g[..., -1:], h[..., -1:]
    gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
    gain[..., -1] = 0.0  # all to one side
    flat = np.round(gain, 9).reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=-1)
    return best // gain.shape[-1], best % gain.shape[-1]


def boost(sums, model: Trees, rounds: int, bins: int, penalty: float = 1.0) -> Trees:
    """Adds rounds of trees. sums(feature, cut, level) gives the histogram over all rows; classes x nodes x features x bins numbers, whatever the rows."""
    k = len(model.classes)
    for _ in range(rounds):
        feature, cut = np.zeros((k, (1 << model.depth) - 1), np.int64), np.full((k, (1 << model.depth) - 1), bins, np.int64)
        for level in range(model.depth):
            own = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            feature[:, own], cut[:, own] = best_cuts(sums(feature, cut, level), penalty)
        g, h = (x[:, :, 0].sum(axis=-1) * UNIT for x in sums(feature, cut, model.depth))  # any feature's bins add up to the leaf
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(np.round(-model.rate * g / (h + penalty), 12))
    return model


def train_boosted(df: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 2, bins: int = 16, rate: float = 0.3, error: float = 0.001) -> Trees:
    """Multiclass boosted trees with a softmax. Bins are quantiles (exact with an error of 0); each level of a round is one pass that sums gradients by
    class, node, feature and bin in tasks and then over them, and the driver picks the cuts."""
    data = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(label).alias("y")).dropna(subset=[f"f{i}" for i in range(len(features))])
    data = data.persist()
    classes = [r[0] for r in data.select("y").distinct().orderBy("y").collect()]
    cuts = data.approxQuantile([f"f{i}" for i in range(len(features))], [k / bins for k in range(1, bins)], error) if classes else []
    model = Trees([np.unique(x) for x in cuts], classes, depth, rate)
    if not classes:
        return model
    number = {c: i for i, c in enumerate(classes)}

    def sums(feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
                    y = np.array([number[v] for v in batch.column("y").to_pylist()], np.int64)
                    one = histogram(model, model.bins(x), y, feature, cut, level, bins)
                    total = one if total is None else total + one
            if total is not None:
                at = np.flatnonzero(total.any(axis=0).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0].ravel()[at]), pa.array(total[1].ravel()[at])], names=["at", "g", "h"])

        shape = (2, len(classes), 1 << level, len(features), bins)
        out = np.zeros(shape, np.int64).reshape(2, -1)
        for r in data.mapInArrow(run, "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[:, r["at"]] = r["g"], r["h"]
        return out.reshape(shape)

    boost(sums, model, rounds, bins)
    data.unpersist()
    return model


def predict_boosted(df: DataFrame, features: list[str], model: Trees) -> DataFrame:
    """df with `predicted` and `probability` (of all classes, in order). Missing features count as the lowest bin."""
    names, kind = df.columns, df.schema
    row = df.select("*", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in features]).alias("__x"))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("__x").to_pylist(), np.float64).reshape(batch.num_rows, len(features))
            p = softmax(model.scores(model.bins(x))) if batch.num_rows else np.zeros((0, len(model.classes)))
            best = [model.classes[i] for i in p.argmax(axis=1)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(best, out_kind), pa.array(np.round(p, 9).tolist(), pa.list_(pa.float64()))], names=[*names, "predicted", "probability"])

    out_kind = pa.string() if model.classes and isinstance(model.classes[0], str) else pa.int64() if model.classes and isinstance(model.classes[0], int) else pa.float64()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return row.mapInArrow(run, f"{ddl}, predicted {({pa.string(): 'string', pa.int64(): 'long'}).get(out_kind, 'double')}, probability array<double>")
