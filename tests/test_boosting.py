"""Out-of-fold discriminants against refitting, boosted trees against plain numpy."""

import math
import random

import numpy as np
import pytest

from factloom.operators import boosting


def test_out_of_fold_equals_refitting(spark):
    r = random.Random(3)
    rows = [(f"d{r.randrange(7)}", c := r.choice(["a", "a", "b", "c"]), {"a": 0.0, "b": 1.5, "c": -2}[c] + r.gauss(0, 1), float(r.randrange(3) + (c == "b"))) for _ in range(160)] + [("d1", None, 0.4, 1.0), ("d9", "only", 9.0, 9.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, fold string, y string, u double, v double")
    got = {x["id"]: (x["predicted"], x["margin"]) for x in boosting.out_of_fold(df, "fold", "y", ["u", "v"]).collect()}
    n = sum(y is not None for _, y, *_ in rows)
    for i, (fold, _, *x) in enumerate(rows):
        scores = []
        for c in sorted({y for _, y, *_ in rows if y is not None}):
            own = np.array([z for f, y, *z in rows if y == c and f != fold])
            if len(own):
                var = np.maximum((own**2).mean(axis=0) - own.mean(axis=0) ** 2, 1e-3)
                scores.append((-(math.log(len(own) / n) - 0.5 * float((np.log(var) + (np.array(x) - own.mean(axis=0)) ** 2 / var).sum())), c))
        (first, c), (second, _) = sorted(scores)[:2]
        assert got[i][0] == c and abs(got[i][1] - (second - first)) < 1e-6
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(0, 1, (900, 5)), 3)
    y = np.where(x[:, 0] * x[:, 1] > 0.2, 2, np.where(x[:, 2] + 0.3 * x[:, 3] > 0.5, 1, 0))
    return spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, e double, y long"), x, y


def test_trees_against_plain_numpy(table):
    """The same trees from histograms summed over tasks and from one array; the same again over other partitions."""
    df, x, y = table
    names = list("abcde")
    model = boosting.train_boosted(df.where("id < 600").repartition(3), names, "y", rounds=6, depth=2, bins=8, error=0.0)
    plain = boosting.Trees(model.edges, [0, 1, 2], 2, 0.3)
    b = plain.bins(x[:600])
    boosting.boost(lambda f, c, level: boosting.histogram(plain, b, y[:600], f, c, level, 8), plain, 6, 8)
    for one, other in ((model.feature, plain.feature), (model.cut, plain.cut), (model.leaf, plain.leaf)):
        assert all(np.array_equal(u, v) for u, v in zip(one, other, strict=True))
    again = boosting.train_boosted(df.where("id < 600").repartition(7, "e"), names, "y", rounds=6, depth=2, bins=8, error=0.0)
    assert all(np.array_equal(u, v) for u, v in zip(model.leaf, again.leaf, strict=True))


def test_trees_beat_the_forest_on_held_out_rows(spark, table):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df, names = table[0], list("abcde")
    model = boosting.train_boosted(df.where("id < 600"), names, "y", rounds=30, depth=3, bins=16)
    out = boosting.predict_boosted(df.where("id >= 600"), names, model)
    right = out.where("predicted = y").count()
    v = VectorAssembler(inputCols=names, outputCol="x").transform(df)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=6, seed=42).fit(v.where("id < 600"))
    assert right >= forest.transform(v.where("id >= 600")).where("prediction = y").count() and right / 300 > 0.85
    assert all(abs(sum(r["probability"]) - 1) < 1e-6 for r in out.limit(5).collect())


def test_nothing_to_learn_from(spark, table):
    df = table[0].limit(0)
    model = boosting.train_boosted(df, ["a"], "y")
    assert model.classes == [] and boosting.out_of_fold(df, "id", "y", ["a"]).collect() == []
