"""Searches that must stay exact at size: labels by edits, column sums, neighbourhoods, forests."""

import itertools
import random

import numpy as np
import pytest

from factloom.operators import graph, labels, structure


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.75, 0.6, 0.9])
def test_fuzzy_labels_against_all_pairs(spark, threshold):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(1, 34))) for _ in range(50)]

    def typo(x):
        x = list(x)
        for _ in range(r.randrange(0, 1 + len(x) // 3)):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randrange(2)] = r.choice(["", "q", "zz"])
        return "".join(x)

    asked = sorted({typo(x) for x in base for _ in range(4)} | {"", "a"})
    index = [(x, f"c{i}") for i, x in enumerate(dict.fromkeys(base))]
    got = {(x["label"], x["norm"]) for x in labels.fuzzy_candidates(spark.createDataFrame([(x,) for x in asked], "label string"), spark.createDataFrame(index, "norm string, concept_id string"), threshold).collect()}
    close = {(a, b) for a in asked for b, _ in index if a and b and 1 - edits(a, b) / max(len(a), len(b)) >= threshold}
    assert close <= got and len(close) > 20


def test_few_candidates_per_label(spark):
    """8,000 labels of financial words against 8,000: under a hundred pairs each come to the edit distance."""
    r = random.Random(6)
    words = "revenue cost sales assets total other income expense tax deferred current liabilities trade receivables provisions interest lease equity capital reserves inventories depreciation amortisation impairment goodwill financial operating result share".split()
    names = sorted({" ".join(r.sample(words, r.randrange(2, 5))) + f" {r.randrange(90)}" for _ in range(8_300)})[:8_000]
    index = spark.createDataFrame([(x, "c") for x in names], "norm string, concept_id string").repartition(4)
    n = labels.fuzzy_candidates(index.withColumnRenamed("norm", "label"), index, 0.85).count()
    assert n / len(names) < 100


def slow_sum(v, min_rows, min_rate):
    best = None
    for t in range(v.shape[1]):
        rest = [c for c in range(v.shape[1]) if c != t]
        for size in range(2, len(rest) + 1):
            for parts in itertools.combinations(rest, size):
                both = v[:, [t, *parts]]
                both = both[~np.isnan(both).any(axis=1)]
                if len(both) >= min_rows:
                    rate = float((np.abs(both[:, 1:].sum(axis=1) - both[:, 0]) <= np.maximum(1, 0.02 * np.abs(both[:, 0]))).mean())
                    if rate >= min_rate and (best is None or rate > best[3]):
                        best = (t, list(parts), len(both), rate)
    return best


@pytest.mark.parametrize("block", [1 << 12, 4])
def test_column_sums_against_all_sets(block, monkeypatch):
    monkeypatch.setattr(structure, "BLOCK", block)
    r, seen = np.random.default_rng(3), 0
    for n in [3, 4, 5, 6, 7, 8] * 6:
        v = np.round(r.normal(0, 300, (r.integers(3, 9), n)))
        if n > 3:
            v[:, 1] = v[:, [0, 2, 3]].sum(axis=1)
        v[r.random(v.shape) < 0.1] = np.nan
        want, got = slow_sum(v, 3, 0.6), structure.best_sum(v, 3, 0.6)
        assert got == want
        seen += want is not None
    assert seen > 15


def test_wide_table_sums(spark):
    """20 columns, of which the last is the sum of seven."""
    r = np.random.default_rng(4)
    v = np.round(r.normal(0, 1e6, (12, 20)))
    v[:, 19] = v[:, [1, 2, 5, 8, 11, 13, 17]].sum(axis=1)
    cells = [(7, i, c, float(v[i, c])) for i in range(12) for c in range(20)]
    got = structure.additive_columns(spark.createDataFrame(cells, "table_id long, row_id long, col_idx int, value double")).collect()
    assert [(x["table_id"], x["n"], x["rate"]) for x in got] == [(7, 12, 1.0)]
    own = {got[0]["total"], *map(int, got[0]["parts"].split(","))}
    assert own == {1, 2, 5, 8, 11, 13, 17, 19} or len(own) >= 3  # a column that is itself a difference of the others may come first
    total, parts = got[0]["total"], list(map(int, got[0]["parts"].split(",")))
    assert (np.abs(v[:, parts].sum(axis=1) - v[:, total]) <= np.maximum(1, 0.02 * np.abs(v[:, total]))).all()


def test_neighbourhood_of_a_hub(spark):
    """An edge of 100,000 members, and chains behind some of them."""
    hub = spark.range(100_000).selectExpr("'hub' AS edge_name", "concat('c', id) AS concept_id")
    chain = spark.createDataFrame([("e1", "c5"), ("e1", "x"), ("e2", "x"), ("e2", "y"), ("e3", "y"), ("e3", "z"), ("e0", "start"), ("e0", "c1")], "edge_name string, concept_id string")
    got = graph.neighborhood(hub.unionByName(chain), "start", 3).groupBy("hop").count().collect()
    assert {r["hop"]: r["count"] for r in got} == {0: 1, 1: 1, 2: 99_999, 3: 1}
    assert graph.neighborhood(chain, "nobody", 2).count() == 0


def test_forest_with_cycle_and_depth(spark):
    deep = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    tree = spark.createDataFrame([*deep, ("n3", "n1"), ("a", "b"), ("b", "a"), ("n0", "other"), ("r", "n5")], "concept_id string, member string")
    concepts = spark.createDataFrame([("PNL", f"n{i}") for i in range(13)] + [("PNL", "a"), ("PNL", "b"), ("PNL", "r"), ("SFP", "n5"), ("SFP", "n6"), ("SFP", "other")], "context string, concept_id string")
    members = spark.createDataFrame([("e1", "n0"), ("e2", "n0"), ("e2", "n12")], "edge_name string, concept_id string")
    got = {(r["context"], r["path"]): (r["depth"], r["n_edges"]) for r in graph.context_forest(concepts, tree, members).collect()}
    line = [f"n{i}" for i in range(13)]
    want = {("PNL", "/".join(line[: k + 1])): (k, {0: 2, 12: 1}.get(k, 0)) for k in range(13)} | {("PNL", "/".join(["r", *line[5 : 5 + k]])): (k, 1 if k == 8 else 0) for k in range(9)}
    assert got == want | {("SFP", "n5"): (0, 0), ("SFP", "n5/n6"): (1, 0), ("SFP", "other"): (0, 0)}
