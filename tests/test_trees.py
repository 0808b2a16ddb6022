"""Histogram trees against exhaustive search on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmill.operators import trees

COLUMNS = ("a", "b", "c")


def table(spark, rows=200, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, rows), rng.normal(size=rows).round(1), rng.integers(0, 3, rows)]).astype(float)
    y = np.where(x[:, 0] > 6, 5.0, 1.0) + 2 * x[:, 1] + (x[:, 2] == 1) + rng.normal(size=rows) / 10
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    return x, y, frame.repartition(4)


def best_cut(x, y, min_leaf, l2=0.0):
    """Largest gain of squared loss over all cuts at observed values; ties to the smaller feature, then value."""
    whole = y.sum() ** 2 / (len(y) + l2)
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            n = left.sum()
            if min(n, len(y) - n) >= min_leaf:
                gain = y[left].sum() ** 2 / (n + l2) + y[~left].sum() ** 2 / (len(y) - n + l2) - whole
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


def exhaustive(x, y, depth, min_leaf, l2=0.0):
    """Prediction of every row by a tree of best cuts."""
    found = best_cut(x, y, min_leaf, l2) if depth and len(y) >= 2 * min_leaf else None
    if found is None or found[0] <= 1e-12:
        return np.full(len(y), y.sum() / (len(y) + l2))
    left = x[:, found[1]] <= found[2]
    out = np.empty(len(y))
    out[left], out[~left] = (exhaustive(x[s], y[s], depth - 1, min_leaf, l2) for s in (left, ~left))
    return out


@pytest.mark.parametrize(("depth", "min_leaf", "l2"), [(1, 1, 0.0), (3, 5, 0.0), (4, 2, 0.4)])
def test_a_tree_of_all_values_is_the_exhaustive_one(spark, depth, min_leaf, l2):
    x, y, frame = table(spark)
    (model,) = trees.boost(frame, COLUMNS, "y", 1, 1.0, None, depth, min_leaf, l2, bins=256)
    want = y.mean() + exhaustive(x, y - y.mean(), depth, min_leaf, l2)
    assert trees.predict(model, x) == pytest.approx(want, abs=1e-9)
    scored = trees.with_predictions(frame, {"p": model}, COLUMNS).collect()
    assert [r.p for r in scored] == pytest.approx(list(trees.predict(model, np.array([[r.a, r.b, r.c] for r in scored]))))


def test_rounds_add_up_across_written_sums(spark, monkeypatch):
    x, y, frame = table(spark, 120, 1)
    whole = trees.boost(frame, COLUMNS, "y", 5, 0.3, None, 2, 3, 0.4, bins=256)[0]
    monkeypatch.setattr(trees, "KEPT_ROUNDS", 2)
    parts = trees.boost(frame, COLUMNS, "y", 5, 0.3, None, 2, 3, 0.4, bins=256)[0]
    sums = np.full(len(y), y.mean())
    for _ in range(5):
        sums = sums + 0.3 * exhaustive(x, y - sums, 2, 3, 0.4)
    assert trees.predict(whole, x) == pytest.approx(sums, abs=1e-9)
    assert trees.predict(parts, x) == pytest.approx(sums, abs=1e-9)


def test_leaves_are_bounded_by_gain(spark):
    x, y, frame = table(spark)
    (model,) = trees.boost(frame, COLUMNS, "y", 1, 1.0, 3, 6, 1, bins=256)
    tree = model["trees"][0]
    assert (tree["left"] < 0).sum() == 3
    # of the two nodes of the first level, the one of larger gain was split
    first = x[:, tree["feature"][0]] <= tree["threshold"][0]
    gains = [best_cut(x[s], (y - y.mean())[s], 1)[0] for s in (first, ~first)]
    assert (tree["left"][1] >= 0) == (gains[0] > gains[1])


def test_quantile_ensembles(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 3000)
    y = 10 * x + rng.normal(size=3000) * (0.2 + 2 * x)
    rows = [(float(a), float(v)) for a, v in zip(x, y, strict=True)]
    frame = spark.createDataFrame(rows, "a double, y double").repartition(4)
    alphas = (0.1, 0.5, 0.9)
    models = trees.boost(frame, ["a"], "y", 12, 0.35, None, 3, 8, alphas=alphas)
    found = [trees.predict(m, x[:, None]) for m in models]
    for alpha, q in zip(alphas, found, strict=True):
        assert np.mean(y <= q) == pytest.approx(alpha, abs=0.03)
        loss = lambda p, alpha=alpha: np.mean(np.maximum(alpha * (y - p), (alpha - 1) * (y - p)))
        assert loss(q) < 0.6 * loss(np.full(len(y), np.quantile(y, alpha)))
    assert np.mean((found[2] - found[0])[x > 0.8]) > 2 * np.mean((found[2] - found[0])[x < 0.2])


def test_pinball_leaf_is_the_quantile_of_its_rows(spark):
    x, y, frame = table(spark, 200, 5)
    (model,) = trees.boost(frame, COLUMNS, "y", 1, 1.0, None, 2, 20, alphas=(0.9,), bins=256)
    leaf = trees.predict(model, x)
    for value in np.unique(leaf):
        own = np.sort(y[leaf == value])
        assert abs(np.searchsorted(own, value + 1e-9) / len(own) - 0.9) <= 1.5 / len(own)


def test_extra_trees_cut_at_random_and_average(spark):
    x, y, frame = table(spark, 400, 2)
    model = trees.extra_trees(frame, COLUMNS, "y", 12, 8, 3, 0.8, seed=7)
    error = np.mean(np.abs(trees.predict(model, x) - y))
    assert error < 0.5 * np.mean(np.abs(y - y.mean()))
    assert len({(t["feature"][0], t["threshold"][0]) for t in model["trees"]}) > 4
    for tree in model["trees"]:
        nodes = np.zeros(len(x), int)
        for _ in range(10):
            inner = tree["left"][nodes] >= 0
            goes = x[np.arange(len(x)), tree["feature"][nodes]] <= tree["threshold"][nodes]
            nodes = np.where(inner, np.where(goes, tree["left"][nodes], tree["right"][nodes]), nodes)
        for leaf in np.unique(nodes):
            own = nodes == leaf
            assert own.sum() >= 3 and tree["value"][leaf] == pytest.approx(y[own].mean())
    again = trees.extra_trees(frame, COLUMNS, "y", 12, 8, 3, 0.8, seed=7)
    assert trees.predict(again, x) == pytest.approx(trees.predict(model, x))


def test_splits_of_cells_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    cells = [(0, n, f, b, int(rng.integers(1, 6)), float(rng.integers(-9, 9))) for n, f, b in itertools.product(range(6), range(3), range(7)) if rng.random() < 0.7]
    # all features of a node hold the same rows
    frame = spark.createDataFrame(cells, "tree int, node int, feature int, bin int, n bigint, g double")
    for r in trees.best_splits(frame, 2, 0.5).collect():
        best = (1e-12, None, None)
        for f in range(3):
            own = sorted(c[3:] for c in cells if c[1] == r.node and c[2] == f)
            n, g = sum(c[1] for c in own), sum(c[2] for c in own)
            for k in range(len(own) - 1):
                nl, gl = sum(c[1] for c in own[: k + 1]), sum(c[2] for c in own[: k + 1])
                gain = gl**2 / (nl + 0.5) + (g - gl) ** 2 / (n - nl + 0.5) - g**2 / (n + 0.5)
                if min(nl, n - nl) >= 2 and gain > best[0] + 1e-12:
                    best = (gain, f, own[k][0])
        assert (r.feature, r.bin) == best[1:] and (r.gain is None or r.gain == pytest.approx(best[0]))


def test_empty_and_constant_tables(spark):
    _, _, frame = table(spark, 50)
    assert trees.predict(trees.boost(frame.limit(0), COLUMNS, "y", 2, 0.1)[0], np.zeros((2, 3))).tolist() == [0, 0]
    assert trees.predict(trees.extra_trees(frame.limit(0), COLUMNS, "y", 2, 3), np.zeros((2, 3))).tolist() == [0, 0]
    flat = frame.withColumn("y", F.lit(4.0)).withColumn("a", F.lit(1.0))
    for alphas in ((None,), (0.1, 0.9)):
        assert [trees.predict(m, np.ones((1, 3)))[0] for m in trees.boost(flat, COLUMNS, "y", 2, 0.5, alphas=alphas)] == pytest.approx([4.0] * len(alphas))
