"""Boosted trees against trees grown by trying every cut, and the perceptron against differences of its loss."""

import math

import numpy as np
import pytest

from plumbrow.operators import boosting
from plumbrow.operators.boosting import Growth, Tree
from plumbrow.operators.classifiers import CONFIGURATIONS
from plumbrow.operators.perceptron import ClassifierNetwork, fit_perceptron


def table(spark, x, y, w=None, parts=3):
    w = np.ones(len(y)) if w is None else w
    rows = [(a.tolist(), int(b), float(c)) for a, b, c in zip(x, y, w)]
    return spark.createDataFrame(rows, "f array<double>, label int, w double").repartition(parts)


def sample(seed, n=160, width=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, width)) / 4
    y = ((x[:, 0] > 1.2) ^ (x[:, 1] > 1.6) ^ (rng.random(n) < 0.1)).astype(int)
    return x, y, rng.choice([1.0, 2.5], n)


def brute_tree(x, g, h, growth):
    """Leaf of every row and its value: the greatest gain of all cuts of all leaves is taken until none is left."""
    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + growth.ridge)

    def best(rows):
        found = (1e-9, None)
        for f in range(x.shape[1]):
            for c in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if min(len(a), len(b)) < growth.least_rows or min(h[a].sum(), h[b].sum()) < growth.least_curvature:
                    continue
                gain = score(a) + score(b) - score(rows)
                if gain > found[0] + 1e-6:
                    found = (gain, (a, b))
        return found

    leaves = [(np.arange(len(x)), 0)]
    while not (growth.leaves and len(leaves) >= growth.leaves):
        open_ = [(best(r), i) for i, (r, d) in enumerate(leaves) if not (growth.depth and d >= growth.depth)]
        open_ = [(o[0], -i, o[1], i) for o, i in open_ if o[1]]
        if not open_:
            break
        _, _, (a, b), i = max(open_, key=lambda o: o[0])
        depth = leaves.pop(i)[1] + 1
        leaves += [(a, depth), (b, depth)]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = -growth.rate * g[rows].sum() / (h[rows].sum() + growth.ridge)
    return out, len(leaves)


@pytest.mark.parametrize("growth", [
    Growth(rounds=3, leaves=6, least_rows=5, stored=2), Growth(rounds=3, leaves=0, depth=3, ridge=1.0, least_rows=1, least_curvature=1.0),
], ids=["leaves", "levels"])
def test_trees_against_all_cuts(spark, growth):
    x, y, w = sample(4)
    model = boosting.fit_boosted(table(spark, x, y, w), growth, weight="w")
    share = (w * y).sum() / w.sum()
    margin = np.full(len(y), math.log(share / (1 - share)))
    assert len(model.trees) == growth.rounds
    bins = boosting.to_bins(x, model.cuts)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want, leaves = brute_tree(x, w * (p - y), w * p * (1 - p), growth)
        assert np.allclose(tree.predict(bins), want, atol=1e-5)
        assert tree.feature.count(-1) == leaves
        margin = margin + tree.predict(bins)
    scored = table(spark, x, y).select(model.probability("f").alias("p"), "f").collect()
    assert np.allclose([r.p for r in scored], 1 / (1 + np.exp(-model.margins(np.array([r.f for r in scored])))))


def test_loss_falls_and_partitions_do_not_matter(spark):
    x, y, _ = sample(7, 300)
    growth = Growth(rounds=6, leaves=5, least_rows=5, stored=4)
    one, two = (boosting.fit_boosted(table(spark, x, y, parts=p), growth) for p in (1, 5))
    assert [vars(t) for t in one.trees] == [vars(t) for t in two.trees]
    margin, last = np.full(len(y), one.base), math.inf
    for tree in one.trees:
        margin = margin + tree.predict(boosting.to_bins(x, one.cuts))
        loss = (np.logaddexp(0, margin) - y * margin).mean()
        assert loss < last
        last = loss


def test_small_jobs_grow_the_same_tree(spark, monkeypatch):
    x, y, _ = sample(9)
    growth = Growth(rounds=1, leaves=8, least_rows=3)
    want = boosting.fit_boosted(table(spark, x, y), growth).trees
    monkeypatch.setattr(boosting, "JOB_CELLS", 1)
    assert [vars(t) for t in boosting.fit_boosted(table(spark, x, y), growth).trees] == [vars(t) for t in want]


def test_early_stop_and_edges(spark):
    rng = np.random.default_rng(1)
    noise = table(spark, rng.random((300, 2)), rng.integers(0, 2, 300))
    stopped = boosting.fit_boosted(noise, Growth(rounds=12, leaves=4, patience=2))
    assert len(stopped.trees) < 12
    one = boosting.fit_boosted(noise.filter("label = 1"), Growth(rounds=2, least_curvature=0.0))
    assert one.base > 10
    assert boosting.fit_boosted(noise.limit(0), Growth(rounds=2)).trees == []
    assert boosting.to_bins(np.array([[math.nan], [0.5], [0.2]]), [np.array([0.2, 0.4])]).ravel().tolist() == [2, 2, 0]
    with pytest.raises(ValueError):
        boosting.fit_boosted(spark.createDataFrame([([1.0], None)], "f array<double>, label int"), Growth(rounds=1))


def test_the_three_libraries_differ(spark):
    x, y, _ = sample(3, 400)
    rows = table(spark, x, y).drop("w")
    scores = {}
    for name in ("HistGradBoost", "XGBoost", "LightGBM"):
        fitted = CONFIGURATIONS[name].with_settings(rounds=3).fit(rows, "f")
        scored = fitted.score(rows).orderBy("f").collect()
        assert np.mean([r.pred == r.label for r in scored]) > 0.8
        scores[name] = [r.score for r in scored]
    assert not np.allclose(scores["XGBoost"], scores["LightGBM"], atol=1e-6)
    assert not np.allclose(scores["HistGradBoost"], scores["LightGBM"], atol=1e-6)


def test_tree_walk():
    tree = Tree()
    left, right = tree.split(0, 1, 3)
    tree.value[left], tree.value[right] = 1.0, 2.0
    assert tree.predict(np.array([[9, 3], [0, 4]], np.uint8)).tolist() == [1.0, 2.0]


def test_classifier_gradient():
    rng = np.random.default_rng(5)
    net = ClassifierNetwork((3, 5, 4, 1), ("relu", "relu", "linear"), penalty=0.3)
    flat = net.start(1) + 0.01
    x = np.column_stack([rng.normal(size=(7, 3)), rng.integers(0, 2, 7), rng.choice([1.0, 4.0], 7)])

    def loss(v):
        squares = sum((a ** 2).sum() for a, _ in net.layers(v))
        return net.loss_sum(v, x) / len(x) + 0.5 * net.penalty / len(x) * squares

    got = net.gradient(flat, x)
    for i in range(0, net.size, 3):
        step = np.zeros(net.size)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - got[i]) < 1e-6


def test_weights_move_the_decision(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.3).astype(int)
    x = rng.normal(size=(600, 2)) + y[:, None]
    share = {}
    for up in (1.0, 8.0):
        rows = table(spark, x, y, np.where(y == 1, up, 1.0), parts=1)
        model = fit_perceptron(rows, (8,), epochs=25, batch=20, weight="w")
        share[up] = rows.select((model.probability("f") > 0.5).cast("int").alias("p")).groupBy().avg("p").first()[0]
    assert share[8.0] > share[1.0] + 0.1


def test_perceptron_learns(spark):
    x, y, _ = sample(11, 600, 2)
    rows = table(spark, x, y, parts=1).drop("w")
    fitted = CONFIGURATIONS["mlp"].with_settings(rounds=60, batch=20).fit(rows, "f")
    scored = fitted.score(rows).collect()
    assert np.mean([r.pred == r.label for r in scored]) > 0.8
    assert all(0 <= r.score <= 1 for r in scored)
    with pytest.raises(ValueError):
        fit_perceptron(spark.createDataFrame([([1.0], None)], "f array<double>, label int"), epochs=1)
