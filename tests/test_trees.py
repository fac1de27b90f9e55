"""Histogram trees, boosting and Gram regression against plain loops."""

import numpy as np
import pytest

from tabsense.operators import linear, trees
from tabsense.operators import models as ML

OPTIONS = ML.ModelOptions(max_depth=4, trees=6, rounds=13, max_bins=16)


def data(n=260, seed=1, classes=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.normal(size=n).round(2)], 1)
    score = 2 * (x[:, 0] > 4) + x[:, 1] - x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n)
    y = np.digitize(score, np.quantile(score, np.arange(1, classes) / classes)).astype(float) if classes else score
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, fold):
    rows = [(i, *map(float, r), float(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "_key long, a double, b double, c double, label double, fold int").repartition(3)


def plain_tree(bins, n_bins, stats, sums, depth, pick=None, at=0):
    """{node: (feature, cut)} and {node: statistics}, one node after another."""
    splits, values = {}, {at: stats.sum(0)}
    worth = lambda s: float((s[sums] ** 2).sum() / s[0]) if s[0] > 0 else 0.0
    if not depth:
        return splits, values
    whole, best = worth(stats.sum(0)), (1e-9 * max(worth(stats.sum(0)), 1e-300), None)
    for f in range(bins.shape[1]):
        for cut in range(n_bins - 1):
            left = bins[:, f] <= cut
            a, b = stats[left].sum(0), stats[~left].sum(0)
            if a[0] >= 0.5 and b[0] >= 0.5 and (pick is None or pick(at)[f]):
                gain = worth(a) + worth(b) - whole
                if gain > best[0] * (1 + 1e-9) if best[1] else gain > best[0]:
                    best = gain, (f, cut)
    if best[1]:
        f, cut = splits[at] = best[1]
        left = bins[:, f] <= cut
        for side, child in ((left, 2 * at + 1), (~left, 2 * at + 2)):
            more, sub = plain_tree(bins[side], n_bins, stats[side], sums, depth - 1, pick, child)
            splits.update(more), values.update(sub)
    return splits, values


def leaf(splits, row):
    node = 0
    while node in splits:
        f, cut = splits[node]
        node = 2 * node + 1 + (row[f] > cut)
    return node


def binned(spark, x, y, fold, labels=None):
    df = frame(spark, x, y, fold)
    cuts = trees.cut_points(df, ["a", "b", "c"], 16)
    rows = trees.binned(df, ["a", "b", "c"], cuts, labels)
    held = rows.toPandas()
    return rows, cuts, np.stack(held["bins"]).astype(int), held


def test_cuts_separate_few_values(spark):
    x, y, fold = data()
    cuts = trees.cut_points(frame(spark, x, y, fold), ["a", "b", "c"], 16)
    assert cuts[0].tolist() == list(range(8)) and 10 <= len(cuts[1]) <= 15


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_equals_plain_loop(spark, monkeypatch, classes):
    monkeypatch.setattr(trees, "SCORE_ROUNDS", 4)
    rounds = 6
    x, y, fold = data(classes=classes)
    labels = np.arange(classes, dtype=float) if classes else None
    rows, cuts, bins, held = binned(spark, x, y, fold, labels)
    model = trees.boosting(rows, ["a", "b", "c"], cuts, labels, 3, rounds, 1)
    n_bins = max(map(len, cuts)) + 1
    for m in (0, 2):
        use = np.ones(len(held), bool) if m == 0 else held["fold"].to_numpy() != m - 1
        t = held["y"].to_numpy()
        outputs = 1 if classes <= 2 else classes
        share = [np.mean(t[use] == k) for k in range(classes)]
        start = [t[use].mean()] if not classes else [np.log(share[1] / share[0])] if classes == 2 else np.log(share)
        score = np.tile(np.array(start, float), (len(t), 1))
        for _ in range(rounds):
            new = score.copy()
            for o in range(outputs):
                if not classes:
                    miss, curve = t - score[:, 0], np.ones(len(t))
                elif classes == 2:
                    p = 1 / (1 + np.exp(-score[:, 0]))
                    miss, curve = (t == 1) - p, p * (1 - p)
                else:
                    p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
                    miss = (t == o) - p[:, o]
                    curve = np.abs(miss) * (1 - np.abs(miss))
                splits, values = plain_tree(bins[use], n_bins, np.stack([np.ones(use.sum()), miss[use], curve[use]], 1), [1], 3)
                scale = 0.1 * ((classes - 1) / classes if classes > 2 else 1)
                for i, row in enumerate(bins):
                    s = values[leaf(splits, row)]
                    new[i, o] += scale * s[1] / s[2]
            score = new
        assert np.allclose(model.outputs(bins, m), score, atol=1e-9)
    assert abs(sum(model.importances()) - 1) < 1e-12


@pytest.mark.parametrize("classes, cells", [(0, 1 << 20), (3, 1 << 20), (3, 3000)])
def test_forest_equals_plain_loop(spark, monkeypatch, classes, cells):
    monkeypatch.setattr(trees, "CELLS", cells)
    monkeypatch.setattr(trees, "NODE_BLOCK", 4)
    n_trees, depth = 4, 4
    x, y, fold = data(classes=classes)
    labels = np.arange(classes, dtype=float) if classes else None
    rows, cuts, bins, held = binned(spark, x, y, fold, labels)
    model = trees.forest(rows, ["a", "b", "c"], cuts, labels, 3, n_trees, depth, 5)
    n_bins, t, key = max(map(len, cuts)) + 1, held["y"].to_numpy(), held["key"].to_numpy()
    for m in (0, 3):
        use = np.ones(len(held), bool) if m == 0 else held["fold"].to_numpy() != m - 1
        total = np.zeros((len(t), max(classes, 1)))
        for tree in range(m * n_trees, (m + 1) * n_trees):
            w = trees.draws(key, tree, 5) * use
            target = np.eye(classes)[t.astype(int)] if classes else (t - t.mean())[:, None]
            stats = np.concatenate([w[:, None], w[:, None] * target], 1)[w > 0]
            wanted = 1 if classes else 3
            splits, values = plain_tree(bins[w > 0], n_bins, stats, slice(1, None), depth, lambda at: trees.choice(tree, np.array([at]), 3, wanted, 5)[0])  # noqa: B023
            for i, row in enumerate(bins):
                s = values[leaf(splits, row)]
                total[i] += s[1:] / s[0] + (0 if classes else t.mean())
        assert np.allclose(model.outputs(bins, m), total / n_trees, atol=1e-9)


def test_draws_are_poisson():
    w = trees.draws(np.arange(200_000), 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() < 12


def test_gram_fits_equal_least_squares(spark):
    x, y, fold = data()
    x = np.concatenate([x + 1000, 2 * x[:, :1] + 2000], 1)  # far from zero, and one column twice
    rows = [(i, *map(float, r), float(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold))]
    df = spark.createDataFrame(rows, "_key long, a double, b double, c double, d double, label double, fold int").repartition(3)
    gram, shift = linear.grams(df, ["a", "b", "c", "d"], 3)
    for alpha in (0.0, 1.0):
        model, folds = linear.fit(gram, shift, ["a", "b", "c", "d"], alpha)
        def by_hand(use):
            mean = x[use].mean(0), y[use].mean()
            xs, ys = x[use] - mean[0], y[use] - mean[1]
            w = np.linalg.lstsq(xs, ys, rcond=1e-9)[0] if not alpha else np.linalg.solve(xs.T @ xs + alpha * np.eye(4), xs.T @ ys)
            return lambda z: (z - mean[0]) @ w + mean[1]
        want = by_hand(np.ones(len(y), bool))(x)
        got = np.array([r.prediction for r in model.transform(df).orderBy("_key").collect()])
        assert np.allclose(got, want, atol=1e-7)
        for f, r in enumerate(folds):
            test = fold == f
            p = by_hand(~test)(x[test])
            assert abs(r - (1 - ((y[test] - p) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())) < 1e-8


def test_ensembles_learn_and_explain(spark):
    x, y, _ = data(600, 3, 3)
    df = spark.createDataFrame([(i, *map(float, r), f"class {int(t)}", "noise") for i, (r, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y string, text string")
    run = ML.train_models(df, "y", ["a", "b", "c", "text"], "classification", ["Random Forest", "Gradient Boosting"], key="k", options=OPTIONS)
    for r in run.metrics.collect():
        assert r["accuracy"] > 0.6 and r["cv_mean"] > 0.6 and r["n"] == 120
    assert {r["prediction_text"] for r in run.predictions.select("prediction_text").distinct().collect()} <= {"class 0", "class 1", "class 2"}
    for name in ("Random Forest", "Gradient Boosting"):
        imp = {r["feature"]: r["importance"] for r in ML.feature_importance(run, name).collect()}
        assert imp["text__idx"] == 0 and abs(sum(imp.values()) - 1) < 1e-9 and min(imp["a"], imp["b"]) > 0.15


def test_constant_target_and_feature(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(40)], "k long, a double, y double")
    run = ML.train_models(df, "y", ["a"], "regression", ["Random Forest", "Gradient Boosting", "Linear Regression"], key="k", options=OPTIONS)
    assert {r["prediction"] for r in run.predictions.collect()} == {2.0}


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_of_combinations_equals_forest_of_rows(spark, monkeypatch, classes):
    """Few combinations of bins, one of which holds a third of the rows: their drawn sums are those of the rows."""
    rng = np.random.default_rng(4)
    n = 900
    x = rng.integers(0, 3, (n, 3)).astype(float)
    x[: n // 3] = 1.0
    y, fold = (x[:, 0] + rng.integers(0, 3, n)) % classes if classes else x[:, 0] * x[:, 1] + rng.normal(size=n), rng.integers(0, 3, n)
    labels = np.arange(classes, dtype=float) if classes else None
    rows, cuts, bins, held = binned(spark, x, y.astype(float), fold, labels)
    shape = (rows, ["a", "b", "c"], cuts, labels, 3, 4, 4, 5)
    fast = trees.forest(*shape)
    records = trees.drawn(rows, fast.plan)
    assert fast.plan.drawn and records.count() < n // 2
    s = fast.plan.drawn_sums
    sums = sum(np.frombuffer(r["sums"], fast.plan.drawn_type).reshape(s) for r in records.collect())
    for tree in range(s[0]):
        w = trees.draws(held["key"].to_numpy(), tree, 5) * trees.used(fast.plan, held["fold"].to_numpy(), tree // 4)
        assert sums[tree].sum() == w.sum() if classes else sums[tree, 0] == w.sum()
    monkeypatch.setattr(trees, "DRAWN", 0)
    slow = trees.forest(*shape)
    assert not slow.plan.drawn
    for m in range(4):
        assert np.allclose(fast.outputs(bins, m), slow.outputs(bins, m), atol=1e-9)


def test_boosting_works_on_combinations(spark, monkeypatch):
    """No job of a round reads more records than there are combinations of bins, fold and class."""
    x, y, fold = data(600, classes=2)
    x = np.tile((x > 0).astype(float), (2, 1))
    rows, cuts, _, held = binned(spark, x, np.tile(y, 2), np.tile(fold, 2), np.arange(2.0))
    read, grow = [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda state, *a: read.append(state.count()) or grow(state, *a))
    trees.boosting(rows, ["a", "b", "c"], cuts, np.arange(2.0), 3, 2, 1)
    assert max(read) == len({(*b, f, t) for b, f, t in zip(held["bins"], held["fold"], held["y"])}) < len(held) / 4


@pytest.mark.parametrize("classes", [0, 3])
def test_whole_trees_equal_trees_level_by_level(spark, monkeypatch, classes):
    """A forest's trees and the rounds of boosting, each grown by one task in one job, are those grown level by level."""
    x, y, fold = data(400, 5, classes)
    x[:150, 1:] = x[0, 1:]  # a combination with many rows
    labels = np.arange(classes, dtype=float) if classes else None
    rows, cuts, bins, _ = binned(spark, x, y, fold, labels)
    shape = (rows, ["a", "b", "c"], cuts, labels, 3)
    makes = (lambda: trees.forest(*shape, 5, 4, 5)), (lambda: trees.boosting(*shape, 11, 1))
    whole = [make() for make in makes]
    monkeypatch.setattr(trees, "WHOLE", 0)
    for make, fast in zip(makes, whole):
        slow = make()
        assert fast.plan.whole and not slow.plan.whole
        for (a, value), (b, slow_value) in zip(fast.rounds, slow.rounds, strict=True):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all()
            assert np.allclose(a.stats, b.stats, atol=1e-8) and np.allclose(value, slow_value, atol=1e-8)
        for m in range(4):
            assert np.allclose(fast.outputs(bins, m), slow.outputs(bins, m), atol=1e-8)


@pytest.mark.parametrize("classes", [0, 3])
def test_jobs_do_not_grow_with_rounds_and_levels(spark, classes):
    x, y, fold = data(300, 6, classes)
    labels = np.arange(classes, dtype=float) if classes else None
    rows, cuts, _, _ = binned(spark, x, y, fold, labels)
    shape, context = (rows, ["a", "b", "c"], cuts, labels, 3), spark.sparkContext

    def jobs(group, make):
        context.setJobGroup(group, group)
        try:
            make()
            return len(context.statusTracker().getJobIdsForGroup(group))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    for name, few, many in (("forest", lambda: trees.forest(*shape, 3, 2, 5), lambda: trees.forest(*shape, 3, 6, 5)),
                            ("boosting", lambda: trees.boosting(*shape, 2, 1), lambda: trees.boosting(*shape, 14, 1))):
        assert jobs(f"few {name} {classes}", few) == jobs(f"many {name} {classes}", many) > 0
