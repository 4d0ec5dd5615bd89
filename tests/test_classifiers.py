"""Linear classifiers against numpy loops, with nulls, ties, single labels and empty tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import classifiers, decoding

RNG = np.random.default_rng(11)
SCHEMA = "cell string, id long, label string, fold int, x array<double>"


def correlated(n=240, d=4, seed=1):
    """Labels that differ along a direction of little spread: centroids mislead, discriminants don't."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 1)) * 5
    x = base + r.normal(size=(n, d)) * 0.5
    label = np.arange(n) % 3
    x[:, 0] += label
    return x, label


def table(spark, x, label, folds=3, cell="a"):
    return spark.createDataFrame([(cell, k, "abc"[label[k]], k // 3 % folds, [float(v) for v in x[k]]) for k in range(len(x))], SCHEMA)


def loop_lda(x, y, train, test, select=None):
    classes = np.unique(y[train])
    chosen = np.arange(x.shape[1])
    if select:
        f = []
        for j in chosen:
            groups = [x[train][y[train] == c, j] for c in classes]
            m = x[train][:, j].mean()
            outer = sum(len(g) * (g.mean() - m) ** 2 for g in groups) / (len(classes) - 1)
            f.append(outer / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(train) - len(classes))))
        chosen = np.argsort(-np.array(f), kind="stable")[:select]
    x = x[:, chosen]
    means = np.array([x[train][y[train] == c].mean(axis=0) for c in classes])
    inner = np.concatenate([x[train][y[train] == c] - m for c, m in zip(classes, means)])
    inverse = np.linalg.inv(inner.T @ inner / (len(train) - len(classes)))
    prior = np.log([np.mean(y[train] == c) for c in classes])
    score = x[test] @ inverse @ means.T - 0.5 * np.einsum("ld,de,le->l", means, inverse, means) + prior
    return classes[score.argmax(axis=1)]


@pytest.mark.parametrize("select", [None, 2])
def test_discriminants_equal_a_loop(spark, select):
    x, y = correlated()
    fold = np.arange(len(x)) // 3 % 3
    items = table(spark, x, y).unionByName(table(spark, x * 2 + 1, y, cell="b"))
    odd = spark.createDataFrame([("a", 900, None, 0, [1.0] * 4), ("a", 901, "a", 0, None), ("a", 902, "a", 1, [1.0, None, 1.0, 1.0]), ("a", 903, "b", 2, [float("nan")] * 4), ("a", 904, "b", 2, [])], SCHEMA)
    got = {(r.cell, r.fold): (r.accuracy, r.n) for r in classifiers.discriminant_accuracy(items.unionByName(odd), ["cell"], "fold", select=select).collect()}
    for f in range(3):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        want = np.mean(loop_lda(x, y, train, test, select) == y[test])
        assert got["a", f] == (pytest.approx(want), len(test)) and got["b", f] == got["a", f]  # affine changes change nothing


def test_discriminants_beat_centroids_on_correlated_features(spark):
    items = table(spark, *correlated())
    lda = classifiers.discriminant_accuracy(items, [], "fold").agg(F.avg("accuracy")).first()[0]
    long = items.select("id", "label", "fold", F.posexplode("x").alias("f", "v"))
    centroid = decoding.cross_validated(long, [], "fold").agg(F.avg("accuracy")).first()[0]
    assert lda > 0.75 > centroid + 0.2


def test_singular_covariances_and_odd_cells(spark):
    x, y = correlated(60)
    doubled = np.column_stack([x, x[:, 0]])  # of less than full rank
    same = table(spark, np.ones((6, 5)), [0, 0, 0, 0, 0, 0], 2, "one")  # one label, no spread
    got = classifiers.discriminant_accuracy(table(spark, doubled, y).unionByName(same), ["cell"], "fold").collect()
    plain = {r.fold: r.accuracy for r in classifiers.discriminant_accuracy(table(spark, x, y), ["cell"], "fold").collect()}
    assert {r.fold: r.accuracy for r in got if r.cell == "a"} == plain
    assert all(r.accuracy == 1.0 for r in got if r.cell == "one") and len(got) == 5
    alone = table(spark, x[:3], y[:3], 1)  # nothing is left to train on
    assert classifiers.discriminant_accuracy(alone, ["cell"], "fold").count() == 0
    assert classifiers.discriminant_accuracy(alone.limit(0), [], "fold").count() == 0


def test_generalisation_to_other_conditions(spark):
    x, y = correlated()
    cond = np.arange(len(x)) // 3 % 3
    got = {(r.train, r.test): r.accuracy for r in classifiers.generalised_accuracy(table(spark, x, y), ["cell"], "fold").collect()}
    assert len(got) == 6
    for (a, b), value in got.items():
        train, test = np.flatnonzero(cond == a), np.flatnonzero(cond == b)
        assert value == pytest.approx(np.mean(loop_lda(x, y, train, test) == y[test]))


def test_choice_of_features_does_not_leak(spark):
    """On noise, features chosen by all items would decode far above chance; those chosen in the training folds don't."""
    x, y = RNG.normal(size=(60, 600)), np.arange(60) % 2
    items = table(spark, x, y, 5)
    inside = classifiers.discriminant_accuracy(items, [], "fold", select=8).agg(F.avg("accuracy")).first()[0]
    f = [abs(x[y == 0, j].mean() - x[y == 1, j].mean()) for j in range(600)]
    best = np.argsort(f)[-8:]
    outside = classifiers.discriminant_accuracy(table(spark, x[:, best], y, 5), [], "fold").agg(F.avg("accuracy")).first()[0]
    assert outside > 0.75 and inside < 0.68


def test_fold_features_equal_the_formula(spark):
    x, y = correlated(30)
    x[:, 3] = 1.0  # no spread
    long = table(spark, x, y).select("label", "fold", F.posexplode("x").alias("f", "v"))
    got = classifiers.fold_features(long, [], "fold", "label", 4).collect()
    fold = np.arange(30) // 3 % 3
    for f in range(3):
        own = sorted((r for r in got if r.fold == f), key=lambda r: (r.score is None, -(r.score or 0)))
        train = fold != f
        n = np.array([np.sum(y[train] == c) for c in range(3)], float)
        s, q = (np.array([(x[train][y[train] == c] ** p).sum(axis=0) for c in range(3)]) for p in (1, 2))
        want = classifiers.f_values(n, s, q)
        assert len(own) == 4 and own[-1].f == 3 and own[-1].score is None
        assert [r.f for r in own[:3]] == list(np.argsort(-want, kind="stable")[:3]) and np.allclose([r.score for r in own[:3]], np.sort(want)[::-1][:3])
    assert classifiers.fold_features(long.limit(0), [], "fold", "label", 4).count() == 0


def test_stratified_folds_and_averages(spark):
    items = spark.createDataFrame([("a", k, "x" if k % 5 else "y", 0, [float(k), 1.0]) for k in range(203)], SCHEMA).drop("fold")
    got = classifiers.stratified_folds(items, ["cell"], 4).collect()
    for c in "xy":
        sizes = [sum(r.label == c and r.fold == f for r in got) for f in range(4)]
        assert sum(sizes) == sum((k % 5 > 0) == (c == "x") for k in range(203)) and max(sizes) - min(sizes) <= 1
        order = sorted((r.id for r in got if r.label == c), key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
        assert all({r.id: r.fold for r in got}[i] == k % 4 for k, i in enumerate(order))
    means = classifiers.averaged(items, ["cell", "label"], 10, 2, F.lit(1)).collect()
    for c in "xy":
        ids = sorted((r.id for r in got if r.label == c), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
        assert sorted(r.x[0] for r in means if r.label == c) == pytest.approx(sorted(np.mean(ids[k : k + 10]) for k in range(0, len(ids), 10)))
    assert classifiers.stratified_folds(items.limit(0), [], 4).count() == 0


def test_margin_models_are_near_a_numpy_fit(spark):
    r = np.random.default_rng(3)
    y = np.arange(200) % 2
    x = r.normal(size=(200, 5)) + 0.8 * y[:, None] * np.array([1, -1, 0.5, 0, 0])
    items = table(spark, x, y, 4)
    fold, hits = np.arange(200) // 3 % 4, []
    for f in range(4):
        train, test = fold != f, fold == f
        m, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z = np.column_stack([(x - m) / sd, np.ones(200)])
        w, n = np.zeros(6), train.sum()
        for _ in range(50):  # Newton's method for the logistic loss
            p = 1 / (1 + np.exp(-z[train] @ w))
            grad = z[train].T @ (p - y[train]) / n + np.append(w[:5], 0) / n
            hess = (z[train].T * (p * (1 - p))) @ z[train] / n + np.diag([1 / n] * 5 + [0])
            w -= np.linalg.solve(hess, grad)
        hits.append(np.mean((z[test] @ w > 0) == y[test]))
    for kind in ("logistic", "svc"):
        got = [r.accuracy for r in classifiers.margin_accuracy(items, "fold", kind=kind).collect()]
        assert len(got) == 4 and abs(np.mean(got) - np.mean(hits)) < 0.02
    three = classifiers.margin_accuracy(table(spark, *correlated(90)), "fold", kind="svc").agg(F.avg("accuracy")).first()[0]
    assert three > 0.5  # one against the rest
    assert classifiers.margin_accuracy(items.limit(0), "fold").count() == 0
