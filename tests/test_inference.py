"""Bayes factors against published values, empirical nulls, nested models, contrasts, label arrays, tau and wide tables against loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.functions import distributions as dist
from trialmill.operators import clusters, decoding, labels, results, stats, trials

RNG = np.random.default_rng(9)
INF = math.inf
#: Extra hours of sleep under the second drug, less those under the first, for ten patients: a data set in print since 1908.
SLEEP = [1.2, 2.4, 1.3, 1.3, 0.0, 1.0, 1.8, 0.8, 4.6, 1.4]


def test_published_bayes_factors():
    """Two-sided and one-sided factors of the sleep data with a Cauchy prior of scale sqrt(2) / 2, as widely used software prints them."""
    x = np.array(SLEEP)
    t, n, df = np.array([x.mean() / x.std(ddof=1) * math.sqrt(10)]), np.array([10.0]), np.array([9.0])
    assert dist.jzs_bayes_factor(t, n, df)[0] == pytest.approx(17.25888, abs=1e-4)
    assert dist.interval_ratio(t, n, df, 0, INF)[0] == pytest.approx(34.41694, abs=1e-4)
    assert dist.interval_ratio(t, n, df, -INF, 0)[0] == pytest.approx(0.1008246, abs=1e-6)


def test_interval_ratios_hang_together():
    t, n = np.array([-7.0, -0.3, 0.0, 1.5, 4.0, 12.0]), np.array([5.0, 12.0, 40.0, 40.0, 300.0, 5000.0])
    whole = dist.jzs_bayes_factor(t, n, n - 1)
    assert np.allclose(dist.interval_ratio(t, n, n - 1), whole, rtol=1e-4)
    assert np.allclose((dist.interval_ratio(t, n, n - 1, 0, INF) + dist.interval_ratio(t, n, n - 1, -INF, 0)) / 2, whole, rtol=1e-4)
    # a central t, and the density of a noncentral one by simulation
    assert np.allclose(dist.likelihood_ratio(t, n - 1, np.zeros((6, 1))), 1.0)
    draws = (RNG.normal(size=2_000_000) + 1.0) / np.sqrt(RNG.chisquare(8, 2_000_000) / 8)
    plain = RNG.normal(size=2_000_000) / np.sqrt(RNG.chisquare(8, 2_000_000) / 8)
    near = lambda v: np.mean(np.abs(v - 1.2) < 0.05)
    assert dist.likelihood_ratio(np.array([1.2]), np.array([8.0]), np.array([[1.0]]))[0, 0] == pytest.approx(near(draws) / near(plain), rel=0.02)


def test_bayes_columns_with_nulls(spark):
    rows = spark.createDataFrame([(2.0, 10, 9), (None, 10, 9), (1.0, 1, 0)], "t double, n int, df int")
    got = rows.select(dist.bayes_factor_between("t", "n", "df", 0.0, INF).alias("a"), dist.interval_null_bf01("t", "n", "df", 0.1).alias("b")).collect()
    assert got[0].a > 1 and 0 < got[0].b < 10 and all(r.a is None and r.b is None for r in got[1:])


def test_bayes_map_wants_all_subjects(spark):
    rows = [("m", v, float(RNG.normal() + v)) for v in range(3) for _ in range(6)] + [("m", 7, 1.0)] * 5 + [("m", 8, None)] * 6
    got = {r.v: r for r in stats.bayes_map(spark.createDataFrame(rows, "map string, v int, x double"), ["map", "v"], "x", 6, 1.0).collect()}
    assert got[7].bf01 is None and got[8].bf01 is None and got[0].bf01 is not None
    assert all((r.over is not None) == (r.bf01 is not None and r.bf01 > 1) for r in got.values())


def test_empirical_null(spark):
    hits = spark.createDataFrame([("a", 32, 50), ("b", 25, 50), ("c", 5, 9)], "c string, k int, n int")
    nulls = {"a": RNG.random(30) * 0.2 + 0.4, "b": np.full(400, 0.5)}
    rows = spark.createDataFrame([(c, float(v)) for c, x in nulls.items() for v in x] + [("a", None)], "c string, p double")
    got = {r.c: r for r in stats.empirical_null_test(hits, rows, ["c"], "k", "n", "p").collect()}
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    for c, k in (("a", 32), ("b", 25)):
        total = int((nulls[c] * 50).sum() + 1e-9)
        a, b = 1000 + total, 1000 + len(nulls[c]) * 50 - total
        if max(a, b) > 5000:
            a, b = a * 5000 / max(a, b), b * 5000 / max(a, b)
        want = math.exp(beta(1 + k, 51 - k) - beta(1, 1) - beta(a + k, b + 50 - k) + beta(a, b))
        assert got[c].bf10 == pytest.approx(want) and got[c].p == pytest.approx(np.mean(nulls[c] >= k / 50 - 1e-9))
    assert got["c"].p is None and stats.empirical_null_test(hits.limit(0), rows, ["c"], "k", "n", "p").count() == 0


def likelihood(y, x, subject, ratio):
    """logLik at its best coefficients by dense matrices."""
    v = np.eye(len(y)) + ratio * (subject[:, None] == subject[None])
    inverse = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ inverse @ x)
    beta = cov @ x.T @ inverse @ y
    left = y - x @ beta
    s2 = left @ inverse @ left / len(y)
    return -0.5 * (len(y) * np.log(2 * np.pi * s2) + np.linalg.slogdet(v)[1] + len(y)), beta, cov * s2


def model_table(spark):
    n = 90
    subject = RNG.integers(0, 12, n)
    late, size = RNG.integers(0, 2, n).astype(float), RNG.random(n)
    y = 1 + 0.8 * late + RNG.normal(size=12)[subject] + RNG.normal(size=n)
    rows = [("g", int(subject[k]), float(y[k]), float(late[k]), float(size[k])) for k in range(n)]
    df = spark.createDataFrame([*rows, ("g", 3, None, 1.0, 1.0)], "g string, subject int, y double, late double, size double")
    return df, y, np.column_stack([np.ones(n), late, size]), subject


def test_nested_models_equal_a_dense_fit(spark):
    df, y, x, subject = model_table(spark)
    models = {"null": [], "late": ["late"], "both": ["late", "size"]}
    fits = stats.compared_models(df, ["g"], "subject", "y", models).cache()
    rows = fits.collect()
    best = {}
    for name, chosen in models.items():
        at = x[:, : len(chosen) + 1]
        ll, beta, cov = max((likelihood(y, at, subject, r) for r in [0, *np.exp(np.linspace(-6, 3, 200))]), key=lambda f: f[0])
        best[name] = ll
        for r in (r for r in rows if r.model == name):
            i = ["one", *chosen].index(r.coefficient)
            assert r.log_lik == pytest.approx(ll, abs=1e-3) and r.estimate == pytest.approx(beta[i], abs=5e-3) and r.se == pytest.approx(math.sqrt(cov[i, i]), rel=2e-2)
            assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2))) and r.aic == pytest.approx(2 * (len(chosen) + 3) - 2 * r.log_lik)
    assert {r.model for r in rows if r.best_aic} == {min(models, key=lambda m: 2 * len(models[m]) - 2 * best[m])}
    ratio = {(r.small, r.large): r for r in stats.likelihood_ratios(fits, ["g"], [("null", "late"), ("late", "both")]).collect()}
    assert ratio["null", "late"].chi2 == pytest.approx(2 * (best["late"] - best["null"]), abs=5e-3) and ratio["null", "late"].df == 1
    assert ratio["null", "late"].p == pytest.approx(math.erfc(math.sqrt(ratio["null", "late"].chi2 / 2)))
    assert stats.compared_models(df.limit(0), ["g"], "subject", "y", models).count() == 0


def test_contrasts_follow_the_model(spark):
    df, *_ = model_table(spark)
    slope = {r.coefficient: r for r in stats.random_intercept_models(df, ["g"], "subject", "y", ["late", "size"]).collect()}
    got = {(r.first, r.second): r for r in stats.model_contrasts(df, ["g"], "subject", "y", ["late", "size"], {"a": {"late": 1.0}, "b": {}, "c": {"late": 1.0, "size": 1.0}}).collect()}
    assert len(got) == 3
    one = got["a", "b"]  # a step of one predictor is its coefficient
    assert one.difference == pytest.approx(slope["late"].estimate) and one.se == pytest.approx(slope["late"].se) and one.p == pytest.approx(slope["late"].p)
    assert one.p_bonferroni == pytest.approx(min(1, 3 * one.p)) and got["a", "c"].difference == pytest.approx(-slope["size"].estimate)


def test_chi_square():
    for x, df, want in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (0.0, 5, 1.0)):
        assert dist.chi2_sf(np.array([x]), np.array([df]))[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("group", [1 << 14, 3])
def test_label_arrays_are_the_shuffled_rows(spark, group):
    rows = [("ab"[k > 7], k, k % 3, float(RNG.normal())) for k in range(20)] + [("c", 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id int, label int, v double")
    perms = 12
    arrays = labels.with_label_arrays(df, ["g"], "id", "label", perms, group)
    want = {(r.perm, r.g, r.id): r.label for r in stats.shuffled_labels(df, ["g"], "id", "label", perms).collect()}
    got = {(p, r.g, r.id): v for r in arrays.collect() for p, v in enumerate(r.labels)}
    assert got == want and len(got) == 21 * (perms + 1)
    sums = labels.label_sums(arrays, ["g"], "id", "labels", "v")
    for r in sums.collect():
        for p in range(perms + 1):
            own = [v for g, i, _, v in rows if g == r.g and want[p, g, i] == r.label]
            assert r.n[p] == len(own) and r.s[p] == pytest.approx(sum(own)) and r.q[p] == pytest.approx(sum(v * v for v in own))
    shuffled = stats.shuffled_labels(df, ["g"], "id", "label", perms)
    plain = {(r.g, r.perm, r.label): r.d for r in stats.category_d_prime(shuffled, ["g", "perm"], "label", "v").collect()}
    for r in labels.d_prime_arrays(sums, ["g"]).collect():
        assert all((plain[r.g, p, r.label] is None and (d is None or math.isnan(d))) or d == pytest.approx(plain[r.g, p, r.label]) for p, d in enumerate(r.d))
    z = F.corr("v", F.when(F.col("label") == 0, 1.0).otherwise(0.0)) - F.corr("v", F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    plain = {(r.g, r.perm): r.z for r in shuffled.where("g <> 'c'").groupBy("g", "perm").agg(z.alias("z")).collect()}
    for r in labels.correlation_difference(sums, ["g"], {0: (1.0, 0.0), 1: (0.0, 1.0), 2: (0.0, 0.0)}).where("g <> 'c'").collect():
        assert r.z == pytest.approx([plain[r.g, p] for p in range(perms + 1)])
    assert labels.label_sums(labels.with_label_arrays(df.limit(0), ["g"], "id", "label", 2), ["g"], "id", "labels", "v").count() == 0


def test_array_p(spark):
    rows = spark.createDataFrame([(1, [2.0, -3.0, 1.0, float("nan")]), (2, [float("nan"), 1.0, 1.0, 1.0])], "k int, v array<double>")
    p = {tail: {r.k: r.p for r in clusters.array_p(rows, ["k"], "v", tail).collect()} for tail in (1, -1, 0)}
    assert p[1][1] == pytest.approx(1 / 3) and p[-1][1] == pytest.approx(1.0) and p[0][1] == pytest.approx(2 / 3) and p[0][2] is None


def test_tau_by_runs_equals_all_pairs(spark):
    rows = [("a", k, float(RNG.integers(0, 9)), float(RNG.integers(0, 9))) for k in range(70)] + [("b", k, float(k), float(-k)) for k in range(5)] + [("c", 0, 1.0, 1.0), ("d", 0, None, 1.0), ("e", 0, 1.0, 2.0), ("e", 1, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    got = {r.g: r for r in stats.kendall_by_runs(df, ["g"], "x", "y").collect()}
    want = {r.g: r.tau for r in stats.kendall_tau(df, ["g"], "i", "x", "y").collect()}
    assert got["a"].tau == pytest.approx(want["a"]) and got["b"].tau == -1 and got["a"].n == 70
    assert got["c"].tau is None and got["e"].tau is None and "d" not in got
    assert stats.kendall_by_runs(df.limit(0), ["g"], "x", "y").count() == 0


def test_wide_tables_and_best_models(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None), (None, 3.0)], "c int, v double")
    b = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "c int, name string")
    got = {r.c: r for r in results.wide_table({"one": a, "two": b}, ["c"]).collect()}
    assert (got[1].one_v, got[1].two_name, got[1].sources) == (0.5, None, "one") and got[2].sources == "one+two"
    assert got[3].two_name == "y" and got[None].one_v == 3.0 and len(got) == 4
    models = spark.createDataFrame([("c", "m1", 1.0), ("c", "m2", 1.0), ("c", "m3", 2.0), ("d", "m1", None)], "c string, m string, bic double")
    tests = spark.createDataFrame([("c", "m1", 7.0), ("c", "m3", 8.0)], "c string, m string, f double")
    assert {(r.c, r.m, r.f) for r in results.best_with(models, tests, ["c"], "m", "bic").collect()} == {("c", "m1", 7.0), ("c", "m2", None)}


def test_responses_in_trigger_time(spark):
    log = spark.createDataFrame([("s", 1, 0.5, "r"), ("s", 2, 1.0, "e"), ("s", 3, 1.4, "r"), ("s", 4, 1.5, "r"), ("s", 5, 2.0, "e"), ("s", 6, 2.5, "r"), ("u", 7, 3.0, "r")], "s string, id int, t double, kind string")
    triggers = spark.createDataFrame([(2, 101.0)], "id int, trigger double")  # that of event 5 is missing
    got = {r.id: r.trigger for r in trials.with_responses(log, triggers, ["s"], "id", ["t", "id"], "t", "trigger", F.col("kind") == "r").collect()}
    assert got[1] is None and got[7] is None and got[5] is None and got[2] == 101.0
    assert got[3] == pytest.approx(101.4) and got[4] == pytest.approx(101.5) and got[6] == pytest.approx(102.5)


def test_sustained_significance(spark):
    p = [0.5, 0.01, 0.6, 0.04, 0.03, 0.001, 0.002, 0.9]
    rows = spark.createDataFrame([("a", t, v, min(1.0, v * 8), 1.0) for t, v in enumerate(p)] + [("b", t, 0.001, 0.001, -1.0) for t in range(3)] + [("c", 0, None, None, 1.0)], "c string, t int, p double, p_fdr double, side double")
    got = {r.c: (r.onset, r.onset_fdr) for r in stats.sustained_significant(rows, ["c"], "t", F.col("side") > 0, 0.05, 2).collect()}
    assert got == {"a": (3, 5)}


def test_permuted_centroids_equal_repeated_rows(spark):
    x = RNG.normal(size=(30, 3)) + (np.arange(30) % 2)[:, None]
    x[7] = x[9]
    rows = [(k, "ab"[k % 2], k % 3, [float(v) for v in x[k]]) for k in range(30)]
    items = spark.createDataFrame([*rows, (90, None, 0, [1.0] * 3), (91, "a", 0, None), (92, "a", 1, [1.0, None, 1.0])], "id int, label string, run int, x array<double>")
    got = labels.permuted_centroids(items, ["run"], "run", 15).first()
    kept = items.where("id < 90")
    long = kept.select("id", "label", "run", F.posexplode("x").alias("f", "v"))
    want = {r.perm: r.accuracy for r in decoding.permuted(kept, long, ["run"], "run", 15).collect()}
    assert got.n == 30 and got.accuracy == pytest.approx([want[p] for p in range(16)])
    assert labels.permuted_centroids(items.limit(0), ["run"], "run", 15).count() == 0


def test_theories_by_rank_correlation(spark):
    v = RNG.integers(0, 6, (4, 5, 5)).astype(float)
    cells = spark.createDataFrame([(k, x, y, float(v[k, x, y])) for k in range(4) for x in range(5) for y in range(5)], "subject int, x int, y int, v double")
    p = np.zeros((5, 5))
    p[1:3, 1:3] = 1
    predicted = spark.createDataFrame([("a", x, y, float(p[x, y])) for x in range(5) for y in range(5)], "theory string, x int, y int, predicted double")
    tau = []
    for k in range(4):
        a, b = np.sign(np.subtract.outer(v[k].ravel(), v[k].ravel())), np.sign(np.subtract.outer(p.ravel(), p.ravel()))
        tau.append((a * b).sum() / math.sqrt(abs(a).sum() * abs(b).sum()))
    got = decoding.theory_rank_correlation(cells, predicted, "subject").first()
    assert got.n == 4 and got["mean"] == pytest.approx(np.mean(tau)) and got.t == pytest.approx(np.mean(tau) / np.std(tau, ddof=1) * 2)
    assert decoding.theory_rank_correlation(cells.limit(0), predicted, "subject").count() == 0


def test_binomial_factors_as_columns(spark):
    """The whole formula runs in tasks, also after the driver has used it: 8 of 10, and 1 of 1."""
    dist.log_beta(np.array([2.0]), np.array([3.0]))
    got = spark.createDataFrame([(8, 10), (1, 1)], "k long, n long").select(dist.beta_binomial_bf("k", "n").alias("bf"), dist.binomial_p("k", "n").alias("p")).collect()
    assert got[0].bf == pytest.approx(1 / 11 / math.comb(10, 8) * 2**10) and got[0].p == pytest.approx(56 / 1024)
    assert got[1].bf == pytest.approx(1.0) and got[1].p == pytest.approx(0.5)
