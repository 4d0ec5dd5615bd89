"""The random intercept model against the dense likelihood, and what its solver sees."""

from __future__ import annotations

import numpy as np

from trialmill.operators import stats


def planted(subjects: int) -> list[tuple]:
    r = np.random.default_rng(5)
    return [(0, s, float(x), float(1 - 2 * x + b + r.normal() * 0.5)) for s, b in enumerate(r.normal(size=subjects)) for x in r.uniform(size=3 + s % 4)]


def test_solver_sees_sizes_not_subjects(spark):
    df = spark.createDataFrame(planted(300), "k int, s int, x double, y double")
    got = stats.sums_by_size(df, ["k"], "s", "y", ["x"]).collect()
    assert sorted((r.n, r.subjects) for r in got) == [(3, 75), (4, 75), (5, 75), (6, 75)]


def test_model_equals_dense_likelihood(spark):
    rows = planted(30)
    got = {r.coefficient: r for r in stats.random_intercept_models(spark.createDataFrame(rows, "k int, s int, x double, y double"), ["k"], "s", "y", ["x"]).collect()}
    s, x, y = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    design, same = np.stack([np.ones(len(y)), x], axis=1), s[:, None] == s[None, :]

    def fit(ratio):
        v = np.eye(len(y)) + ratio * same
        inverse = np.linalg.inv(v)
        covariance = np.linalg.inv(design.T @ inverse @ design)
        beta = covariance @ design.T @ inverse @ y
        sigma2 = (y - design @ beta) @ inverse @ (y - design @ beta) / len(y)
        return -0.5 * (len(y) * np.log(2 * np.pi * sigma2) + np.linalg.slogdet(v)[1] + len(y)), beta, np.sqrt(np.diag(covariance) * sigma2), ratio * sigma2

    ll, beta, se, variance = max((fit(r) for r in np.exp(np.linspace(-3, 4, 400))), key=lambda f: f[0])
    assert got["x"].subjects == 30 and abs(got["x"].log_lik - ll) < 1e-3 and abs(got["x"].subject_variance - variance) < 0.05
    assert np.allclose([got["one"].estimate, got["x"].estimate], beta, atol=1e-3) and np.allclose([got["one"].se, got["x"].se], se, atol=1e-3)
