"""Operators on a few literal rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trialmill.functions import distributions as dist
from trialmill.functions.normal import norm_cdf, norm_ppf
from trialmill.operators import intervals, signals, stats, trials


def test_codes_and_labels(spark):
    row = spark.createDataFrame([(4302.0,), (None,)], "code double").select(*trials.parse_code(F.col("code"))).collect()
    assert tuple(row[0]) == ("falseFont", "right", "02") and tuple(row[1]) == (None, None, None)
    labels = spark.createDataFrame([(True, True), (True, None), (False, True), (False, None)], "e boolean, g boolean").select(trials.response_label(F.col("e"), F.col("g")).alias("x"))
    assert [r.x for r in labels.collect()] == ["TruePositive", "FalseNegative", "FalsePositive", "TrueNegative"]


def test_range_join_holds_bounds_and_empty_tables(spark):
    points = spark.createDataFrame([(1, "a", 0.0), (2, "a", 5.0), (3, "a", 10.0), (4, "b", 5.0)], "id int, k string, t double")
    spans = spark.createDataFrame([("a", 0.0, 5.0, 7), ("a", None, 5.0, 8)], "k string, lo double, hi double, s int")
    assert sorted((r.id, r.s) for r in intervals.range_join(points, spans, ["k"], "t", "lo", "hi", 2.0).collect()) == [(1, 7), (2, 7)]
    assert intervals.range_join(points, spans.limit(0), ["k"], "t", "lo", "hi", 2.0).count() == 0
    assert intervals.range_join(points, spans, ["k"], "t", "lo", "hi", 2.0, "left_anti").count() == 2


def test_islands_and_merging(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, None), (4, 1)], "t int, v int").withColumn("k", F.lit(1))
    got = intervals.islands(rows, ["k"], ["t"], F.col("v") == 1, "t").orderBy("lo").collect()
    assert [(r.lo, r.hi, r["size"]) for r in got] == [(0, 1, 2), (4, 4, 1)]
    spans = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 12, 13), (1, 40, 41)], "k int, lo int, hi int")
    assert sorted((r.lo, r.hi) for r in intervals.merge_close(spans, ["k"], 5).collect()) == [(0, 13), (40, 41)]


def test_references(spark):
    sig = spark.createDataFrame([("c", 0, 0.0), ("a", 0, 1.0), ("b", 0, 3.0)], "channel string, t int, value double")
    refs = spark.createDataFrame([("c", "a", "b")], "channel string, ref1 string, ref2 string")
    assert signals.laplacian(sig, refs, ["t"]).first().value == -2.0
    one = spark.createDataFrame([("c", "a", None)], "channel string, ref1 string, ref2 string")
    assert signals.laplacian(sig, one, ["t"]).first().value == -1.0
    ref = spark.createDataFrame([("r1", 0, 1.0), ("r2", 0, 0.0), ("x", 0, 10000.0)], "channel string, t int, value double")
    got = {r.channel: r.value for r in signals.average_reference(ref, ["t"], F.col("channel").isin("r1", "r2"), F.col("channel") != "x").collect()}
    assert got == {"r1": 0.5, "r2": -0.5, "x": 10000.0}


def test_moving_mean_of_pairs(spark):
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 1, 2, 2, 3, 3])], "k int, t int, value double")
    assert [r.smooth for r in signals.moving_mean(rows, ["k"], 0, 1).orderBy("t").collect()] == [1.0, 1.5, 2.0, 2.5, 3.0]


def test_cluster_test_finds_planted_stretch(spark):
    r = np.random.default_rng(3)
    rows = [(0, t, p, float(r.normal() + (4 if p == 0 and 10 <= t < 20 else 0))) for p in range(60) for t in range(40)]
    got = stats.cluster_test(spark.createDataFrame(rows, "k int, t int, perm int, value double"), ["k"], 1.8).where("p < 0.05").collect()
    assert [(x.lo, x.hi) for x in got] == [(10, 19)] or (len(got) == 1 and got[0].lo <= 11 and got[0].hi >= 18)


def test_grid_clusters(spark):
    on = {(0, 0), (0, 1), (1, 1), (3, 3)}
    cells = spark.createDataFrame([(0, x, y, 1.0 if (x, y) in on else 0.0) for x in range(5) for y in range(5)], "k int, x int, y int, v double")
    got = stats.grid_clusters(cells, ["k"], "x", "y", "v", 0.5).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == [1, 3]


def test_normal_and_t(spark):
    row = spark.createDataFrame([(0.975, 1.959964)], "p double, z double").select(norm_ppf("p").alias("z"), norm_cdf("z").alias("p")).first()
    assert abs(row.z - 1.959964) < 1e-5 and abs(row.p - 0.975) < 1e-5
    assert abs(dist.t_cdf(np.array([2.228139]), np.array([10.0]))[0] - 0.975) < 1e-6
    assert abs(dist.f_cdf(np.array([4.964603]), np.array([1.0]), np.array([10.0]))[0] - 0.95) < 1e-6
    assert dist.jzs_bayes_factor(np.array([0.0, 5.0]), np.array([20.0, 20.0]), np.array([19.0, 19.0]))[0] < 1 < dist.jzs_bayes_factor(np.array([5.0]), np.array([20.0]), np.array([19.0]))[0]


def test_mixed_model_recovers_coefficients(spark):
    r = np.random.default_rng(1)
    rows = [(0, s, float(x), float(2 + 3 * x + b + r.normal() * 0.1)) for s, b in enumerate(r.normal(size=40)) for x in r.uniform(size=15)]
    got = {x.coefficient: x for x in stats.random_intercept_models(spark.createDataFrame(rows, "k int, s int, x double, y double"), ["k"], "s", "y", ["x"]).collect()}
    assert abs(got["x"].estimate - 3) < 0.05 and 0.4 < got["x"].subject_variance < 2
