"""Decoding operators on a few literal rows, with nulls, ties and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import decoding

ROWS = [(k, "ab"[k % 2], k // 4, float(k % 2) + 0.01 * k) for k in range(12)]


def long(spark, rows=ROWS):
    return spark.createDataFrame([(i, label, run, 0, v) for i, label, run, v in rows], "id int, label string, run int, f int, v double")


def test_folds_and_generalisation(spark):
    rows = long(spark, [*ROWS, (90, None, 0, 1.0), (91, "a", 0, None)])
    assert {(r.run, r.accuracy, r.n) for r in decoding.cross_validated(rows, [], "run").collect()} == {(0, 1.0, 4), (1, 1.0, 4), (2, 1.0, 4)}
    got = decoding.generalisation(rows, [], "run").collect()
    assert len(got) == 6 and all(r.accuracy == 1.0 and r.train != r.test for r in got)
    assert decoding.cross_validated(rows.limit(0), [], "run").count() == decoding.generalisation(rows.limit(0), [], "run").count() == 0


def test_ties_go_to_the_smaller_label(spark):
    rows = long(spark, [(1, "b", 0, 0.0), (2, "a", 0, 2.0), (3, "b", 1, 1.0), (4, "a", 1, 1.0)])
    got = {(r.train, r.test): r.accuracy for r in decoding.generalisation(rows, [], "run").collect()}
    assert got[0, 1] == 0.5  # 1.0 lies between both centroids: "a" is guessed for both items


def test_permutations_keep_the_observed_labels(spark):
    rows = long(spark)
    got = {r.perm: r.accuracy for r in decoding.permuted(rows.select("id", "label", "run"), rows, ["run"], "run", 9).collect()}
    assert len(got) == 10 and got[0] == 1.0 and min(got.values()) < 1.0


def test_grid_cluster_test(spark):
    cells = [(0, p, x, y, 3.0 if p == 0 and x in (2, 3) and y < 3 else 2.0 if (x, y) == (6, 6) else 0.0) for p in range(4) for x in range(8) for y in range(8)]
    got = decoding.grid_cluster_test(spark.createDataFrame(cells, "k int, perm int, x int, y int, value double"), ["k"], "x", "y", 1.0).collect()
    assert sorted((r.cells, r.mass, r.p) for r in got) == [(1, 2.0, 1.0), (6, 18.0, 0.25)]


def test_smoothing(spark):
    rows = spark.createDataFrame([(t, float(t)) for t in range(6)], "t int, v double").withColumn("k", F.lit(1))
    assert [r.v for r in decoding.smoothed(rows, ["k"], "t", "v").orderBy("t").collect()] == [1.0, 1.5, 2.0, 3.0, 3.5, 4.0]
