"""Sums of sign flips against rows repeated for each perm, with a hot group, nulls and an empty table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import stats

PERMS = 20


def test_flipped_sums_equal_repeated_rows(spark):
    hot = [("hot", None, str(k), (k * 37 % 101) / 7 - 6) for k in range(2500)]  # longer than a step of a task
    rows = [*hot, ("a", 1, "s1", 1.5), ("a", 1, "s2", -2.0), ("a", 1, None, 4.0), ("a", 2, "s1", None), (None, 2, "s1", 3.0), (None, 2, "s1", 3.0)]
    df = spark.createDataFrame(rows, "g string, h int, subject string, v double").repartition(3)
    signed = stats.permutations(df, PERMS).withColumn("x", F.col("v") * stats.sign_of(F.col("perm"), F.col("subject")))
    want = {(r.g, r.h, r.perm): r for r in signed.groupBy("g", "h", "perm").agg(F.count("x").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("x") ** 2), F.lit(0.0)).alias("q")).collect()}
    got = {(r.g, r.h, r.perm): r for r in stats.flipped_sums(df, ["g", "h"], "subject", "v", PERMS).collect()}
    assert got.keys() == want.keys() and len(got) == 4 * (PERMS + 1)
    for k, r in got.items():
        assert r.n == want[k].n and abs(r.s - want[k].s) < 1e-8 and abs(r.q - want[k].q) < 1e-6
    t = {(r.g, r.h, r.perm): r.t for r in stats.flipped_t(df, ["g", "h"], "subject", "v", PERMS).collect()}
    assert t["a", 2, 0] is None and t[None, 2, 0] is None and t["hot", None, 0] is not None  # no values, no spread
    whole = stats.flipped_sums(df, [], "subject", "v", PERMS).where("perm = 0").first()
    assert whole.n == len(rows) - 1
    assert stats.flipped_sums(df.limit(0), ["g"], "subject", "v", PERMS).count() == 0


def test_groups_that_meet_equal_spread_ones(spark):
    """A null, a group without spread, one of a single row and one of nulls alone."""
    rows = [(g, s, float((s * 7 + g * 3) % 11) - 4.0) for g in range(4) for s in range(6)] + [(0, 9, None), (5, 1, 2.0), (6, 1, None), (7, 1, 0.0), (7, 2, 0.0)]
    df = spark.createDataFrame(rows, "g long, s int, v double")
    near, far = ({r.g: (r.t, r.p) for r in stats.sign_flip_test(df, ["g"], "s", "v", 99, spread=spread).collect()} for spread in (False, True))
    assert near == far and len(near) == 7 and near[5] == near[6] == near[7] == (None, None)
    assert "Union" not in stats.sign_flip_test(df, ["g"], "s", "v", 9)._jdf.queryExecution().toString()
