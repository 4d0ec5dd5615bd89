"""Combinations within fixed columns: equal to grouping sets, without a row repeated for each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import trials


def test_fixed_combinations_equal_grouping_sets(spark):
    rows = [(k % 5 or None, "ab"[k % 2], None if k % 7 == 0 else "xyz"[k % 3], None if k % 11 == 0 else k * 1.25) for k in range(120)]
    df = spark.createDataFrame(rows, "subject int, flag string, status string, value double")
    found = trials.stats_by_combination(df, "value", ["flag", "status"], ["subject"])
    assert found.columns == ["subject", "flag", "status", "mean", "sd", "n", "level"]
    every = [F.col(c) for c in ("subject", "flag", "status")]
    want = df.groupingSets([every[:2], every[::2], every], *every).agg(F.avg("value"), F.stddev_samp("value"), F.count("value"), F.grouping_id())
    plain = lambda x: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()), key=repr)
    assert plain(found) == plain(want)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
