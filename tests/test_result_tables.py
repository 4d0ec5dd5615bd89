"""Summaries of result tables: nulls, NaN, labels in both atlases, theories' regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import results


def test_validated(spark):
    rows = [("a_one", 0.3, 0.01), ("a_one", -0.3, 0.01), ("a_one", 0.3, 0.05), ("b_two", -0.3, 0.01), ("b_two", 0.3, 0.01), ("b_two", None, 0.01), ("b_two", -0.1, None), ("c", 0.3, 0.01), (None, 0.3, 0.01)]
    out = results.validated(spark.createDataFrame(rows, "roi string, d double, p double"), "roi", {"one": 1, "two": -1}, "d", "p").collect()
    assert sorted((r.roi, r.d or 0, r.p or 0) for r in out if r.validated) == [("a_one", 0.3, 0.01), ("b_two", -0.3, 0.01)]
    assert len(out) == 7


def test_label_summary(spark):
    rows = [(1, "x", "p", 2.0, 1.0, "face"), (2, "x", None, -2.0, float("nan"), "object"), (3, "y", "p", None, 3.0, None), (4, "x", "q", 5.0, 5.0, "object")]
    df = spark.createDataFrame(rows, "subject long, fine string, coarse string, effect double, onset double, best string")
    out = results.label_summary(df, ["fine", "coarse", "subject"], {"up": F.col("effect") > 0, "face": F.col("best") == "face", "object": F.col("best") == "object"}, ["onset"])
    got = {(r.atlas, r.label): (r.n, r.n_up, r.n_face, r.n_object, r.mean_onset, r.sd_onset) for r in out.collect()}
    assert got["fine", "x"] == (3, 2, 1, 2, 3.0, 2.0) and got["fine", "y"] == (1, 0, 0, 0, 3.0, 0.0)
    assert got["coarse", "p"] == (2, 1, 1, 0, 2.0, 1.0) and ("coarse", None) not in got
    assert got["subject", "2"] == (1, 0, 0, 1, None, None) and len(got) == 8
    assert results.label_summary(df.where("false"), ["fine"], {}, ["onset"]).count() == 0
