"""Matrices of differences between points against a loop, with groups that span batches, gaps and nulls."""

from __future__ import annotations

import numpy as np
import pytest

from trialmill.operators import signals


def test_matrices_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(g, u, t, None if rng.random() < 0.1 else float(rng.normal())) for g in range(7) for u in range(5) for t in range(6) if rng.random() < 0.6]
    rows += [(None, 0, 0, 1.0), (8, None, 0, 1.0), (9, 0, 1, None), (9, 0, 2, 3.0)]
    df = spark.createDataFrame(rows, "g long, u int, t int, v double").repartition(3)
    want = {}
    for g, u, x, p in rows:
        for h, w, y, q in rows:
            if None not in (g, u) and (g, u) == (h, w):
                want.setdefault((g, x, y), []).extend([abs(p - q)] if p is not None and q is not None else [])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {(r.g, r.x, r.y): r.v for r in signals.difference_matrices(df, ["g"], "u", "t", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want)
    assert all(got[k] == (pytest.approx(np.mean(v)) if v else None) for k, v in want.items())
    assert signals.difference_matrices(df.limit(0), ["g"], "u", "t", "v").count() == 0


def test_plan_joins_no_rows(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0)], "g long, u int, t int, v double")
    assert "Join" not in signals.difference_matrices(df, ["g"], "u", "t", "v")._jdf.queryExecution().toString()
