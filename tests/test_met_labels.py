"""Tests of shuffled labels whose groups meet in one task: equal to arrays over perms, and nothing of that width leaves a task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import clusters, labels

THEORIES = {0: (1.0, 1.0), 1: (1.0, 0.0), 2: (0.0, 1.0), 3: (0.0, 0.0)}


def _rows(spark):
    r = np.random.default_rng(3)
    rows = [(g, i, i % 4, None if i == 5 and g == 2 else float(r.normal() + i % 4 * (g == 1))) for g in range(7) for i in range(20 + g)]
    rows += [(50, 1, 0, 1.0), (51, 1, 2, None), (52, 1, 1, 2.0), (52, 2, 1, 2.0), (None, 1, 1, 1.0), (53, None, 1, 1.0)]
    return spark.createDataFrame(rows, "g int, id long, label int, value double")


def _near(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


@pytest.mark.parametrize("group", [1 << 14, 22, 1])
def test_met_labels_equal_arrays(spark, group):
    df, perms = _rows(spark), 99
    sums = labels.label_sums(labels.with_label_arrays(df, ["g"], "id", "label", perms), ["g"], "id", "labels", "value")
    want = {(x.g, x.label): x for x in clusters.array_p(labels.d_prime_arrays(sums, ["g"]), ["g", "label"], "d", 1).collect()}
    got = {(x.g, x.label): x for x in labels.d_prime_test(df, ["g"], "id", "label", "value", perms, group).collect()}
    assert got.keys() == want.keys() and len(got) == 7 * 4 + 2
    assert all(_near(got[k].observed, want[k].observed) and _near(got[k].p, want[k].p) for k in want)
    want = {x.g: x for x in labels.theory_tests(sums, ["g"], THEORIES).collect()}
    got = {x.g: x for x in labels.theory_shuffle_tests(df, ["g"], "id", "label", "value", THEORIES, perms, group).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    assert all(_near(got[k][c], want[k][c]) for k in want for c in ("p_first", "p_second", "observed", "p"))
    assert labels.d_prime_test(df.limit(0), ["g"], "id", "label", "value", 9).count() == 0


def test_steps_over_perms_and_text_labels(spark, monkeypatch):
    monkeypatch.setattr(labels, "_PLACES", 64)
    x = np.arange(9.0)
    one = labels._sums_of([str(k) for k in range(9)], np.arange(9) % 2, x, 2, 30)
    monkeypatch.setattr(labels, "_PLACES", 1 << 20)
    two = labels._sums_of([str(k) for k in range(9)], np.arange(9) % 2, x, 2, 30)
    assert all(np.array_equal(a, b) for a, b in zip(one, two))
    df = _rows(spark).where("g < 3")
    named = df.withColumn("label", F.concat(F.lit("c"), "label"))
    plain = {(x.g, f"c{x.label}"): x.p for x in labels.d_prime_test(df, ["g"], "id", "label", "value", 49).collect()}
    assert {(x.g, x.label): x.p for x in labels.d_prime_test(named, ["g"], "id", "label", "value", 49).collect()} == plain


def test_only_results_leave_a_task(spark):
    plan = labels.d_prime_test(_rows(spark).where("g < 7"), ["g"], "id", "label", "value", 99)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan  # the groups that meet have no array of perms among their columns
    assert "array" not in plan.split("MapInArrow")[1].split("\n")[0]
