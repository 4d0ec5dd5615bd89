"""Random forests by fold, and theory differences behind a test of each theory."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import classifiers, labels


@pytest.fixture(scope="module")
def corners(spark):
    """Labels by the sign of the product of two features: no line tells them apart."""
    r = np.random.default_rng(4)
    x = r.uniform(-1, 1, (240, 2))
    rows = [(i, "even" if a * b > 0 else "odd", i % 3, [float(a), float(b)]) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label string, fold int, x array<double>").cache()


def test_forest_bends(corners):
    forest = {r.fold: r.accuracy for r in classifiers.forest_accuracy(corners, "fold", trees=40).collect()}
    linear = [r.accuracy for r in classifiers.discriminant_accuracy(corners, [], "fold").collect()]
    assert len(forest) == 3 and min(forest.values()) >= 0.88 and np.mean(linear) < 0.65


def test_forest_does_not_see_the_order_of_rows(corners):
    a = {r.id: r.guess for r in classifiers.forest_guesses(corners, "fold", trees=5).collect()}
    b = {r.id: r.guess for r in classifiers.forest_guesses(corners.repartition(7).orderBy(F.desc("id")), "fold", trees=5).collect()}
    assert a == b and len(a) == 240


def test_forest_of_odd_tables(spark, corners):
    assert classifiers.forest_accuracy(corners.where("false"), "fold", trees=3).count() == 0
    odd = spark.createDataFrame([(1, "a", 0, [1.0]), (2, None, 0, [1.0]), (3, "a", 1, None), (4, "a", 1, [float("nan")]), (5, "a", 1, [2.0])], corners.schema)
    assert sorted((r.id, r.guess) for r in classifiers.forest_guesses(odd, "fold", trees=3).collect()) == [(1, "a"), (5, "a")]
    alone = classifiers.forest_guesses(odd.where("fold = 0"), "fold", trees=3).collect()
    assert [(r.id, r.guess) for r in alone] == [(1, None)]


def test_gate_keeps_groups_with_a_theory(spark):
    r = np.random.default_rng(2)
    rows = []
    for g in range(12):
        for i in range(24):
            label = i % 4
            rows.append((g, i, label, float(r.normal() + (3 * (label < 2) if g == 0 else 3 * (label % 2 == 0) if g == 1 else 0))))
    df = spark.createDataFrame([*rows, (99, 1, 0, 1.0), (99, 2, 0, 1.0)], "g int, id long, label int, value double")
    theories = {0: (1.0, 1.0), 1: (1.0, 0.0), 2: (0.0, 1.0), 3: (0.0, 0.0)}
    sums = labels.label_sums(labels.with_label_arrays(df, ["g"], "id", "label", 199), ["g"], "id", "labels", "value")
    got = {x.g: x for x in labels.gated_theory_test(sums, ["g"], theories).collect()}
    assert got[0].p_first <= 0.01 and got[0].observed > 0 and got[0].p <= 0.05
    assert got[1].p_second <= 0.01 and got[1].observed < 0 and got[1].p >= 0.95
    assert len(got) <= 5 and 99 not in got
    every = labels.theory_correlations(sums, ["g"], theories).collect()
    for x in every:
        own = [(v, theories[c]) for g, _, c, v in rows if g == x.g]
        if own:
            v, a, b = np.array([o[0] for o in own]), *np.array([o[1] for o in own]).T
            assert np.isclose(x["first"][0], np.corrcoef(v, a)[0, 1]) and np.isclose(x["second"][0], np.corrcoef(v, b)[0, 1])
    assert labels.gated_theory_test(sums.where("false"), ["g"], theories).count() == 0
