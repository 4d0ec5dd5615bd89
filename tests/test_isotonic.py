"""Isotonic calibration against the max-min formula, with ties, reversed targets, nulls, several ranges and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from trialmill.operators.isotonic import isotonic_fits, isotonic_probability, pooled

RNG = np.random.default_rng(2)


def formula(score, hit):
    """The fit at each distinct score: the greatest over starts of the least over ends of the mean between them."""
    x = np.unique(score)
    n, h = (np.array([w[score == v].sum() for v in x], float) for w in (np.ones(len(score)), hit))
    cn, ch = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(h))
    mean = lambda a, b: (ch[b + 1] - ch[a]) / (cn[b + 1] - cn[a])
    return x, np.array([max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))])


def table(spark, folds):
    rows = [(f, float(s), int(t)) for f, (score, hit) in folds.items() for s, t in zip(score, hit)]
    return spark.createDataFrame([*rows, ("a", None, 1), ("a", 1.0, None), ("a", float("nan"), 1)], "fold string, score double, target int")


def test_fits_equal_the_formula(spark):
    rough, fine = np.round(RNG.normal(size=150) * 2), RNG.normal(size=300)
    folds = {
        "a": (rough, RNG.random(150) < 1 / (1 + np.exp(-rough))), "b": (fine, RNG.random(300) < 1 / (1 + np.exp(-2 * fine))),
        "reversed": (fine[:40], fine[:40] < 0), "one": (np.array([3.0]), np.array([1])), "parted": (np.arange(6.0), np.arange(6) > 2),
    }
    rows = table(spark, folds).repartition(3)
    fits = isotonic_fits(rows, "fold", "score", "target")
    got = {}
    for r in fits.collect():
        got.setdefault(r.fold, []).append((r.lo, r.hi, r.n, r.value))
    assert got.keys() == folds.keys() and len(got["reversed"]) == 1 and len(got["parted"]) == 2
    for f, (score, hit) in folds.items():
        x, want = formula(score, hit)
        blocks = sorted(got[f])
        value = [next(v for lo, hi, _, v in blocks if lo <= s <= hi) for s in x]
        assert np.allclose(value, want) and sum(b[2] for b in blocks) == len(score)
        assert all(a[1] < b[0] and a[3] < b[3] for a, b in zip(blocks, blocks[1:]))
    judged = isotonic_probability(spark.createDataFrame([(k, s) for k, s in enumerate([-9.0, 0.3, 9.0, None])], "id int, score double"), fits, "fold", "score").orderBy("id").collect()
    for r in judged[:3]:
        each = [np.interp(r.score, *formula(*folds[f])) for f in folds]
        assert r.probability == pytest.approx(np.mean(each))
    assert judged[3].probability is None


def test_empty_tables(spark):
    rows = table(spark, {}).limit(0)
    fits = isotonic_fits(rows, "fold", "score", "target")
    assert fits.count() == 0
    one = spark.createDataFrame([(0.5, 7.0)], "score double, probability double")  # a clashing name is replaced
    got = isotonic_probability(one, fits, "fold", "score").first()
    assert got.probability is None and isotonic_probability(one.limit(0), fits, "fold", "score").count() == 0


def test_pooling_in_parts_is_pooling_at_once():
    for _ in range(50):
        n = int(RNG.integers(1, 60))
        k, h = RNG.integers(1, 4, n), None
        h = [int(RNG.integers(0, v + 1)) for v in k]
        x = list(range(n))
        whole = pooled(x, x, k.tolist(), h)
        cut = int(RNG.integers(0, n + 1))
        parts = [pooled(x[a:b], x[a:b], k[a:b].tolist(), h[a:b]) for a, b in ((0, cut), (cut, n))]
        assert pooled(*(p + q for p, q in zip(*parts))) == whole
