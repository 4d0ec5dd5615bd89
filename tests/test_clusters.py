"""Cluster tests on arrays of perms against loops, the block of a noisy grid, swaps of subjects, and odd tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import clusters

RNG = np.random.default_rng(6)


def loop_clusters(v, threshold, sides=(1,)):
    """Stretches (cells, sum) of a list, or sets of neighbours of a grid, of one sign each."""
    v, out = np.atleast_2d(v), []
    grid = v.shape[0] > 1
    for side in sides:
        left = {tuple(c) for c in np.argwhere(v * side > threshold)}
        while left:
            heap, found = [left.pop()], []
            while heap:
                c = heap.pop()
                found.append(c)
                for step in ((0, 1), (0, -1), *(((1, 0), (-1, 0)) if grid else ())):
                    n = (c[0] + step[0], c[1] + step[1])
                    if n in left:
                        left.remove(n)
                        heap.append(n)
            out.append((sorted(found), sum(v[c] for c in found)))
    return out


@pytest.mark.parametrize("shape", [(30,), (9, 11)])
@pytest.mark.parametrize("tail", [1, -1, 0])
def test_clusters_and_p_equal_a_loop(shape, tail):
    values = RNG.normal(size=(40, *shape))
    sides = {1: (1,), -1: (-1,), 0: (1, -1)}[tail]
    got = clusters.find_clusters(values, 0.8, tail)
    want = loop_clusters(values[0], 0.8, sides)
    top = [max((abs(m) for _, m in loop_clusters(v, 0.8, sides)), default=0.0) for v in values]
    assert sorted(round(m, 9) for _, m, _ in got) == sorted(round(m, 9) for _, m in want)
    for mask, mass, p in got:
        cells = [c if len(shape) == 2 else (0, *c) for c in map(tuple, np.argwhere(mask).tolist())]
        assert sorted(cells) in [[tuple(map(int, c)) for c in w[0]] for w in want]
        assert p == pytest.approx(np.mean([t >= abs(mass) - 1e-9 for t in top]))


def test_block_of_a_noisy_grid_is_found():
    """A block of 10 x 10 that stands out of 80 x 80, where 4 % of 1,024 perms hold a greater one of their own."""
    x = RNG.normal(scale=0.1, size=(80, 80))
    x[10:20, 10:20] += 2
    null = RNG.normal(size=(1024, 80, 80))
    for sheet in null[RNG.random(1024) < 0.04]:
        sheet[5:10, 5:10] = 10
    found = clusters.find_clusters(np.concatenate([x[None], null]), 1.5, 1, 0.05)
    lit = np.zeros((80, 80), bool)
    for mask, _, p in found:
        if p < 0.05:
            lit |= mask
    want = np.zeros((80, 80), bool)
    want[10:20, 10:20] = True
    assert (lit == want).all()


def test_step_down_frees_the_smaller_cluster():
    """The perms' greatest stretches lie where the first cluster is: without its cells the second passes as well."""
    values = np.zeros((101, 20))
    values[0, 2:8], values[0, 12:14] = 3.0, 3.0
    values[1:11, 3:6] = 3.0
    plain = {int(m.sum()): p for m, _, p in clusters.find_clusters(values, 1.0)}
    stepped = {int(m.sum()): p for m, _, p in clusters.find_clusters(values, 1.0, step_down=0.05)}
    assert plain == {6: pytest.approx(1 / 101), 2: pytest.approx(11 / 101)}
    assert stepped == {6: pytest.approx(1 / 101), 2: pytest.approx(1 / 101)}


def test_t_quantiles():
    for p, df, want in ((0.975, 9, 2.262157), (0.95, 1, 6.313752), (0.5, 5, 0.0), (0.025, 30, -2.042272)):
        assert clusters.t_quantile(p, df) == pytest.approx(want, abs=1e-6)


def curves(spark, subjects=9, points=12, lift=2.0):
    x = RNG.normal(size=(2, subjects, points))
    x[0, : subjects // 2, 3:7] += lift
    rows = [("ab"[c], f"s{k}", t, "one" if k < subjects // 2 else "two", float(x[c, k, t])) for c in range(2) for k in range(subjects) for t in range(points)]
    return x, spark.createDataFrame(rows, "ch string, subject string, t int, side string, v double")


def two_sample(a, b):
    n, m = len(a), len(b)
    pooled = (((a - a.mean(axis=0)) ** 2).sum(axis=0) + ((b - b.mean(axis=0)) ** 2).sum(axis=0)) / (n + m - 2)
    return (a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(pooled * (1 / n + 1 / m))


def test_two_groups_equal_a_loop(spark):
    perms = 30
    x, df = curves(spark)
    odd = spark.createDataFrame([("a", None, 3, "one", 9.0), ("a", "s1", 3, "one", None), ("a", "s1", 50, "one", 4.0)], df.schema)
    got = clusters.two_sample_clusters(df.unionByName(odd), ["ch"], ["t"], "subject", "side", "v", perms, "one").collect()
    names = [f"s{k}" for k in range(9)]
    threshold = clusters.t_quantile(0.975, 7)
    for c in range(2):
        t = []
        for perm in range(perms + 1):
            order = sorted(names, key=lambda s: (hashlib.md5(f"{perm}:{s}".encode()).hexdigest(), s))
            first = set(order[:4]) if perm else set(names[:4])
            pick = np.array([n in first for n in names])
            t.append(two_sample(x[c][pick], x[c][~pick]))
        top = [max((abs(m) for _, m in loop_clusters(v, threshold, (1, -1))), default=0.0) for v in t]
        want = {(cells[0][1], cells[-1][1], round(m, 6), round(float(np.mean([y >= abs(m) - 1e-9 for y in top])), 6)) for cells, m in loop_clusters(t[0], threshold, (1, -1))}
        assert {(r.lo, r.hi, round(r.mass, 6), round(r.p, 6)) for r in got if r.ch == "ab"[c]} == want
    assert any(r.ch == "a" and r.p < 0.1 for r in got)
    with pytest.raises(ValueError):
        clusters.two_sample_clusters(df.unionByName(df.withColumn("side", F.lit("two"))), ["ch"], ["t"], "subject", "side", "v", 5, "one")
    assert clusters.two_sample_clusters(df.limit(0), ["ch"], ["t"], "subject", "side", "v", 5, "one", threshold=1.0).count() == 0


def test_grids_of_one_group(spark):
    cells = [(k, x, y, float(RNG.normal() + (3 if 2 <= x <= 4 and 1 <= y <= 2 else 0))) for k in range(8) for x in range(7) for y in range(5) if (x, y) != (6, 4)]
    df = spark.createDataFrame(cells, "subject int, x int, y int, v double")
    got = clusters.one_sample_clusters(df, [], ["x", "y"], "subject", "v", 60, subjects=8, step_down=0.05).collect()
    best = max(got, key=lambda r: r.mass)
    assert best.cells >= 6 and best.p < 0.05 and best.cluster[0] in (1, 2)
    assert clusters.one_sample_clusters(df.limit(0), [], ["x", "y"], "subject", "v", 60, 1.0).count() == 0


def test_sums_stay_whole_over_tasks_and_steps(spark):
    """Groups that end at a step's or a task's edge, a hot one and single rows: each is one row."""
    rows = [("hot", str(k), float(k % 13) - 6) for k in range(3300)] + [(f"g{k % 999:04}", str(k), float(k)) for k in range(2600)] + [(None, "x", 1.0), ("null", "x", None)]
    df = spark.createDataFrame(rows, "g string, subject string, v double").repartition(3)
    got = clusters.permuted_sums(df, ["g"], "subject", "v", clusters.signs(8), 9).collect()
    assert len(got) == len({r.g for r in got}) == 1002
    want: dict = {}
    for g, s, v in rows:
        n, q, t = want.get(g, (0, 0.0, np.zeros(9)))
        want[g] = (n + (v is not None), q + (v or 0.0) ** 2, t + (v or 0.0) * clusters.signs(8)(s))
    for r in got:
        n, q, t = want[r.g]
        assert r.n == n and math.isclose(r.q, q) and np.allclose(r.s, t)


def test_tests_that_meet_equal_spread_ones(spark):
    """Sums, t and clusters in one task give what shuffled arrays give, with nulls, points that lack subjects, and one and two axes."""
    rng = np.random.default_rng(12)
    rows = [(g, s, "a" if s < 4 else "b", r, t, None if rng.random() < 0.03 else float(rng.normal() + 1.2 * (t > 2) + (s < 4))) for g in range(5) for s in range(9) for r in range(2) for t in range(6) if rng.random() < 0.98]
    df = spark.createDataFrame(rows, "g long, s int, side string, r int, t int, v double")
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r)
    for axes in (["t"], ["r", "t"]):
        one = df if len(axes) == 2 else df.where("r = 0")
        for make in (
            lambda spread: clusters.one_sample_clusters(one, ["g"], axes, "s", "v", 49, 1.5, tail=0, step_down=0.05, spread=spread),
            lambda spread: clusters.two_sample_clusters(one, ["g"], axes, "s", "side", "v", 49, "a", 1.0, spread=spread),
        ):
            near, far = (sorted(map(key, make(spread).collect())) for spread in (False, True))
            assert near == far and near
    plan = clusters.one_sample_clusters(df, ["g"], ["r", "t"], "s", "v", 9, 1.5)._jdf.queryExecution().toString()
    assert "Union" not in plan and "rangepartitioning" not in plan
