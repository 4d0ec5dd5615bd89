"""Naive Bayes, calibration, cleaned covariances and map clusters against plain numpy, with nulls, ties and empty tables."""

from __future__ import annotations

import hashlib

import numpy as np

from trialmill.operators import decoding, stats

RNG = np.random.default_rng(5)


def test_naive_bayes_equals_a_loop(spark):
    x = RNG.normal(size=(40, 3)) + (np.arange(40) % 2)[:, None]
    items = [(k, "ab"[k % 2], k % 5, f, float(x[k, f])) for k in range(40) for f in range(3)]
    long = spark.createDataFrame([*items, (90, None, 0, 0, 1.0), (0, "a", 0, 3, None)], "id int, label string, run int, f int, v double")
    want = {}
    for run in range(5):
        train, test = [k for k in range(40) if k % 5 != run], [k for k in range(40) if k % 5 == run]
        hits = []
        for k in test:
            cost = {}
            for c in (0, 1):
                own = x[[i for i in train if i % 2 == c]]
                var = own.var(axis=0) + 1e-9
                cost[c] = (np.log(var) + (x[k] - own.mean(axis=0)) ** 2 / var).sum() - 2 * np.log(len(own))
            hits.append(min(cost, key=cost.get) == k % 2)
        want[run] = np.mean(hits)
    got = {r.run: r.accuracy for r in decoding.naive_bayes(long, [], "run").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert decoding.naive_bayes(long.limit(0), [], "run").count() == 0


def test_calibration_is_at_the_optimum(spark):
    score = RNG.normal(size=200) * 3 + 10
    hit = (RNG.random(200) < 1 / (1 + np.exp(-(score - 10)))).astype(int)
    rows = [(k % 2, float(score[k]), int(hit[k])) for k in range(200)] + [(0, None, 1), (1, 1.0, None), (2, 4.0, 1), (2, 4.0, 0), (3, 1.0, 0), (3, 2.0, 1)]
    table = spark.createDataFrame(rows, "fold int, score double, target int")
    fits = {r.fold: r for r in decoding.sigmoid_calibration(table, "fold", "score", "target").collect()}
    assert fits[0].n == fits[1].n == 100
    for fold in (0, 1, 3):  # fold 3 is parted by its scores: the fit is finite
        s, y = (np.array([r[i] for r in rows if r[0] == fold and r[1] is not None and r[2] is not None], float) for i in (1, 2))
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        p = 1 / (1 + np.exp(fits[fold].a * s + fits[fold].b))
        assert abs((goal - p).sum()) < 1e-6 and abs(((goal - p) * s).sum()) < 1e-5
    assert fits[2].a == 0.0 and abs(fits[2].b) < 1e-9  # one score alone
    both = [fits[k] for k in fits]
    got = decoding.calibrated(spark.createDataFrame([(9.0,), (None,)], "score double"), spark.createDataFrame([(r.a, r.b) for r in both], "a double, b double"), "score").collect()
    assert abs(got[0].probability - np.mean([1 / (1 + np.exp(r.a * 9 + r.b)) for r in both])) < 1e-9 and got[1].probability is None
    assert decoding.sigmoid_calibration(table.limit(0), "fold", "score", "target").count() == 0


def test_cleaned_covariance_equals_numpy(spark):
    x = RNG.normal(size=(30, 3, 6))
    x[7] *= 20  # far from the mean of all
    cells = [("a", k, c, t, float(x[k, c, t])) for k in range(30) for c in range(3) for t in range(6)]
    table = spark.createDataFrame([*cells, ("a", 3, 0, 9, None)], "label string, id int, channel int, t int, v double")
    each = np.array([np.cov(m) for m in x])
    far = np.sqrt(((each - each.mean(axis=0)) ** 2).sum(axis=(1, 2)))
    kept = each[(far - far.mean()) / far.std() < 3]
    assert len(kept) == 29
    want = kept.mean(axis=0)
    want = 0.99 * want + 0.01 * np.linalg.eigvalsh(want).mean() * np.eye(3)
    got = decoding.cleaned_covariance(decoding.trial_covariances(table, ["label"], "id", "channel", "t", "v"), ["label"], "id").collect()
    assert len(got) == 6 and all(abs(r["cov"] - want[r.i, r.j]) < 1e-9 and r.kept == 29 for r in got)
    one = table.where("id = 1")  # a single trial has no spread and stays
    assert decoding.cleaned_covariance(decoding.trial_covariances(one, ["label"], "id", "channel", "t", "v"), ["label"], "id").first().kept == 1
    assert decoding.cleaned_covariance(decoding.trial_covariances(table.limit(0), ["label"], "id", "channel", "t", "v"), ["label"], "id").count() == 0


def _clusters(lit: set[int]) -> dict[int, int]:
    """Least member of each member's run of consecutive numbers."""
    return {v: next(w for w in range(v, -2, -1) if w - 1 not in lit) for v in lit}


def test_map_clusters_equal_a_loop(spark):
    subjects, voxels, perms = 8, 12, 6
    x = RNG.normal(size=(subjects, voxels)) + np.isin(np.arange(voxels), [2, 3, 4, 9])
    values = spark.createDataFrame([("m", k, v, float(x[k, v])) for k in range(subjects) for v in range(voxels)] + [("m", 1, 40, None), ("m", 1, 41, 2.0)], "map string, subject int, voxel long, value double")
    near = spark.createDataFrame([(v, v + s) for v in range(voxels) for s in (1, -1)], "voxel long, to long")
    t, size, label = {}, {}, {}
    for perm in range(perms + 1):
        sign = np.array([1 if perm == 0 or int(hashlib.md5(f":{perm}:{k}".encode()).hexdigest()[0], 16) % 2 == 0 else -1 for k in range(subjects)])
        flipped = x * sign[:, None]
        t[perm] = flipped.mean(axis=0) / (flipped.std(axis=0, ddof=1) / np.sqrt(subjects))
        label[perm] = _clusters({v for v in range(voxels) if t[perm][v] > 1.5})
        size[perm] = {c: list(label[perm].values()).count(c) for c in label[perm].values()}
    top_t, top = [t[p].max() for p in t], [max(size[p].values(), default=0) for p in size]
    got = {r.voxel: r for r in stats.cluster_size_test(values, ["map"], "subject", "voxel", "value", near, 1.5, perms).collect()}
    assert got[41].t is None and got[41].p is None and 40 not in got  # one value has no spread, nulls are no values
    for v in range(voxels):
        assert abs(got[v].t - t[0][v]) < 1e-8 and got[v].label == label[0].get(v)
        assert abs(got[v].p - np.mean([x >= t[0][v] - 1e-9 for x in top_t])) < 1e-12
        if v in label[0]:
            assert got[v]["size"] == size[0][label[0][v]] and abs(got[v].p_size - np.mean([x >= got[v]["size"] for x in top])) < 1e-12
    assert stats.cluster_size_test(values.limit(0), ["map"], "subject", "voxel", "value", near, 1.5, perms).count() == 0
