"""Tests of connected cells by stretches: equal to labels that spread in rounds, and few links are left for rounds."""

from __future__ import annotations

import numpy as np
import pytest

from trialmill.operators import stats


def _grid(spark):
    r = np.random.default_rng(5)
    cells = [(k, x * 1000 + y) for k in range(4) for x in range(24) for y in range(24) if r.random() < 0.62] + [(9, 7)]
    steps = (1, -1, 1000, -1000)
    links = [(k, c, c + s) for k, c in cells if k < 9 for s in steps]
    return cells, spark.createDataFrame(cells, "k int, cell long"), spark.createDataFrame(links, "k int, cell long, to long")


def _loop(cells):
    there, label = set(cells), {}
    for k, c in sorted(cells):
        todo = [c] if (k, c) not in label else []
        while todo:
            x = todo.pop()
            if (k, x) not in label:
                label[k, x] = c
                todo += [x + s for s in (1, -1, 1000, -1000) if (k, x + s) in there]
    return label


@pytest.mark.parametrize("size", [1 << 18, 300, 1])
def test_stretches_equal_a_loop(spark, size):
    cells, on, links = _grid(spark)
    got = stats.connected_cells(on, links, ["k"], size).collect()
    assert len(got) == len(cells) and {(r.k, r.cell): r.label for r in got} == _loop(cells)


def test_rounds_get_links_across_stretches_only(spark, monkeypatch):
    cells, on, links = _grid(spark)
    seen, real = [], stats._spread_labels
    monkeypatch.setattr(stats, "_spread_labels", lambda nodes, ends, keys: (seen.append(ends.count()), real(nodes, ends, keys))[1])
    got = stats.connected_cells(on, links, ["k"]).collect()
    assert {(r.k, r.cell): r.label for r in got} == _loop(cells)
    assert sum(seen) < len(cells) / 4
    assert stats.connected_cells(on.limit(0), links.limit(0), ["k"]).count() == 0


def test_flips_stay_arrays_until_they_are_read(spark, monkeypatch):
    def exploded(*args, **kwargs):
        raise AssertionError("a row for each voxel and perm is written out")

    monkeypatch.setattr(stats, "flipped_t", exploded)
    values = spark.createDataFrame([("m", s, v, float(v % 3 + s / 7)) for s in range(5) for v in range(6)], "map string, subject int, voxel long, value double")
    near = spark.createDataFrame([(v, v + s) for v in range(6) for s in (1, -1)], "voxel long, to long")
    got = stats.cluster_size_test(values, ["map"], "subject", "voxel", "value", near, 1.5, 9).collect()
    assert len(got) == 6 and all(r.p is not None for r in got)
