"""What the driver's Python holds after the classifier's fit."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from trialmill.llm import common, quality


def held_mb() -> float:
    return int(Path("/proc/self/smaps_rollup").read_text().split("Pss_Anon:")[1].split()[0]) / 1024


def test_freed_arrays_go_back_to_the_system():
    arrays = [np.ones(2000) for _ in range(10_000)]  # 160 MB
    last = arrays[-1].copy()  # the top of the heap stays in use
    full = held_mb()
    del arrays
    common.give_back()
    assert full - held_mb() > 120 and last[0] == 1


def test_fit_gives_its_sample_back(spark, sf_dir, monkeypatch):
    calls = []
    monkeypatch.setattr(quality, "give_back", lambda: calls.append(1))
    labels, scorer = quality.train(common.table(spark, sf_dir, "documents"))
    assert calls == [1] and len(scorer.weights) == quality.DIMS and 0 < labels.good < 1
