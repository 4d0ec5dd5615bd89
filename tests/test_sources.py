"""Readers on files that the tests write."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trialmill.sources import readers


def test_run_logs_keep_the_latest_file(spark, tmp_path):
    for name, times in {"SA101_run_1.csv": [1, 2], "SA101_run_2.csv": [5], "SA101_run_2_RESTARTED.csv": [9, 10], "SA101_run_3_ABORTED.csv": []}.items():
        (tmp_path / name).write_text("time,event\n" + "".join(f"{t},e\n" for t in times))
    got = readers.run_logs(spark, str(tmp_path), "time double, event string")
    assert sorted((r.run, r.time, r.kind) for r in got.collect()) == [(1, 1.0, "regular"), (1, 2.0, "regular"), (2, 9.0, "restarted"), (2, 10.0, "restarted")]
    (tmp_path / "SA101_run_1_b.csv").write_text("time,event\n3,e\n")
    with pytest.raises(Exception, match="two regular files"):
        readers.run_logs(spark, str(tmp_path), "time double, event string").collect()


def test_tracker_log(spark, tmp_path):
    (tmp_path / "a.asc").write_text("MSG\t10 start here\n100 1.0 2.0 300.0\n101 . . 0.0\nEFIX L 100 101 2 5.0 6.0 7\nEBLINK R 90 95 6\nnoise\n")
    (tmp_path / "b.asc").write_text("5 1.5 2.5 3.5\nESACC L 1 4 4 0 0\n")
    got = readers.tracker_log(spark, str(tmp_path))
    assert sorted((r.t, r.x) for r in got["sample"].where("x is not null").collect()) == [(100, 1.0), (106, 1.5)]
    assert [tuple(r)[1:] for r in got["message"].collect()] == [(10, "start here")]
    assert [(r.lo, r.hi) for r in got["saccade"].collect()] == [(102, 105)] and got["blink"].first().eye == "R" and got["fixation"].first().y == 6.0


def test_metrics_sequences_and_sinks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "sub-SD1_ses-V1_run-2_bold.json").write_text(json.dumps({"tsnr": 4.5}))
    assert tuple(readers.run_metrics(spark, str(tmp_path / "m"), "tsnr double").first()) == ("SD1", "V1", "2", 4.5)
    (tmp_path / "s.csv").write_text("1;a\nx;b\n1;a\n2;c\n")
    assert sorted(tuple(r) for r in readers.sequences(spark, str(tmp_path / "s.csv"), "n int, k string").collect()) == [(1, "a"), (2, "c")]
    (tmp_path / "p.tsv").write_text("participant_id\tecog\nsub-A\t1\nsub-B\t0\n")
    assert [r.subject for r in readers.flagged_participants(spark, str(tmp_path / "p.tsv"), "ecog").collect()] == ["A"]
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    readers.save_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        readers.save_new(df, str(tmp_path / "out"))
    assert readers.cached(df, str(tmp_path / "c"), ["k"]).count() == readers.cached(df.limit(0), str(tmp_path / "c"), ["k"]).count() == 2
    assert sorted(r.file for r in readers.find_files(spark, str(tmp_path), "*.tsv").collect()) == ["p.tsv"]
    assert spark.createDataFrame([("SA101",), ("sa1",)], "s string").where(readers.is_subject("s")).count() == 1
    assert df.where(F.lit(False)).count() == 0
