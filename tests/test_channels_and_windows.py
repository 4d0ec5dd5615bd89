"""Channel tables, spans and windows of signals, trials and labels: small tables with nulls, ties and no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trialmill.operators import channels, maps, signals, trials


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "bad/EEG", ["bad", "EEG"]), (2, None, None), (3, "", []), (4, "x.y/x/bad", ["x.y", None, "x"])]
    return spark.createDataFrame(rows, "channel long, text string, labels array<string>")


def test_tags(table):
    out = table.select("channel", channels.without_tag("text", "bad").alias("w"), channels.with_tag("text", "bad").alias("a"))
    assert got(out) == [(1, "EEG", "bad/EEG"), (2, None, "bad"), (3, "", "bad"), (4, "x.y/x", "x.y/x/bad")]
    assert got(channels.in_regions(table, "labels", ["x", "EEG"]), "channel") == [(1,), (4,)]
    assert got(channels.without_tagged(table, "labels", ["bad"]), "channel") == [(2,), (3,), (4,)]
    assert channels.in_regions(table, "labels", []).count() == 0 and channels.without_tagged(table, "labels", []).count() == 4


def test_event_columns(spark, table):
    two = table.where("channel < 3")
    assert got(channels.event_columns(two, "text", ["p", "q"]), "p", "q") == sorted([("bad", "EEG"), (None, None)], key=repr)
    with pytest.raises(Exception, match="not 2 parts"):
        channels.event_columns(table, "text", ["p", "q"]).select("channel", "p").collect()
    dots = spark.createDataFrame([("a.b",)], "text string")
    assert got(channels.event_columns(dots, "text", ["p", "q"], "."), "p", "q") == [("a", "b")]


def test_rotated(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([],), (None,)], "x array<int>")
    for by, want in [(1, [2, 3, 4, 1]), (0, [1, 2, 3, 4]), (4, [1, 2, 3, 4]), (-1, [4, 1, 2, 3]), (6, [3, 4, 1, 2])]:
        assert [r[0] for r in df.select(channels.rotated("x", by)).collect()] == [want, [], None]


@pytest.fixture(scope="module")
def signal(spark):
    rows = [(1, 0, 1, 1.0), (1, 0, 2, 5.0), (1, 0, 3, None), (1, 0, 4, 9.0), (1, 0, 5, 2.0), (2, 1, 1, 4.0), (2, 1, 4, 8.0), (2, None, 2, 3.0)]
    return spark.createDataFrame(rows, "channel long, epoch int, t int, value double")


def test_spans(signal):
    left = signals.without_spans(signal, ["channel", "epoch"], F.col("epoch"), {0: [(2, 3), (5, 9)], 7: [(1, 9)]})
    assert got(left, "channel", "epoch", "t", "i") == sorted([(1, 0, 1, 1), (1, 0, 4, 2), (2, 1, 1, 1), (2, 1, 4, 2), (2, None, 2, 1)], key=repr)
    assert signals.without_spans(signal, ["channel"], F.col("epoch"), {}).count() == 8
    filled = signals.filled_with_minimum(signal, ["channel"], [(3, 4)])
    assert [r.value for r in filled.orderBy("channel", "epoch", "t").collect()] == [1.0, 5.0, 1.0, 1.0, 2.0, 3.0, 4.0, 3.0]
    assert signals.filled_with_minimum(signal.where("false"), ["channel"], [(3, 4)]).count() == 0


def test_window_differences(signal):
    out = signals.window_differences(signal, ["channel"], F.col("t") <= 2, F.col("t").between(2, 4))
    assert got(out) == [(1, 1, 4.0), (1, 2, None), (2, 1, -1.0 + 0.0), (2, 2, 5.0)]


def test_roi_averages(spark, signal):
    wanted = spark.createDataFrame([(1,), (2,), (2,), (9,)], "channel long")
    out = signals.roi_averages(signal, F.lit("r"), wanted)
    assert {r.t: r.value for r in out.collect()} == {1: 2.5, 2: 4.0, 3: None, 4: 8.5, 5: 2.0}
    assert signals.roi_averages(signal, F.lit("r"), wanted.where("false")).count() == 0


def test_rising_edges(spark):
    values = [9.0, 0.0, 9.0, 0.0, 9.0, None, 9.0, 0.0, 0.0, 9.0]
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "channel long, t int, value double")
    assert got(signals.rising_edges(df, ["channel"], 5.0, 3), "t") == [(2,), (9,)]
    assert got(signals.rising_edges(df, ["channel"], 5.0, 1), "t") == [(2,), (4,), (9,)]


def test_trial_tables(spark):
    log = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3)], "subject long, k int")
    assert got(trials.missing_triggers(log, log.where("k <> 2"), ["subject", "k"])) == sorted([(1, 2), (None, 3)], key=repr)
    rows = spark.createDataFrame([(1, 2, "x"), (1, 2, "r"), (1, 3, "r"), (1, 4, None), (1, 5, "x"), (1, None, "x")], "subject long, k int, kind string")
    out = trials.response_by_event(rows, ["subject", "k"], F.col("k") % 2 == 0, F.col("kind") == "r")
    assert {r.k: r.response for r in out.collect()} == {2: "hit", 3: "falseAlarm", 4: "miss", 5: "correctRejection", None: "correctRejection"}


def test_times(spark):
    log = spark.createDataFrame([(1, "a", 0.0, 1.0), (1, "a", 1.0, None), (1, "b", 5.0, 2.0), (2, "a", 3.0, 1.0)], "subject long, kind string, t double, plan double")
    out = trials.duration_errors(log, ["subject"], ["t"], "t", F.col("plan"), 0.5, ["kind"])
    assert got(out) == [("a", 2, 0.0)]
    onsets = spark.createDataFrame([(1, 1.0), (1, 4.0), (2, None)], "subject long, onset double")
    assert got(trials.time_in_trial(log, onsets, ["subject"], "t", "onset", 4.0), "t", "since") == [(1.0, 0.0), (5.0, 4.0)]
    assert trials.time_in_trial(log, onsets.where("false"), ["subject"], "t", "onset", 4.0).count() == 0


def test_super_subject(spark):
    rows = [("s", "a", 1), ("s", "a", 2), ("s", "b", 3), ("t", "a", 4), ("t", "c", 5), (None, "a", 6), ("t", None, 7)]
    df = spark.createDataFrame(rows, "subject string, label string, id long")
    out = maps.super_subject(df, "subject", "label", "id").collect()
    assert sorted((r.subject, r.label, r["rank"]) for r in out) == [("s", "a", 1), ("t", "a", 1)]
    assert maps.super_subject(df.where("false"), "subject", "label", "id").count() == 0
    assert got(maps.enough_repeats(df, ["label"], 2), "id") == [(1,), (2,), (4,), (6,)]
    assert got(maps.enough_repeats(df, ["subject", "label"], 2), "id") == [(1,), (2,)]
