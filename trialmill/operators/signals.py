"""Multichannel signals in long form (channel, epoch, t, value): summaries, baselines, windows, rejection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_summary(signal: DataFrame, keys: Sequence[str], t: str = "t", value: str = "value") -> DataFrame:
    """Mean, range, maximum, minimum and area (trapezoids of unit width) of each group in order of t."""
    w = Window.partitionBy(*keys).orderBy(t)
    rows = signal.withColumn("_next", F.lead(value).over(w))
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("ptp"), F.max(value).alias("max"), F.min(value).alias("min"), F.coalesce(F.sum((F.col(value) + F.col("_next")) / 2), F.lit(0.0)).alias("auc")
    )


def in_windows(signal: DataFrame, windows: DataFrame, t: str = "t") -> DataFrame:
    """Rows with the name of each window (name, lo, hi) that holds their t; the few windows are broadcast."""
    return signal.join(F.broadcast(windows), (F.col(t) >= F.col("lo")) & (F.col(t) <= F.col("hi"))).drop("lo", "hi")


def baseline_scaled(signal: DataFrame, keys: Sequence[str], in_baseline: Column, mode: str, value: str = "value") -> DataFrame:
    """scaled: value against the mean m and population deviation s of the baseline.

    mean: x - m; ratio: x / m; logratio: log10(x / m); percent: (x - m) / m; zscore: (x - m) / s; zlogratio: log10(x / m) / s of log10(x / m)
    """
    w, x, base = Window.partitionBy(*keys), F.col(value), F.when(in_baseline, F.col(value))
    m = F.avg(base).over(w)
    if mode == "zlogratio":
        rows = signal.withColumn("_log", F.log10(x / m))
        s = F.stddev_pop(F.when(in_baseline, F.col("_log"))).over(w)
        return rows.withColumn("scaled", F.try_divide(F.col("_log"), s)).drop("_log")
    made = {"mean": x - m, "ratio": F.try_divide(x, m), "logratio": F.log10(F.try_divide(x, m)), "percent": F.try_divide(x - m, m), "zscore": F.try_divide(x - m, F.stddev_pop(base).over(w))}
    return signal.withColumn("scaled", made[mode])


def average_reference(signal: DataFrame, at: Sequence[str], is_reference: Column, targets: Column, value: str = "value") -> DataFrame:
    """The mean of the reference channels at each time is taken out of the target channels."""
    mean = F.avg(F.when(is_reference, F.col(value))).over(Window.partitionBy(*at))
    return signal.withColumn(value, F.when(targets, F.col(value) - mean).otherwise(F.col(value)))


def neighbours(channels: DataFrame, prefix: Column, number: Column) -> DataFrame:
    """(channel, ref1, ref2): channels of the same prefix with number one less and one more; null where there is none."""
    c = channels.select("channel", prefix.alias("p"), number.cast("int").alias("n"))
    before = c.select(F.col("channel").alias("ref1"), "p", (F.col("n") + 1).alias("n"))
    after = c.select(F.col("channel").alias("ref2"), "p", (F.col("n") - 1).alias("n"))
    return c.join(before, ["p", "n"], "left").join(after, ["p", "n"], "left").select("channel", "ref1", "ref2")


def without_bad(refs: DataFrame, bad: DataFrame) -> DataFrame:
    """References without bad channels; ok is false where none is left."""
    flags = bad.select("channel").distinct()
    rows = refs.join(flags.withColumnRenamed("channel", "b1"), F.col("ref1") == F.col("b1"), "left").join(flags.withColumnRenamed("channel", "b2"), F.col("ref2") == F.col("b2"), "left")
    rows = rows.select("channel", F.when(F.col("b1").isNull(), F.col("ref1")).alias("ref1"), F.when(F.col("b2").isNull(), F.col("ref2")).alias("ref2"))
    return rows.withColumn("ok", F.col("ref1").isNotNull() | F.col("ref2").isNotNull())


def laplacian(signal: DataFrame, refs: DataFrame, at: Sequence[str], value: str = "value") -> DataFrame:
    """value less the mean of the references at the same place, nulls left out; null if both are."""
    x = signal.join(refs, "channel")
    for r in ("ref1", "ref2"):
        other = signal.select(F.col("channel").alias(r), *at, F.col(value).alias(f"_{r}"))
        x = x.join(other, [r, *at], "left")
    both = F.coalesce((F.col("_ref1") + F.col("_ref2")) / 2, "_ref1", "_ref2")
    return x.select("channel", *at, (F.col(value) - both).alias(value))


def binned(signal: DataFrame, keys: Sequence[str], n: int, t: str = "t", value: str = "value") -> DataFrame:
    """Means of n consecutive samples; a last bin of fewer is dropped."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(t)) - 1
    rows = signal.withColumn("bin", F.floor(place / n)).groupBy(*keys, "bin").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n"))
    return rows.where(F.col("_n") == n).drop("_n")


def moving_mean(signal: DataFrame, keys: Sequence[str], before: int, after: int, whole: bool = True, t: str = "t", value: str = "value", into: str = "smooth") -> DataFrame:
    """Mean over a frame of rows; whole: frames that reach over an edge give no row."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-before, after)
    rows = signal.withColumn(into, F.avg(value).over(w))
    return rows.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == before + after + 1).drop("_n") if whole else rows


def lagged(signal: DataFrame, keys: Sequence[str], lags: int, t: str = "t", value: str = "value") -> DataFrame:
    """stacked: the values of the last lags rows, the row's own first; null before the start."""
    w = Window.partitionBy(*keys).orderBy(t)
    return signal.withColumn("stacked", F.array(*[F.lag(value, k).over(w) for k in range(lags)]))


def sub_windows(signal: DataFrame, keys: Sequence[str], n: int, overlapping: bool, t: str = "t", value: str = "value") -> DataFrame:
    """Arrays of n consecutive values, from every row or every n-th; shorter ones at the end are left out."""
    w = Window.partitionBy(*keys).orderBy(t)
    rows = signal.withColumns({"part": F.collect_list(value).over(w.rowsBetween(0, n - 1)), "_i": F.row_number().over(w) - 1}).where(F.size("part") == n)
    return (rows if overlapping else rows.where(F.col("_i") % n == 0)).drop("_i")


def fir(signal: DataFrame, keys: Sequence[str], taps: Sequence[float], t: str = "t", value: str = "value") -> DataFrame:
    """Causal filter: the sum of taps times the last values; values before the start count 0."""
    w = Window.partitionBy(*keys).orderBy(t)
    return signal.withColumn("filtered", sum((F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * tap for k, tap in enumerate(taps)), F.lit(0.0)))


def sustained(signal: DataFrame, keys: Sequence[str], over: Column, least: int, t: str = "t") -> DataFrame:
    """First stretch of at least so many consecutive rows whose condition holds: onset, offset, length per key."""
    from .intervals import islands

    runs = islands(signal, keys, [t], over, t).where(F.col("size") >= least)
    return runs.groupBy(*keys).agg(F.min("lo").alias("onset"), F.min_by("hi", "lo").alias("offset"), F.min_by("size", "lo").alias("length"))


def by_deviation(df: DataFrame, keys: Sequence[str], value: str, m: float, centre: str = "median") -> DataFrame:
    """outlier: distance from the median over the median (or mean) distance is above m."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_d", F.abs(F.col(value) - F.percentile(value, F.lit(0.5)).over(w)))
    middle = F.percentile("_d", F.lit(0.5)).over(w) if centre == "median" else F.avg("_d").over(w)
    return rows.withColumn("score", F.try_divide(F.col("_d"), middle)).withColumn("outlier", F.coalesce(F.col("score") > m, F.lit(False))).drop("_d")


def rejected_epochs(summary: DataFrame, metric: str, k: float, share: float, upper_only: bool = False) -> DataFrame:
    """Epochs of which more than a share of channels lie beyond their mean by k population deviations, on both sides by default."""
    w = Window.partitionBy("channel")
    z = F.try_divide(F.col(metric) - F.avg(metric).over(w), F.stddev_pop(metric).over(w))
    rows = summary.withColumn("out", F.coalesce((z if upper_only else F.abs(z)) > k, F.lit(False)))
    return rows.groupBy("epoch").agg(F.avg(F.col("out").cast("int")).alias("share")).withColumn("rejected", F.col("share") > share)


def segment_scores(signal: DataFrame, keys: Sequence[str], channel: str, t: str = "t", value: str = "value") -> DataFrame:
    """Range and steepest step of each segment, as distance from the median over channels in median distances."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(channel, *keys).orderBy(t)))
    per = signal.withColumn("_s", step).groupBy(channel, *keys).agg((F.max(value) - F.min(value)).alias("range"), F.max("_s").alias("steep"))
    for c in ("range", "steep"):
        per = by_deviation(per, keys, c, 5).withColumnsRenamed({"score": f"{c}_score", "outlier": f"{c}_bad"})
    return per


def tracked_duration(signal: DataFrame, keys: Sequence[str], baseline: Column, active: Column, t: str = "t", value: str = "value") -> DataFrame:
    """Threshold between baseline and active means; first time after which is below it; never_dropped rows get the first time."""
    both = signal.groupBy(*keys).agg(((F.avg(F.when(baseline, F.col(value))) + F.avg(F.when(active, F.col(value)))) / 2).alias("threshold"))
    low = F.col(value) < F.col("threshold")
    rows = signal.where(active).join(both, list(keys))
    return rows.groupBy(*keys, "threshold").agg(F.coalesce(F.min(F.when(low, F.col(t))), F.min(t)).alias("drop"), (F.count_if(low) == 0).alias("never_dropped"))


def spikes(envelope: DataFrame, keys: Sequence[str], span: int, step: int, k: float, apart: int, t: str = "t", value: str = "value") -> DataFrame:
    """Local maxima above k times (mode + median) of a log-normal law, fitted in rolling windows of span samples every step.

    A sample's threshold is that of its nearest window centre before it; maxima closer than apart keep the larger.
    """
    starts = F.sequence(F.floor((F.col(t) - span) / step) + 1, F.floor(F.col(t) / step))
    fitted = envelope.where(F.col(value) > 0).withColumn("win", F.explode(starts)).groupBy(*keys, "win").agg(F.avg(F.ln(value)).alias("mu"), F.stddev_pop(F.ln(value)).alias("sd"))
    limit = k * (F.exp(F.col("mu") - F.col("sd") ** 2) + F.exp("mu"))
    rows = envelope.withColumn("win", F.floor((F.col(t) - span / 2) / step).cast("long")).join(fitted.select(*keys, "win", limit.alias("limit")), [*keys, "win"])
    w = Window.partitionBy(*keys).orderBy(t)
    x = F.col(value)
    peak = (x > F.coalesce(F.lag(value).over(w), x - 1)) & (x >= F.coalesce(F.lead(value).over(w), x - 1)) & (x > F.col("limit"))
    tops = rows.withColumn("_p", peak).where("_p")
    new = F.when(F.col(t) - F.lag(t).over(w) <= apart, 0).otherwise(1)
    tops = tops.withColumn("_n", new).withColumn("group", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tops.groupBy(*keys, "group").agg(F.max_by(t, F.struct(value, t)).alias("at"), F.max(value).alias("height"))


def _inside(t: str, spans: Sequence[tuple[float, float]]) -> Column:
    """Whether t lies in one of a few spans (lo, hi), both ends included; a null t lies in none."""
    found = F.lit(False)
    for lo, hi in spans:
        found = found | F.col(t).between(lo, hi)
    return F.coalesce(found, F.lit(False))


def without_spans(signal: DataFrame, keys: Sequence[str], condition: Column, spans: Mapping[object, Sequence[tuple[float, float]]], t: str = "t") -> DataFrame:
    """signal without the spans of its condition, and i: the place (from 1) of what is left in order of t.

    Conditions that spans doesn't name, null ones too, stay whole.
    """
    cut = F.lit(False)
    for c, own in spans.items():
        cut = cut | (F.coalesce(condition == F.lit(c), F.lit(False)) & _inside(t, own))
    return signal.where(~cut).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(t)).cast("long"))


def filled_with_minimum(signal: DataFrame, keys: Sequence[str], spans: Sequence[tuple[float, float]], t: str = "t", value: str = "value") -> DataFrame:
    """signal with the group's least value wherever t lies in a span of noise; the least is taken over all rows, those of noise included."""
    return signal.withColumn(value, F.when(_inside(t, spans), F.min(value).over(Window.partitionBy(*keys))).otherwise(F.col(value)))


def window_differences(signal: DataFrame, keys: Sequence[str], first: Column, second: Column, t: str = "t", value: str = "value") -> DataFrame:
    """(keys, i, difference): of the i-th samples of two windows, in order of t, the second less the first; the longer window is cut.

    A sample may lie in both windows. A null value counts as a sample and gives a null difference.
    """
    sides = F.array_compact(F.array(F.when(first, 1), F.when(second, 2)))
    rows = signal.select(*keys, t, value, F.explode(sides).alias("_side"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "_side").orderBy(t, value)).cast("long"))
    of = [F.max(F.when(F.col("_side") == k, F.col(value))).alias(f"_{k}") for k in (1, 2)]
    both = rows.groupBy(*keys, "i").agg(*of, F.count(F.lit(1)).alias("_n")).where("_n = 2")
    return both.select(*keys, "i", (F.col("_2") - F.col("_1")).alias("difference"))


def roi_averages(signal: DataFrame, roi: Column, channels: DataFrame, channel: str = "channel", t: str = "t", value: str = "value") -> DataFrame:
    """(roi, t, value): means over the wanted channels of each channel's mean, so that a channel counts once whatever its epochs."""
    rows = signal.join(channels.select(channel).distinct(), channel, "left_semi")
    per = rows.groupBy(roi.alias("roi"), channel, t).agg(F.avg(value).alias("_m"))
    return per.groupBy("roi", t).agg(F.avg("_m").alias(value))


def rising_edges(signal: DataFrame, keys: Sequence[str], threshold: float, apart: float, t: str = "t", value: str = "value") -> DataFrame:
    """(keys, t): where a value is above the threshold and the one before isn't, apart or more after the edge before, kept or not.

    The first sample is no edge, and none is where this sample or the one before is null.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    edges = signal.withColumn("_before", F.lag(value).over(w)).where((F.col(value) > threshold) & (F.col("_before") <= threshold))
    gap = F.col(t) - F.lag(t).over(w)
    return edges.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= apart)).select(*keys, t)


def difference_matrices(df: DataFrame, keys: Sequence[str], unit: str, axis: str, value: str) -> DataFrame:
    """(keys, x, y, v): the mean absolute difference between two points of an axis, over the units of a group that have both.

    df has one row for each unit and point. Pairs of points that no unit has are left out; v is null where values are. Rows
    without a key, a unit or a point take no part. A group's rows meet in one task in order of their unit, and its matrix is
    formed there, so that pairs of rows are neither joined nor grouped.
    """
    kinds = dict(df.dtypes)
    keys = list(keys)

    def matrices(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        group = np.cumsum(first) - 1
        new = first.copy()
        new[1:] |= pdf["unit_"].to_numpy()[1:] != pdf["unit_"].to_numpy()[:-1]
        at = np.cumsum(new) - 1
        at -= at[first][group]  # units are numbered within their group
        points, place = np.unique(pdf["at_"].to_numpy(), return_inverse=True)
        cells = np.full((group[-1] + 1, at.max() + 1, len(points)), np.nan)
        cells[group, at, place] = pdf["v_"].to_numpy(float)
        seen = np.zeros(cells.shape)
        seen[group, at, place] = 1.0
        both = lambda there: there.transpose(0, 2, 1) @ there
        total = np.zeros((len(cells), len(points), len(points)))
        for u in range(cells.shape[1]):
            d = np.abs(cells[:, u, :, None] - cells[:, u, None, :])
            total += np.where(np.isnan(d), 0.0, d)
        n = both((~np.isnan(cells)).astype(float))
        g, x, y = np.nonzero(both(seen))
        out = pdf.loc[first, keys].iloc[g].reset_index(drop=True)
        with np.errstate(invalid="ignore"):
            return out.assign(x=points[x], y=points[y], v=(total / n)[g, x, y])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the group that may go on in the next batch
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            first = np.ones(len(pdf), bool)
            first[1:] = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
            last = int(np.flatnonzero(first)[-1])
            held = pdf.iloc[last:]
            if last:
                yield matrices(pdf.iloc[:last], first[:last])
        if held is not None:
            yield matrices(held, np.arange(len(held)) == 0)

    there = F.col(unit).isNotNull() & F.col(axis).isNotNull()
    for k in keys:
        there &= F.col(k).isNotNull()
    rows = df.where(there).select(*keys, F.col(unit).alias("unit_"), F.col(axis).alias("at_"), F.col(value).cast("double").alias("v_"))
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "unit_")
    return rows.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"x {kinds[axis]}, y {kinds[axis]}, v double"]))
