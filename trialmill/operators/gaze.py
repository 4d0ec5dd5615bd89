"""Gaze samples: blinks, saccades, distances and window statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands, merge_close, overlap_join, range_join


def degrees_to_pixels(degrees: Column, distance_cm: float, cm_per_pixel: float) -> Column:
    return F.round(F.tan(F.radians(degrees) / 2) * 2 * distance_cm / cm_per_pixel)


def pixels_to_degrees(pixels: Column, distance_cm: float, cm_per_pixel: float) -> Column:
    return F.degrees(F.atan(pixels * cm_per_pixel / (2 * distance_cm))) * 2


def distance_from(samples: DataFrame, x0: float, y0: float, degrees_per_pixel: float, radius: float) -> DataFrame:
    """Signed x and y, distance in pixels and degrees from a point, and whether it is within radius degrees."""
    dx, dy = F.col("x") - x0, F.col("y") - y0
    far = F.sqrt(dx * dx + dy * dy)
    return samples.withColumns({"dx": dx, "dy": dy, "px": far, "deg": far * degrees_per_pixel, "inside": far * degrees_per_pixel <= radius})


def padded(spans: DataFrame, before: float, after: float) -> DataFrame:
    return spans.withColumns({"lo": F.col("lo") - before, "hi": F.col("hi") + after})


def in_spans(samples: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, width: float, into: str) -> DataFrame:
    """samples with a flag: whether t lies in any span of the same keys. samples must have an id column."""
    hit = range_join(samples.select("id", *keys, t), spans.select(*keys, "lo", "hi"), keys, t, "lo", "hi", width, "left_semi").select("id")
    marked = samples.join(hit.withColumn(into, F.lit(True)), "id", "left")
    return marked.withColumn(into, F.coalesce(into, F.lit(False)))


def blink_runs(samples: DataFrame, keys: Sequence[str], order: Sequence[str], pupil: str, t: str) -> DataFrame:
    """Runs of zero pupil; a run may be open at either end."""
    return islands(samples, keys, order, F.col(pupil) == 0, t)


def missing_runs(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, t: str, least: float) -> DataFrame:
    """Runs of missing values that last longer than least."""
    return islands(samples, keys, order, value.isNull(), t).where(F.col("hi") - F.col("lo") > least)


def extended_blinks(samples: DataFrame, keys: Sequence[str], order: Sequence[str], pupil: str, t: str, gap: float, half: int = 2) -> DataFrame:
    """Blink runs whose edges are moved out along the monotone parts of the smoothed pupil, then merged where closer than gap.

    Before a run the pupil falls towards it and after it rises: the start moves to the last sample before at which the
    smoothed pupil does not fall, the end to the first sample after at which it does not rise.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = samples.withColumn("_s", F.avg(pupil).over(w.rowsBetween(-half, half)))
    rows = rows.withColumns({"_falls": F.lead("_s").over(w) < F.col("_s"), "_rises": F.lag("_s").over(w) < F.col("_s")})
    rows = rows.withColumns({
        "_from": F.last(F.when(~F.coalesce("_falls", F.lit(False)), F.col(t)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_to": F.first(F.when(~F.coalesce("_rises", F.lit(False)), F.col(t)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    zero = rows.withColumn("_zero", F.coalesce(F.col(pupil) == 0, F.lit(False)))
    new = F.when(F.lag("_zero").over(w) == F.col("_zero"), 0).otherwise(1)
    zero = zero.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_zero")
    spans = zero.groupBy(*keys, "run").agg(F.coalesce(F.min_by("_from", t), F.min(t)).alias("lo"), F.coalesce(F.max_by("_to", t), F.max(t)).alias("hi"))
    return merge_close(spans, keys, gap)


def saccades(samples: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, factor: float = 5, least: int = 3, run_keys: Sequence[str] | None = None) -> DataFrame:
    """Runs of samples outside the velocity ellipse: five-point velocity, thresholds factor times its median-based deviation.

    A run of at least `least` samples gives start, end, displacement, direction (degrees, y upwards) and amplitude.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    five = lambda c: (F.lead(c, 2).over(w) + F.lead(c, 1).over(w) - F.lag(c, 1).over(w) - F.lag(c, 2).over(w)) / 6
    rows = samples.withColumns({"vx": five("x"), "vy": five("y")})
    spread = lambda v: F.sqrt(F.median(F.col(v) * F.col(v)) - F.median(v) * F.median(v))
    limits = rows.groupBy(*(run_keys or keys)).agg((spread("vx") * factor).alias("_sx"), (spread("vy") * factor).alias("_sy"))
    rows = rows.join(limits, list(run_keys or keys)).withColumn("fast", (F.col("vx") / F.col("_sx")) ** 2 + (F.col("vy") / F.col("_sy")) ** 2 > 1)
    new = F.when(F.lag("fast").over(w) == F.col("fast"), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("fast")
    out = rows.groupBy(*keys, "run").agg(
        F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("size"), (F.max_by("x", t) - F.min_by("x", t)).alias("dx"), (F.max_by("y", t) - F.min_by("y", t)).alias("dy"),
        (F.signum(F.max_by("x", "x") * 0 + F.max("x") - F.min("x")) * (F.max("x") - F.min("x"))).alias("width"), (F.max("y") - F.min("y")).alias("height"),
    )
    out = out.where(F.col("size") >= least)
    return out.withColumns({"direction": F.degrees(F.atan2(0.0 - F.col("dy"), F.col("dx"))), "amplitude": F.sqrt(F.col("width") ** 2 + F.col("height") ** 2)})


def valid_events(events: DataFrame, blinks: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Events (lo, hi) that overlap no blink, numbered in order within their keys."""
    kept = overlap_join(events, blinks, keys, width, "left_anti")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("lo", "hi")).cast("long"))


def main_window(points: DataFrame, event: Sequence[str], window: str) -> DataFrame:
    """The window that holds most samples of each event; ties go to the smaller window."""
    counts = points.groupBy(*event, window).agg(F.count(F.lit(1)).alias("samples"))
    n = F.row_number().over(Window.partitionBy(*event).orderBy(F.desc("samples"), window))
    return counts.withColumn("_n", n).where("_n = 1").drop("_n")


def baseline_corrected(samples: DataFrame, trial: Sequence[str], value: str, in_baseline: Column) -> DataFrame:
    base = F.avg(F.when(in_baseline, F.col(value))).over(Window.partitionBy(*trial))
    return samples.withColumn("corrected", F.col(value) - base)


def density(samples: DataFrame, keys: Sequence[str], width_x: float, width_y: float, nx: int, ny: int) -> DataFrame:
    """Share of samples in each cell of a fixed grid from 0; cells are half-open, the last ones closed; empty cells count 0."""
    cell = lambda c, width, n: F.when(F.col(c) == width * n, n - 1).otherwise(F.floor(F.col(c) / width))
    counts = samples.groupBy(*keys, cell("x", width_x, nx).alias("cx"), cell("y", width_y, ny).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    spark = samples.sparkSession
    grid = samples.select(*keys).distinct().crossJoin(F.broadcast(spark.range(nx).toDF("cx"))).crossJoin(F.broadcast(spark.range(ny).toDF("cy")))
    full = grid.join(counts, [*keys, "cx", "cy"], "left").fillna(0, ["n"])
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def histogram(df: DataFrame, keys: Sequence[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Count and share per bin from 1 to bins; values outside are left out, empty bins count 0."""
    place = F.floor((value - low) / ((high - low) / bins)) + 1
    counts = df.withColumn("bin", F.when(value == high, bins).otherwise(place)).where(F.col("bin").between(1, bins)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(df.sparkSession.range(1, bins + 1).toDF("bin")))
    full = grid.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])
    return full.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))
