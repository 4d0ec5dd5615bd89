"""Range joins, as-of look-ups and runs: the shapes that Spark has no operator for, as DataFrame helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Points joined with the spans [lo, hi] of the same keys that hold their t.

    Each span is repeated once for every bucket of the given width that it touches, so this is an equi join on keys and
    bucket; choose a width near the median length of spans. how: inner, left, left_semi or left_anti. Null bounds match nothing.
    """
    cells = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    right = spans.where(F.col(lo) <= F.col(hi)).withColumn("_cell", F.explode(cells))
    left = points.withColumn("_cell", F.floor(F.col(t) / width))
    # names of the right side that would clash
    clash = [c for c in spans.columns if c in points.columns and c not in keys]
    for c in clash:
        right = right.withColumnRenamed(c, f"{c}_span")
    lo, hi = (f"{c}_span" if c in clash else c for c in (lo, hi))
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = (F.col("_cell") == F.col("_r_cell")) & (F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))
    right = right.withColumnRenamed("_cell", "_r_cell")
    for k in keys:
        on &= F.col(k) == F.col(f"_r_{k}")
    return left.join(right, on, how).drop("_cell", "_r_cell", *[f"_r_{k}" for k in keys])


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], width: float, how: str = "inner", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Spans of a with spans of b (columns b_lo, b_hi) of the same keys that overlap: a.lo <= b.hi and a.hi >= b.lo.

    Both sides go to the buckets that they touch; of a pair's common buckets, only the first yields it.
    """
    left = a.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    right = b.select(*keys, F.col(lo).alias("b_lo"), F.col(hi).alias("b_hi")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("b_lo") / width), F.floor(F.col("b_hi") / width))))
    if how in ("left_semi", "left_anti"):
        on = F.expr(f"{lo} <= b_hi and {hi} >= b_lo")
        pairs = left.join(right, [*keys, "_cell"]).where(on).select(*a.columns).distinct()
        return a.join(pairs, a.columns, how)
    first = F.floor(F.greatest(F.col(lo), F.col("b_lo")) / width) == F.col("_cell")
    return left.join(right, [*keys, "_cell"]).where(F.expr(f"{lo} <= b_hi and {hi} >= b_lo")).where(first).drop("_cell")


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, into: str) -> DataFrame:
    """The next non-null value after each row, in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(into, F.first(value, ignorenulls=True).over(w))


def last_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, into: str, own: bool = True) -> DataFrame:
    """The last non-null value up to each row, in order; own: the row itself counts."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def mark_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """df with flag and run, which numbers maximal stretches of equal flag in order; a null flag counts as false."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("flag", F.coalesce(flag, F.lit(False)))
    changed = F.when(F.lag("flag").over(w) == F.col("flag"), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, t: str) -> DataFrame:
    """(keys, run, lo, hi, size): maximal stretches of rows whose flag is true, with first and last t and number of rows."""
    runs = mark_runs(df, keys, order, flag).where("flag")
    return runs.groupBy(*keys, "run").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("size"))


def merge_close(spans: DataFrame, keys: Sequence[str], gap: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Spans that begin less than gap after the latest end before them become one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col(lo) - before < gap, 0).otherwise(1)).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*keys, "part").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("parts"))
