"""Voxel maps and regions: conjunctions, set operations on masks, top-k picks, counts by region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunction(maps: DataFrame, names: Sequence[str], rules: dict[str, Column], key: str = "voxel", value: str = "value") -> DataFrame:
    """One row per voxel with its value in each map, and a flag for each rule; a missing value makes a flag false."""
    wide = maps.groupBy(key).pivot("map", list(names)).agg(F.first(value))
    return wide.select(key, *[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()])


def merged(maps: DataFrame, key: str = "voxel", value: str = "value") -> DataFrame:
    """Least, largest and sum over maps: and, or and count of boolean maps."""
    return maps.groupBy(key).agg(F.min(value).alias("all_maps"), F.max(value).alias("any_map"), F.sum(value).alias("total"))


def region_counts(members: DataFrame, flagged: DataFrame, key: str = "voxel", roi: str = "roi") -> DataFrame:
    """Members and flagged members of each region, as count, fraction and percent."""
    hit = flagged.select(key).distinct().withColumn("_on", F.lit(1))
    rows = members.join(hit, key, "left").groupBy(roi).agg(F.count(F.lit(1)).alias("size"), F.count("_on").alias("n"))
    return rows.withColumn("fraction", F.col("n") / F.col("size")).withColumn("percent", 100 * F.col("fraction"))


def top_and_bottom(df: DataFrame, keys: Sequence[str], n_top: int, n_bottom: int, value: str = "value", tie: str = "voxel") -> DataFrame:
    """The n_top highest and n_bottom lowest non-zero values of each group, with side; ties go to the smaller id."""
    rows = df.where(F.col(value) != 0)
    high, low = (F.row_number().over(Window.partitionBy(*keys).orderBy(x, tie)) for x in (F.desc(value), F.col(value)))
    top = rows.withColumn("place", high).where(F.col("place") <= n_top).withColumn("side", F.lit("top"))
    return top.unionByName(rows.withColumn("place", low).where(F.col("place") <= n_bottom).withColumn("side", F.lit("bottom")))


def overlapping(members: DataFrame, key: str = "voxel", roi: str = "roi") -> DataFrame:
    """Members with the number of regions that hold their voxel and whether this one is the smallest of them (ties by name)."""
    sizes = F.count(F.lit(1)).over(Window.partitionBy(roi))
    rows = members.withColumn("size", sizes).withColumn("regions", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return rows.withColumn("owner", F.row_number().over(Window.partitionBy(key).orderBy("size", roi)) == 1)


def phase_codes(a: DataFrame, b: DataFrame, key: str = "voxel") -> DataFrame:
    """Code 1, 2 or 3: in the first mask only, in the second only, in both."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(2))
    return x.join(y, key, "full_outer").select(key, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("code"))


def equal_label_counts(df: DataFrame, label: str, tie: str, seed: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """As many rows of each label as the rarest has, picked in an order by md5 of seed and id."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(tie)))
    w = Window.partitionBy(*within, label)
    counts = df.groupBy(*within, label).agg(F.count(F.lit(1)).alias("_c"))
    least = counts.groupBy(*within).agg(F.min("_c").alias("_least")) if within else counts.agg(F.min("_c").alias("_least"))
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(order, tie)))
    rows = rows.join(least, list(within)) if within else rows.crossJoin(F.broadcast(least))
    return rows.where(F.col("_n") <= F.col("_least")).withColumn("rank", F.col("_n").cast("long")).drop("_n", "_least")


def anova_f(values: DataFrame, feature: str, label: str, value: str) -> DataFrame:
    """F of each feature between labels, from sums per feature and label."""
    g = values.groupBy(feature, label).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(feature).agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    between, within = F.col("B") - F.col("S") ** 2 / F.col("N"), F.col("Q") - F.col("B")
    return t.select(feature, ((between / (F.col("k") - 1)) / (within / (F.col("N") - F.col("k")))).alias("f"))


def super_subject(rows: DataFrame, subject: str, label: str, tie: str, seed: int = 0) -> DataFrame:
    """Rows of the labels that every subject has, as many of each label from each subject as the subject with least has.

    rank (from 1) is a row's place among those of its subject and label, in order of the md5 of seed and tie: rows of one
    label and rank make one trial of all subjects' channels. Rows without a subject or a label take no part.
    """
    known = rows.where(F.col(subject).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(subject, label).agg(F.count(F.lit(1)).alias("_n"))
    all_subjects = counts.agg(F.count_distinct(subject).alias("_all"))  # one row
    common = counts.groupBy(label).agg(F.count(F.lit(1)).alias("_subjects"), F.min("_n").alias("_least")).crossJoin(F.broadcast(all_subjects)).where("_subjects = _all")
    rank = F.row_number().over(Window.partitionBy(subject, label).orderBy(F.md5(F.concat_ws(":", F.lit(seed), tie)), tie))
    return known.join(common.select(label, "_least"), label).withColumn("rank", rank.cast("long")).where("rank <= _least").drop("_least")


def enough_repeats(rows: DataFrame, labels: Sequence[str], least: int) -> DataFrame:
    """Rows whose labels, nulls as a label like others, occur at least so many times."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*labels))).where(F.col("_n") >= least).drop("_n")
