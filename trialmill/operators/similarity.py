"""Trials by features: distances, representational similarity, classifiers by aggregates, pseudo-trials, connectivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def pair_distances(items: DataFrame, within: Sequence[str], key: str = "id", label: str = "label", x: str = "x") -> DataFrame:
    """Distance of every pair of items of a group (a < b), and whether their labels agree; groups are small by design."""
    a = items.select(*within, F.col(key).alias("a"), F.col(label).alias("la"), F.col(x).alias("xa"))
    b = items.select(*within, F.col(key).alias("b"), F.col(label).alias("lb"), F.col(x).alias("xb"))
    return a.join(b, list(within)).where("a < b").select(*within, "a", "b", (F.col("la") == F.col("lb")).alias("same"), euclidean("xa", "xb").alias("distance"))


def within_between(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean distance across labels less the mean within labels."""
    w, b = F.avg(F.when(F.col("same"), F.col("distance"))), F.avg(F.when(~F.col("same"), F.col("distance")))
    return pairs.groupBy(*keys).agg(w.alias("within"), b.alias("between"), (b - w).alias("score"))


def centroid_guesses(items: DataFrame, fold: str, key: str = "id", label: str = "label", x: str = "x") -> DataFrame:
    """The label of the nearest centroid for each item. A fold's centroids are the totals of all items less its own."""
    long = items.select(key, label, fold, F.posexplode(x).alias("f", "v"))
    own = long.groupBy(label, fold, "f").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    total = own.groupBy(label, "f").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    folds = items.select(fold).distinct()
    centre = total.crossJoin(F.broadcast(folds)).join(own, [label, fold, "f"], "left").fillna(0, ["s", "n"])
    centre = centre.where("all_n > n").select(F.col(label).alias("guess"), fold, "f", ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("c"))
    far = long.join(centre, [fold, "f"]).groupBy(key, label, fold, "guess").agg(F.sum((F.col("v") - F.col("c")) ** 2).alias("d"))
    return far.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.round("d", 9), "guess"))).where("_n = 1").drop("_n")


def centroid_accuracy(items: DataFrame, fold: str, key: str = "id", label: str = "label", x: str = "x") -> DataFrame:
    """Leave-one-fold-out accuracy of nearest centroids."""
    return centroid_guesses(items, fold, key, label, x).groupBy(fold).agg(F.avg((F.col("guess") == F.col(label)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def pseudo_trials(items: DataFrame, keys: Sequence[str], tie: str, n: int, value: str, seed: int = 0) -> DataFrame:
    """Means of every n rows of a group in an order by md5; the last may be of fewer."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(tie)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie)) - 1
    return items.withColumn("pseudo", F.floor(place / n)).groupBy(*keys, "pseudo").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def phase_consistency(phases: DataFrame, pair: Sequence[str], trial: str, difference: Column) -> DataFrame:
    """Pairwise phase consistency over trials of a phase difference."""
    g = phases.groupBy(*pair).agg(F.sum(F.cos(difference)).alias("c"), F.sum(F.sin(difference)).alias("s"), F.count(trial).alias("n"))
    return g.select(*pair, F.try_divide(F.col("c") ** 2 + F.col("s") ** 2 - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("ppc"))


def reliability_curve(df: DataFrame, predicted: Column, observed: str, bins: int) -> DataFrame:
    place = F.least(F.floor(predicted * bins), F.lit(bins - 1))
    return df.withColumn("_p", predicted).groupBy(place.alias("bin")).agg(F.avg("_p").alias("predicted"), F.avg(observed).alias("observed"), F.count(F.lit(1)).alias("n"))
