"""Decoding problems over many cells at once: folds, permutations and feature sets are key columns, never a driver loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import grid_clusters, kendall_by_runs, one_sample_t, shuffled_labels


def _nearest(long: DataFrame, centres: DataFrame, on: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep and guess: the label whose centre is nearest over the features; ties to the smaller label."""
    far = long.join(centres, [*on, "f"]).groupBy(*keep, "guess").agg(F.sum((F.col("v") - F.col("c")) ** 2).alias("d"))
    best = F.min(F.struct(F.round("d", 9).alias("d"), "guess"))
    return far.groupBy(*keep).agg(best["guess"].alias("guess"))


def _accuracy(guesses: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return guesses.groupBy(*keys).agg(F.avg((F.col("guess") == F.col(label)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _less_own(own: DataFrame, keys: Sequence[str], by: Sequence[str], fold: str, sums: Sequence[str]) -> DataFrame:
    """For each fold the totals of sums over all other folds; own has a row for each (keys, by, fold), folds are few."""
    total = own.groupBy(*keys, *by).agg(*[F.sum(c).alias(f"all_{c}") for c in sums], F.collect_list(F.struct(fold, *sums)).alias("folds"))  # a row for each fold
    every = own.select(*keys, fold).distinct()
    joined = total.join(every, list(keys)) if keys else total.crossJoin(F.broadcast(every))
    mine = F.get(F.filter("folds", lambda x: x[fold] == F.col(fold)), F.lit(0))
    left = joined.select(*keys, *by, fold, *[(F.col(f"all_{c}") - F.coalesce(mine[c], F.lit(0))).alias(c) for c in sums])
    return left.where(F.col(sums[-1]) > 0)


def _left_out(long: DataFrame, keys: Sequence[str], fold: str, label: str) -> DataFrame:
    """(keys, guess, fold, f, s, q, n): sum, sum of squares and count of each label's values in the other folds."""
    rows = long.where(F.col(label).isNotNull() & F.col("v").isNotNull())
    own = rows.groupBy(*keys, label, fold, "f").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    return _less_own(own, keys, [label, "f"], fold, ["s", "q", "n"]).withColumnRenamed(label, "guess")


def cross_validated(long: DataFrame, keys: Sequence[str], fold: str, key: str = "id", label: str = "label") -> DataFrame:
    """(keys, fold, accuracy, n) of nearest centroids with one fold left out at a time, for each cell of keys.

    long has a row (keys, id, label, fold, f, v) for each feature of an item. A fold's centroids are the totals less its
    own sums, so that every row is read twice whatever the number of folds. Null values and labels take no part.
    """
    centres = _left_out(long, keys, fold, label).select(*keys, "guess", fold, "f", (F.col("s") / F.col("n")).alias("c"))
    rows = long.where(F.col(label).isNotNull() & F.col("v").isNotNull())
    return _accuracy(_nearest(rows, centres, [*keys, fold], [*keys, key, label, fold]), [*keys, fold], label)


def naive_bayes(long: DataFrame, keys: Sequence[str], fold: str, key: str = "id", label: str = "label", smoothing: float = 1e-9) -> DataFrame:
    """(keys, fold, accuracy, n) of Gaussian naive Bayes with one fold left out at a time, rows as for cross_validated.

    Means, variances (smoothing is added to them) and shares of labels come from the sums of the other folds. An item is
    judged by its features that aren't null; ties go to the smaller label.
    """
    rows = long.where(F.col(label).isNotNull() & F.col("v").isNotNull())
    own = rows.select(*keys, label, fold, key).distinct().groupBy(*keys, label, fold).agg(F.count(F.lit(1)).alias("here"))
    shares = _less_own(own, keys, [label], fold, ["here"]).select(*keys, F.col(label).alias("guess"), fold, F.log("here").alias("prior"))
    mean = F.col("s") / F.col("n")
    laws = _left_out(long, keys, fold, label).select(*keys, "guess", fold, "f", mean.alias("c"), (F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) + smoothing).alias("var"))
    each = F.log("var") + (F.col("v") - F.col("c")) ** 2 / F.col("var")
    far = rows.join(laws, [*keys, fold, "f"]).groupBy(*keys, key, label, fold, "guess").agg(F.sum(each).alias("d"))
    far = far.join(shares, [*keys, fold, "guess"]).withColumn("d", F.round(F.col("d") - 2 * F.col("prior"), 6))
    best = far.groupBy(*keys, key, label, fold).agg(F.min(F.struct("d", "guess"))["guess"].alias("guess"))
    return _accuracy(best, [*keys, fold], label)


def generalisation(long: DataFrame, keys: Sequence[str], condition: str, key: str = "id", label: str = "label") -> DataFrame:
    """(keys, train, test, accuracy, n): nearest centroids trained on one condition (or time) and tested on every other."""
    long = long.where(F.col(label).isNotNull() & F.col("v").isNotNull())
    centres = long.groupBy(*keys, F.col(condition).alias("train"), F.col(label).alias("guess"), "f").agg(F.avg("v").alias("c"))
    tested = long.withColumnRenamed(condition, "test")
    trains = centres.select(*keys, "train").distinct()
    tested = (tested.join(trains, list(keys)) if keys else tested.crossJoin(F.broadcast(trains))).where("train <> test")
    return _accuracy(_nearest(tested, centres, [*keys, "train"], [*keys, "train", "test", key, label]), [*keys, "train", "test"], label)


def permuted(items: DataFrame, long: DataFrame, within: Sequence[str], fold: str, count: int, key: str = "id", label: str = "label") -> DataFrame:
    """(perm, accuracy): cross-validated accuracy of the observed labels (perm 0) and of labels shuffled within groups.

    items has one row (id, label, within) each; only these are shuffled, features are joined to them by id.
    """
    shuffled = shuffled_labels(items.select(*dict.fromkeys([*within, key, label])), within, key, label, count).select("perm", key, label)
    rows = long.drop(label).join(shuffled, key)
    folds = cross_validated(rows, ["perm"], fold, key, label)
    return folds.groupBy("perm").agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"))


def grid_cluster_test(scores: DataFrame, keys: Sequence[str], x: str, y: str, threshold: float, value: str = "value") -> DataFrame:
    """2-D cluster test of scores by perm (0 observed): sets of cells above the threshold, p by the largest mass of each perm."""
    cells = scores.select(*keys, "perm", x, y, value)
    found = grid_clusters(cells, [*keys, "perm"], x, y, value, threshold)
    clusters = found.groupBy(*keys, "perm", "label").agg(F.count(F.lit(1)).alias("cells"), F.sum(value).alias("mass"))
    largest = cells.select(*keys, "perm").distinct().join(clusters.groupBy(*keys, "perm").agg(F.max("mass").alias("top")), [*keys, "perm"], "left").fillna(0.0, ["top"])
    seen = clusters.where("perm = 0").drop("perm")
    return seen.join(largest, list(keys)).groupBy(*keys, "label", "cells", "mass").agg(F.avg((F.col("top") >= F.col("mass") - 1e-9).cast("int")).alias("p"))


def theory_correlation(cells: DataFrame, predicted: DataFrame, subject: str, x: str = "x", y: str = "y", value: str = "v") -> DataFrame:
    """(theory, mean, sd, n, t, df): each subject's correlation with each theory's predicted matrix, then t over subjects.

    predicted has (theory, x, y, predicted), a row for each cell of a theory; it is as small as a few matrices and is broadcast.
    """
    each = cells.join(F.broadcast(predicted), [x, y]).groupBy("theory", subject).agg(F.corr(value, "predicted").alias("rho"))
    return one_sample_t(each, ["theory"], F.col("rho"))


def theory_rank_correlation(cells: DataFrame, predicted: DataFrame, subject: str, x: str = "x", y: str = "y", value: str = "v") -> DataFrame:
    """(theory, mean, sd, n, t, df): as theory_correlation, by Kendall's tau-b of each subject's matrix with the predicted one.

    A subject's cells of one theory meet in one task, in order, without a join of their pairs.
    """
    each = kendall_by_runs(cells.join(F.broadcast(predicted), [x, y]), ["theory", subject], value, "predicted")
    return one_sample_t(each, ["theory"], F.col("tau"))


def smoothed(signal: DataFrame, keys: Sequence[str], t: str, value: str, width: int = 5) -> DataFrame:
    """value as the mean of the points around it, fewer at the ends, as decoding problems begin."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-(width // 2), width // 2)
    return signal.withColumn(value, F.avg(value).over(w))


def sigmoid_calibration(rows: DataFrame, fold: str, score: str, target: str, rounds: int = 12) -> DataFrame:
    """(fold, a, b, n): each fold's sigmoid 1 / (1 + exp(a score + b)), fitted to its own held-out scores and 0 or 1 targets.

    Newton's method on all folds at once: a round is one aggregation. Targets are drawn in by Platt's counts, so that a
    fold whose scores part the targets has a finite fit; one score alone gives a = 0. Nulls take no part.
    """
    kept = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(F.col(fold).alias("fold"), F.col(score).cast("double").alias("x"), F.col(target).cast("int").alias("y"))
    kept = kept.groupBy("fold", "x", "y").agg(F.count(F.lit(1)).alias("k"))  # the rounds share this exchange
    k, x, hit = F.col("k"), F.col("x"), F.col("y") == 1
    fit = kept.groupBy("fold").agg(
        F.sum(k).alias("n"), F.sum(F.when(hit, k).otherwise(0)).alias("n1"), (F.sum(k * x) / F.sum(k)).alias("m"),
        F.sqrt(F.greatest(F.sum(k * x * x) / F.sum(k) - (F.sum(k * x) / F.sum(k)) ** 2, F.lit(0.0))).alias("sd"),
    ).withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    u = F.coalesce(F.try_divide(x - F.col("m"), F.col("sd")), F.lit(0.0))
    p, goal = 1 / (1 + F.exp(F.col("a") * F.col("u") + F.col("b"))), F.when(hit, (F.col("n1") + 1) / (F.col("n1") + 2)).otherwise(1 / (F.col("n") - F.col("n1") + 2))
    for _ in range(rounds):
        each = kept.join(fit, "fold").withColumn("u", u).withColumns({"g": k * (goal - p), "w": k * p * (1 - p)})
        sums = each.groupBy("fold", "n", "n1", "m", "sd", "a", "b").agg(
            F.sum(F.col("g") * F.col("u")).alias("g1"), F.sum("g").alias("g0"), (F.sum(F.col("w") * F.col("u") * F.col("u")) + 1e-12).alias("h11"),
            F.sum(F.col("w") * F.col("u")).alias("h01"), (F.sum("w") + 1e-12).alias("h00"),
        )
        det = F.col("h11") * F.col("h00") - F.col("h01") ** 2
        a = F.col("a") - (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det
        b = F.col("b") - (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / det
        fit = sums.select("fold", "n", "n1", "m", "sd", a.alias("a"), b.alias("b"))
    slope = F.coalesce(F.try_divide("a", "sd"), F.lit(0.0))
    return fit.select(F.col("fold").alias(fold), slope.alias("a"), (F.col("b") - slope * F.col("m")).alias("b"), "n")


def calibrated(rows: DataFrame, fits: DataFrame, score: str, into: str = "probability") -> DataFrame:
    """rows with the mean probability that the folds' sigmoids give a score; null for a null score or no fit."""
    folds = fits.agg(F.collect_list(F.struct("a", "b")).alias("_fits"))  # one row, an entry for each fold
    total = F.aggregate("_fits", F.lit(0.0), lambda sum_, f: sum_ + 1 / (1 + F.exp(f["a"] * F.col(score) + f["b"])))
    return rows.crossJoin(F.broadcast(folds)).withColumn(into, F.try_divide(total, F.size("_fits"))).drop("_fits")


def trial_covariances(long: DataFrame, keys: Sequence[str], trial: str, channel: str, t: str, value: str) -> DataFrame:
    """(keys, trial, i, j, cov): covariance over time of each pair of channels i <= j of a trial, one row (channel, t) each.

    Null values take no part; a pair with fewer than two common times has none.
    """
    side = lambda name, v: long.where(F.col(value).isNotNull()).select(*keys, trial, t, F.col(channel).alias(name), F.col(value).alias(v))
    both = side("i", "_p").join(side("j", "_q"), [*keys, trial, t]).where("i <= j")
    return both.groupBy(*keys, trial, "i", "j").agg(F.covar_samp("_p", "_q").alias("cov")).where("cov is not null")


def cleaned_covariance(covs: DataFrame, keys: Sequence[str], trial: str, z: float = 3.0, gamma: float = 0.01) -> DataFrame:
    """(keys, i, j, cov, kept): the mean covariance without trials whose distance to the mean of all has a z score of z or more, then shrunk.

    Shrinking moves the matrix by gamma to its mean eigenvalue, trace / n, on the diagonal. Trials at one distance all stay.
    """
    twice = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    mean = covs.groupBy(*keys, "i", "j").agg(F.avg("cov").alias("_m"))
    far = covs.join(mean, [*keys, "i", "j"]).groupBy(*keys, trial).agg(F.round(F.sqrt(F.sum(twice * (F.col("cov") - F.col("_m")) ** 2)), 9).alias("_d"))
    spread = far.groupBy(*keys).agg(F.avg("_d").alias("_a"), F.stddev_pop("_d").alias("_s"))
    good = far.join(spread, list(keys)).where(F.coalesce(F.try_divide(F.col("_d") - F.col("_a"), F.col("_s")), F.lit(0.0)) < z).select(*keys, trial)
    left = covs.join(good, [*keys, trial]).groupBy(*keys, "i", "j").agg(F.avg("cov").alias("cov"), F.count(F.lit(1)).alias("kept"))
    trace = left.where("i = j").groupBy(*keys).agg(F.avg("cov").alias("_e"))
    shrunk = F.col("cov") * (1 - gamma) + F.when(F.col("i") == F.col("j"), gamma * F.col("_e")).otherwise(0.0)
    return left.join(trace, list(keys)).select(*keys, "i", "j", shrunk.alias("cov"), "kept")
