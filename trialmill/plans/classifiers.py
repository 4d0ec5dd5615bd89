"""Queries on linear classifiers and whole decoding problems: embeddings with labels stand in for trials, runs for folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classifiers as ops
from .decoding import _LONG, long
from .similarity import TIMES
from .standins import features, query


@query("u23_discriminants")
def u23_lda(s: SparkSession, d: str) -> DataFrame:
    return ops.discriminant_accuracy(features(s, d), [], "run")


#: Rounds of the solver; each is a Spark job for each fold.
ROUNDS = 20


def categories(s: SparkSession, d: str) -> DataFrame:
    """Items with one of two categories in place of the label, and four stratified folds."""
    return ops.stratified_folds(features(s, d).withColumn("label", F.col("label") % 2), [], 4)


@query("u23_linear_support_vectors")
def u23_svc(s: SparkSession, d: str) -> DataFrame:
    return ops.margin_accuracy(categories(s, d), "fold", rounds=ROUNDS)


@query("u23_logistic_regression")
def u23_logistic(s: SparkSession, d: str) -> DataFrame:
    return ops.margin_accuracy(ops.stratified_folds(features(s, d), [], 4), "fold", kind="logistic", rounds=ROUNDS)


#: Trees of a forest.
TREES = 30


@query("u23_random_forest")
def u23_forest(s: SparkSession, d: str) -> DataFrame:
    return ops.forest_accuracy(ops.stratified_folds(features(s, d), [], 4), "fold", trees=TREES)


_FOLDS = f"(SELECT l.label, q.run, l.f - 1 AS f, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM {_LONG} l JOIN (SELECT DISTINCT run FROM {{ft}}) q ON l.run <> q.run GROUP BY ALL)"
_F = f"(SELECT run, f, (m - s * s / n) / (k - 1) / nullif((q - m) / (n - k), 0) AS score FROM (SELECT run, f, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS m FROM {_FOLDS} GROUP BY 1, 2))"


@query("u34_f5_features_by_fold", f"SELECT run, CAST(f AS INT) AS f, r(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(score, 9) DESC NULLS LAST, f) AS i FROM {_F}) WHERE i <= 16")
def u34_features(s: SparkSession, d: str) -> DataFrame:
    return ops.fold_features(long(s, d), [], "run", "label", 16)


#: Averaged trials of a pseudo-trial, repeats of the averaging, folds, channels kept, and points of the running mean.
AVERAGED, REPEATS, FOLDS, KEPT, WIDTH = 5, 3, 5, 4, 5


def pseudo_items(s: SparkSession, d: str) -> DataFrame:
    """(repeat, task, label, id, t, x): pseudo-trials of two categories in two tasks, a vector of smoothed channels for each time."""
    channels = 64 // TIMES
    trials = features(s, d).where(F.size("x") == 64).withColumns({"task": F.when(F.col("id") % 2 == 0, "relevant").otherwise("irrelevant"), "label": F.col("label") % 2})
    trials = trials.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    means = ops.averaged(trials, ["repeat", "task", "label"], AVERAGED, 64, F.col("repeat"))
    points = [range(max(t - WIDTH // 2, 0), min(t + WIDTH // 2 + 1, TIMES)) for t in range(TIMES)]
    smooth = F.array(*[F.array(*[sum(F.col("x")[channels * p + c] for p in span) / len(span) for c in range(channels)]) for span in points])
    return means.select("repeat", "task", "label", "id", F.posexplode(smooth).alias("t", "x"))


@query("u34_decoding_problems")
def u34(s: SparkSession, d: str) -> DataFrame:
    """Category within each task by folds, and from each task to the other, at every time: mean accuracy over folds and repeats."""
    items = pseudo_items(s, d)
    folds = ops.stratified_folds(items, ["repeat", "task", "t"], FOLDS)
    within = ops.discriminant_accuracy(folds, ["repeat", "task", "t"], "fold", select=KEPT, shrink=0.01)
    across = ops.generalised_accuracy(items, ["repeat", "t"], "task", select=KEPT, shrink=0.01)
    rows = within.select(F.lit("within").alias("problem"), F.col("task").alias("train"), F.col("task").alias("test"), "t", "accuracy", "n")
    rows = rows.unionByName(across.select(F.lit("across").alias("problem"), "train", "test", "t", "accuracy", "n"))
    return rows.groupBy("problem", "train", "test", "t").agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
