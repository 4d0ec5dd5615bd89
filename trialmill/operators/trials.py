"""Behaviour: event logs to trials, response labels, subject quality, and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import norm_ppf

# Codes of stimulus types and orientations.
TYPES = {"1": "face", "2": "object", "3": "letter", "4": "falseFont"}
ORIENTATIONS = {"1": "center", "2": "left", "3": "right"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def parse_code(code: Column) -> list[Column]:
    """Type, orientation and id of a four-digit event code."""
    text = code.cast("int").cast("string")
    return [lookup(TYPES, text.substr(1, 1)).alias("stim_type"), lookup(ORIENTATIONS, text.substr(2, 1)).alias("orientation"), text.substr(3, 2).alias("stim_id")]


def task_relevance(stim_type: Column, block_type: Column) -> Column:
    """Whether a block's type names the stimulus type; a false font is named as 'false' there."""
    return F.when(stim_type == "falseFont", F.contains(F.lower(block_type), F.lit("false"))).otherwise(F.contains(F.lower(block_type), F.lower(stim_type)))


def response_label(expected: Column, given: Column) -> Column:
    """TruePositive, FalseNegative, FalsePositive or TrueNegative; a null response is none (a target then is a miss)."""
    given = F.coalesce(given, F.lit(False))
    return F.when(expected & given, "TruePositive").when(expected, "FalseNegative").when(given, "FalsePositive").otherwise("TrueNegative")


def subject_quality(trials: DataFrame) -> DataFrame:
    """Hits, false alarms, rates and mean reaction time of hits per subject, from label, relevant and rt."""
    fa, hit = F.col("label") == "FalsePositive", F.col("label") == "TruePositive"
    lures = F.count_if(F.col("label").isin("FalsePositive", "TrueNegative"))
    targets = F.count_if(F.col("label").isin("TruePositive", "FalseNegative"))
    return trials.groupBy("subject").agg(
        F.count_if(hit).alias("hits"), targets.alias("targets"), F.count_if(fa).alias("fas"), lures.alias("lures"), F.count_if(fa & F.col("relevant")).alias("fas_relevant"), F.count_if(fa & ~F.col("relevant")).alias("fas_irrelevant"),
        F.try_divide(F.count_if(hit), targets).alias("hit_rate"), F.try_divide(F.count_if(fa), lures).alias("fa_rate"), F.avg(F.when(hit, F.col("rt"))).alias("hit_rt"),
    )


def validity(quality: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Quality rows with hits_ok, fas_ok and valid, by bounds (key, min_hits, max_fas)."""
    rows = quality.join(bounds, key, "left")
    return rows.withColumns({"hits_ok": F.col("hit_rate") >= F.col("min_hits"), "fas_ok": F.col("fa_rate") <= F.col("max_fas")}).withColumn("valid", F.col("hits_ok") & F.col("fas_ok"))


def d_prime(trials: DataFrame, keys: Sequence[str], target: Column, responded: Column) -> DataFrame:
    """d' per combination of keys, every combination of their values included, rates as (n + 0.5) / (N + 1)."""
    counts = trials.groupBy(*keys).agg(F.count_if(target & responded).alias("hits"), F.count_if(target).alias("targets"), F.count_if(~target & responded).alias("fas"), F.count_if(~target).alias("lures"))
    grid = trials.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(F.broadcast(trials.select(k).distinct()))
    full = grid.join(counts, list(keys), "left").fillna(0, ["hits", "targets", "fas", "lures"])
    full = full.withColumns({"h": (F.col("hits") + 0.5) / (F.col("targets") + 1), "f": (F.col("fas") + 0.5) / (F.col("lures") + 1)})
    return full.withColumn("d_prime", norm_ppf("h") - norm_ppf("f")).drop("h", "f")


def stats_by_combination(df: DataFrame, value: str, by: Sequence[str], fixed: Sequence[str] = ()) -> DataFrame:
    """Mean, standard deviation and count of value for every non-empty combination of the by columns, within fixed ones.

    With fixed columns rows are dealt by them once and each combination is a pass over that, so that no task holds the groups
    of all combinations together with the sorts of what df is joined from.
    """
    sets = [[*fixed, *c] for k in range(1, len(by) + 1) for c in combinations(by, k)]
    stats = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")]
    every = [*fixed, *by]
    if not fixed:
        return df.groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in every]).agg(*stats, F.grouping_id().alias("level"))
    rows, kinds = df.select(*every, value).repartition(*fixed), dict(df.dtypes)
    out = None
    for x in sets:
        level = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in x)
        one = rows.groupBy(*x).agg(*stats).select(*[F.col(c) if c in x else F.lit(None).cast(kinds[c]).alias(c) for c in every], "mean", "sd", "n", F.lit(level).cast("long").alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (latest first)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def trial_rows(log: DataFrame, keys: Sequence[str], kinds: Sequence[str], kind: str = "kind", t: str = "t") -> DataFrame:
    """One row per key with the first time of each kind of event: one pass with a fixed list of kinds."""
    return log.groupBy(*keys).agg(*[F.min(F.when(F.col(kind) == k, F.col(t))).alias(k) for k in kinds])


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join by keys: per column the value (a's, else b's) and whether both agree (nulls agree with each other)."""
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns])
    out = []
    for c in columns:
        out += [F.coalesce(f"a_{c}", f"b_{c}").alias(c), F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).alias(f"{c}_same")]
    return x.join(y, list(keys), "full_outer").select(*keys, *out)


def trials_of_stream(log: DataFrame, starts: Column, keys: Sequence[str] = ("subject",), order: Sequence[str] = ("t", "id")) -> DataFrame:
    """Number the trials of a trigger stream: each start opens one; rows before the first have number 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("trial", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def last_restart(log: DataFrame, key: str, start: Column, order: str) -> DataFrame:
    """Rows from the last start event of each key on; all rows of a key without one."""
    at = F.max(F.when(start, F.col(order))).over(Window.partitionBy(key))
    return log.withColumn("_at", at).where(F.col("_at").isNull() | (F.col(order) >= F.col("_at"))).drop("_at")


def align_in_order(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str], t: str) -> DataFrame:
    """The n-th event of a with the n-th of b, and the difference of their intervals to the event before."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select(*keys, F.row_number().over(w).cast("long").alias("n"), F.col(t).alias(f"{name}_t"), (F.col(t) - F.lag(t).over(w)).alias(f"{name}_gap"))

    return numbered(a, "a").join(numbered(b, "b"), [*keys, "n"], "full_outer").withColumn("gap_difference", F.col("a_gap") - F.col("b_gap"))


def with_responses(log: DataFrame, triggers: DataFrame, keys: Sequence[str], event: str, order: Sequence[str], t: str, trigger: str, response: Column) -> DataFrame:
    """log with the trigger time of each event; a response has that of the last event before it that has one, plus the log's delay.

    triggers has (event, trigger) of events that aren't responses. Responses before any such event, and events that are
    missing among the triggers, have none.
    """
    rows = log.join(triggers.select(event, F.col(trigger).alias("_g")), event, "left").withColumn("_g", F.when(~response, F.col("_g")))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_g").isNotNull(), F.struct("_g", F.col(t).alias("_t"))), ignorenulls=True).over(w)
    rows = rows.withColumn("_last", last)
    at = F.when(response, F.col("_last._g") + (F.col(t) - F.col("_last._t"))).otherwise(F.col("_g"))
    return rows.withColumn(trigger, at).select(*[c for c in log.columns if c != trigger], trigger)


def within_subject_ci(df: DataFrame, subject: str, by: Sequence[str], value: str) -> DataFrame:
    """Cousineau: subjects' means taken out, the grand mean put back, then mean and 1.96 standard errors by condition; morey is the corrected SE."""
    w = Window.partitionBy(subject)
    grand = df.agg(F.avg(value).alias("_grand"))
    normed = df.withColumn("_y", F.col(value) - F.avg(value).over(w)).crossJoin(F.broadcast(grand)).withColumn("_y", F.col("_y") + F.col("_grand"))
    levels = F.broadcast(df.select(*by).distinct().agg(F.count(F.lit(1)).alias("_m")))
    out = normed.groupBy(*by).agg(F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("_sd"), F.count("_y").alias("n")).crossJoin(levels)
    se = F.col("_sd") / F.sqrt("n")
    return out.select(*by, "mean", (1.96 * se).alias("ci"), (se * F.sqrt(F.col("_m") / (F.col("_m") - 1))).alias("morey"), "n")


def two_level_means(df: DataFrame, subject: str, by: Sequence[str], value: Column) -> DataFrame:
    """Means of subjects first, then mean, standard error and number of subjects by condition."""
    per = df.groupBy(subject, *by).agg(F.avg(value).alias("_m"))
    return per.groupBy(*by).agg(F.avg("_m").alias("mean"), (F.stddev_samp("_m") / F.sqrt(F.count("_m"))).alias("se"), F.count("_m").alias("subjects"))


def trigger_bursts(triggers: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, limit: float, classes: dict[int, str]) -> DataFrame:
    """Triggers with the size of the burst (consecutive gaps of at most limit) that they belong to, and its class by size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col(t) - F.lag(t).over(w) <= limit, 0).otherwise(1)
    rows = triggers.withColumn("_new", new).withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "burst"))
    kind = F.coalesce(*[F.when(F.col("size") == n, F.lit(name)) for n, name in classes.items()], F.lit("single"))
    return rows.withColumn("size", size).withColumn("class", kind)


def missing_triggers(log: DataFrame, triggers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of log rows that no trigger has, once each; a key with a null has no trigger."""
    return log.select(*keys).distinct().join(triggers.select(*keys), list(keys), "left_anti")


def response_by_event(rows: DataFrame, keys: Sequence[str], target: Column, response: Column) -> DataFrame:
    """(keys, response): hit, miss, falseAlarm or correctRejection of each trial, by whether one of its rows is a response.

    target is an expression of the keys; a null one is no target. A null response is none.
    """
    there = rows.groupBy(*keys).agg(F.bool_or(F.coalesce(response, F.lit(False))).alias("_there"))
    label = F.when(target & F.col("_there"), "hit").when(target, "miss").when(F.col("_there"), "falseAlarm").otherwise("correctRejection")
    return there.select(*keys, label.alias("response"))


def duration_errors(log: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, planned: Column, limit: float, by: Sequence[str]) -> DataFrame:
    """(by, n, share): events with a next one in their group, and the share whose time until then misses the planned one by more than limit.

    Events without a planned time count in n, not in the share.
    """
    measured = F.lead(t).over(Window.partitionBy(*keys).orderBy(*order)) - F.col(t)
    rows = log.withColumn("_measured", measured).where("_measured is not null")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("_measured") - planned) > limit).cast("int")).alias("share"))


def time_in_trial(samples: DataFrame, onsets: DataFrame, keys: Sequence[str], t: str, onset: str, longest: float) -> DataFrame:
    """Samples of the trials with since: time since the trial's onset, from 0 to longest; others go. Of several onsets the least counts."""
    starts = onsets.groupBy(*keys).agg(F.min(onset).alias("_onset"))
    rows = samples.join(starts, list(keys)).withColumn("since", F.col(t) - F.col("_onset")).drop("_onset")
    return rows.where((F.col("since") >= 0) & (F.col("since") <= longest))
