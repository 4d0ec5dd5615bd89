"""Test statistics over groups: t, ranks, permutations, clusters, corrections, regressions, mixed models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import bayes_factor_t, chi2_p_value, empirical_null_bf
from .clusters import array_p, met_flip_p, permuted_sums, signs, t_arrays
from .intervals import mark_runs
from .signals import sustained


def one_sample_t(df: DataFrame, keys: Sequence[str], value: Column, mu: float = 0.0) -> DataFrame:
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return g.withColumn("t", F.try_divide(F.col("mean") - mu, F.col("sd") / F.sqrt("n"))).withColumn("df", F.col("n") - 1)


def two_sample_t(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """Equal-variance t of rows where first holds against the others."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    g = df.groupBy(*keys).agg(F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n1"), F.count(b).alias("n2"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return g.select(*keys, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, into: str = "rank") -> DataFrame:
    """Ranks within each group, ties at their mean."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(into, first + (ties - 1) / 2)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, rho): correlation of the ranks of x and y among a group's rows that have both; null without spread.

    Values are ranked to 9 digits, so that those that differ by rounding alone are ties.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.select(*keys, both.alias("_b"), F.when(both, F.round(x, 9)).alias("_x"), F.when(both, F.round(y, 9)).alias("_y"))
    ranked = average_ranks(average_ranks(rows, [*keys, "_b"], "_x", "_rx"), [*keys, "_b"], "_y", "_ry")
    rx, ry = F.when(F.col("_b"), F.col("_rx")), F.when(F.col("_b"), F.col("_ry"))
    return ranked.groupBy(*keys).agg(F.try_divide(F.covar_pop(rx, ry), F.stddev_pop(rx) * F.stddev_pop(ry)).alias("rho"))


def signed_rank(df: DataFrame, keys: Sequence[str], difference: Column) -> DataFrame:
    """Wilcoxon's signed-rank sum of positive differences and its normal z; zero differences are left out."""
    rows = df.withColumn("_d", difference).where("_d <> 0").withColumn("_a", F.abs("_d"))
    g = average_ranks(rows, keys, "_a").groupBy(*keys).agg(F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return g.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))


def rank_sum(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    g = average_ranks(df, keys, value).groupBy(*keys).agg(F.sum(F.when(first, F.col("rank"))).alias("w"), F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    return g.withColumn("z", F.try_divide(F.col("w") - n1 * (n1 + n2 + 1) / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)))


def permutations(df: DataFrame, count: int, observed: bool = True) -> DataFrame:
    """Every row once for each perm: 0 (the observed data, if asked for) and 1 to count."""
    return df.withColumn("perm", F.explode(F.sequence(F.lit(0 if observed else 1), F.lit(count))))


def sign_of(perm: Column, key: Column, seed: str = "") -> Column:
    """1 or -1 for each (perm, key) by the parity of an md5 digit; 1 for perm 0."""
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), perm, key)), 1, 1), 16, 10).cast("int")
    return F.when((perm == 0) | (digit % 2 == 0), 1).otherwise(-1)


def flipped_sums(df: DataFrame, keys: Sequence[str], subject: str, value: str, count: int) -> DataFrame:
    """(keys, perm, n, s, q): per group and perm the number, the sum of signed values and the sum of squares; perm 0 is unsigned.

    Signs are those of sign_of. A row is never repeated for its perms, see clusters.permuted_sums. Null values take no part, a
    group with no other has n = 0. Keys have other names than the result's own columns.
    """
    sums = permuted_sums(df, keys, subject, value, signs(count), count + 1)
    return sums.select(*keys, "n", "q", F.posexplode("s").alias("perm", "s")).select(*keys, "perm", "n", "s", "q")


def flipped_t(df: DataFrame, keys: Sequence[str], subject: str, value: str, count: int) -> DataFrame:
    """(keys, perm, t): one-sample t of each group under sign flips of subjects; null where values have no spread."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    left = q - s * s / n  # squares about the mean; below rounding error there is no spread
    var = F.when((n > 1) & ~(left <= 1e-12 * q), left / (n - 1))
    return flipped_sums(df, keys, subject, value, count).select(*keys, "perm", F.try_divide(s / n, F.sqrt(var / n)).alias("t"))


def sign_flip_test(df: DataFrame, keys: Sequence[str], subject: str, value: str, count: int, spread: bool = False) -> DataFrame:
    """One-sample permutation t per group: share of sign flips whose absolute t reaches the observed one, which counts as one of them.

    A group's rows meet in one task; spread (and no keys) sums them in many tasks first, for few groups of very many rows.
    """
    if keys and not spread:
        return met_flip_p(df, keys, subject, value, count).withColumnRenamed("observed", "t")
    t = t_arrays(permuted_sums(df, keys, subject, value, signs(count), count + 1), keys, missing=float("nan"))
    return array_p(t, keys, "stat").withColumnRenamed("observed", "t")


def shuffled_labels(df: DataFrame, within: Sequence[str], key: str, label: str, count: int) -> DataFrame:
    """Every row for each perm with a label of its group: ids in order meet labels in order of an md5 of perm and id."""
    by_id = F.lpad(F.col(key).cast("string"), 20, "0")
    order = F.when(F.col("perm") == 0, by_id).otherwise(F.md5(F.concat_ws(":", "perm", key)))
    left = df.withColumn("_i", F.row_number().over(Window.partitionBy(*within).orderBy(by_id)))  # the same for every perm
    rows = permutations(df.select(*within, key, F.col(label).alias("_l")), count)
    right = rows.select("perm", *within, F.row_number().over(Window.partitionBy("perm", *within).orderBy(order)).alias("_i"), "_l")
    return left.drop(label).join(right, [*within, "_i"]).withColumnRenamed("_l", label).drop("_i")


def category_d_prime(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Per label: its mean less the mean of the others' means, over the root of the mean of population variances."""
    g = df.groupBy(*keys, label).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(*keys)
    k, sm, sv = F.count(F.lit(1)).over(w), F.sum("m").over(w), F.sum("v").over(w)
    others_m, others_v = F.try_divide(sm - F.col("m"), k - 1), F.try_divide(sv - F.col("v"), k - 1)  # null for a single label
    return g.select(*keys, label, F.try_divide(F.col("m") - others_m, F.sqrt((F.col("v") + others_v) / 2)).alias("d"))


def histogram_p(df: DataFrame, keys: Sequence[str], value: str, tail: int = 0) -> DataFrame:
    """p of perm 0 among all perms: tail 1 upper, -1 lower, 0 both (absolute values); the observed one counts once."""
    x = F.abs(value) if tail == 0 else F.col(value) * (tail or 1)
    rows = df.withColumn("_x", x).withColumn("_o", F.max(F.when(F.col("perm") == 0, x)).over(Window.partitionBy(*keys)))
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("perm") == 0, F.col(value))).alias("observed"), F.avg((F.col("_x") >= F.col("_o") - 1e-9).cast("int")).alias("p"))


def cluster_test(scores: DataFrame, keys: Sequence[str], threshold: float, t: str = "t", value: str = "value") -> DataFrame:
    """1-D cluster test of scores by perm (0 observed): stretches above the threshold, their sums, p by the largest sum of each perm."""
    runs = mark_runs(scores, [*keys, "perm"], [t], F.col(value) > threshold).where("flag")
    clusters = runs.groupBy(*keys, "perm", "run").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.sum(value).alias("mass"))
    perms = scores.select(*keys, "perm").distinct()
    largest = perms.join(clusters.groupBy(*keys, "perm").agg(F.max("mass").alias("top")), [*keys, "perm"], "left").fillna(0.0, ["top"])
    seen = clusters.where("perm = 0").drop("perm", "run")
    return seen.join(largest, list(keys)).groupBy(*keys, "lo", "hi", "mass").agg(F.avg((F.col("top") >= F.col("mass") - 1e-9).cast("int")).alias("p"))


def _checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; a local one only for a local master."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or "file:///tmp/checkpoints")


def _stretches(keys: Sequence[str], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (keys, cell, to) in order to rows (keys, cell, label, to): each cell with the least cell that links of its stretch reach (to null), and links that may leave the stretch.

    A stretch is whole groups of keys, or a part of one group of at most `size` links and a batch.
    """
    names = [*keys, "cell", "label", "to"]

    def changes(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in columns:
            own = rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            new[1:] |= own[1:] != own[:-1]
        return new

    def solve(rows: pa.Table) -> pa.RecordBatch:
        cell, to = (rows.column(c).to_numpy() for c in ("cell", "to"))
        fresh = changes(rows, keys)
        group = np.cumsum(fresh) - 1
        fresh[1:] |= cell[1:] != cell[:-1]
        first, source = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        known = np.unique(cell)
        code = group[first] * len(known) + np.searchsorted(known, cell[first])  # ascends with the nodes
        at = np.minimum(np.searchsorted(known, to), len(known) - 1)
        near = np.minimum(np.searchsorted(code, group * len(known) + at), len(code) - 1)
        inside = (known[at] == to) & (code[near] == group * len(known) + at)
        x, y, label = source[inside], near[inside], np.arange(len(first))
        while True:
            new = label.copy()
            np.minimum.at(new, label[x], label[y])
            while not np.array_equal(new[new], new):
                new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        # of a group that ends within the stretch all cells are here; the first and the last may go on
        beyond = np.flatnonzero(~inside & ((group == 0) & (to < cell[0]) | (group == group[-1]) & (to > cell[-1])))
        rows_at = np.concatenate([first, beyond])
        labels = cell[first][label]
        ends = pa.array(np.concatenate([np.zeros(len(first), np.int64), to[beyond]]), mask=np.arange(len(rows_at)) < len(first))
        heads = rows.select([*keys, "cell"]).take(pa.array(rows_at)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in heads.columns), pa.array(np.concatenate([labels, labels[source[beyond]]])), ends], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < size:
                continue
            rows = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(changes(rows, keys))[-1]) or int(np.flatnonzero(changes(rows, [*keys, "cell"]))[-1])
            if cut:
                yield solve(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _spread_labels(on: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """on (keys, cell) with label; links lead from cells of on to cells of on, in both directions.

    Labels spread to neighbours and then to the label of their label, each round written out, until none changes.
    """
    columns = on.columns
    on = on.withColumn("label", F.col("cell")).checkpoint()
    before = None
    while True:
        least = links.join(on.select(*keys, F.col("cell").alias("to"), "label"), [*keys, "to"]).groupBy(*keys, "cell").agg(F.min("label").alias("_l"))
        new = on.join(least, [*keys, "cell"], "left").withColumn("label", F.least("label", F.coalesce("_l", "label"))).drop("_l").checkpoint()
        jump = new.select(*keys, F.col("cell").alias("label"), F.col("label").alias("_j"))
        on = new.join(jump, [*keys, "label"]).withColumn("label", F.least("label", "_j")).select(*columns, "label").checkpoint()
        total = on.agg(F.sum(F.col("label") - F.col("cell")).cast("string")).first()[0]  # labels only ever get smaller
        if total == before:
            return on
        before = total


def connected_cells(cells: DataFrame, links: DataFrame, keys: Sequence[str], size: int = 1 << 18) -> DataFrame:
    """cells with label, the least cell that links reach within a group of keys; links are rows (keys, cell, to) from cells, in both directions.

    Links that leave the cells are passed over; a cell without links is its own label. Links lie by range of (keys, cell), and
    each stretch of them is solved where it lies; only labels that links join across stretches spread in rounds.
    """
    _checkpoint_folder(cells.sparkSession)
    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "cell long, label long, to long"])
    for k in keys:
        cells = cells.where(F.col(k).isNotNull())
    rows = links.select(*keys, F.col("cell").cast("long"), F.col("to").cast("long")).where("to IS NOT NULL")
    parts = rows.repartitionByRange(*keys, "cell").sortWithinPartitions(*keys, "cell").mapInArrow(_stretches(keys, size), schema).checkpoint()
    own = parts.where("to IS NULL").drop("to")
    far = own.select(*keys, F.col("cell").alias("to"), F.col("label").alias("far_"))
    across = parts.where("to IS NOT NULL").select(*keys, F.col("label").alias("cell"), "to").join(far, [*keys, "to"])
    across = across.select(*keys, "cell", F.col("far_").alias("to")).distinct().checkpoint()
    if not across.isEmpty():
        tops = _spread_labels(across.select(*keys, "cell").distinct(), across, keys)
        tops = tops.select(*keys, F.col("cell").alias("label"), F.col("label").alias("top_"))
        own = own.join(tops, [*keys, "label"], "left").select(*keys, "cell", F.coalesce("top_", "label").alias("label"))
    label = F.coalesce("label", "cell").cast(kinds["cell"])
    return cells.join(own, [*keys, "cell"], "left").select(*cells.columns, label.alias("label")).checkpoint()


def grid_clusters(cells: DataFrame, keys: Sequence[str], x: str, y: str, value: str, threshold: float) -> DataFrame:
    """Connected sets of cells above a threshold on a grid (four neighbours): each cell with the least cell number of its set."""
    number = F.col(x).cast("long") * (1 << 31) + F.col(y).cast("long")
    _checkpoint_folder(cells.sparkSession)
    on = cells.where(F.col(value) > threshold).withColumn("cell", number).checkpoint()
    near = F.explode(F.array(*[F.col("cell") + F.lit(step) for step in (1 << 31, -(1 << 31), 1, -1)]))
    return connected_cells(on, on.select(*keys, "cell", near.alias("to")), keys).drop("cell")


def cluster_size_test(values: DataFrame, keys: Sequence[str], subject: str, voxel: str, value: str, adjacency: DataFrame, threshold: float, count: int) -> DataFrame:
    """Group test of maps by sign flips of subjects: (keys, voxel, t, label, size, p, p_size), a row for each voxel.

    values has one row (keys, subject, voxel, value) for each subject and voxel; nulls take no part. adjacency has rows
    (voxel, to) in both directions. Voxels with t above the threshold that touch form a cluster, named by its least voxel. p is
    the share of perms, the observed one included, whose largest t in any voxel reaches the voxel's; p_size the share
    whose largest cluster reaches its cluster's size. label, size and p_size are null outside clusters, t without spread.
    """
    rows = values.where(F.col(value).isNotNull()).withColumn("cell", F.col(voxel))
    _checkpoint_folder(values.sparkSession)
    sums = permuted_sums(rows, [*keys, "cell"], subject, value, signs(count), count + 1)
    arrays = t_arrays(sums, [*keys, "cell"], missing=float("nan")).select(*keys, "cell", F.transform("stat", lambda x: F.round(F.nanvl(x, F.lit(None)), 9)).alias("t"))
    arrays = arrays.checkpoint()  # flips are summed once; perms become rows only where they are read
    scores = arrays.select(*keys, "cell", F.posexplode("t").alias("perm", "t"))
    by = [*keys, "perm"]
    on = scores.where(F.col("t") > threshold)
    found = connected_cells(on, on.join(adjacency.select(F.col(voxel).alias("cell"), "to"), "cell"), by)
    sizes = found.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("size"))
    top_t = scores.groupBy(*by).agg(F.max("t").alias("top_t"))
    top = top_t.join(sizes.groupBy(*by).agg(F.max("size").alias("top_size")), by, "left").fillna(0, ["top_size"])
    tops = top.groupBy(*keys).agg(F.collect_list("top_t").alias("_tt"), F.collect_list("top_size").alias("_ts"), F.count(F.lit(1)).alias("_n"))  # a number for each perm
    seen = arrays.withColumn("t", F.col("t")[0]).join(found.where("perm = 0").select(*keys, "cell", "label"), [*keys, "cell"], "left").join(sizes.where("perm = 0").drop("perm"), [*keys, "label"], "left")
    seen = seen.join(tops, list(keys)) if keys else seen.crossJoin(F.broadcast(tops))  # without keys one row
    share = lambda tops, own: F.size(F.filter(tops, lambda x: x >= F.col(own))) / F.col("_n")
    return seen.select(*keys, F.col("cell").alias(voxel), "t", "label", "size", F.when(F.col("t").isNotNull(), share("_tt", "t")).alias("p"), F.when(F.col("size").isNotNull(), share("_ts", "size")).alias("p_size"))


def false_discovery(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p and Bonferroni's, within each family; a family's rows are one window."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    n = F.count(p).over(w)
    rows = df.withColumn("_r", F.col(p) * n / F.row_number().over(w.orderBy(p, *tie)))
    back = w.orderBy(F.desc(p), *[F.desc(c) for c in tie]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"p_fdr": F.least(F.min("_r").over(back), F.lit(1.0)), "p_bonferroni": F.least(F.col(p) * n, F.lit(1.0))}).drop("_r")


def corrected_t(df: DataFrame, keys: Sequence[str], difference: str, test_over_train: float) -> DataFrame:
    """Resampled t with the variance corrected for overlapping training sets."""
    g = df.groupBy(*keys).agg(F.avg(difference).alias("m"), F.var_samp(difference).alias("v"), F.count(difference).alias("n"))
    return g.select(*keys, F.try_divide(F.col("m"), F.sqrt(F.col("v") * (1 / F.col("n") + test_over_train))).alias("t"), (F.col("n") - 1).alias("df"))


def without_regressor(df: DataFrame, keys: Sequence[str], value: str, regressor: Column) -> DataFrame:
    """value less its projection on a regressor (least squares without intercept) within each group."""
    w = Window.partitionBy(*keys)
    b = F.try_divide(F.sum(F.col(value) * regressor).over(w), F.sum(regressor * regressor).over(w))
    return df.withColumn("residual", F.col(value) - F.coalesce(b, F.lit(0.0)) * regressor)


def kendall_tau(df: DataFrame, keys: Sequence[str], item: str, x: str, y: str) -> DataFrame:
    """tau-b per group, from all pairs of the few items of a group."""
    a = df.select(*keys, F.col(item).alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = df.select(*keys, F.col(item).alias("j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    sx, sy = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2"))
    g = a.join(b, list(keys)).where("i < j").groupBy(*keys).agg(F.sum(sx * sy).alias("s"), F.sum(sx * sx).alias("nx"), F.sum(sy * sy).alias("ny"))
    return g.select(*keys, F.try_divide(F.col("s"), F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def partial_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Pearson, partial and semi-partial correlation of x and y, z taken out."""
    g = df.groupBy(*keys).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    top = F.col("xy") - F.col("xz") * F.col("yz")
    return g.select(*keys, F.col("xy").alias("pearson"), F.try_divide(top, F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("partial"), F.try_divide(top, F.sqrt(1 - F.col("yz") ** 2)).alias("semi_partial"))


def sums_by_size(df: DataFrame, keys: Sequence[str], subject: str, value: str, predictors: Sequence[str]) -> DataFrame:
    """For each group and number of rows n of a subject: how many such subjects, and what a random intercept model needs of them.

    a|b, y|a and yy sum the products of rows; s|a|b, sy|a and syy sum the products of the subjects' own sums. "one" is the intercept.
    """
    names = ["one", *predictors]
    products = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = df.withColumn("one", F.lit(1.0)).where(F.col(value).isNotNull())
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in products]
    stats = rows.groupBy(*keys, subject).agg(F.sum(F.col(value) * F.col(value)).alias("yy"), *[F.sum(F.col(a) * F.col(value)).alias(f"y|{a}") for a in names], *sums)
    total, own = lambda c: F.sum(F.col(c)).alias(c), lambda a: F.col(f"one|{a}")
    return stats.withColumn("n", own("one")).groupBy(*keys, "n").agg(
        F.count(F.lit(1)).alias("subjects"), total("yy"), F.sum(F.col("y|one") * F.col("y|one")).alias("syy"),
        *[total(f"y|{a}") for a in names], *[F.sum(F.col("y|one") * own(a)).alias(f"sy|{a}") for a in names],
        *[total(f"{a}|{b}") for a, b in products], *[F.sum(own(a) * own(b)).alias(f"s|{a}|{b}") for a, b in products],
    )


def _profile(names: Sequence[str], pdf: pd.DataFrame) -> tuple:
    """The likelihood of a random intercept model with these predictors at a variance ratio, from sums by size; the number of rows."""
    k = len(names)
    xx, ss = np.zeros((len(pdf), k, k)), np.zeros((len(pdf), k, k))
    known = set(pdf.columns)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            pair = f"{a}|{b}" if f"{a}|{b}" in known else f"{b}|{a}"
            xx[:, i, j], ss[:, i, j] = pdf[pair], pdf[f"s|{pair}"]
    xy, sy = (pdf[[f"{p}|{a}" for a in names]].to_numpy(float) for p in ("y", "sy"))
    yy, syy, n, subjects = (pdf[c].to_numpy(float) for c in ("yy", "syy", "n", "subjects"))
    total = (n * subjects).sum()

    def fit(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        c = ratio / (1 + n * ratio)
        a = (xx - c[:, None, None] * ss).sum(axis=0)
        b = (xy - c[:, None] * sy).sum(axis=0)
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        rss = max(float((yy - c * syy).sum() - beta @ b), 1e-12)
        return -0.5 * (total * np.log(2 * np.pi * rss / total) + (subjects * np.log1p(n * ratio)).sum() + total), beta, inverse, rss / total

    return fit, total, subjects.sum()


def _best_fit(names: Sequence[str], pdf: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray, float, float, float, float]:
    """logLik, coefficients, their covariance, error variance, variance ratio, rows and subjects at the greatest likelihood."""
    fit, total, subjects = _profile(names, pdf)
    grid = [0.0, *np.exp(np.linspace(-9, 5, 57))]
    best = max(range(len(grid)), key=lambda i: fit(grid[i])[0])
    lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    for _ in range(60):
        p, q = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, q) if fit(p)[0] >= fit(q)[0] else (p, hi)
    ratio = max((lo, hi, grid[best]), key=lambda r: fit(r)[0])
    ll, beta, inverse, sigma2 = fit(ratio)
    return ll, beta, inverse * sigma2, sigma2, ratio, total, subjects


def _solved(df: DataFrame, keys: Sequence[str], subject: str, value: str, predictors: Sequence[str], solve, schema: str) -> DataFrame:
    """What solve gives of a group's sums by size."""
    kinds = dict(df.dtypes)
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return solve(pdf).assign(**{k: pdf[k].iloc[0] for k in keys})[names]

    by = list(keys) or [F.lit(0).alias("_all")]
    return sums_by_size(df, keys, subject, value, predictors).groupBy(*by).applyInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], schema]))


def random_intercept_models(df: DataFrame, keys: Sequence[str], subject: str, value: str, predictors: Sequence[str]) -> DataFrame:
    """A linear model with a random intercept per subject, for each group: coefficients, standard errors, logLik, AIC, BIC.

    The likelihood depends on a subject by sums alone, weighted by a factor of its number of rows and the variance ratio. So
    subjects of equally many rows are summed up in Spark and the solver sees a row for each such number: of N rows of a group
    at most sqrt(2 N), however many subjects there are. It searches the ratio on a grid and then around its best point.
    z and p are those of each coefficient against 0 by the normal law. Crossed effects and random slopes aren't built.
    """
    one = compared_models(df, keys, subject, value, {"model": list(predictors)})
    return one.select(*keys, "coefficient", "estimate", "se", "z", "p", "log_lik", "aic", "bic", "subject_variance", "subjects")


def compared_models(df: DataFrame, keys: Sequence[str], subject: str, value: str, models: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several random intercept models of each group, a row for each coefficient, from one pass over the rows.

    models gives each one's predictors; sums are those of all predictors of any model, so a model is a choice of their rows
    and columns. best_aic and best_bic mark the model of the least value of a group.
    """
    predictors = list(dict.fromkeys(p for chosen in models.values() for p in chosen))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for model, chosen in models.items():
            names = ["one", *chosen]
            ll, beta, cov, sigma2, ratio, total, subjects = _best_fit(names, pdf)
            se = np.sqrt(np.maximum(np.diag(cov), 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                z = np.where(se > 0, beta / se, np.nan)
            k = len(names) + 2
            parts.append(pd.DataFrame({
                "model": model, "coefficient": names, "estimate": beta, "se": se, "z": z, "p": [erfc(abs(v) / sqrt(2)) if v == v else None for v in z],
                "log_lik": ll, "parameters": k, "aic": 2 * k - 2 * ll, "bic": np.log(total) * k - 2 * ll, "subject_variance": ratio * sigma2, "subjects": int(subjects),
            }))
        out = pd.concat(parts)
        return out.assign(best_aic=out["aic"] <= out["aic"].min(), best_bic=out["bic"] <= out["bic"].min())

    schema = "model string, coefficient string, estimate double, se double, z double, p double, log_lik double, parameters int, aic double, bic double, subject_variance double, subjects long, best_aic boolean, best_bic boolean"
    return _solved(df, keys, subject, value, predictors, solve, schema)


def likelihood_ratios(models: DataFrame, keys: Sequence[str], nested: Sequence[tuple[str, str]]) -> DataFrame:
    """(keys, small, large, chi2, df, p) of pairs of nested models, from compared_models; p by the chi-square law."""
    one = models.select(*keys, "model", "log_lik", "parameters").distinct()
    side = lambda name, n: one.select(*keys, F.col("model").alias(name), F.col("log_lik").alias(f"ll{n}"), F.col("parameters").alias(f"k{n}"))
    a, b = side("small", 1), side("large", 2)
    asked = F.array(*[F.struct(F.lit(x).alias("small"), F.lit(y).alias("large")) for x, y in nested])
    both = a.join(b, list(keys)) if keys else a.crossJoin(b)  # a row for each model
    both = both.where(F.array_contains(asked, F.struct("small", "large"))).withColumns({"chi2": F.greatest(2 * (F.col("ll2") - F.col("ll1")), F.lit(0.0)), "df": F.col("k2") - F.col("k1")})
    return both.select(*keys, "small", "large", "chi2", "df", chi2_p_value("chi2", "df").alias("p"))


def model_contrasts(df: DataFrame, keys: Sequence[str], subject: str, value: str, predictors: Sequence[str], cells: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(keys, first, second, mean_first, mean_second, difference, se, z, p, p_bonferroni): estimated means of cells after the model, in pairs.

    cells gives the predictors' values of each cell, 0 where one is left out. Standard errors come from the fit's covariance.
    """
    names = ["one", *predictors]
    rows = {c: np.array([1.0, *(float(v.get(p, 0.0)) for p in predictors)]) for c, v in cells.items()}
    pairs = [(a, b) for i, a in enumerate(rows) for b in list(rows)[i + 1 :]]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        _, beta, cov, *_ = _best_fit(names, pdf)
        out = []
        for a, b in pairs:
            gap = rows[a] - rows[b]
            d, se = float(gap @ beta), float(np.sqrt(max(gap @ cov @ gap, 0.0)))
            z = d / se if se > 0 else None
            p = erfc(abs(z) / sqrt(2)) if z is not None else None
            out.append((a, b, float(rows[a] @ beta), float(rows[b] @ beta), d, se, z, p, min(1.0, p * len(pairs)) if p is not None else None))
        return pd.DataFrame(out, columns=["first", "second", "mean_first", "mean_second", "difference", "se", "z", "p", "p_bonferroni"])

    return _solved(df, keys, subject, value, predictors, solve, "first string, second string, mean_first double, mean_second double, difference double, se double, z double, p double, p_bonferroni double")


def sustained_significant(points: DataFrame, keys: Sequence[str], t: str, side: Column, alpha: float, least: int) -> DataFrame:
    """(keys, onset, onset_fdr): the first of at least so many points in a row with p below alpha on the asked side, and with p_fdr below.

    points has p and p_fdr, as false_discovery gives them. Keys without such points at p are left out.
    """
    first = lambda p, name: sustained(points, keys, (F.col(p) < alpha) & side, least, t).select(*keys, F.col("onset").alias(name))
    return first("p", "onset").join(first("p_fdr", "onset_fdr"), list(keys), "left")


def bayes_map(values: DataFrame, keys: Sequence[str], value: str, subjects: int, evidence: float) -> DataFrame:
    """(keys, n, bf01, over): BF01 of each voxel's values against 0, null where a subject is missing; over keeps those above the evidence."""
    t = one_sample_t(values, keys, F.col(value)).withColumn("t", F.when(F.col("n") == subjects, F.col("t")))
    t = t.withColumn("bf01", F.try_divide(F.lit(1.0), bayes_factor_t("t", "n", "df")))
    return t.select(*keys, "n", "bf01", F.when(F.col("bf01") > evidence, F.col("bf01")).alias("over"))


def empirical_null_test(hits: DataFrame, nulls: DataFrame, keys: Sequence[str], k: str, n: str, accuracy: str) -> DataFrame:
    """hits with bf10 and p against the accuracies of a null, of which there is a row each: see distributions.empirical_null_bf.

    p is the share of null accuracies that reach k / n. Keys without null accuracies have nulls for both.
    """
    draws = nulls.where(F.col(accuracy).isNotNull()).select(*keys, F.col(accuracy).alias("_a"))
    both = hits.join(draws, list(keys), "left").groupBy(*hits.columns)
    sums = both.agg(F.count("_a").alias("_d"), (F.sum(F.col("_a") * F.col(n)) + 1e-9).alias("_h"), F.avg((F.col("_a") >= F.col(k) / F.col(n) - 1e-9).cast("int")).alias("p"))
    return sums.select(*hits.columns, empirical_null_bf(k, n, "_h", "_d").alias("bf10"), "p")


def _inversions(x: np.ndarray) -> int:
    """Pairs in which the earlier value is greater, by merging sorted runs of doubling length."""
    total, width, x = 0, 1, x.copy()
    while width < len(x):
        for at in range(0, len(x) - width, 2 * width):
            left, right = x[at : at + width], x[at + width : at + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            x[at : at + 2 * width] = np.sort(x[at : at + 2 * width], kind="stable")
        width *= 2
    return total


def kendall_by_runs(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, tau): tau-b of each group without a join of its pairs, n log n for a group of n.

    Discordant pairs are the inversions of y in order of x and y; ties are counted from runs of equal values. Rows with a
    null x or y take no part. A group meets in one task, as its rows are ordered; tau is null where x or y doesn't vary.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["x_"].to_numpy(float), pdf["y_"].to_numpy(float)
        n = len(a)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        pairs = lambda sizes: int((sizes * (sizes - 1) // 2).sum())
        ties_a, ties_b = (pairs(np.unique(v, return_counts=True)[1]) for v in (a, b))
        both = pairs(np.unique(np.stack([a, b]), axis=1, return_counts=True)[1])
        whole, down = n * (n - 1) // 2, _inversions(b)
        up = whole - ties_a - ties_b + both - down
        left = (whole - ties_a) * (whole - ties_b)
        out = pd.DataFrame({"n": [n], "tau": [(up - down) / sqrt(left) if left else None]})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "n", "tau"]]

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_"))
    by = list(keys) or [F.lit(0).alias("_all")]
    return rows.groupBy(*by).applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, tau double"]))
