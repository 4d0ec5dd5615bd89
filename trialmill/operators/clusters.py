"""Permutation tests on arrays: sums over all perms of a group stay one row, clusters are found for all perms at once.

A group (a time point, a cell of a grid) is one row with an array of one number for each perm, the observed data first.
Rows of a test, its points or cells, meet in one task: cells x perms numbers, whatever the number of subjects or trials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_cdf

#: Rows whose products with all perms are formed together.
_STEP = 1000


def t_quantile(p: float, df: float) -> float:
    """The t below which a t variable of df degrees of freedom lies with probability p."""
    lo, hi = -1.0, 1.0
    while t_cdf(np.array([lo]), np.array([df]))[0] > p:
        lo *= 2
    while t_cdf(np.array([hi]), np.array([df]))[0] < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(np.array([mid]), np.array([df]))[0] < p else (lo, mid)
    return (lo + hi) / 2


def signs(count: int, seed: str = "") -> Callable[[str | None], np.ndarray]:
    """For a subject's name its signs over perms: 1 for perm 0, then by the parity of the first digit of md5(seed:perm:name)."""

    def of(name: str | None) -> np.ndarray:
        tail = "" if name is None else f":{name}"
        odd = [hashlib.md5(f"{seed}:{perm}{tail}".encode()).digest()[0] >> 4 & 1 for perm in range(1, count + 1)]
        return np.array([1, *(1 - 2 * np.array(odd, np.int8))], np.int8)

    return of


def swaps(groups: dict[str, bool], count: int) -> Callable[[str | None], np.ndarray]:
    """For a subject's name 1 where it is in the first group, over perms: perm 0 as given, then as many by least md5(perm:name).

    groups has every subject; whole subjects change sides, and the sizes of both groups stay.
    """
    n, names = sum(groups.values()), sorted(groups)
    first = [set(sorted(names, key=lambda s: (hashlib.md5(f"{perm}:{s}".encode()).hexdigest(), s))[:n]) for perm in range(1, count + 1)]

    def of(name: str | None) -> np.ndarray:
        return np.array([groups[name], *(name in x for x in first)], np.int8)

    return of


def _summing(keys: Sequence[str], weights: Callable[[str | None], np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows (keys, _s, _x) in order of their keys to batches of sums (keys, n, q, s, edge_), see permuted_sums."""
    names = [*keys, "n", "q", "s", "edge_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, np.ndarray] = {}

        def of(name: str | None) -> np.ndarray:
            if name not in known:
                if len(known) >= 10_000:
                    known.clear()
                known[name] = weights(name)
            return known[name]

        kept, first = None, True  # the group that may go on in the next rows; whether no group has been sent yet

        def out(parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]], edge: np.ndarray) -> pa.RecordBatch:
            table = pa.Table.from_batches([p[0] for p in parts]).combine_chunks() if keys else None
            n, q, s = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * width, s.ravel())
            heads = [table.column(k).combine_chunks() for k in keys] if keys else []
            return pa.RecordBatch.from_arrays([*heads, pa.array(n), pa.array(q), lists, pa.array(edge)], names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                rows = whole.slice(at, _STEP)
                new = np.zeros(rows.num_rows, bool)
                new[0] = True
                for k in keys:
                    code = rows.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    new[1:] |= code[1:] != code[:-1]
                start = np.flatnonzero(new)
                there = rows.column("_x").is_valid().to_numpy(zero_copy_only=False)
                x = np.where(there, rows.column("_x").to_numpy(zero_copy_only=False), 0.0)
                s = np.add.reduceat(x[:, None] * np.stack([of(v) for v in rows.column("_s").to_pylist()]), start, axis=0)
                n, q = np.add.reduceat(there.astype(np.int64), start), np.add.reduceat(x * x, start)
                heads = rows.select(keys).take(pa.array(start)) if keys else rows.select([])
                if kept is not None:
                    if not keys or kept[0].to_pylist()[0] == heads.slice(0, 1).to_pylist()[0]:
                        n[0], q[0], s[0] = n[0] + kept[1][0], q[0] + kept[2][0], s[0] + kept[3][0]
                    else:
                        yield out([kept], np.array([first]))
                        first = False
                if len(n) > 1:
                    edge = np.zeros(len(n) - 1, bool)
                    edge[0], first = first, False
                    yield out([(heads.slice(0, len(n) - 1), n[:-1], q[:-1], s[:-1])], edge)
                kept = (heads.slice(len(n) - 1), n[-1:], q[-1:], s[-1:])
        if kept is not None:
            yield out([kept], np.array([True]))

    return run


def permuted_sums(df: DataFrame, keys: Sequence[str], subject: str, value: str, weights: Callable[[str | None], np.ndarray], width: int) -> DataFrame:
    """(keys, n, q, s): of each group the number of values, their sum of squares, and an array of their sums weighted by subject.

    weights gives a subject's (as string) array of that width. No row is repeated for its perms: rows lie by range of
    (keys, subject), so that a group of any size is spread over tasks, and a task sums the rows of a group by products. Only
    groups that may go on in another task are merged afterwards. Null values take no part; a group with no other has n = 0.
    """
    keys = list(keys)
    run = _summing(keys, weights, width)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1].copy()
        one["n"], one["q"], one["s"] = pdf["n"].sum(), pdf["q"].sum(), [np.sum(pdf["s"].to_list(), axis=0)]
        return one

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, q double, s array<double>, edge_ boolean"])
    rows = df.select(*keys, F.col(subject).cast("string").alias("_s"), F.col(value).cast("double").alias("_x"))
    rows = rows.repartitionByRange(*keys, "_s").sortWithinPartitions(*keys, "_s")
    parts = rows.mapInArrow(run, schema)
    edges = parts.where("edge_").groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(merge, schema)  # a row or two a task
    return parts.where("not edge_").unionByName(edges).drop("edge_")


def _t(n: np.ndarray, q: np.ndarray, s: np.ndarray, first: int | None, total: np.ndarray | None, missing: float) -> np.ndarray:
    """t of sums over perms, of one sample or, with the first group's size and all values' sum, of two."""
    n, q = n[:, None], q[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        if first is None:
            left = q - s * s / n
            fine = (n > 1) & ~(left <= 1e-12 * q)
            t = (s / n) / np.sqrt(left / (n - 1) / n)
        else:
            rest, total = n - first, total[:, None]
            left = q - s * s / first - (total - s) ** 2 / rest
            fine = (rest > 0) & (n > 2) & ~(left <= 1e-12 * q)
            t = (s / first - (total - s) / rest) / np.sqrt(left / (n - 2) * (1 / first + 1 / rest))
    return np.where(fine, t, missing)


def t_arrays(sums: DataFrame, keys: Sequence[str], first: int | None = None, missing: float = 0.0) -> DataFrame:
    """(keys, n, stat): the t of each perm from permuted_sums; `missing` where values have no spread.

    Sums of signed values give one-sample t. With first, the number of values that the first group has, sums are those of
    the first group and t is that of two samples of equal variance; groups of another number of values are left out.
    """
    kinds = dict(sums.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, stat array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            total = None if first is None else pdf["total"].to_numpy(float)
            t = _t(pdf["n"].to_numpy(float), pdf["q"].to_numpy(float), np.stack(pdf["s"].to_list()), first, total, missing)
            out = pdf[[*keys, "n"]].copy()
            out["stat"] = list(t)
            yield out

    return sums.mapInPandas(run, schema)


def array_p(rows: DataFrame, keys: Sequence[str], values: str, tail: int = 0) -> DataFrame:
    """(keys, observed, p): the first number of each array, and the share of numbers that reach it, itself included.

    tail 1 is upper, -1 lower, 0 both (absolute values). NaN takes no part; an observed one gives null for both.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "observed double, p double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf[values].to_list())
                x = np.abs(v) if tail == 0 else v * tail
                there = ~np.isnan(x)
                p = ((x >= x[:, :1] - 1e-9) & there).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
                yield pdf[list(keys)].assign(observed=v[:, 0], p=np.where(there[:, 0], p, np.nan))

    out = rows.select(*keys, values).mapInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("observed", "p")})


def met_flip_p(df: DataFrame, keys: Sequence[str], subject: str, value: str, count: int) -> DataFrame:
    """(keys, observed, p): array_p of the one-sample t under sign flips, of groups whose rows meet in one task; arrays over perms never leave it."""
    keys, kinds, width = list(keys), dict(df.dtypes), count + 1
    summing = _summing(keys, signs(count), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in summing(batches):
            n, q = (batch.column(c).to_numpy().astype(float) for c in ("n", "q"))
            t = _t(n, q, batch.column("s").flatten().to_numpy().reshape(-1, width), None, None, np.nan)
            p = (np.abs(t) >= np.abs(t[:, :1]) - 1e-9).sum(axis=1) / np.maximum((~np.isnan(t)).sum(axis=1), 1)
            none = np.isnan(t[:, 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(t[:, 0], mask=none), pa.array(p, mask=none)], names=[*keys, "observed", "p"])

    rows = df.select(*keys, F.col(subject).cast("string").alias("_s"), F.col(value).cast("double").alias("_x"))
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "observed double, p double"])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_s").mapInArrow(run, schema)


def _labels_1d(on: np.ndarray) -> np.ndarray:
    """For each row the number of the stretch that a point lies in, 0 outside."""
    fresh = on.copy()
    fresh[:, 1:] &= ~on[:, :-1]
    return np.where(on, np.cumsum(fresh, axis=1), 0)


def _labels_2d(on: np.ndarray) -> np.ndarray:
    """For each sheet (perm, x, y) the number of the set that a cell lies in, four neighbours each; 0 outside."""
    p, h, w = on.shape
    size = h * w
    own = np.where(on.reshape(p, size), np.arange(size), size)
    flat = np.concatenate([own, np.full((p, 1), size)], axis=1)  # a cell outside points to itself at the end
    base = (np.arange(p) * (size + 1))[:, None]
    while True:
        sheet = flat[:, :size].reshape(p, h, w)
        least = sheet.copy()
        least[:, 1:] = np.minimum(least[:, 1:], sheet[:, :-1])
        least[:, :-1] = np.minimum(least[:, :-1], sheet[:, 1:])
        least[:, :, 1:] = np.minimum(least[:, :, 1:], sheet[:, :, :-1])
        least[:, :, :-1] = np.minimum(least[:, :, :-1], sheet[:, :, 1:])
        new = flat.copy()
        new[:, :size] = np.where(on, least, size).reshape(p, size)
        # the root takes the least label that any of its cells has seen, then cells take their root's
        np.minimum.at(new.reshape(-1), (base + flat).reshape(-1), new.reshape(-1))
        new[:, size] = size
        new = np.take(new.reshape(-1), base + new).reshape(p, size + 1)
        new[:, size] = size
        if (new == flat).all():
            return np.where(on, flat[:, :size].reshape(p, h, w) + 1, 0)
        flat = new


def _masses(values: np.ndarray, on: np.ndarray, chunk: int = 64) -> np.ndarray:
    """The greatest sum over a cluster, of each perm, 0 without clusters; values and on have perms first."""
    top = np.zeros(len(values))
    for at in range(0, len(values), chunk):
        v, o = values[at : at + chunk], on[at : at + chunk]
        label = (_labels_1d if v.ndim == 2 else _labels_2d)(o)
        p, most = len(v), int(label.max(initial=0)) + 1
        code = label.reshape(p, -1) + (np.arange(p) * most)[:, None]
        sums = np.bincount(code.reshape(-1), (v * o).reshape(-1), p * most).reshape(p, most)
        top[at : at + chunk] = sums[:, 1:].max(axis=1, initial=0.0)
    return top


def find_clusters(values: np.ndarray, threshold: float, tail: int = 1, step_down: float | None = None, there: np.ndarray | None = None) -> list[tuple[np.ndarray, float, float]]:
    """(mask, mass, p) of each observed cluster; values have perms first, the observed data as the first of them.

    tail 1 takes values above the threshold, -1 those below its negative, 0 both, clusters of one sign each. p is the share
    of perms, the observed one included, whose greatest mass (absolute for tail 0) reaches the cluster's. step_down: cells
    of clusters below that p are taken out of the perms and all are tested again, until no more fall below it. there masks
    cells that exist; missing ones end a cluster on a grid.
    """
    values = np.nan_to_num(values, nan=0.0)
    there = np.ones(values.shape[1:], bool) if there is None else there
    sides = {1: [1], -1: [-1], 0: [1, -1]}[tail]
    seen = []
    for side in sides:
        on = (values[:1] * side > threshold) & there
        label = (_labels_1d if values.ndim == 2 else _labels_2d)(on)[0]
        seen += [(label == k, float(values[0][label == k].sum())) for k in np.unique(label[label > 0])]
    if not seen:
        return []
    mass = np.array([abs(m) for _, m in seen])
    include, gone = there, 0
    while True:
        top = np.max([_masses(values * side, (values * side > threshold) & include) for side in sides], axis=0)
        top[0] = mass.max()
        p = np.array([(top >= m - 1e-9).mean() for m in mass])
        out = p < step_down if step_down is not None else np.zeros(len(p), bool)
        if out.sum() <= gone:
            return [(m, s, float(q)) for (m, s), q in zip(seen, p)]
        gone, include = int(out.sum()), there & ~np.any([m for (m, _), o in zip(seen, out) if o], axis=0)


def _tester(keys: Sequence[str], axes: Sequence[str], values: str, threshold: float, tail: int, step_down: float | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What makes rows of clusters of the rows of one test, see array_cluster_test."""
    grid = len(axes) == 2
    columns = [*keys, *(["cluster"] if grid else ["lo", "hi"]), "cells", "mass", "p"]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(axes))
        v = np.stack(pdf[values].to_list(), axis=1)
        head, out = [pdf[k].iloc[0] for k in keys], []
        if grid:
            x, y = (pdf[a].to_numpy(np.int64) for a in axes)
            shape = (int(np.ptp(x)) + 1, int(np.ptp(y)) + 1)
            sheet, there = np.zeros((len(v), *shape)), np.zeros(shape, bool)
            sheet[:, x - x.min(), y - y.min()], there[x - x.min(), y - y.min()] = v, True
            for mask, mass, p in find_clusters(sheet, threshold, tail, step_down, there):
                i, j = (a[0] for a in np.nonzero(mask))
                out.append((*head, [int(i + x.min()), int(j + y.min())], int(mask.sum()), mass, p))
        else:
            points = pdf[axes[0]].to_numpy()
            for mask, mass, p in find_clusters(v, threshold, tail, step_down):
                out.append((*head, points[mask][0], points[mask][-1], int(mask.sum()), mass, p))
        return pd.DataFrame(out, columns=columns)

    return test


def array_cluster_test(rows: DataFrame, keys: Sequence[str], axes: Sequence[str], values: str, threshold: float, tail: int = 1, step_down: float | None = None) -> DataFrame:
    """Clusters of each test along one axis (keys, lo, hi, cells, mass, p), or on two (keys, cluster, cells, mass, p).

    rows has a row for each point or cell of a test, with an array of values over perms (the observed one first). Along one
    axis, neighbours follow each other in its order. On two axes (whole numbers), neighbours differ by one in one of them, and
    cluster is the least (x, y) of its cells, in that order, as an array. See find_clusters for tails and step-down.
    """
    kinds = dict(rows.dtypes)
    grid = len(axes) == 2
    at = "cluster array<long>" if grid else f"lo {kinds[axes[0]]}, hi {kinds[axes[0]]}"
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"{at}, cells long, mass double, p double"])
    test = _tester(keys, axes, values, threshold, tail, step_down)
    by = list(keys) or [F.lit(0).alias("_all")]
    return rows.select(*keys, *axes, values).groupBy(*by).applyInPandas(test, schema)


def _met_clusters(rows: DataFrame, keys: Sequence[str], axes: Sequence[str], subject: str, value: str, weights: Callable[[str | None], np.ndarray], width: int, threshold: float, tail: int, step_down: float | None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Cluster tests whose rows meet in one task, in order: sums, t and clusters are formed there, arrays over perms never leave it.

    Rows are summed as they come; a task holds the arrays of one test's points. With sizes, those of the first group and of
    both, t is that of two samples, and points of another number of values are left out.
    """
    keys, axes, kinds = list(keys), list(axes), dict(rows.dtypes)
    by, grid = [*keys, *axes], len(axes) == 2
    two = sizes is not None
    own = (lambda name: np.append(weights(name), 1)) if two else weights  # two samples: the last sum is that of all values
    summing, test = _summing(by, own, width + two), _tester(keys, axes, "stat", threshold, tail, step_down)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, kind = None, [], None

        def send() -> Iterator[pa.RecordBatch]:
            found = test(pd.concat(held, ignore_index=True))
            if len(found):
                yield pa.RecordBatch.from_pandas(found, schema=kind, preserve_index=False)

        for batch in summing(batches):
            if kind is None:
                own_kinds = [(k, batch.schema.field(k).type) for k in keys]
                ends = [("cluster", pa.list_(pa.int64()))] if grid else [(c, batch.schema.field(axes[0]).type) for c in ("lo", "hi")]
                kind = pa.schema([*own_kinds, *ends, ("cells", pa.int64()), ("mass", pa.float64()), ("p", pa.float64())])
            n, q = (batch.column(c).to_numpy().astype(float) for c in ("n", "q"))
            s = batch.column("s").flatten().to_numpy().reshape(len(n), -1)
            t = _t(n, q, s[:, :width], sizes[0] if two else None, s[:, -1] if two else None, 0.0)
            points = batch.select(by).to_pandas().assign(stat=list(t))
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * len(n)
            kept = n == sizes[1] if two else np.ones(len(n), bool)
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for at, end in zip(starts, starts[1:]):
                if held and names[at] != name:
                    yield from send()
                    held.clear()
                name = names[at]
                part = points.iloc[at:end][kept[at:end]]
                if len(part):
                    held.append(part)
        if held:
            yield from send()

    at = "cluster array<long>" if grid else f"lo {kinds[axes[0]]}, hi {kinds[axes[0]]}"
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"{at}, cells long, mass double, p double"])
    rows = rows.select(*by, F.col(subject).cast("string").alias("_s"), F.col(value).cast("double").alias("_x"))
    return rows.repartition(*keys).sortWithinPartitions(*by, "_s").mapInArrow(run, schema)


def one_sample_clusters(df: DataFrame, keys: Sequence[str], axes: Sequence[str], subject: str, value: str, count: int, threshold: float | None = None, subjects: int | None = None, alpha: float = 0.05, tail: int = 0, step_down: float | None = None, spread: bool = False) -> DataFrame:
    """Cluster test of subjects' values against 0 by sign flips, along one or two axes.

    A test's rows meet in one task. spread (and a test without keys) sums them in many tasks first, for few tests of very many
    subjects; then arrays over perms are shuffled.
    The threshold is given, or is the t that alpha leaves outside (on both sides for tail 0) at subjects - 1 degrees of freedom.
    """
    if threshold is None:
        threshold = t_quantile(1 - alpha / (2 if tail == 0 else 1), subjects - 1)
    if keys and not spread:
        return _met_clusters(df, keys, axes, subject, value, signs(count), count + 1, threshold, tail, step_down)
    sums = permuted_sums(df, [*keys, *axes], subject, value, signs(count), count + 1)
    return array_cluster_test(t_arrays(sums, [*keys, *axes]), keys, axes, "stat", threshold, tail, step_down)


def two_sample_clusters(df: DataFrame, keys: Sequence[str], axes: Sequence[str], subject: str, group: str, value: str, count: int, first: str, threshold: float | None = None, alpha: float = 0.05, tail: int = 0, step_down: float | None = None, most: int = 10_000, spread: bool = False) -> DataFrame:
    """Cluster test of two groups of subjects by swaps of whole subjects, along one or two axes; see one_sample_clusters.

    df has one row (keys, axes, subject, group, value) for each subject and point; t is that of equal variances. Subjects
    and their groups come to the driver, at most `most` (more are an error). Points that lack a subject are left out; rows
    without a subject, a group or a value take no part.
    """
    rows = df.where(F.col(subject).isNotNull() & F.col(group).isNotNull() & F.col(value).isNotNull())
    found = rows.select(F.col(subject).cast("string").alias("s"), (F.col(group) == first).alias("g")).distinct().limit(2 * most + 1).collect()
    groups = {r.s: r.g for r in found}
    if len(groups) != len(found):
        raise ValueError("a subject is in both groups")
    if len(groups) > most:
        raise ValueError(f"more than {most} subjects")
    one, total = sum(groups.values()), len(groups)
    if threshold is None:
        threshold = t_quantile(1 - alpha / (2 if tail == 0 else 1), max(total - 2, 1))
    by = [*keys, *axes]
    if keys and not spread:
        return _met_clusters(rows, keys, axes, subject, value, swaps(groups, count), count + 1, threshold, tail, step_down, (one, total))
    sums = permuted_sums(rows, by, subject, value, swaps(groups, count), count + 1).where(F.col("n") == total)
    sums = sums.join(rows.groupBy(*by).agg(F.sum(value).alias("total")), by) if by else sums
    return array_cluster_test(t_arrays(sums, by, first=one), keys, axes, "stat", threshold, tail, step_down)
