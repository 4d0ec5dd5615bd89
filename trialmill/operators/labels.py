"""Shuffled labels as arrays over perms: an item stays one row, and sums by label are products with its labels' indicators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import shuffled_labels

#: Items of a group that are shuffled in one task; larger groups are shuffled by Spark's windows, with the same result.
GROUP = 1 << 14
#: Rows whose labels are compared together, and places (items x perms) of a group that are formed together.
_STEP, _PLACES = 256, 1 << 20


@lru_cache(1 << 12)
def _digests(name: str, first: int, last: int) -> np.ndarray:
    """The leading 64 bits of md5(perm:name) of some perms; ids recur in many groups."""
    return np.frombuffer(b"".join(hashlib.md5(f"{perm}:{name}".encode()).digest()[:8] for perm in range(first, last)), ">u8").astype(np.uint64)


def _places(names: list[str], first: int, last: int) -> np.ndarray:
    """For each of some perms (columns) the order of names by md5(perm:name)."""
    lead = np.stack([_digests(n, first, last) for n in names])
    order = np.argsort(lead, axis=0, kind="stable")
    found = np.take_along_axis(lead, order, axis=0)
    for k in np.flatnonzero((found[1:] == found[:-1]).any(axis=0)).tolist():  # equal leads are told apart by all digits
        order[:, k] = sorted(range(len(names)), key=lambda i: hashlib.md5(f"{first + k}:{names[i]}".encode()).digest())
    return order


@lru_cache(64)
def _kept_places(names: tuple[str, ...], count: int) -> np.ndarray:
    """_places of all perms, as groups of the same few ids come again and again."""
    return _places(list(names), 1, count + 1).astype(np.int32)


def _sums_of(names: list[str], code: np.ndarray, x: np.ndarray, kinds: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels x perms) numbers, sums and sums of squares of a group's values under shuffled labels, given as codes; its ids are in order."""
    n, s, q = (np.zeros((kinds, count + 1)) for _ in range(3))
    there = ~np.isnan(x)
    step = max(1, _PLACES // len(names))
    for at in range(0, count + 1, step):
        perms = slice(at, min(at + step, count + 1))
        first = max(at, 1)
        if len(names) * count <= _PLACES // 8:
            places = _kept_places(tuple(names), count)[:, first - 1 : perms.stop - 1]
        else:
            places = _places(names, first, perms.stop) if perms.stop > first else np.zeros((len(names), 0), int)
        own = code[places] if at else np.concatenate([code[:, None], code[places]], axis=1)
        own, v = own[there], x[there]
        for c in range(kinds):
            on = (own == c).astype(float)
            n[c, perms], s[c, perms], q[c, perms] = on.sum(axis=0), v @ on, (v * v) @ on
    return n, s, q


def with_label_arrays(df: DataFrame, within: Sequence[str], key: str, label: str, count: int, group: int = GROUP) -> DataFrame:
    """df with labels: its label under each perm, the observed one first, from the labels of its group.

    Perms are those of stats.shuffled_labels: ids in order meet labels in order of an md5 of perm and id. Rows need a key
    that is unique in its group, and a label.
    """
    rows = df.select(*within, F.col(key).alias("key_"), F.col(label).alias("label_"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in within], f"key_ {kinds['key_']}, labels array<{kinds['label_']}>"])

    def shuffle(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["key_"].astype(str)
        pdf = pdf.assign(_o=names.str.rjust(20, "0").str.slice(0, 20)).sort_values("_o")
        labels, names = pdf["label_"].to_numpy(), pdf["key_"].astype(str).to_list()
        out = np.empty((len(pdf), count + 1), labels.dtype)
        out[:, 0] = labels
        step = max(1, (1 << 20) // len(names))
        for at in range(1, count + 1, step):
            perms = slice(at, min(at + step, count + 1))
            out[:, perms] = labels[_places(names, perms.start, perms.stop)]
        return pdf[[*within, "key_"]].assign(labels=list(out))

    by = list(within) or [F.lit(0).alias("_all")]
    sizes = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("n_"))
    sized = rows.join(sizes, list(within)) if within else rows.crossJoin(F.broadcast(sizes))  # without groups one row
    small = sized.where(F.col("n_") <= group).drop("n_").groupBy(*by).applyInPandas(shuffle, schema)
    large = shuffled_labels(sized.where(F.col("n_") > group).drop("n_"), within, "key_", "label_", count)
    large = large.groupBy(*within, "key_").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", "label_"))), lambda x: x["label_"]).alias("labels"))  # a number for each perm
    return df.join(small.unionByName(large).withColumnRenamed("key_", key), [*within, key])


def label_sums(df: DataFrame, keys: Sequence[str], key: str, labels: str, value: str) -> DataFrame:
    """(keys, label, n, s, q): for each label of a group, arrays over perms of the number, sum and sum of squares of its values.

    Null values take no part. Rows lie by range of (keys, key), so that a group of any size is spread over tasks.
    """
    kinds = dict(df.dtypes)
    element = kinds[labels].removeprefix("array<").removesuffix(">")
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"label {element}, n array<long>, s array<double>, q array<double>, edge_ boolean"])
    columns = [*keys, "label", "n", "s", "q", "edge_"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, first, out = None, {}, True, []  # the group that may go on in the next rows

        def send(edge: bool) -> None:
            out.extend((*name, c, *sums, edge) for c, sums in held.items())

        for whole in batches:
            for own_name, pdf in whole.groupby(list(keys), sort=False, dropna=False) if keys else [((), whole)]:
                # null keys are NaN, of which none equals another
                if name is not None and not all(a == b or (a != a and b != b) for a, b in zip(name, own_name)):
                    send(first)
                    held, first = {}, False
                name = own_name
                for at in range(0, len(pdf), _STEP):
                    x, own = pdf["x_"].to_numpy(float)[at : at + _STEP], np.stack(pdf["l_"].iloc[at : at + _STEP].to_list())
                    for c in np.unique(own):
                        on = (own == c).astype(float)
                        sums = [on.sum(axis=0).astype(np.int64), x @ on, (x * x) @ on]
                        held[c] = [a + b for a, b in zip(held[c], sums)] if c in held else sums
            if out:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        if name is not None:
            send(True)
            yield pd.DataFrame(out, columns=columns)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1].copy()
        for c in ("n", "s", "q"):
            one[c] = [np.sum(pdf[c].to_list(), axis=0)]
        return one

    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(key).alias("key_"), F.col(labels).alias("l_"), F.col(value).cast("double").alias("x_"))
    rows = rows.repartitionByRange(*keys, "key_").sortWithinPartitions(*keys, "key_").drop("key_")
    parts = rows.mapInPandas(each, schema)
    edges = parts.where("edge_").groupBy(*keys, "label").applyInPandas(merge, schema)  # groups at a task's ends only
    return parts.where("not edge_").unionByName(edges).drop("edge_")


def _by_group(sums: DataFrame, keys: Sequence[str], make, schema: str) -> DataFrame:
    """What make gives of a group's labels and their (labels x perms) arrays; a group's labels are few rows."""
    kinds = dict(sums.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        with np.errstate(divide="ignore", invalid="ignore"):
            out = make(pdf["label"].to_numpy(), *(np.stack(pdf[c].to_list()).astype(float) for c in ("n", "s", "q")))
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    heads, names = [f"`{k}` {kinds[k]}" for k in keys], [*keys, *(c.split()[0] for c in schema.split(", "))]
    by = list(keys) or [F.lit(0).alias("_all")]
    return sums.groupBy(*by).applyInPandas(lambda pdf: run(pdf)[names], ", ".join([*heads, schema]))


def _d_prime(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    there = n > 0
    m = np.where(there, s / n, 0.0)
    v = np.where(there, np.maximum(q / n - m * m, 0.0), 0.0)
    k = there.sum(axis=0)
    others_m, others_v = (m.sum(axis=0) - m) / (k - 1), (v.sum(axis=0) - v) / (k - 1)
    spread = np.sqrt((v + others_v) / 2)
    return np.where(there & (spread > 0), (m - others_m) / spread, np.nan)


def _theory_rho(labels: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, theories: Mapping[object, tuple[float, float]]) -> list[np.ndarray]:
    total, sx, sxx = n.sum(axis=0), s.sum(axis=0), q.sum(axis=0)
    rho = []
    for i in range(2):
        y = np.array([theories[c][i] for c in labels.tolist()])[:, None]
        sy, syy, sxy = (n * y).sum(axis=0), (n * y * y).sum(axis=0), (s * y).sum(axis=0)
        left = (total * sxx - sx * sx) * (total * syy - sy * sy)
        rho.append(np.where(left > 0, (total * sxy - sx * sy) / np.sqrt(left), np.nan))
    return rho


def _upper(v: np.ndarray) -> np.ndarray:
    """Of each row, the share of numbers that reach its first, itself included; NaN takes no part."""
    there = ~np.isnan(v)
    share = ((v >= v[:, :1] - 1e-9) & there).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
    return np.where(there[:, 0], share, np.nan)


def d_prime_arrays(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, d): per label and perm its mean less the mean of the others' means, over the root of the mean of variances; NaN without spread."""

    def make(labels: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"label": labels, "d": list(_d_prime(n, s, q))})

    return _by_group(sums, keys, make, f"label {dict(sums.dtypes)['label']}, d array<double>")


def theory_correlations(sums: DataFrame, keys: Sequence[str], theories: Mapping[object, tuple[float, float]]) -> DataFrame:
    """(keys, first, second, z): per perm the correlations of values with two predictions by label, and the first less the second; NaN without spread.

    theories gives both predictions for a label.
    """

    def make(labels: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        rho = _theory_rho(labels, n, s, q, theories)
        return pd.DataFrame({"first": [rho[0]], "second": [rho[1]], "z": [rho[0] - rho[1]]})

    return _by_group(sums, keys, make, "first array<double>, second array<double>, z array<double>")


def correlation_difference(sums: DataFrame, keys: Sequence[str], theories: Mapping[object, tuple[float, float]]) -> DataFrame:
    """(keys, z): of theory_correlations, the difference only."""
    return theory_correlations(sums, keys, theories).select(*keys, "z")


def theory_tests(sums: DataFrame, keys: Sequence[str], theories: Mapping[object, tuple[float, float]]) -> DataFrame:
    """(keys, p_first, p_second, observed, p): two theories' correlations and their difference against shuffles.

    All p are upper tails with the observed labels among the perms; null without spread.
    """
    rho = theory_correlations(sums, keys, theories)
    kinds = dict(rho.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "p_first double, p_second double, observed double, p double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                first, second, z = (np.stack(pdf[c].to_list()) for c in ("first", "second", "z"))
                yield pdf[list(keys)].assign(p_first=_upper(first), p_second=_upper(second), observed=z[:, 0], p=_upper(z))

    made = ("p_first", "p_second", "observed", "p")
    return rho.mapInPandas(run, schema).withColumns({c: F.nanvl(c, F.lit(None)) for c in made})


def gated_theory_test(sums: DataFrame, keys: Sequence[str], theories: Mapping[object, tuple[float, float]], alpha: float = 0.05) -> DataFrame:
    """theory_tests of the groups where one theory is significant by itself; groups without a theory of p <= alpha have no row."""
    return theory_tests(sums, keys, theories).where(F.least("p_first", "p_second") <= alpha)


def _met_labels(df: DataFrame, keys: Sequence[str], key: str, label: str, value: str, count: int, test: Callable[..., pd.DataFrame], made: Sequence[str], labelled: bool, group: int) -> DataFrame:
    """(keys, label if labelled, made): the numbers that test gives of a group's labels and sums under shuffled labels; NaN is null.

    A group's rows meet in one task, in order, and are shuffled, summed and tested there, so that arrays over perms never leave
    it. Groups of more than `group` items, and a table without keys, are shuffled by Spark's windows and summed in many tasks.
    """
    keys, kinds = list(keys), dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *([f"label {kinds[label]}"] if labelled else []), *(f"{c} double" for c in made)])
    names = [*keys, *(["label"] if labelled else []), *made]

    def spread(rows: DataFrame) -> DataFrame:
        sums = label_sums(with_label_arrays(rows, keys, key, label, count, group), keys, key, "labels", value)
        return _by_group(sums, keys, test, schema.split(", ", len(keys))[len(keys)]).select(*names)

    def finish(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, x = rows.column("name_").to_pylist(), rows.column("x_").to_numpy()
        coded = rows.column("label_").combine_chunks().dictionary_encode()
        known, code = coded.dictionary, coded.indices.fill_null(-1).to_numpy()
        order = np.argsort(np.array(known.to_pylist())) if len(known) else np.zeros(0, int)
        of, labels, found = [], [], []
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
            own = order[np.isin(order, code[at:end])]
            place = np.full(len(known) + 1, -1)  # without a label an item has a place, but is in no sum
            place[own] = np.arange(len(own))
            n, s, q = _sums_of(ids[at:end], place[code[at:end]], x[at:end], len(own), count)
            some = n.any(axis=1)
            if some.any():
                values = np.array(known.take(pa.array(own[some])).to_pylist())
                with np.errstate(divide="ignore", invalid="ignore"):
                    out = test(values, n[some], s[some], q[some])
                of += [at] * len(out)
                labels += own[some].tolist() if labelled else []
                found.append(out[list(made)].to_numpy(float))
        heads = rows.select(keys).take(pa.array(of, pa.int64()))
        v = np.concatenate(found) if found else np.zeros((0, len(made)))
        columns = [*(heads.column(k).combine_chunks() for k in keys), *([known.take(pa.array(labels, pa.int64()))] if labelled else [])]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(v[:, i], mask=np.isnan(v[:, i])) for i in range(len(made)))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of the group that may go on in the next rows
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*held, b]).combine_chunks()
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for k in keys:
                own = rows.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
                new[1:] |= own[1:] != own[:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield finish(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
        if held:
            yield finish(pa.Table.from_batches(held), np.zeros(1, int))

    if not keys:
        return spread(df)
    there = F.col(key).isNotNull()
    for k in keys:
        there &= F.col(k).isNotNull()
    name = F.col(key).cast("string")
    rows = df.where(there).select(*dict.fromkeys([*keys, key, label, value]), name.alias("name_"), F.lpad(name, 20, "0").alias("order_"))
    whole = Window.partitionBy(*keys).orderBy("order_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("n_", F.count(F.lit(1)).over(whole))
    met = rows.where(F.col("n_") <= group).sortWithinPartitions(*keys, "order_")
    met = met.select(*keys, "name_", F.col(label).alias("label_"), F.col(value).cast("double").alias("x_")).mapInArrow(run, schema)
    return met.unionByName(spread(rows.where(F.col("n_") > group).select(*dict.fromkeys([*keys, key, label, value]))))


def d_prime_test(df: DataFrame, keys: Sequence[str], key: str, label: str, value: str, count: int, group: int = GROUP) -> DataFrame:
    """(keys, label, observed, p): d_prime_arrays of labels shuffled in a group, and the upper p of the observed one; null without spread."""

    def test(labels: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        d = _d_prime(n, s, q)
        return pd.DataFrame({"label": labels, "observed": d[:, 0], "p": _upper(d)})

    return _nulls(_met_labels(df, keys, key, label, value, count, test, ["observed", "p"], True, group), ["observed", "p"])


def theory_shuffle_tests(df: DataFrame, keys: Sequence[str], key: str, label: str, value: str, theories: Mapping[object, tuple[float, float]], count: int, group: int = GROUP) -> DataFrame:
    """(keys, p_first, p_second, observed, p): theory_tests of labels shuffled in a group."""
    made = ["p_first", "p_second", "observed", "p"]

    def test(labels: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        first, second = _theory_rho(labels, n, s, q, theories)
        p = _upper(np.stack([first, second, first - second]))
        return pd.DataFrame([(p[0], p[1], first[0] - second[0], p[2])], columns=made)

    return _nulls(_met_labels(df, keys, key, label, value, count, test, made, False, group), made)


def _nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in columns})


def permuted_centroids(items: DataFrame, within: Sequence[str], fold: str, count: int, key: str = "id", label: str = "label", x: str = "x", most: int = 1 << 28) -> DataFrame:
    """(n, accuracy): accuracy of nearest centroids with one fold left out, an array over perms of labels shuffled within groups.

    An item is one row with its labels of all perms. Sums of vectors by fold, label and perm are products with the labels'
    indicators; the centroids of all folds and perms, folds x labels x perms x d numbers (more than `most` bytes are an
    error), are broadcast, and tasks count the hits of their items. Distances are compared to 9 digits, ties go to the
    smaller label. Items without a label or a vector, and vectors with null components, take no part.
    """
    there = F.col(label).isNotNull() & F.col(x).isNotNull() & ~F.exists(F.col(x), lambda v: v.isNull())
    rows = items.where(there).select(*dict.fromkeys([*within, key, label, fold]), F.col(x).cast("array<double>").alias("x_"))
    rows = with_label_arrays(rows, within, key, label, count).select(F.col(fold).alias("fold_"), F.col("labels").alias("l_"), "x_")
    kinds = dict(rows.dtypes)
    element = kinds["l_"].removeprefix("array<").removesuffix(">")
    schema = f"fold_ {kinds['fold_']}, label {element}, part int, n array<double>, s array<double>"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % 32, {}
        for whole in batches:
            for f, pdf in whole.groupby("fold_", dropna=False):
                for at in range(0, len(pdf), _STEP):
                    v, own = (np.stack(pdf[c].iloc[at : at + _STEP].to_list()) for c in ("x_", "l_"))
                    for c in np.unique(own):
                        on = (own == c).astype(float)
                        n, s = held.get((f, c), (0.0, 0.0))
                        held[f, c] = n + on.sum(axis=0), s + on.T @ v
        yield pd.DataFrame([(*k, part, n, s.ravel()) for k, (n, s) in held.items()], columns=["fold_", "label", "part", "n", "s"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1].copy()
        one["n"], one["s"] = [np.sum(pdf["n"].to_list(), axis=0)], [np.sum(pdf["s"].to_list(), axis=0)]
        return one

    found = rows.mapInPandas(sums, schema).groupBy("fold_", "label", "part").applyInPandas(merge, schema).groupBy("fold_", "label").applyInPandas(merge, schema)
    size = found.agg(F.sum(8 * F.size("s"))).first()[0] or 0
    if size > most:
        raise ValueError(f"centroids of all folds and perms take {size} bytes")
    table = found.toPandas()
    known = np.sort(table["label"].unique()) if len(table) else np.zeros(0)
    folds, perms = list(table["fold_"].unique()), count + 1
    d = len(table["s"].iloc[0]) // perms if len(table) else 0
    n, s = np.zeros((len(folds), len(known), perms)), np.zeros((len(folds), len(known), perms, d))
    for f, c, own_n, own_s in zip(table["fold_"], table["label"], table["n"], table["s"]):
        at = folds.index(f), int(np.searchsorted(known, c))
        n[at], s[at] = own_n, np.asarray(own_s).reshape(perms, d)
    n, s = n.sum(axis=0) - n, s.sum(axis=0) - s
    centres = items.sparkSession.sparkContext.broadcast((folds, known, n > 0, s / np.maximum(n, 1)[..., None]))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds, known, there, mean = centres.value
        total, right = 0, np.zeros(perms, np.int64)
        for whole in batches:
            for f, pdf in whole.groupby("fold_", dropna=False):
                at = folds.index(f)
                square = np.where(there[at], (mean[at] ** 2).sum(axis=2), np.inf)
                for i in range(0, len(pdf), 64):
                    v, own = (np.stack(pdf[c].iloc[i : i + 64].to_list()) for c in ("x_", "l_"))
                    far = np.round((v * v).sum(axis=1)[:, None, None] + square - 2 * np.einsum("id,lpd->ilp", v, mean[at], optimize=True), 9)
                    judged = there[at].any(axis=0)
                    right += ((known[far.argmin(axis=1)] == own) & judged).sum(axis=0)
                    total += len(v)
        yield pd.DataFrame({"n": [total], "right": [right]})

    parts = rows.mapInPandas(hits, "n long, right array<long>").where("n > 0")
    each = parts.select("n", F.posexplode("right").alias("perm", "right")).groupBy("perm").agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"))  # a row for each task and perm
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("perm", "accuracy"))), lambda v: v["accuracy"])
    return each.agg(F.max("n").alias("n"), ordered.alias("accuracy")).where("n IS NOT NULL")
