"""Linear classifiers for many cells at once: sums of vectors by fold, fits from the sums of other folds, shared scoring.

Items are rows (keys, id, label, fold, x) with x a vector. A cell is one value of keys: a region, a time point, a problem.
Sums of a fold, of a label and of products of features are formed where the rows lie, one block of numbers for each task,
and a cell's fits see these blocks only. So every row is read twice, to sum and to score, whatever the number of folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decoding import _left_out

#: Blocks of sums that a task holds before it sends them on, and the parts in which blocks of a fold and label are merged.
_HELD, _PARTS = 256, 32
_NUMBERS = T.ArrayType(T.DoubleType())


def spread_rank(df: DataFrame, keys: Sequence[str], seed: Column, tie: str, into: str) -> DataFrame:
    """df with the place (from 0) of each row of a group, in order of the md5 of seed and tie, then of tie.

    A group of any size is ranked in 4,096 parts, by the first digits of the md5, each after the counts of those before.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", seed, F.col(tie)))).withColumn("_b", F.substring("_h", 1, 3))
    parts = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_p"), before.alias("_before"))
    place = hashed.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", tie)))
    on = F.col("_b") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return place.join(parts, on).withColumn(into, F.col("_before") + F.col("_i") - 1).select(*[c for c in df.columns if c != into], into)


def stratified_folds(items: DataFrame, keys: Sequence[str], folds: int, key: str = "id", label: str = "label", into: str = "fold", seed: int = 0) -> DataFrame:
    """items with a fold (int): each label of a cell is dealt over the folds in turn, in a random order that seed and key fix."""
    ranked = spread_rank(items, [*keys, label], F.lit(seed), key, into)
    return ranked.withColumn(into, (F.col(into) % folds).cast("int"))


def averaged(items: DataFrame, keys: Sequence[str], n: int, width: int, seed: Column, key: str = "id", x: str = "x") -> DataFrame:
    """(keys, id, x): the mean vector of every n items of a group in a random order; the last may be of fewer. width is the length of x."""
    place = spread_rank(items, keys, seed, key, "_place").withColumn("id", F.floor(F.col("_place") / n))
    return place.groupBy(*keys, "id").agg(F.array(*[F.avg(F.col(x)[i]) for i in range(width)]).alias("x"))


def _usable(items: DataFrame, label: str, x: str) -> DataFrame:
    """Items with a label and a vector whose components are all finite."""
    finite = F.forall(F.col(x).cast("array<double>"), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return items.where(F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(x) > 0))


def moments(items: DataFrame, keys: Sequence[str], fold: str, label: str = "label", x: str = "x") -> DataFrame:
    """(keys, fold, label, part, n, s, g): number, sum and sum of products (d x d, in one array) of the vectors, in up to 32 parts.

    Items without a label, and vectors that are null, empty or hold null or non-finite components, take no part. Vectors
    of a cell have one length; another is an error.
    """
    by = [*keys, fold, label]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % _PARTS, {}

        def out() -> pd.DataFrame:
            rows = [(*k, part, n, s, g.ravel()) for k, (n, s, g) in held.items()]
            return pd.DataFrame(rows, columns=[*by, "part", "n", "s", "g"])

        for pdf in batches:
            for values, rows in pdf.groupby(by, dropna=False, sort=False):
                v = np.stack(rows["x_"].to_list()).astype(float)
                n, s, g = held.get(values, (0, 0.0, 0.0))
                held[values] = (n + len(v), s + v.sum(axis=0), g + v.T @ v)
                if len(held) >= _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1].copy()
        first["n"], first["s"], first["g"] = pdf["n"].sum(), [np.sum(pdf["s"].to_list(), axis=0)], [np.sum(pdf["g"].to_list(), axis=0)]
        return first

    rows = _usable(items, label, x).select(*by, F.col(x).cast("array<double>").alias("x_"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "x_"]).add("part", T.IntegerType()).add("n", T.LongType()).add("s", _NUMBERS).add("g", _NUMBERS)
    return rows.mapInPandas(each, schema).groupBy(*by, "part").applyInPandas(merge, schema)


def f_values(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each feature's F of an analysis of variance by label: n (labels), s and q (labels x features) are counts, sums and sums of squares.

    No spread within labels gives infinity, or 0 without any between them; a single label or no item to spare gives 0.
    """
    k, total = len(n), n.sum()
    inner = np.maximum(q.sum(axis=0) - (s * s / n[:, None]).sum(axis=0), 0.0)
    inner[inner <= 1e-12 * q.sum(axis=0)] = 0.0
    outer = np.maximum((s * s / n[:, None]).sum(axis=0) - s.sum(axis=0) ** 2 / total, 0.0)
    outer[outer <= 1e-12 * q.sum(axis=0)] = 0.0
    if k < 2 or total <= k:
        return np.zeros(s.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((outer / (k - 1)) / (inner / (total - k)), nan=0.0, posinf=np.inf)


def _solve(n: np.ndarray, s: np.ndarray, g: np.ndarray, select: int | None, shrink: float) -> np.ndarray:
    """Weights and intercept (last) of each label's linear discriminant from training sums; g is summed over labels."""
    d = s.shape[1]
    chosen = np.arange(d)
    if select is not None and select < d:
        q = np.broadcast_to(np.diag(g) / len(n), s.shape)  # only their sum over labels enters
        chosen = np.sort(np.argsort(-f_values(n, s, q), kind="stable")[:select])
    mean = s[:, chosen] / n[:, None]
    scatter = g[np.ix_(chosen, chosen)] - (s[:, chosen].T / n) @ s[:, chosen]
    cov = scatter / max(n.sum() - len(n), 1)
    if shrink:
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / len(chosen) * np.eye(len(chosen))
    out = np.zeros((len(n), d + 1))
    weights = mean @ np.linalg.pinv((cov + cov.T) / 2, rcond=1e-10, hermitian=True)
    out[:, chosen] = weights
    out[:, d] = np.log(n / n.sum()) - 0.5 * (weights * mean).sum(axis=1)
    return out


def discriminant_fits(sums: DataFrame, keys: Sequence[str], fold: str, label: str = "label", select: int | None = None, shrink: float = 0.0, left_out: bool = True) -> DataFrame:
    """(keys, fold, labels, w): the linear discriminants of each cell and fold, from moments.

    left_out: a fold's fit is that of all other folds; else it is that of the fold itself, to be tested on others. select
    keeps so many features of the greatest F, by the training sums alone; shrink moves the covariance to its mean
    eigenvalue. A singular covariance is inverted within its range. A fold without training items has no fit. One task
    handles the blocks of one cell: its folds, labels and parts, but no items.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {k: (r["n"].sum(), np.sum(r["s"].to_list(), axis=0), np.sum(r["g"].to_list(), axis=0)) for k, r in pdf.groupby([fold, label])}
        rows, folds, labels = [], sorted({k[0] for k in by}), sorted({k[1] for k in by})
        for f in folds:
            train = {c: [v for (g, c2), v in by.items() if c2 == c and (g != f) == left_out] for c in labels}
            known = [c for c in labels if train[c]]
            if known:
                n, s, g = (np.array([np.sum([v[i] for v in train[c]], axis=0) for c in known]) for i in range(3))
                d = s.shape[1]
                w = _solve(n.astype(float), s, g.sum(axis=0).reshape(d, d), select, shrink)
                rows.append((*[pdf[k].iloc[0] for k in keys], f, known, w.ravel()))
        return pd.DataFrame(rows, columns=[*keys, fold, "labels", "w"])

    kinds = {f.name: f.dataType for f in sums.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in [*keys, fold]]).add("labels", T.ArrayType(kinds[label])).add("w", _NUMBERS)
    return sums.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(solve, schema)


def linear_guesses(items: DataFrame, fits: DataFrame, on: Sequence[str], label: str = "label", x: str = "x") -> DataFrame:
    """items (but for x) with guess: the label of the greatest score; ties go to the smaller label.

    fits has (on, labels, w), a few rows for each cell; Spark broadcasts or shuffles them by their size. Items without a
    label, a usable vector or a fit are left out.
    """
    rest = [c for c in items.columns if c != x]
    rows = _usable(items, label, x).select(*rest, F.col(x).cast("array<double>").alias("x_"))
    joined = rows.join(fits, list(on)).select(*rest, F.col("labels").alias("labels_"), F.col("w").alias("w_"), "x_")
    schema = T.StructType([joined.schema[c] for c in rest]).add("guess", fits.schema["labels"].dataType.elementType)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at : at + 1024]
                out = pdf[rest].copy()
                guess = np.empty(len(pdf), object)
                sizes = pdf["w_"].map(len).to_numpy()
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    v = np.stack(pdf["x_"].iloc[rows].to_list())
                    w = np.stack(pdf["w_"].iloc[rows].to_list()).reshape(len(rows), -1, v.shape[1] + 1)
                    best = (np.einsum("nld,nd->nl", w[:, :, :-1], v) + w[:, :, -1]).argmax(axis=1)
                    for r, b in zip(rows.tolist(), best.tolist()):
                        guess[r] = pdf["labels_"].iloc[r][b]
                out["guess"] = guess
                yield out

    return joined.mapInPandas(run, schema)


def accuracy(guesses: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return guesses.groupBy(*keys).agg(F.avg((F.col("guess") == F.col(label)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def discriminant_accuracy(items: DataFrame, keys: Sequence[str], fold: str, label: str = "label", x: str = "x", select: int | None = None, shrink: float = 0.0) -> DataFrame:
    """(keys, fold, accuracy, n) of linear discriminants with one fold left out at a time, for each cell of keys."""
    fits = discriminant_fits(moments(items, keys, fold, label, x), keys, fold, label, select, shrink)
    return accuracy(linear_guesses(items, fits, [*keys, fold], label, x), [*keys, fold], label)


def generalised_accuracy(items: DataFrame, keys: Sequence[str], condition: str, label: str = "label", x: str = "x", select: int | None = None, shrink: float = 0.0) -> DataFrame:
    """(keys, train, test, accuracy, n): linear discriminants trained on one condition and tested on each other one."""
    fits = discriminant_fits(moments(items, keys, condition, label, x), keys, condition, label, select, shrink, left_out=False)
    fits = fits.withColumnRenamed(condition, "train")
    trains = fits.select(*keys, "train")
    tested = items.withColumnRenamed(condition, "test")
    tested = (tested.join(trains, list(keys)) if keys else tested.crossJoin(F.broadcast(trains))).where("train <> test")  # a row for each condition
    return accuracy(linear_guesses(tested, fits, [*keys, "train"], label, x), [*keys, "train", "test"], label)


def fold_features(long: DataFrame, keys: Sequence[str], fold: str, label: str, select: int) -> DataFrame:
    """(keys, fold, f, score): the features of the greatest F for each fold, by the sums of the other folds; ties to the smaller f.

    long has a row (keys, label, fold, f, v) for each feature of an item; nulls take no part. Features without spread
    within labels have a null score and come last.
    """
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    by = _left_out(long, keys, fold, label).groupBy(*keys, fold, "f").agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(q).alias("q"), F.sum(s * s / n).alias("m"))
    inner = F.col("q") - F.col("m")
    score = F.when(inner > F.col("q") * 1e-12, (F.col("m") - F.col("s") ** 2 / F.col("n")) / (F.col("k") - 1) / (inner / (F.col("n") - F.col("k"))))
    scored = by.where("k > 1 and n > k").select(*keys, fold, "f", score.alias("score"))
    place = F.row_number().over(Window.partitionBy(*keys, fold).orderBy(F.round("score", 9).desc_nulls_last(), "f"))  # a row for each feature
    return scored.withColumn("_i", place).where(F.col("_i") <= select).drop("_i")


def margin_fits(items: DataFrame, fold: str, label: str = "label", x: str = "x", kind: str = "svc", c: float = 1.0, rounds: int = 50) -> DataFrame:
    """(fold, labels, w): pyspark.ml's linear support vectors (one against the rest) or logistic regression, without each fold in turn.

    Each fold's fit is a distributed one over the items of all other folds, with standardised features and a penalty of
    1 / (c n). Folds and labels are few: their names come to the driver, items don't. A fold whose other folds hold fewer
    than two labels has no fit.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector
    from pyspark.storagelevel import StorageLevel

    session, kinds = items.sparkSession, {f.name: f.dataType for f in items.schema.fields}
    rows = _usable(items, label, x).select(fold, label, array_to_vector(F.col(x).cast("array<double>")).alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = rows.groupBy(fold, label).count().collect()
    out = []
    for f in sorted({r[0] for r in counts}):
        labels = sorted({r[1] for r in counts if r[0] != f})
        n = sum(r[2] for r in counts if r[0] != f)
        if len(labels) < 2:
            continue
        train = rows.where(F.col(fold) != F.lit(f)).withColumn("target", (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("double"))
        if kind == "logistic":
            fit = LogisticRegression(labelCol="target", maxIter=rounds, regParam=1 / (c * n), family="multinomial").fit(train)
            w = np.column_stack([fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()])
        else:
            svc = LinearSVC(labelCol="target", maxIter=rounds, regParam=1 / (c * n))
            if len(labels) == 2:
                fit = svc.fit(train)
                one = np.append(fit.coefficients.toArray(), fit.intercept)
                w = np.stack([-one, one])
            else:
                models = OneVsRest(classifier=svc, labelCol="target", parallelism=4).fit(train).models
                w = np.stack([np.append(m.coefficients.toArray(), m.intercept) for m in models])
        out.append((f, labels, w.ravel().tolist()))
    rows.unpersist()
    schema = T.StructType([T.StructField(fold, kinds[fold])]).add("labels", T.ArrayType(kinds[label])).add("w", _NUMBERS)
    return session.createDataFrame(out, schema)


def margin_accuracy(items: DataFrame, fold: str, label: str = "label", x: str = "x", kind: str = "svc", c: float = 1.0, rounds: int = 50) -> DataFrame:
    """(fold, accuracy, n) of a linear margin model with one fold left out at a time."""
    return accuracy(linear_guesses(items, margin_fits(items, fold, label, x, kind, c, rounds), [fold], label, x), [fold], label)


def forest_guesses(items: DataFrame, fold: str, label: str = "label", x: str = "x", trees: int = 100, depth: int = 5, seed: int = 0) -> DataFrame:
    """items that have a label and a vector, with guess: the label by a random forest over all other folds, by pyspark.ml.

    Features of a split are a root of their number. A fold whose other folds hold a single label gets that label; one
    without other folds gets null. Rows are put in partitions by a hash of all columns before each fit, so that trees
    don't depend on how items are stored. The driver sees the folds' labels only; a forest is at most trees * 2^(depth + 1) nodes.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.storagelevel import StorageLevel

    kind = dict(items.dtypes)[label]
    rows = _usable(items, label, x).withColumn("_features", array_to_vector(F.col(x).cast("array<double>"))).persist(StorageLevel.MEMORY_AND_DISK)
    counts = [(r[0], r[1]) for r in rows.groupBy(fold, label).count().collect()]
    out = rows.where("false").drop("_features").withColumn("guess", F.lit(None).cast(kind))
    for f in sorted({f for f, _ in counts}):
        known = sorted({c for other, c in counts if other != f})
        test = rows.where(F.col(fold) == F.lit(f))
        names = F.array(*map(F.lit, known)).cast(f"array<{kind}>")
        if len(known) < 2:
            found = test.withColumn("guess", F.lit(known[0] if known else None).cast(kind))
        else:
            train = rows.where(F.col(fold) != F.lit(f)).select("_features", (F.array_position(names, F.col(label)) - 1).cast("double").alias("_target"))
            train = train.repartition("_features", "_target").sortWithinPartitions(F.xxhash64(F.col("_features").cast("string")), "_target")
            forest = RandomForestClassifier(featuresCol="_features", labelCol="_target", predictionCol="_at", probabilityCol="", rawPredictionCol="", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
            found = forest.fit(train).transform(test).withColumn("guess", F.element_at(names, F.col("_at").cast("int") + 1))
        out = out.unionByName(found.select(*out.columns))
    return out


def forest_accuracy(items: DataFrame, fold: str, label: str = "label", x: str = "x", trees: int = 100, depth: int = 5, seed: int = 0) -> DataFrame:
    """(fold, accuracy, n) of a random forest with one fold left out at a time."""
    return accuracy(forest_guesses(items, fold, label, x, trees, depth, seed), [fold], label)
