"""Isotonic calibration by fold: adjacent violators are pooled where scores lie, then the pooled blocks once more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled(lo: list, hi: list, n: list, hits: list) -> tuple[list, list, list, list]:
    """Blocks in ascending order with ascending means, from blocks in ascending order: neighbours merge while means don't ascend."""
    out: list[list] = []
    for block in zip(lo, hi, n, hits):
        a, b, k, h = block
        while out and out[-1][3] * k >= h * out[-1][2]:
            a, _, k2, h2 = out.pop()
            k, h = k + k2, h + h2
        out.append([a, b, k, h])
    return tuple(map(list, zip(*out))) if out else ([], [], [], [])


def isotonic_fits(rows: DataFrame, fold: str, score: str, target: str) -> DataFrame:
    """(fold, lo, hi, n, value): the blocks of each fold's ascending least-squares fit of 0 or 1 targets to scores.

    Scores are counted, dealt by range and pooled range by range. A fold's pooled blocks meet in one task: of N rows they are
    in the order of N^(2/3) at most, as their means are different shares of whole numbers. Pooling blocks again gives the
    fit of all rows, as a pooled block is never split. Equal scores are one point. NaN and null scores and null targets
    take no part. Targets that fall with the score give one block.
    """
    kept = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(target).isNotNull())
    points = kept.groupBy(F.col(fold).alias("fold_"), F.col(score).cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("hits"))
    kind = dict(points.dtypes)["fold_"]
    schema = f"fold_ {kind}, lo double, hi double, n long, hits long"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for f, own in pdf.groupby("fold_", dropna=False, sort=False):
                before = held.get(f, ([], [], [], []))
                held[f] = pooled(*(x + own[c].tolist() for x, c in zip(before, ("lo", "lo", "n", "hits"))))
        for f, (lo, hi, n, hits) in held.items():
            yield pd.DataFrame({"fold_": f, "lo": lo, "hi": hi, "n": n, "hits": hits})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        lo, hi, n, hits = pooled(*(pdf[c].tolist() for c in ("lo", "hi", "n", "hits")))
        return pd.DataFrame({"fold_": pdf["fold_"].iloc[0], "lo": lo, "hi": hi, "n": n, "hits": hits})

    parts = points.repartitionByRange("fold_", "lo").sortWithinPartitions("fold_", "lo").mapInPandas(each, schema)
    blocks = parts.groupBy("fold_").applyInPandas(last, schema)
    return blocks.select(F.col("fold_").alias(fold), "lo", "hi", "n", (F.col("hits") / F.col("n")).alias("value"))


def isotonic_probability(rows: DataFrame, fits: DataFrame, fold: str, score: str, into: str = "probability") -> DataFrame:
    """rows with the mean over folds of what each fold's fit gives the score: between blocks on a straight line, beyond the ends the end's value.

    Null for a null or NaN score, or without fits. One fold's blocks after the other are broadcast as arrays.
    """
    context, curves = rows.sparkSession.sparkContext, []
    for (f,) in fits.select(fold).distinct().collect():
        t = fits.where(F.col(fold).eqNullSafe(F.lit(f))).select("lo", "hi", "value").toArrow().sort_by("lo")
        ends = np.stack([t["lo"].to_numpy(), t["hi"].to_numpy()], axis=1).ravel()
        curves.append(context.broadcast((ends, np.repeat(t["value"].to_numpy(), 2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)  # null is NaN
            total = sum((np.interp(x, *c.value) for c in curves), np.zeros(len(x))) / max(len(curves), 1)
            none = np.isnan(x) | (not curves)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(total, pa.float64(), mask=none)], names=[*names, into])

    names = [c for c in rows.columns if c != into]
    out = rows.select(*names).withColumn(into, F.lit(None).cast("double")).schema
    return rows.select(*names, F.col(score).cast("double").alias("_x")).mapInArrow(run, out)
