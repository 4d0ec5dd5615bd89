"""Result tables: many of them side by side, and best models with their tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide_table(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, source_column for each column of each table, sources): all keys of any table, with what each table says of them.

    One shuffle, whatever the number of tables: rows of all tables are grouped by key. sources names the tables that have
    the key, in their order. Of rows of one table with the same keys, the least stays; null keys are a key like others.
    """
    kinds = {name: [c for c in df.columns if c not in keys] for name, df in tables.items()}
    rows = [df.select(*keys, F.struct(F.lit(True).alias("_there"), *kinds[name]).alias(f"_{name}")) for name, df in tables.items()]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy(*keys).agg(*[F.min(f"_{name}").alias(f"_{name}") for name in tables])
    there = F.concat_ws("+", *[F.when(F.col(f"_{name}._there"), F.lit(name)) for name in tables])
    return one.select(*keys, *[F.col(f"_{name}.{c}").alias(f"{name}_{c}") for name in tables for c in kinds[name]], there.alias("sources"))


def best_with(models: DataFrame, tests: DataFrame, keys: Sequence[str], model: str, criterion: str) -> DataFrame:
    """The models of the least criterion of each key, ties included, with the columns of the tests of the same key and model, or nulls."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(criterion))  # a row for each model
    best = models.where(F.col(criterion).isNotNull()).withColumn("_i", place).where("_i = 1").drop("_i")
    return best.join(tests, [*keys, model], "left")


def validated(tests: DataFrame, roi: str, signs: Mapping[str, int], difference: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Tests in the regions of a theory, with validated: whether the difference has the theory's sign at p < alpha.

    signs gives a text that names of a theory's regions hold, and the sign that the theory predicts; the first text counts.
    Regions of no theory go; a null difference or p validates nothing.
    """
    sign = F.coalesce(*[F.when(F.contains(roi, F.lit(name)), F.lit(s)) for name, s in signs.items()])
    rows = tests.withColumn("_sign", sign).where("_sign is not null")
    return rows.withColumn("validated", F.coalesce((F.signum(difference) == F.col("_sign")) & (F.col(p) < alpha), F.lit(False))).drop("_sign")


def label_summary(channels: DataFrame, atlases: Sequence[str], flags: Mapping[str, Column], values: Sequence[str]) -> DataFrame:
    """(atlas, label, n, n_flag for each flag, mean_value and sd_value for each value): a row for each label of each atlas.

    atlases are columns with a channel's label in each, a subject's name among them. Null labels are left out, null and NaN
    values and null flags aren't counted; sd is of the population.
    """
    numbers = {f"_v{k}": F.nanvl(F.col(v).cast("double"), F.lit(None)) for k, v in enumerate(values)}
    rows = channels.select(*[F.col(a).cast("string").alias(a) for a in atlases], *[c.alias(f"_f{k}") for k, c in enumerate(flags.values())], *[c.alias(n) for n, c in numbers.items()])
    rows = rows.unpivot([*[f"_f{k}" for k in range(len(flags))], *numbers], list(atlases), "atlas", "label").where("label is not null")
    counts = [F.count_if(f"_f{k}").alias(f"n_{name}") for k, name in enumerate(flags)]
    spread = [f(f"_v{k}").alias(f"{name}_{v}") for k, v in enumerate(values) for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return rows.groupBy("atlas", "label").agg(F.count(F.lit(1)).alias("n"), *counts, *spread)
