"""Channel tables with lists of tags or atlas labels, and vectors as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tags_of(text: str, sep: str = "/") -> Column:
    """The tags of a list in text form; null stays null, an empty text has none."""
    return F.filter(F.split(text, rf"\Q{sep}\E"), lambda v: v != "")


def event_columns(df: DataFrame, text: str, names: Sequence[str], sep: str = "/") -> DataFrame:
    """df with the parts of a text as columns; a text of another number of parts is an error, a null text gives nulls."""
    parts = F.split(text, rf"\Q{sep}\E")
    wrong = F.raise_error(F.concat(F.lit(f"not {len(names)} parts: "), F.col(text))).cast("array<string>")
    kept = F.when(F.col(text).isNull() | (F.size(parts) == len(names)), parts).otherwise(wrong)
    return df.withColumn("_parts", kept).select("*", *[F.col("_parts")[k].alias(n) for k, n in enumerate(names)]).drop("_parts")


def without_tag(text: str, tag: str, sep: str = "/") -> Column:
    """A list in text form without a tag, its other tags in their order."""
    return F.array_join(F.array_remove(tags_of(text, sep), tag), sep)


def with_tag(text: str, tag: str, sep: str = "/") -> Column:
    """A list in text form with a tag at its end, unless it has it; a null list becomes the tag alone."""
    tags = F.coalesce(tags_of(text, sep), F.array().cast("array<string>"))
    return F.array_join(F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, tag)), sep)


def any_of(labels: str, wanted: Sequence[str]) -> Column:
    """Whether an array holds one of the wanted labels; false for null and empty arrays, nulls in them are passed over."""
    return F.coalesce(F.exists(F.col(labels), lambda v: F.coalesce(v.isin(*wanted), F.lit(False))), F.lit(False)) if wanted else F.lit(False)


def in_regions(channels: DataFrame, labels: str, rois: Sequence[str]) -> DataFrame:
    """Channels one of whose atlas labels is among the rois."""
    return channels.where(any_of(labels, rois))


def without_tagged(channels: DataFrame, labels: str, tags: Sequence[str]) -> DataFrame:
    """Channels none of whose tags is among the given ones; channels without tags stay."""
    return channels.where(~any_of(labels, tags))


def rotated(x: str, by: int) -> Column:
    """An array that starts with its element number by (from 0, modulo its length), the ones before it at its end."""
    at = F.pmod(F.lit(by), F.size(x))
    return F.when(F.size(x) > 0, F.concat(F.slice(x, at + 1, F.size(x)), F.slice(x, F.lit(1), at))).otherwise(F.col(x))
