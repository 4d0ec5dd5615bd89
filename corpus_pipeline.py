"""A corpus pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmill.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from trialmill.llm.common import materialize, table
from trialmill.llm.queries import BYTE_BPE


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, null and blank texts with them; rows that repeat are judged alike.

    As for all stages, other columns pass through, an empty table gives an empty one, and texts of any length are judged whole.
    """
    return quality.keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites stay at their first place only; a document that loses all its words goes. n_chars follows.

    Null texts and texts without such lines stay as they are; a null source counts for no site.
    """
    left = line_dedup.dedup_lines(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id; of rows that repeat, one.

    Texts without words and rows without a doc_id stay.
    """
    return ngram_join.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away a benchmark item go; null and empty texts give none away and stay."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, and whether decoding them gives its text back; none for null and empty texts."""
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    both = byte_bpe.encode(docs, path, pattern, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_boilerplate),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

#: Model scores and similarity components have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
