"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, decontaminate, html_text, line_dedup, nearest, packing, pii, quality, secret_scan, token_alignment, token_files
from .common import materialize, scratch_dir, table
from .ngram_join import similar_groups

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE_FILE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    both = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decoded="decoded")
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), path, special_as_text=False)
    return token_files.with_crc32(token_files.read_tokens(spark, path))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "label", "score", (F.col("score") >= quality.BOUND).alias("kept"))


def op10_pii_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal(table(spark, sf_dir, "documents")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all usable vectors of embeddings; see centroids.cluster for odd rows."""
    return centroids.digest(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece of every document; see packing.cut_pieces and packing.pack for odd rows."""
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of both tokenizers' tokens in every document; see token_alignment.align for odd rows."""
    docs = table(spark, sf_dir, "documents")
    aligned, counts = token_alignment.align(docs, public_tokenizers.path(BYTE_BPE_FILE), public_tokenizers.path(PIECE_BPE), public_tokenizers.PATTERN)
    measured = token_alignment.measures(aligned, counts, extra=("groups_sha256", token_alignment.group_digests))
    texts = materialize(measured, "alignment-measures")
    return token_alignment.to_documents(docs, texts).withColumn("groups_sha256", F.coalesce("groups_sha256", F.lit("")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_orc_token_files": op6_orc_token_files,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_pii_chain_field": op10_pii_chain_field,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_token_alignment": op13_token_alignment,
}

#: DuckDB SQL where SQL can express a query and is fast enough over the whole tables.
ORACLE: dict[str, str] = {"op5_line_dedup": line_dedup.ORACLE, "op11_centroid_clustering": centroids.oracle()}
