"""Line deduplication by distinct-site spread.

A line's hash gets a HyperLogLog sketch of the sites that have it; sketches merge by aggregation, so a line that half of
all texts share meets no task as a group. Lines whose estimate is near the bound get exact distinct counts. Of a line
that at least min_sites sites have, the first occurrence (smallest doc_id, first place in it) stays and all others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

MIN_SITES = 5
#: log2 of a sketch's registers; the relative standard error is about 1.04 / 2^(LG_K / 2), 0.8 % here.
LG_K = 14
#: Estimates within this share of the bound are settled by exact counts; 5 standard errors.
NEAR = 0.05
#: Lines whose hashes are broadcast, 16 bytes each; above, they are joined.
MAX_LINES = 1 << 20
SEED = 42  # of Spark's xxhash64


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, site, line): the hash of every line that isn't blank, without spaces at its ends."""
    lines = docs.select("doc_id", "site", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "site", F.trim("line").alias("line"))
    return lines.where("line <> ''").select("doc_id", "site", F.xxhash64("line").alias("line"))


def widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, keep): hashes of lines on min_sites sites or more, and the smallest doc_id that has each.

    docs has doc_id, text and site; a null site counts for none.
    """
    lines = _lines(docs)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("keep"))
    spread = spread.select("line", "keep", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.where(F.col("sites") >= min_sites * (1 - NEAR) - 0.5), "lines")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR) + 0.5).select("line")
    wanted = F.broadcast(near) if small(near, MAX_LINES) else near
    exact = lines.join(wanted, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("exact"))
    return spread.join(exact, "line", "left").where(F.coalesce("exact", "sites") >= min_sites).select("line", "keep")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """docs with the text that is left, and two more columns, n_lines and n_removed (long; columns of these names give way).

    Lines are compared without spaces at their ends; blank lines stay and count as lines. A null text stays null and has
    no lines, an empty one has one. Rows that repeat the keeping doc_id each keep the line. A line whose only texts have
    no doc_id keeps nothing. Other columns pass through.
    """
    docs = docs.drop("n_lines", "n_removed")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(site).cast("string").alias("site"))
    drop = materialize(widespread_lines(named, min_sites), "widespread")
    if not small(drop, MAX_LINES):
        return _by_join(docs, drop)
    rows = drop.orderBy("line").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((rows["line"].to_numpy(np.int64), rows["keep"].astype("Int64").fillna(-(1 << 62)).to_numpy(np.int64)))
    names = docs.columns
    id_at, text_at = names.index("doc_id"), names.index("text")
    out = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(zip(shared.value[0].tolist(), shared.value[1].tolist()))
        digest = xxhash.xxh64_intdigest
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                texts, counts, removed = [], [], []
                for doc, text in zip(b.column(id_at).to_pylist(), b.column(text_at).to_pylist()):
                    lines = text.split("\n") if text is not None else []
                    left, once = [], set()
                    for line in lines:
                        core = line.strip(" ")
                        if core:
                            h = digest(core.encode(), SEED)
                            h -= (h >> 63) << 64
                            keep = table.get(h)
                            if keep is not None and (keep != doc or h in once):
                                continue
                            if keep is not None:
                                once.add(h)
                        left.append(line)
                    texts.append(None if text is None else "\n".join(left))
                    counts.append(len(lines))
                    removed.append(len(lines) - len(left))
                columns = list(b.columns)
                columns[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=out.names)

    return docs.mapInArrow(run, out)


def _by_join(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The same for any number of lines: places of dropped lines are joined to their texts by doc_id and text hash."""
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash")]
    placed = docs.select(*key, F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("line", F.xxhash64(F.trim("line")))
    hit = placed.join(drop, "line").distinct()
    first = hit.where("keep = _id").groupBy("_id", "_hash", "line").agg(F.min("place").alias("place"))
    hit = hit.join(first, ["_id", "_hash", "line", "place"], "left_anti")
    gone = hit.groupBy("_id", "_hash").agg(F.collect_set("place").alias("_gone"))
    rows = docs.withColumns({"_i": key[0], "_h": key[1]}).join(gone, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    lines = F.split("text", "\n")
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.filter(lines, lambda _, k: ~F.array_contains("_gone", k))))
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    counts["n_removed"] = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    return rows.withColumns(counts).withColumn("text", left).drop("_i", "_h", "_id", "_hash", "_gone")


ORACLE = f"""
WITH placed AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
wide AS (SELECT trim(line, ' ') AS core, min(doc_id) AS keep FROM placed WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT p.doc_id, p.place, p.line,
    w.core IS NOT NULL AND NOT (w.keep = p.doc_id AND row_number() OVER (PARTITION BY p.doc_id, trim(p.line, ' ') ORDER BY p.place) = 1) AS gone
  FROM placed p LEFT JOIN wide w ON w.core = trim(p.line, ' '))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
