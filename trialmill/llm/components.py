"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours; edges holds both directions."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of links; root is the least node that it reaches.

    Each step is a pre-aggregated minimum per node and one join, so no node's neighbours meet in one task,
    and each result is written to the shared folder. Null ends and loops are left out. Ends when no link changes.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u is linked with u's least neighbour
        e = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked with the least of them; here each row has v < u
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(m, "u")
        e = e.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.select("u", F.col("m").alias("v")))
        e = materialize(e.where("u <> v").distinct(), "links")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first())
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    roots = roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return materialize(roots, "components")
