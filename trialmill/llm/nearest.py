"""Approximate nearest neighbours by a few 2-stable projections and a kd-tree.

Vectors are dealt to parts of bounded size. In each part they are projected on DIMS Gaussian directions, and a kd-tree
over the projections is cut into leaves. A query meets the leaves in order of their projected distance, and the vectors
in them are verified by their true distance. For a vector at distance d, squared projected distance over d^2 follows a
chi-square law with DIMS degrees of freedom; the search stops once a vector that is nearer than the present k-th one
would, with probability SURE, have been met. Every vector is in the index.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMS = 8
SURE = 0.97
LEAF = 64
#: Vectors of a part, and queries of a block; each task holds one of each.
PART, BLOCK = 20_000, 1 << 14
#: Leaves that are verified together.
STEP = 6


def chi_square_cdf(x: np.ndarray | float, even: int = DIMS) -> np.ndarray | float:
    """For an even number of degrees of freedom: 1 - exp(-x/2) times the first terms of exp(x/2)."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(even // 2))


class KdTree:
    """Leaves of a kd-tree: rows in leaf order, the bounds of each leaf, and its box."""

    def __init__(self, points: np.ndarray) -> None:
        order, stack, bounds = np.arange(len(points)), [(0, len(points))], []
        while stack:
            a, b = stack.pop()
            if b - a <= LEAF:
                bounds.append((a, b))
                continue
            here = points[order[a:b]]
            axis, mid = int(np.ptp(here, axis=0).argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(here[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.order, self.bounds = order, sorted(x for x in bounds if x[1] > x[0])
        boxes = [points[order[a:b]] for a, b in self.bounds]
        self.low, self.high = np.array([x.min(axis=0) for x in boxes]), np.array([x.max(axis=0) for x in boxes])

    def leaves(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf numbers by their squared distance from point, and these distances."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (gap * gap).sum(axis=1)
        by = np.argsort(far, kind="stable")
        return by, far[by]


def directions(length: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, DIMS))


def search_part(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Of each query, its k nearest of this part that are found: by distance, ties to the smaller id."""
    found = []
    project = directions(vectors.shape[1])
    tree = KdTree(vectors @ project)
    ids, vectors = ids[tree.order], vectors[tree.order]
    for qid, q, p in zip(query_ids.tolist(), queries, queries @ project):
        by, far = tree.leaves(p)
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, len(by), STEP):
            # what is still unseen lies at least this far away in the projection
            if len(best_d) == k and (best_d[-1] == 0 < far[at] or best_d[-1] > 0 and chi_square_cdf(far[at] / best_d[-1] ** 2) >= SURE):
                break
            rows = np.concatenate([np.arange(*tree.bounds[x]) for x in by[at : at + STEP]])
            rows = rows[ids[rows] != qid]
            gap = vectors[rows] - q
            d = np.sqrt((gap * gap).sum(axis=1))
            if len(best_d) == k:
                near = d <= best_d[-1]
                d, rows = d[near], rows[near]
            d, i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[rows]])
            top = np.lexsort((i, d))[:k]
            best_d, best_i = d[top], i[top]
        found.append(pd.DataFrame({"query_id": qid, "vec_id": best_i, "score": best_d}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector that isn't null, empty or zero and has finite components only."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query, by Euclidean distance in doubles.

    vectors and queries have vec_id and a vector column; other columns are ignored. A vector of the query's own vec_id is
    no candidate, nor are vectors of another length. Unusable vectors take no part. Ties go to the smaller vec_id; of
    rows that repeat a vec_id each counts. Queries without candidates give no rows. Index parts and query blocks are
    dealt by hash, so equal vectors spread evenly, and a task holds one part and one block.
    """
    found, asked = usable(vectors, column), usable(queries, column)
    parts = max(1, -(-found.count() // PART))
    blocks = max(1, -(-asked.count() // BLOCK))
    size = F.size("v").alias("length")
    part, block = F.pmod(F.xxhash64("vec_id"), F.lit(parts)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    left = found.select("vec_id", "v", size, part.cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("vec_id", "v", size, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.cast("int").alias("block"))
    key = ["length", "part", "block"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_part(a["vec_id"].to_numpy(np.int64), np.stack(a["v"].to_list()).astype(float), b["vec_id"].to_numpy(np.int64), np.stack(b["v"].to_list()).astype(float), k)

    each = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
