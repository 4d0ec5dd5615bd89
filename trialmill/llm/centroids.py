"""Exact centroid clustering of integer vectors by a tournament over the bisectors of centroid pairs.

For centroids a and b, |x-a|^2 > |x-b|^2 holds just when 2x(b-a) > |b|^2 - |a|^2. Normals 2(b-a) and thresholds are
integers, computed once a round for all pairs. Each vector goes through k-1 sign tests: the present winner meets the
next centroid, and the sign tells which of them is out; zero keeps the smaller number. Only the distance to the last
winner is computed. Sums, too, are exact integers, in limbs, so that any order of tasks gives the same centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, DIMS = 1024, 64
#: Bits of a limb of a sum; a long holds the limbs of 2^23 tasks.
LIMB = 40
#: Rows of an Arrow batch that are handled together.
ROWS = 4096
_LONG = 1 << 63


def floors(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's where these are too small. scale is a power of two."""
    if not values.size or np.abs(values).max() < (1 << 62) / scale:
        return np.floor(values * scale).astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _exact(bound: int) -> type:
    """A type in which integers up to the bound are exact: doubles (fastest), 64-bit, else Python's integers."""
    return np.float64 if bound < 1 << 53 else np.int64 if bound < _LONG else object


class Bisectors:
    """Normals and thresholds of all pairs of centroids, and the tournament over them."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = c = centroids.astype(object)
        self.normals = {(i, j): 2 * (c[j] - c[i]) for j in range(len(c)) for i in range(j)}
        squares = [int((x * x).sum()) for x in c]
        self.thresholds = {(i, j): squares[j] - squares[i] for i, j in self.normals}
        self.steepest = max([1, *(_most(x) for x in self.normals.values())])
        self.reach = _most(c)
        self.furthest = max([0, *map(abs, self.thresholds.values())])

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row."""
        kind = _exact(max(_most(x) * self.steepest * x.shape[1], self.furthest))
        x, winner = x.astype(kind), np.zeros(len(x), np.int32)
        for j in range(1, len(self.centroids)):
            for i in range(j):
                rows = np.flatnonzero(winner == i)
                if len(rows):
                    out = x[rows] @ self.normals[i, j].astype(kind) > np.array(self.thresholds[i, j], kind)
                    winner[rows[out.astype(bool)]] = j
        return winner

    def distances(self, x: np.ndarray, winner: np.ndarray) -> list[int | None]:
        """Squared distance to the winner; None where it is beyond a long."""
        kind = _exact(x.shape[1] * (_most(x) + self.reach) ** 2)
        gap = x.astype(kind) - self.centroids.astype(kind)[winner]
        return [int(d) if d < _LONG else None for d in (gap * gap).sum(axis=1).tolist()]


def _limbs(total: list[int], n: int) -> list[list[int]]:
    """n limbs of each integer, least first; the last keeps the sign."""
    out = []
    for _ in range(n - 1):
        out.append([t & (1 << LIMB) - 1 for t in total])
        total = [t >> LIMB for t in total]
    return [*out, total]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dims)


def usable(vectors: DataFrame, dims: int = DIMS, column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of just so many components, none null, NaN or infinite."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dims) & finite)


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the least sha256 of `seed:vec_id`, in that order; equal ids by their components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return floors(np.array([r.v for r in rows], np.float64))


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of each centroid's vectors; a centroid without vectors stays.

    Each task sends one row for a centroid and limb. Spark sums them; the driver gets the sums of k centroids.
    """
    dims, bisectors = centroids.shape[1], Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for b in batches:
            for at in range(0, len(b), ROWS):
                x = floors(_matrix(b.column(0).slice(at, ROWS), dims))
                winner = bisectors.winners(x)
                kind = np.int64 if _most(x) * len(x) < _LONG else object
                for c in np.unique(winner).tolist():
                    rows = x[winner == c].astype(kind)
                    counts[c] = counts.get(c, 0) + len(rows)
                    sums[c] = [a + int(s) for a, s in zip(sums.get(c, [0] * dims), rows.sum(axis=0).tolist())]
        if sums:
            n = max(2, -(-max(t.bit_length() + 1 for x in sums.values() for t in x) // LIMB))
            rows = [(c, k, counts[c] if k == 0 else 0, limb) for c in sums for k, limb in enumerate(_limbs(sums[c], n))]
            names = ["cluster", "limb", "n", *(f"s{i}" for i in range(dims))]
            columns = [[r[i] for r in rows] for i in range(3)] + [[r[3][i] for r in rows] for i in range(dims)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i < 2 else pa.int64()) for i, x in enumerate(columns)], names=names)

    schema = "cluster int, limb int, n long, " + ", ".join(f"s{i} long" for i in range(dims))
    found = kept.select("v").mapInArrow(run, schema).groupBy("cluster", "limb").agg(F.sum("n"), *(F.sum(f"s{i}") for i in range(dims))).collect()
    out = centroids.astype(object)
    for c in {r[0] for r in found}:
        rows = [r for r in found if r[0] == c]
        count = sum(r[2] for r in rows)
        out[c] = [sum(r[3 + i] << LIMB * r[1] for r in rows) // count for i in range(dims)]
    return out


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dims, bisectors = centroids.shape[1], Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                x = floors(_matrix(b.column(1).slice(at, ROWS), dims))
                winner = bisectors.winners(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS), pa.array(winner), pa.array(bisectors.distances(x, winner), pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = DIMS, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of each kept vector, and the final centroids.

    vectors has vec_id and a vector column; other columns are ignored. Vectors that are null, of another length or hold
    null or non-finite components take no part. Rows that repeat a vec_id each count, as do rows without one. With fewer
    than k vectors there are as many centroids; without any, the result is empty. Components are exact at any size: where
    a distance, or a sum of distances, is beyond a long, it is null. Each round reads the vectors once and shuffles k
    rows a task; only the k centroids come to the driver.
    """
    kept = usable(vectors, dims, column)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia").where("false"), centroids
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    assigned = assign(kept, centroids)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), total).alias("sum_"))
    whole = sums.agg(F.when(F.count("sum_") == F.count(F.lit(1)), F.sum("sum_")).alias("all_"))
    sums = sums.crossJoin(F.broadcast(whole)).select("cluster", F.expr("try_cast(sum_ as long)").alias("cluster_inertia"), F.expr("try_cast(all_ as long)").alias("inertia"))
    return assigned.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def digest(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """clustered with centroid_sha256 of each vector's final centroid."""
    hashes = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    known = F.array(*map(F.lit, hashes)) if hashes else F.array().cast("array<string>")
    return clustered.withColumn("centroid_sha256", F.get(known, F.col("cluster")))


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = DIMS) -> str:
    """The same in DuckDB's SQL: one round after the other, components as rows."""
    head = f"""WITH raw AS MATERIALIZED (SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 c, v m FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) h, v FROM raw ORDER BY 1, 2 LIMIT {k}))"""
    parts = [head]
    near = "SELECT r.vec_id, r.v, arg_min(c, (d, c)) c, min(d) d FROM (SELECT r.rowid_, c, list_sum(list_transform(list_zip(r.v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT d FROM numbered r, {c}) JOIN numbered r USING (rowid_) GROUP BY rowid_, r.vec_id, r.v"
    parts.append("numbered AS MATERIALIZED (SELECT row_number() OVER () rowid_, * FROM raw)")
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        floor_mean = "(((s - ((s % n) + n) % n)) // n)::BIGINT"
        parts.append(f"""m{i} AS MATERIALIZED (SELECT c, list({floor_mean} ORDER BY i) m FROM (SELECT c, i, sum(x) s, count(*)::HUGEINT n FROM (SELECT c, unnest(v) x, generate_subscripts(v, 1) i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.m, c{i}.m) m FROM c{i} LEFT JOIN m{i} USING (c))""")
    parts.append(f"z AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return ",\n".join(parts) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN c{rounds} USING (c)"""
