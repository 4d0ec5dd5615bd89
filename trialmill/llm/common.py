"""Shared helpers: text tables, shared scratch folders, and word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at a time; bounds the arrays of a task.
SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Where that is unset, a folder of this machine will do for a local master only; on a cluster it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and any executor can read it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written meanwhile hands Python so many rows at a time, or fewer if the session says so; its setting comes back at the end.

    Spark forms each Arrow batch outside the heap, and once more in the buffer that it sends, so that 10,000 rows of texts or
    token arrays take an executor some hundred MB that malloc doesn't give back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialize wrote for these tables; only for tables whose readers have all been materialized."""
    for table in tables:
        path = getattr(table, "_written_to", None) if table is not None else None
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return what this process has freed to the system; malloc and Arrow's pool else keep it for as long as the driver runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every system's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; different seeds give different orders of the same values."""
    h = h + np.uint64((seed * 2 + 1) * _ODD & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, SLICE_BYTES), base & _MASK, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)


class Words:
    """Words of some consecutive texts: row, byte bounds within the slice, and a 64-bit hash of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> None:
        self.base = int(offsets[0])
        raw = data[self.base : int(offsets[-1])]
        self.bytes = _LOWER[raw] if lower else raw
        self.at = offsets - self.base
        n = len(self.bytes)
        self.rows = len(offsets) - 1
        solid = ~_SPACE[self.bytes]
        edge = np.zeros(n + 1, bool)
        edge[self.at[:-1]] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.at, self.start, side="right") - 1
        if n:
            up, down = _power_table(_ODD, n), _power_table(pow(_ODD, -1, 1 << 64), n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.bytes] * up[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        #: Of each row, the index of its first word, and one more.
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of at most so many bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    offsets, data = text_buffer(column)
    for i, j in slices(offsets):
        yield i, j, Words(offsets[i : j + 1], data, lower)


def window_hashes(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each window of so many words; a row of fewer words, but some, is one window."""
    n = len(w.hash)
    mult = np.resize(_MULT, width) + np.arange(width, dtype=np.uint64) * np.uint64(2)
    if n >= width:
        ok = w.row[: n - width + 1] == w.row[width - 1 :]
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h += w.hash[k : n - width + 1 + k] * mult[k]
        rows, h = w.row[: n - width + 1][ok], mix(h[ok], 3)
    else:
        rows, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        with np.errstate(over="ignore"):
            extra = np.array([(w.hash[w.first[r] : w.first[r + 1]] * mult[: count[r]]).sum(dtype=np.uint64) for r in short], np.uint64)
        rows, h = np.concatenate([rows, short]), np.concatenate([h, mix(extra, 11)])
        order = np.argsort(rows, kind="stable")
        rows, h = rows[order], h[order]
    return rows, h


def shingle_sets(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Bounds per row, and each row's distinct shingle hashes in ascending order."""
    rows, h = window_hashes(w, width)
    at = np.searchsorted(rows, np.arange(w.rows + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[keep], h[keep]
    return np.searchsorted(rows, np.arange(w.rows + 1)), h


def content_keys(w: Words) -> np.ndarray:
    """A hash of each row's sequence of words; 0 for none."""
    out = np.zeros(w.rows, np.uint64)
    if len(w.hash):
        k = np.arange(len(w.hash)) - w.first[w.row]
        values = mix(w.hash ^ mix(k.astype(np.uint64), 5), 9)
        filled = np.flatnonzero(np.diff(w.first) > 0)
        out[filled] = mix(np.add.reduceat(values, w.first[filled]), 13) | np.uint64(1)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Covered:
    """Spans (start, end) as disjoint runs in order, to ask whether another span touches any."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one above that."""
    return df.limit(rows + 1).agg(F.count(F.lit(1))).first()[0] <= rows
