"""Packing of documents' token ids into sequences of a fixed length, by a configuration linear program.

A configuration is a multiset of piece lengths that fit one sequence. The program asks for the least number of
sequences so that the configurations taken hold each length as often as there are pieces of it. It sees only the
histogram of lengths (at most `capacity` counts, whatever the corpus) and is solved by multiplicative weights: each
length has a price that falls exponentially with the share of its pieces already covered, and a knapsack dynamic
program over the capacity prices configurations. The fractional solution is rounded down to whole sequences; what is
left goes into the best-fitting sequences in order of length, alike sequences as one entry with their number.

Spark cuts the texts into pieces, numbers the pieces of each length and gives each its place. A number is a count
within a task plus the counts of the tasks before, so that no length, however frequent, has to meet in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, slices, text_buffer
from .token_files import loaded

CAPACITY = 2048
#: Share of its pieces by which one run of the dynamic program covers a length at most, and how fast prices fall with it.
STEP, STEEP = 0.5, 2.0
#: By how much the price of a token is higher in the longest pieces at the start.
LONG = 0.2
#: Passes at most, how near to the bound they end, and how fast prices rise between them.
PASSES, CLOSE, RATE = 8, 0.002, 1.0
#: Roundings that are tried: shares of a sequence that a configuration must fill to be kept.
FULL = (1.0, 0.99, 0.97, 0.9, 0.0)

Config = tuple[tuple[int, int], ...]


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest total value of lengths within each capacity, and the length chosen last there; -1: a token stays free.

    value[l] is that of length l, -inf where there is none; lengths may repeat.
    """
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    gain = value[1 : capacity + 1]
    for c in range(1, capacity + 1):
        total = gain[:c] + best[:c][::-1]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], chosen[c] = total[k], k + 1
        else:
            best[c], chosen[c] = best[c - 1], -1
    return best, chosen


def _items(chosen: list[int], room: int) -> Counter:
    """The lengths behind the best value of a capacity."""
    out: Counter = Counter()
    while room > 0:
        if chosen[room] > 0:
            out[chosen[room]] += 1
        room -= abs(chosen[room])
    return out


def _pass(counts: np.ndarray, unit: np.ndarray, capacity: int, most: float) -> dict[Config, float]:
    """Configurations with their shares, which cover just counts[l] pieces of each length l, the dearest first.

    unit are the prices of lengths, most is the price of the dearest configuration. Within a pass, a length's price
    falls with the share of its pieces covered, so that configurations spread over all lengths. When none near the
    dearest is left, cheaper ones are taken as well.
    """
    lengths, loss = np.flatnonzero(counts), 0.0
    covered, taken = np.zeros(capacity + 1), {}
    base = unit * (1 + LONG * np.arange(capacity + 1) / capacity)
    while len(lengths):
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = base[lengths] * np.exp(-STEEP * covered[lengths])
        best, chosen = knapsack(value, capacity)
        path, before, found = chosen.tolist(), covered.copy(), False
        # the dearest configuration with each of the lengths, the dearest of these first
        for n in lengths[np.argsort(-(value[lengths] + best[capacity - lengths]), kind="stable")].tolist():
            config = _items(path, capacity - n)
            config[n] += 1
            size, times = np.array(list(config)), np.array(list(config.values()))
            if unit[size] @ times < (1 - loss) * most - 1e-9:
                continue
            share = float((counts[size] / times * (np.minimum(before[size] + STEP, 1) - covered[size])).min())
            if share > 1e-9:
                found = True
                covered[size] = covered[size] + share * times / counts[size]
                key = tuple(sorted(config.items(), reverse=True))
                taken[key] = taken.get(key, 0.0) + share
        if not found:
            loss = min(2 * loss + 0.5 / capacity, 1.0)
        lengths = lengths[covered[lengths] < 1 - 1e-9]
    return taken


def fractional(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[Config, float], float]:
    """A solution of the program, by configuration, and a lower bound of the program.

    Prices start in proportion to length. After each pass, lengths that were covered by cheap configurations become
    dearer, by multiplicative weights. Prices times counts, over the dearest configuration, bound the program from
    below; passes end when the best solution is close to the best bound.
    """
    if not counts.any():
        return {}, 0.0
    unit, held = np.arange(capacity + 1.0), counts > 0
    solution, least, bound = {}, np.inf, 0.0
    for _ in range(PASSES):
        most = float(knapsack(np.where(held, unit, -np.inf), capacity)[0][capacity])
        bound = max(bound, float(counts @ unit / most))
        taken = _pass(counts, unit, capacity, most)
        if sum(taken.values()) < least:
            solution, least = taken, sum(taken.values())
        if least <= bound * (1 + CLOSE):
            break
        lost = np.zeros(capacity + 1)
        for config, x in taken.items():
            missing = 1 - sum(k * unit[n] for n, k in config) / most
            for n, k in config:
                lost[n] += x * k * missing
        unit = unit * np.exp(RATE * lost / np.maximum(counts, 1))
    return solution, bound


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> Counter:
    """Whole configurations that hold all pieces: each piece, longest first, goes where the least room stays.

    Sequences that are filled alike are one entry with their number, so the work doesn't grow with the counts.
    """
    rooms: list[dict[Config, int]] = [{} for _ in range(capacity + 1)]
    filled = 0  # bit r: some sequence has room r

    def put(config: Config, n: int, k: int, room: int, times: int) -> int:
        config = (*config, (n, k)) if k else config
        rooms[room - n * k][config] = rooms[room - n * k].get(config, 0) + times
        return 1 << (room - n * k)

    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            fits = filled >> n
            room = n + (fits & -fits).bit_length() - 1 if fits else capacity
            config, times = rooms[room].popitem() if fits else ((), -(-left // (capacity // n)))
            if fits and not rooms[room]:
                filled &= ~(1 << room)
            each = room // n
            whole = min(times, left // each)
            rest = min(left - whole * each, each) if whole < times else 0
            # some get as many as fit, one the last few, the others stay as they are
            for k, m in ((each, whole), (rest, 1 if rest else 0), (0, times - whole - (1 if rest else 0))):
                if m:
                    filled |= put(config, n, k, room, m)
            left -= whole * each + rest
    return Counter({config: m for group in rooms for config, m in group.items()})


def rounded(counts: np.ndarray, shares: dict[Config, float], full: float, capacity: int = CAPACITY) -> Counter:
    """Whole sequences of the configurations that fill at least that share of one; what is left goes by best fit."""
    left, whole = counts.copy(), Counter()
    for config in sorted(shares, key=lambda x: (-shares[x], x)):
        times = min([int(shares[config] + 1e-6), *(int(left[n]) // k for n, k in config)])
        if times > 0 and sum(n * k for n, k in config) >= full * capacity:
            whole[config] = times
            for n, k in config:
                left[n] -= k * times
    return whole + best_fit(left, capacity)


def configurations(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[Config, int], float]:
    """How often each configuration is used, so that every piece has just one place, and the program's lower bound."""
    part = counts.astype(np.int64).copy()
    part[capacity] = 0  # a piece of full length has a sequence of its own
    shares, bound = fractional(part, capacity)
    whole = min((rounded(part, shares, full, capacity) for full in FULL), key=lambda x: x.total())
    if counts[capacity]:
        whole[((capacity, 1),)] = int(counts[capacity])
    return dict(whole), int(counts[capacity]) + bound


class Places:
    """Where the pieces of each length go, by their number among those of that length."""

    def __init__(self, whole: dict[Config, int]) -> None:
        used: Counter = Counter()
        rows, sequence = [], 0
        for config, times in sorted(whole.items(), reverse=True):
            offset = 0
            for n, k in config:
                rows.append((n << 48 | used[n], k, sequence, offset))
                used[n] += k * times
                offset += n * k
            sequence += times
        rows.sort()
        self.first, self.each, self.sequence, self.offset = (np.array([x[i] for x in rows], np.int64) for i in range(4))

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        at = np.searchsorted(self.first, length << 48 | number, side="right") - 1
        copy, slot = np.divmod(number - (self.first[at] & (1 << 48) - 1), self.each[at])
        return self.sequence[at] + copy, self.offset[at] + slot * length


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and end_id after them, cut every `capacity` ids.

    ids (binary) holds little-endian unsigned 32-bit integers. docs has doc_id and text, other columns are ignored. A null
    or empty text is end_id alone; a null doc_id and rows that repeat are pieces like any other. Texts are encoded whole;
    start counts the document's ids before the piece.
    """
    schema = "doc_id long, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer_path, special_as_text)
        for b in batches:
            for i, j in slices(text_buffer(b.column(1))[0], 8 * SLICE_BYTES):
                count, flat = encoder.encode(b.column(1).slice(i, j - i), [end_id])
                pieces = -(-count // capacity)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(count[doc] - piece * capacity, capacity)
                at = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(flat.astype("<u4"))])
                columns = [b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset (long) of each: pieces of a sequence follow each other from 0 without gaps.

    pieces has length (1 to capacity; others are an error) and any other columns, which pass through, but for
    sequence_id, offset, task_, row_ and rank_, which are replaced. An empty table gives an empty one. Rows are written
    once, with their task, so that numbers stay when an executor is lost; the driver sees the histogram only.
    """
    pieces = pieces.drop("sequence_id", "offset", "task_", "row_", "rank_").withColumn("length", F.col("length").cast("long"))
    rows = materialize(pieces.withColumns({"task_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()}), "pieces")
    by_task = rows.groupBy("task_", "length").agg(F.count(F.lit(1)).alias("n_"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n_")).collect():
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} doesn't fit a sequence of {capacity}")
        counts[length] = n
    places = rows.sparkSession.sparkContext.broadcast(Places(configurations(counts, capacity)[0]))
    # a piece's number: the pieces of its length in earlier tasks, and in earlier rows of its own
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("task_", "length").orderBy("row_")) - 1
    placed = rows.withColumn("rank_", own).join(by_task.select("task_", "length", before.alias("before_")), ["task_", "length"])
    rest = pieces.columns
    out = pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")).schema
    at = rest.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.of(b.column(at).to_numpy(), b.column(len(rest)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(sequence), pa.array(offset)], names=out.names)

    return placed.select(*rest, (F.col("rank_") + F.col("before_")).alias("rank_")).mapInArrow(run, out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most `capacity` ids each, in binary as packed has them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"))
