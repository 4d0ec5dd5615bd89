"""Byte-level BPE encoding and decoding from a rank file.

Merges of a piece run on a segment tree over its byte positions: a leaf holds the rank of the pair that starts there, a
node the leftmost least of its leaves. A merge reads the root, then updates three leaves: the merged position, the
neighbour that it swallowed, and the live neighbour before it. A piece of n bytes thus costs O(n log n), also when it
is a whole text without a space. The trees of a batch of pieces of like size are rows of one array, and every step
merges a pair of each.

Texts, pieces and ids stay in flat arrays: the splitter gives the places where pieces start, Arrow numbers the distinct
pieces of a slice, and only those that are neither a token nor known from before are merged.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, text_buffer

#: Pieces whose ids a worker keeps, some 20 bytes each; all are dropped when there are more.
MAX_PIECES = 200_000
#: Bytes of the longest piece whose tree is a row among others; longer ones run alone.
LONG = 2048
#: Bytes of the trees of a batch; bounds the arrays of a step.
BATCH_BYTES = 4 << 20
# Fixed value: the splitting pattern for which pieces are found by character classes, without a regular expression.
CLASS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = range(5)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: letter, number, white space or other."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for base in range(0, len(kinds), 0x8000):
        if not 0xD800 <= base < 0xE000:  # a block holds the surrogates alone, or none
            every = "".join(map(chr, range(base, base + 0x8000 if base != 0x8000 else 0xD800)))
            for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
                for m in regex.finditer(pattern, every):
                    kinds[base + m.start() : base + m.end()] = kind
    return kinds


def _blocks(raw: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of bytes to split apart: they end with a text, or before a space that follows a visible character."""
    a, end = int(at[0]), int(at[-1])
    while a < end:
        b = end
        if end - a > limit:
            b = int(at[np.searchsorted(at, a + limit, side="right") - 1])
            if b <= a:  # within one text
                b = int(at[np.searchsorted(at, a, side="right")])
                x = raw[a : min(b, a + limit)]
                cut = np.flatnonzero((x[1:] == 32) & (x[:-1] > 32) & (x[:-1] < 127)) if b - a > limit else x[:0]
                if len(cut):
                    b = a + 1 + int(cut[-1])
                elif b - a > limit:  # no such place near: look for the first one further on
                    x = raw[a:b]
                    cut = np.flatnonzero((x[1:] == 32) & (x[:-1] > 32) & (x[:-1] < 127))
                    b = a + 1 + int(cut[0]) if len(cut) else b
        yield a, b
        a = b


def _starts_by_class(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets in raw where a piece of CLASS_PATTERN starts; texts start at the offsets at."""
    kinds, found = _kinds(), []
    for a, b in _blocks(raw, at, SLICE_BYTES):
        part = raw[a:b]
        points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        where = np.flatnonzero((part & 0xC0) != 0x80)
        kind, n = kinds[points], len(points)
        inside = at[np.searchsorted(at, a) : np.searchsorted(at, b)]
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(where, inside - a)] = True
        edge[[0, n]] = True
        before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[edge[:-1]], after[edge[1:]] = _EDGE, _EDGE
        space, plain = kind == _SPACE, points == 32
        led = np.zeros(n, bool)
        led[1:] = plain[:-1]
        led &= ~edge[:-1]
        # white space: its run starts a piece, and so does its last character if something follows
        start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != _EDGE)), (kind != before) & ~led)
        quote = np.flatnonzero((points == 39) & start)
        if len(quote):
            padded = np.append(np.where(edge[1:], 0, np.append(points[1:], 0)), [0, 0])  # the character that follows in the text
            one, two = padded[quote], np.where(padded[quote] > 0, padded[quote + 1], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[quote[short | long] + 1] = False
            ends = np.concatenate([quote[short] + 2, quote[long] + 3])
            ends = ends[ends < n]
            start[ends[kind[ends] == _LETTER]] = True
        found.append(where[start] + a)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class ByteBPE:
    """Token tables as arrays, and a store of the pieces that were merged last."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens, self.rank = pa.array(ranks, pa.binary()), np.array(list(ranks.values()), np.int32)
        #: Of each rank its place in tokens; -1 for none.
        self.place = np.full(int(self.rank.max()) + 1, -1, np.int64)
        self.place[self.rank] = np.arange(len(self.rank))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, of = array("q"), array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    of.append(rank)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys)[order], np.array(of)[order]
        self.pattern = pattern
        self.forget()

    def forget(self) -> None:
        """Drop the pieces that were merged."""
        self.by_pair: dict[int, int] | None = None
        self.known, self.known_ids, self.known_at = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; -1 for none."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_ranks[k], -1)

    def merge_alone(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of two bytes or more by a tree of its own, for pieces too long to find others like them."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        n, rank_of = len(piece), self.by_pair.get
        ids, after, before = self.single[np.frombuffer(piece, np.uint8)].tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        bits, size, none = n.bit_length(), 1 << (n - 1).bit_length(), 1 << 62

        def leaf(at: int) -> int:
            """The value of the pair that starts at a live position."""
            if at < 0 or after[at] >= n:
                return none
            rank = rank_of(ids[at] << 32 | ids[after[at]])
            return none if rank is None else rank << bits | at

        tree = [none] * size + [leaf(k) for k in range(n)] + [none] * (size - n)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while (best := tree[1]) != none:
            i = best & ((1 << bits) - 1)
            j = after[i]
            ids[i], after[i] = best >> bits, after[j]
            if after[j] < n:
                before[after[j]] = i
            for at, value in ((j, none), (i, leaf(i)), (before[i], leaf(before[i]))):
                if at >= 0:
                    at += size
                    tree[at] = value
                    while at > 1:
                        at >>= 1
                        a, b = tree[2 * at], tree[2 * at + 1]
                        least = a if a < b else b
                        if tree[at] == least:
                            break
                        tree[at] = least
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32)

    def merge_batch(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of two bytes or more, and how many each has, by one segment tree a row. Lengths should be alike."""
        rows = len(start)
        size = 1 << (int(length.max()) - 1).bit_length()
        width, bits = 2 * size, size.bit_length()
        place = np.arange(size)
        live = place < length[:, None]
        ids = self.single[flat[np.minimum(start[:, None] + place, len(flat) - 1)]]
        none = np.int64(1) << np.int64(62)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        tree = np.full((rows, width), none)
        tree[:, size : width - 1] = np.where((rank >= 0) & live[:, 1:], rank << bits | place[:-1], none)
        half = size
        while half > 1:
            np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
            half //= 2
        after, before = np.tile((place + 1).astype(np.int32), rows), np.tile((place - 1).astype(np.int32), rows)
        tree, ids, live = tree.reshape(-1), ids.reshape(-1), live.reshape(-1)
        r = np.flatnonzero(tree[1::width] != none)
        root, base, n = tree[r * width + 1], r * size, length[r]
        while len(r):
            i, own = root & ((1 << bits) - 1), root >> bits
            j = after[base + i]
            k, p = after[base + j], before[base + i]
            more, less = k < n, p >= 0
            ids[base + i], after[base + i], live[base + j] = own, k, False
            before[(base + k)[more]] = i[more]
            kk, pp = np.where(more, k, j), np.where(less, p, i)
            rank = self._ranks(np.concatenate([ids[base + pp], own]), np.concatenate([own, ids[base + kk]]))
            m = len(r)
            at = np.concatenate([j, pp, i])  # a first position has no neighbour before: pp is i then, and i's leaf is written last
            value = np.concatenate([np.full(m, none), np.where(less & (rank[:m] >= 0), rank[:m] << bits | pp, none), np.where(more & (rank[m:] >= 0), rank[m:] << bits | i, none)])
            tree_at = r * width
            trunk = np.concatenate([tree_at, tree_at, tree_at])
            tree[trunk + size + at] = value
            at = size + at
            while at[0] > 1:
                at >>= 1
                child = trunk + 2 * at
                tree[trunk + at] = np.minimum(tree[child], tree[child + 1])
            root = tree[tree_at + 1]
            on = root != none
            if not on.all():
                r, root, base, n = r[on], root[on], base[on], n[on]
        return ids[live].astype(np.int32), live.reshape(rows, size).sum(axis=1)

    def _merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any pieces of two bytes or more, and how many each has: batches of like length."""
        flat = np.frombuffer(pieces.buffers()[2], np.uint8)
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        start, length = offsets[:-1], np.diff(offsets)
        order = np.argsort(length, kind="stable")
        ordered, parts, a = length[order], [], 0
        while a < len(order):
            size = 1 << (int(ordered[a]) - 1).bit_length()
            if size > LONG:
                ids = self.merge_alone(flat[start[order[a]] : start[order[a]] + ordered[a]].tobytes())
                parts.append((ids, np.array([len(ids)])))
                a += 1
                continue
            b = min(int(np.searchsorted(ordered, size, side="right")), a + max(1, BATCH_BYTES // (16 * size)))
            parts.append(self.merge_batch(flat, start[order[a:b]], ordered[a:b]))
            a = b
        ids, count = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        # back to the order of pieces
        first = np.cumsum(count) - count
        back = np.argsort(order, kind="stable")
        count, first = count[back], first[back]
        return ids[_spread(first, count)], count

    def _numbers(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: an array of ids, and of each piece the place of its first and their number."""
        token = pc.index_in(pieces, self.tokens)
        other = np.flatnonzero(token.is_null().to_numpy(zero_copy_only=False))
        first, count = token.fill_null(0).to_numpy().astype(np.int64), np.ones(len(pieces), np.int64)
        if not len(other):
            return self.rank, first, count
        rest = pieces.take(pa.array(other))
        known = pc.index_in(rest, self.known)
        fresh = known.is_null().to_numpy(zero_copy_only=False)
        at = known.filter(known.is_valid()).to_numpy().astype(np.int64)
        new = rest.filter(known.is_null())
        ids, size = self._merge(new) if len(new) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        first[other[~fresh]], count[other[~fresh]] = len(self.rank) + self.known_at[at], np.diff(self.known_at)[at]
        first[other[fresh]], count[other[fresh]] = len(self.rank) + len(self.known_ids) + np.cumsum(size) - size, size
        pool = np.concatenate([self.rank, self.known_ids, ids])
        if len(self.known) + len(new) > MAX_PIECES:
            self.forget()
        self.known, self.known_ids = pa.concat_arrays([self.known, new]), np.concatenate([self.known_ids, ids])
        self.known_at = np.concatenate([self.known_at, self.known_at[-1] + np.cumsum(size)])
        return pool, first, count

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of some texts one after the other, and the bounds of each text's among them."""
        if self.pattern == CLASS_PATTERN:
            starts = _starts_by_class(raw, at) - at[0]
            offsets = np.append(starts, at[-1] - at[0]).astype(np.int32)
            data = pa.py_buffer(np.ascontiguousarray(raw[int(at[0]) : int(at[-1])]))
            return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), data]), np.searchsorted(starts, at - at[0])
        split, every, bounds = regex.compile(self.pattern), [], [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            every += [m[0].encode() for m in split.finditer(raw[a:b].tobytes().decode()) if m[0]]
            bounds.append(len(every))
        return pa.array(every, pa.binary()), np.array(bounds)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after the other, and the bounds of each text's; null counts as empty."""
        at, raw = text_buffer(column)
        if at[-1] == at[0]:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        pieces, bounds = self._pieces(raw, at)
        coded = pieces.dictionary_encode()
        pool, first, count = self._numbers(coded.dictionary)
        number = coded.indices.to_numpy()
        each = count[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        return pool[_spread(first[number], each)], ends[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each row's ids; an id that is no token is an error."""
        place = self.place[ids] if not len(ids) or 0 <= ids.min() and ids.max() < len(self.place) else np.full(1, -1)
        if len(place) and place.min() < 0:
            raise ValueError("an id is not in the rank file")
        tokens = self.tokens.take(pa.array(place))
        offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[bounds])), tokens.buffers()[2] if len(tokens) else pa.py_buffer(b"")])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] of them, for each k in turn."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


_loaded: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker process, some 15 MB without its store."""
    if (path, pattern) not in _loaded:
        _loaded.clear()
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with one more column, the token ids of each row's whole text (array<int>); null and empty texts give [].

    path is a rank file (base64 token and rank a line) and pattern the regular expression that splits texts before
    merges; for CLASS_PATTERN a faster splitter finds the same pieces. decoded: the name of another column for what the
    ids decode to (binary), as decode() gives it, found in the same pass. Existing columns of the new names are replaced;
    other columns pass through, rows that repeat are encoded alike, an empty table stays empty. Very long texts are
    encoded whole: their memory is some 40 times their bytes. Rows are independent: no shuffle.
    """
    more = [into] if decoded is None else [into, decoded]
    rest = [c for c in docs.columns if c != text and c not in more]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(text))
    out = docs.withColumns({c: F.lit(None).cast("array<int>" if c == into else "binary") for c in more}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for b in batches:
            for i, j in slices(text_buffer(b.column(len(rest)))[0], 2 * SLICE_BYTES):
                part = b.slice(i, j - i)
                ids, bounds = coder.encode(part.column(len(rest)))
                new = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if decoded is not None:
                    new.append(coder.decode(ids, bounds))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*b.schema.names, *more])
        coder.forget()

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with one more column, the bytes of each row's ids; null ids, and null elements, give no bytes.

    An unknown id is an error. An existing column of the new name is replaced; other columns pass through, rows that
    repeat are decoded alike, an empty table stays empty.
    """
    rest = [c for c in encoded.columns if c not in (ids, into)]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids}`").cast("array<int>").alias(ids))
    out = encoded.withColumn(into, F.lit(None).cast("binary")).schema
    known = F.filter(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")), lambda x: x.isNotNull())
    encoded = encoded.withColumn("_known", known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                column = part.column(len(rest) + 1)
                at = column.offsets.to_numpy()
                text = coder.decode(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest) + 1], text], names=[*b.schema.names[:-1], into])

    return encoded.mapInArrow(run, out)
