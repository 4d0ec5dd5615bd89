"""Alignment of two tokenizers' tokens, and how often their ids are linked over the whole corpus.

Texts are shuffled by their full text, so that each distinct one is tokenised and aligned once; its links count as
often as documents have it, and its measures are joined to their doc_ids. The places where tokens of both sides end cut
a text into groups; a token of the one side is linked with each token of the other that shares its group.

Counts of id pairs are sums over distinct texts. The most frequent pairs, a bounded number of them, are broadcast as
sorted arrays, in which tasks look up the links of whole texts; links of all other pairs meet their counts in a join.
So no frequent pair is a join key, and the broadcast doesn't grow with the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, slices, text_buffer

#: Bits of a pair's number that hold the id of the second tokenizer.
BITS = 15
#: Pairs that are broadcast at most, 13 bytes each.
FREQUENT = 1 << 20
#: Tokens of A whose links are handled together, or those of one longer text.
TOKENS = 1 << 17
#: Texts that are in more documents than this, and in more than a 2^-14th of all, are joined by broadcast: fewer than 2^14.
COPIES = 1000
LISTS = ["ids_a", "ids_b", "ends_a", "ends_b"]
_MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Encoders:
    """Both tokenizers, and the bytes of their tokens.

    A is a byte-level BPE file of the tokenizers library whose merges are in the order of ids: then ids are ranks, and
    tiktoken's engine gives the library's ids at several times its speed. Texts with long runs of white space, in which
    that engine's splitting recurses, go through the library itself. B is a sentencepiece model with byte fallback.
    """

    def __init__(self, path_a: str, path_b: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        self.path_a = path_a
        with open(path_a, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        special = {x["content"] for x in whole["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        for at, merge in enumerate(model["merges"]):
            if model["vocab"]["".join(merge if isinstance(merge, list) else merge.split(" "))] != at + 256:
                raise ValueError("ids of the first tokenizer aren't in the order of its merges")
        self.fast = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        if len(self.bytes_a) > 1 << 16 or len(self.bytes_b) > 1 << BITS:
            raise ValueError(f"the tokenizers have more than {1 << 16} and {1 << BITS} ids")
        self.spelt_a, self.spelt_b = Spelling(self.bytes_a), Spelling(self.bytes_b)

    @cached_property
    def plain(self):
        """The library's own tokenizer; few texts need it."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path_a)
        found.encode_special_tokens = True
        return found

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        return self.pieces.id_to_piece(i).replace("▁", " ").encode()

    def first(self, text: str) -> list[int] | np.ndarray:
        if _long_space(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def aligned(self, texts: list[str]) -> tuple[list[int], list[list[bytes]]]:
        """The numbers of the texts whose tokens give a space and the text back on both sides, and their LISTS."""
        spaced = [" " + x for x in texts]
        data = [x.encode() for x in spaced]
        rows = np.arange(len(texts))
        a = [np.asarray(self.first(x), np.int64) for x in spaced]
        b = [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]
        for spelt, sides in ((self.spelt_a, a), (self.spelt_b, b)):
            rows = spelt.same(rows, sides, data)
        a, b = [a[r] for r in rows], [b[r] for r in rows]
        # places where tokens end, over the bytes of all texts one after the other
        ends_a, ends_b = (np.cumsum(s.size[np.concatenate([np.zeros(0, np.int64), *x])]) for s, x in ((self.spelt_a, a), (self.spelt_b, b)))
        last = []
        for one, other in ((ends_a, ends_b), (ends_b, ends_a)):
            marked = np.zeros(int(other[-1]) + 1 if len(other) else 1, bool)
            marked[other] = True
            last.append(marked[one])
        flags = [np.split(f, np.cumsum([len(v) for v in x])[:-1]) if x else [] for f, x in zip(last, (a, b))]
        ids = [[v.astype("<u2").tobytes() for v in x] for x in (a, b)]
        return rows.tolist(), [*ids, *([np.packbits(f).tobytes() for f in x] for x in flags)]


class Spelling:
    """The bytes of a vocabulary's tokens, one after the other."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def same(self, rows: np.ndarray, ids: list[np.ndarray], data: list[bytes]) -> np.ndarray:
        """Those of some rows whose ids spell their data."""
        lengths = np.array([len(data[r]) for r in rows], np.int64)
        sizes = np.array([self.size[ids[r]].sum() for r in rows], np.int64)
        rows, lengths = rows[sizes == lengths], lengths[sizes == lengths]
        if not len(rows):
            return rows
        flat = np.concatenate([ids[r] for r in rows])
        n = self.size[flat]
        spelt = self.flat[np.arange(int(n.sum())) + np.repeat(self.start[flat] - (np.cumsum(n) - n), n)]
        wrong = spelt != np.frombuffer(b"".join(data[r] for r in rows), np.uint8)
        return rows[np.add.reduceat(wrong, np.cumsum(lengths) - lengths) == 0]


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of byte-level vocabularies: printable Latin-1 is itself, the rest follows from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


def _long_space(text: str, most: int = 2000) -> bool:
    import re

    return len(text) > most and re.search(rf"\s{{{most}}}", text) is not None


_loaded: dict[tuple[str, str, str], Encoders] = {}


def encoders(path_a: str, path_b: str, pattern: str) -> Encoders:
    if (path_a, path_b, pattern) not in _loaded:
        _loaded[path_a, path_b, pattern] = Encoders(path_a, path_b, pattern)
    return _loaded[path_a, path_b, pattern]


def align_distinct(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """(key, copies, ids_a, ids_b, ends_a, ends_b): each distinct text that has tokens on both sides, aligned once.

    key is the text's sha256, copies the number of rows with it. ids are little-endian unsigned 16-bit integers, ends a bit
    for each token, set where a group ends (the first token is the highest bit of the first byte). Null and empty texts, and
    such whose tokens don't give a space and the text back, are left out.
    """
    schema = "key binary, copies long, ids_a binary, ids_b binary, ends_a binary, ends_b binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(path_a, path_b, pattern)
        for b in batches:
            for i, j in slices(text_buffer(b.column(0))[0], 2 * SLICE_BYTES):
                rows, lists = both.aligned(b.column(0).slice(i, j - i).to_pylist())
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i).take(at) for n in (1, 2)), *(pa.array(x, pa.binary()) for x in lists)], names=["key", "copies", *LISTS])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select("text", F.unhex(F.sha2("text", 256)).alias("key"), "copies").mapInArrow(run, schema)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column, from its first row on."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def _side(ids: pa.Array, ends: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tokenizer: offsets of rows, ids and flags of group ends, of all tokens of some texts."""
    at, data = _bytes(ids)
    at = at // 2
    bit_at, bits = _bytes(ends)
    place = np.arange(at[-1]) + np.repeat(8 * bit_at[:-1] - at[:-1], np.diff(at))
    return at, data.view("<u2").astype(np.int64), np.unpackbits(bits)[place].astype(bool)


class Links:
    """The links of some texts: row, pair (A's id and B's in one number) and number of links of each distinct pair of a group."""

    def __init__(self, ids_a: pa.Array, ids_b: pa.Array, ends_a: pa.Array, ends_b: pa.Array) -> None:
        (at_a, a, last_a), (at_b, b, last_b) = _side(ids_a, ends_a), _side(ids_b, ends_b)
        na, nb = (np.diff(np.flatnonzero(x), prepend=-1) for x in (last_a, last_b))
        groups = np.concatenate([[0], np.cumsum(last_a)])[at_a]
        #: Numbers of tokens of A and B and of groups of each row.
        self.sizes = np.diff(at_a), np.diff(at_b), np.diff(groups)
        group_row = np.repeat(np.arange(len(ids_a)), self.sizes[2])
        (ga, a, ka), (gb, b, kb) = self._distinct(a, na), self._distinct(b, nb)
        # of each distinct id of A, all distinct ids of B in its group
        many = np.bincount(gb, minlength=len(na))
        first = np.cumsum(many) - many
        each = many[ga]
        other = np.arange(int(each.sum())) + np.repeat(first[ga] - (np.cumsum(each) - each), each)
        self.row = np.repeat(group_row[ga], each)
        self.pair = np.repeat(a << BITS, each) | b[other]
        self.links = np.repeat(ka, each) * kb[other]

    @staticmethod
    def _distinct(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, id and number of the distinct ids of each group; groups ascend."""
        group = np.repeat(np.arange(len(sizes)), sizes)
        count = np.ones(len(ids), np.int64)
        mixed = np.flatnonzero(sizes[group] > 1)
        if not len(mixed):
            return group, ids, count
        code, many = np.unique(group[mixed] << 32 | ids[mixed], return_counts=True)
        single = np.flatnonzero(sizes[group] == 1)
        group = np.concatenate([group[single], code >> 32])
        ids = np.concatenate([ids[single], code & (1 << 32) - 1])
        count = np.concatenate([count[single], many])
        order = np.argsort(group, kind="stable")
        return group[order], ids[order], count[order]

    def by_row(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and pair, each pair of a row once."""
        code = np.unique(self.row << 32 | self.pair)
        return code >> 32, code & (1 << 32) - 1


def _linked(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, Links]]:
    """Links of runs of rows, by the columns from `at` on."""
    for i, j in slices(_bytes(b.column(at))[0], 2 * TOKENS):
        yield i, j, Links(*(b.column(at + n).slice(i, j - i) for n in range(4)))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each pair of ids is linked, and if none of the same A id is in more.

    pair is A's id times 2^15 plus B's. One row for each pair that occurs: their number is bounded by the vocabularies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies = b.column(0).to_numpy()
            for i, j, links in _linked(b, 1):
                row, pair = links.by_row()
                order = np.argsort(pair, kind="stable")
                total = np.concatenate([[0], np.cumsum(copies[i:j][row[order]])])
                values, first = np.unique(pair[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.diff(total[np.append(first, len(pair))]))], names=["pair", "docs"])

    parts = aligned.select("copies", *LISTS).mapInArrow(run, "pair long, docs long")
    counts = parts.groupBy("pair").agg(F.sum("docs").alias("docs"))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(F.shiftright("pair", BITS))))


def _frequent(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The pairs of at least so many documents as sorted arrays, at most `most` of them, and that number."""
    levels = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("level")).count()
    least, seen = 1, 0
    for power, n in levels.orderBy(F.col("level").desc()).collect():
        if seen + n > most:
            least = 1 << (power + 1)
            break
        seen += n
    rows = counts.where(F.col("docs") >= least).toArrow().sort_by("pair")
    return tuple(rows.column(c).to_numpy() for c in ("pair", "docs", "best")), least


def measures(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT, extra: tuple[str, Callable[..., list[str]]] | None = None) -> DataFrame:
    """(key, copies, n_a, n_b, n_groups, n_links, n_best, count_sum) of each text, all measures long, and one more column.

    n_links counts links; n_best those whose pair is the most frequent of its A id, ties included; count_sum adds up the
    documents of the links' pairs. extra names a string column, and what makes it of some rows' ids_a, ids_b, ends_a and
    ends_b. aligned and counts are read several times and should be written tables.
    """
    known, least = _frequent(counts, frequent)
    known = aligned.sparkSession.sparkContext.broadcast(known)
    names = ["key", "copies", *_MEASURES, *([extra[0]] if extra else [])]
    schema = "key binary, copies long, " + ", ".join(f"{c} long" for c in _MEASURES) + (f", {extra[0]} string" if extra else "")

    def look_up(links: Links) -> tuple[np.ndarray, np.ndarray]:
        """Where each link's pair is among the known ones, and whether it is there."""
        pairs = known.value[0]
        own, back = np.unique(links.pair, return_inverse=True)  # sorted: the search walks through the known pairs once
        at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
        hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
        return at[back], hit[back]

    def by_row(rows: int, row: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])  # rows ascend
        return np.diff(total[np.searchsorted(row, np.arange(rows + 1))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, links in _linked(b, 2):
                at, hit = look_up(links)
                docs = np.where(hit, known.value[1][at] * links.links, 0) if len(known.value[0]) else np.zeros(len(at), np.int64)
                best = np.where(hit & known.value[2][at], links.links, 0) if len(known.value[0]) else docs
                own = [b.column(n).slice(i, j - i) for n in range(6)]
                numbers = [*links.sizes, *(by_row(j - i, links.row, x) for x in (links.links, best, docs))]
                more = [pa.array(extra[1](*own[2:]), pa.string())] if extra else []
                yield pa.RecordBatch.from_arrays([*own[:2], *map(pa.array, numbers), *more], names=names)

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, links in _linked(b, 1):
                rest = ~look_up(links)[1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(links.row[rest])), pa.array(links.pair[rest]), pa.array(links.links[rest])], names=["key", "pair", "links"])

    out = aligned.select("key", "copies", *LISTS).mapInArrow(found, schema)
    if least == 1:
        return out
    rare = aligned.select("key", *LISTS).mapInArrow(missed, "key binary, pair long, links long")
    rare = rare.groupBy("key", "pair").agg(F.sum("links").alias("links")).join(counts.where(F.col("docs") < least), "pair")
    more = rare.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best_"), F.sum(F.col("links") * F.col("docs")).alias("docs_"))
    add = {"n_best": F.col("n_best") + F.coalesce("best_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("docs_", F.lit(0))}
    return out.join(more, "key", "left").withColumns(add).drop("best_", "docs_")


def to_documents(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """(doc_id, the measures of its text) of every row of docs; zeros and nulls where a text has no tokens.

    Texts of very many documents, fewer than 2^14 of them, are joined by broadcast, so no key of the other join is hot.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("key"))
    bound = max(COPIES, (measured.agg(F.sum("copies")).first()[0] or 0) >> 14)
    hot = measured.where(F.col("copies") > bound).drop("copies")
    rest = measured.where(F.col("copies") <= bound).drop("copies")
    left = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key", "left")
    out = rows.join(F.broadcast(hot), "key").unionByName(left).drop("key")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in _MEASURES})


def group_digests(ids_a: pa.Array, ids_b: pa.Array, ends_a: pa.Array, ends_b: pa.Array) -> list[str]:
    """The sha256 of each text's groups, written as `a1,a2|b1;a3|b2,b3`."""
    (at_a, a, last_a), (at_b, b, last_b) = _side(ids_a, ends_a), _side(ids_b, ends_b)
    na, nb = (np.diff(np.flatnonzero(x), prepend=-1) for x in (last_a, last_b))
    # tokens of A and B in the order of the texts, each with the sign that follows it
    code = np.zeros(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)] = a * 3 + last_a
    code[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = b * 3 + 2 * last_b
    parts, ends = _signed_ids(), (at_a + at_b).tolist()
    known = code.tolist()
    return [hashlib.sha256("".join(map(parts.__getitem__, known[i:j]))[:-1].encode()).hexdigest() for i, j in zip(ends, ends[1:])]


@cache
def _signed_ids() -> list[str]:
    """Each 16-bit id with each of the signs that follow one."""
    return [f"{i}{c}" for i in range(1 << 16) for c in ",|;"]


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The aligned distinct texts (key, copies, ids_a, ids_b, ends_a, ends_b) and the pair counts of all docs, both written.

    docs has doc_id and text; other columns are ignored. Every row is a document, also if its doc_id repeats or is null.
    An empty table gives empty ones. A text is handled whole in one task; its groups are short but for texts in which the
    two sides hardly ever end together, where distinct links grow with the product of distinct ids.
    """
    aligned = materialize(align_distinct(docs, path_a, path_b, pattern), "aligned")
    return aligned, materialize(pair_counts(aligned), "pair-counts")
