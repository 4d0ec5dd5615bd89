"""Token ids as ORC files: integer run-length encoded stripes in document order, with Bloom filters on document ids.

Layout of a folder: `ids/` holds ORC files, one for each range of document ids, with rows (doc_id, part, before,
n_tokens, ids) in ascending order; `before` counts the ids of earlier rows of that file. `parts/` holds one row for each
file: its number of rows and ids and its least and greatest document id. A document's place in the whole stream is the
number of ids in the files before its own, plus `before`. Row indexes (minimum and maximum per row group) and Bloom
filters let a reader of some documents skip stripes; stripes are read in parallel.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, text_buffer

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(32 << 20),
}
#: Words whose ids a worker keeps; all are dropped when there are more.
CACHE_SIZE = 400_000
#: White space beyond ASCII's, or what only one of the engines takes for it.
_RARE_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Letters of Latin-1, which normalisation only lower-cases, then signs: the tokenizer cuts such a word between the two.
_PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[.,;:!?*#$&%|]*)$"


class WordEncoder:
    """Ids of whole texts by a tokenizers file.

    Its splitting drops white space, so words are encoded apart, each distinct one once, and its ids are kept. Words of
    plain letters go straight to the file's BPE model, others through its normaliser and splitting as well. Texts that
    quote an added token go through the tokenizer whole, unless such strings are to be ordinary text (special_as_text).
    """

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_RARE_SPACE.pattern, *added]))
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.words: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.int32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters."""
        known, tokenize, out = self.letters, self.model.tokenize, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                tokens = tokenize(word if word.isascii() else word.translate(self.byte_level)) if word else ()
                ids = known[word] = array("i", [x.id for x in tokens]).tobytes()
            out.append(ids)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of any words."""
        known = self.words
        new = [x for x in words if x not in known]
        for i in range(0, len(new), 4096):
            known.update(zip(new[i : i + 4096], self._encode(new[i : i + 4096])))
        return [known[x] for x in words]

    def _parts(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of parts of words, and of each word the numbers of its two parts: letters and signs, or all and nothing."""
        cut = pc.extract_regex(words, _PLAIN)
        other = pc.fill_null(pc.if_else(cut.is_valid(), None, words), "").dictionary_encode()
        letters = pc.utf8_lower(pc.fill_null(pc.struct_field(cut, "letters"), "")).dictionary_encode()
        signs = pc.fill_null(pc.struct_field(cut, "signs"), "").dictionary_encode()
        parts = self._letters(letters.dictionary.to_pylist()) + self._words([*signs.dictionary.to_pylist(), *other.dictionary.to_pylist()])
        first, second = len(letters.dictionary), len(signs.dictionary)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        tail = signs.indices.to_numpy() + first
        return parts, np.stack([np.where(plain, letters.indices.to_numpy(), other.indices.to_numpy() + first + second), tail], axis=1)

    def encode(self, column: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, the end's included, and all ids one after the other."""
        for kept in (self.words, self.letters):
            if len(kept) > CACHE_SIZE:
                kept.clear()
        self.words[""] = b""
        rows = len(column)
        rare = [k for k, x in enumerate(column.to_pylist()) if self.whole.search(x)]
        if rare:
            keep = np.ones(rows, bool)
            keep[rare] = False
            split = pc.ascii_split_whitespace(pc.if_else(pa.array(keep), column, ""))
        else:
            split = pc.ascii_split_whitespace(column)
        flat = split.flatten().dictionary_encode()
        parts, pairs = self._parts(flat.dictionary)
        whole = self._encode([column[k].as_py() for k in rare])
        parts += [*whole, array("i", end).tobytes()]
        # numbers of the parts in text order, two of each word, each text's end after its words
        words = 2 * np.diff(split.offsets.to_numpy())
        last = np.cumsum(words + 1) - 1
        number = np.empty(2 * len(flat) + rows, np.int64)
        inner = np.ones(len(number), bool)
        inner[last] = False
        number[inner] = pairs[flat.indices.to_numpy()].reshape(-1)
        number[last] = len(parts) - 1
        for n, k in enumerate(rare):  # such a text has the one word "", in whose first part's place its ids go
            number[last[k] - 2] = len(parts) - 1 - len(rare) + n
        size = np.array([len(x) // 4 for x in parts], np.int64)
        start = np.cumsum(size) - size
        each = size[number]
        at = np.arange(int(each.sum())) + np.repeat(start[number] - (np.cumsum(each) - each), each)
        ids = np.frombuffer(b"".join(parts), np.int32)[at]
        return np.add.reduceat(each, last - words) if rows else np.zeros(0, np.int64), ids


_loaded: dict[tuple[str, bool], WordEncoder] = {}


def loaded(path: str, special_as_text: bool = True) -> WordEncoder:
    if (path, special_as_text) not in _loaded:
        _loaded[path, special_as_text] = WordEncoder(path, special_as_text)
    return _loaded[path, special_as_text]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, special_as_text: bool = True) -> None:
    """Encode docs (doc_id, text; other columns are ignored) and write the token files to path.

    end_id follows each document's ids; a null or empty text gives end_id alone. Rows of one doc_id are in order of
    their text, null ids come first. Texts are dealt by ranges of doc_id before they are encoded, as ids take more
    room than texts do. Very large documents stay one row. special_as_text=False is the library's default: the string of
    an added token in a text becomes that token.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of equal ids may be a large share: the hash of the text splits them over ranges
    docs = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    docs = docs.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id())
    schema = "doc_id long, part int, before long, n_tokens int, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = loaded(tokenizer_path, special_as_text), 0
        for b in batches:
            for i, j in slices(text_buffer(b.column(1))[0], 8 * SLICE_BYTES):
                count, flat = encoder.encode(b.column(1).slice(i, j - i), [end_id])
                starts = np.concatenate([[0], np.cumsum(count)])
                ids = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(before + starts[:-1]), pa.array(count.astype(np.int32)), ids],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(starts[-1])

    docs.mapInArrow(run, schema).write.options(**ORC_OPTIONS).orc(f"{path}/ids")
    rows = docs.sparkSession.read.orc(f"{path}/ids")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    parts.coalesce(1).write.options(**ORC_OPTIONS | {"orc.bloom.filter.columns": "part"}).orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of some: their filter reaches row indexes and Bloom filters.

    start counts the ids of all documents before. The table of files is one small row for each file.
    """
    rows = spark.read.schema("doc_id long, part int, before long, n_tokens int, ids array<int>").orc(f"{path}/ids")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    parts = spark.read.schema("part int, rows long, tokens long, least long, most long").orc(f"{path}/parts")
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", base.alias("base"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """tokens with ids_crc32 (long) in place of ids: the unsigned crc32 of the ids as little-endian 32-bit integers."""
    import zlib

    rest = [c for c in tokens.columns if c != "ids"]
    out = tokens.select(*rest).withColumn("ids_crc32", F.lit(None).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(len(rest))
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[x:y].data) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(crc, pa.int64())], names=out.names)

    return tokens.select(*rest, "ids").mapInArrow(run, out)
