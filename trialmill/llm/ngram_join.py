"""Set-similarity self join of texts on word shingles, with several global token orders.

Every text becomes its set of distinct shingles, kept as a sorted array in a table that is written once. For a Jaccard
bound of 4/5 two linked sets must share a token among the first n - ceil(4n/5) + 1 tokens of each, under *any* order that
all sets use. The join uses three:

* Order 1 brings candidates together: a hash order with the most frequent tokens moved to the end. Frequencies come from
  all texts, in rounds: the tokens that many texts have in their prefixes go last, the prefixes then reach further, and
  those tokens are counted in turn. The order only steers cost; links are the same under any.
* Orders 2 and 3 are two more hash orders. The sets of candidate pairs give their prefixes under these. Up to where the
  shorter prefix ends all common tokens are known, so that a pair goes on only if these, and as many as may follow, reach
  the bound under both orders. Texts are fetched for the pairs that are left, and their sets compared exactly.

Texts of equal words are one node from the start. A pair is only a candidate if what follows its shared token in both
texts is long enough for the bound (the first token that two linked sets share always allows it). Within the texts that
share a token, each is first compared with a leader only, the text with the fewest tokens that aren't frequent; texts that are
thereby in one component need no more comparison. Of those of different components, where many have most tokens from one
leader, sets meet by pairs of blocks and are counted by products; all other pairs become rows. Thus large groups of copies
cost about as many pairs as they have members, linked or just not, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, batch, content_keys, discard, materialize, mix, shingle_sets, signed, small, words_of
from .components import components

WIDTH = 5
#: A token that more texts than this have in their prefixes counts as frequent.
FREQUENT = 4
#: Frequent tokens that are told apart, as at most 32 bits of a bitmap each; the most frequent if there are more.
MAX_FREQUENT = 1 << 22
#: Rows that are broadcast to pick sets and texts; above, a join picks them.
MAX_KEYS = 1 << 18
#: Rows of texts or sets that Python gets at a time.
BATCH_ROWS = 1024
#: Bits of a token in the table of sets. Tokens that share them only bring more candidates.
TOKEN_BITS = 48
ORDER_ROUNDS, LEADER_ROUNDS = 3, 1
#: Texts that are a home together; fewer meet as pairs.
HOME = 64
#: Tokens and texts of a block of one home, on average, and the tokens of two blocks that are counted at once.
BLOCK_TOKENS, BLOCK_TEXTS, COUNTED = 1 << 18, 512, 1024


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, n, toks) of every row: the hash of its words, its number of shingles, and their tokens in order.

    toks is null for no words, and where the same task has given the key's before.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("toks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            for i, j, w in words_of(b.column(2)):
                at, h = shingle_sets(w, WIDTH)
                key, size = signed(content_keys(w)), np.diff(at)
                first = np.zeros(len(key), bool)
                first[np.unique(key, return_index=True)[1]] = True
                first &= ~np.isin(key, seen) & (size > 0)
                seen = np.union1d(seen, key[first])
                bounds = np.concatenate([[0], np.cumsum(np.where(first, size, 0))]).astype(np.int32)
                toks = pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(h[np.repeat(first, size)] >> np.uint64(64 - TOKEN_BITS))), mask=pa.array(~first))
                rest = [b.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(key), pa.array(size.astype(np.int32)), toks], schema=schema)

    # tokens are random numbers in order: their differences take fewer bits, no dictionary or compression makes them smaller
    packed = {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0", "compression": "none"}
    return materialize(docs.mapInArrow(run, "row long, doc_id long, key long, n int, toks array<long>"), "sets", **packed)


class _Ordered:
    """The sets of a batch under order 1: of each token its row, place in hash order, place in order 1, and if it is frequent."""

    def __init__(self, toks: pa.ListArray, bits: np.ndarray | None) -> None:
        at = toks.offsets.to_numpy().astype(np.int64)
        self.h = toks.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
        at = at - at[0]
        self.n = np.diff(at)
        self.size = self.n - (4 * self.n + 4) // 5 + 1
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.h)) - at[self.row]
        self.late = np.zeros(len(self.h), bool)
        if bits is not None:
            x = self.h & np.uint64(8 * len(bits) - 1)
            self.late = (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0
        before = np.concatenate([[0], np.cumsum(~self.late)])
        self.light = np.diff(before[at])
        ahead = before[:-1] - before[at[:-1]][self.row]
        self.order = np.where(self.late, self.light[self.row] + self.place - ahead, ahead)


def _prefixes(sets: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """(tok, key, at, light): the prefix tokens of each text under order 1.

    at holds the size of the set in its upper and the token's place, from 1, in its lower 32 bits; light is the number of
    tokens of the text's prefix that aren't frequent, which is small for the middle of a group of copies.
    """
    schema = pa.schema([("tok", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("light", pa.int32())])
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                o = _Ordered(b.column(1), shared.value)
                on = o.order < o.size[o.row]
                row = o.row[on]
                key, light = b.column(0).to_numpy()[row], np.minimum(o.light, o.size)[row]
                yield batch(schema, tok=signed(o.h[on]), key=key, at=(o.n[row] << 32) + o.order[on] + 1, light=light.astype(np.int32))

    return sets.where("toks is not null").select("key", "toks").mapInArrow(run, "tok long, key long, at long, light int")


def _parts(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def _moved(sets: DataFrame, bits: np.ndarray) -> DataFrame:
    """(tok): of texts with frequent tokens among their first in hash order, the other tokens that come forward for them.

    A text that has half its prefix of frequent ones, as large groups of copies do, gives all its others.
    """
    schema = pa.schema([("tok", pa.int64())])
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                o = _Ordered(b.column(0), shared.value)
                head = o.place < o.size[o.row]
                hit = np.bincount(o.row[head & o.late], minlength=len(o.n))
                half = 2 * hit >= o.size
                on = ~o.late & (half[o.row] | ~head & (o.order < o.size[o.row]) & (hit[o.row] > 0))
                yield batch(schema, tok=signed(o.h[on]))

    return sets.where("toks is not null").select("toks").mapInArrow(run, "tok long")


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits of tokens (tok, count), by their lower bits: 32 bits a token or more, 16 MB at most."""
    octave = F.floor(F.log2("count") * 4).cast("int")
    sizes = frequent.groupBy(octave.alias("octave")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("octave")).collect()  # some 250 rows at most
    total, least = 0, 0
    for x in sizes:
        if total + x.n > MAX_FREQUENT:
            least = x.octave + 1
            break
        total += x.n
    size = min(1 << 27, max(1 << 15, 1 << (32 * total).bit_length()))
    at = F.col("tok").bitwiseAND(size - 1) + 1  # Spark counts bits of a bitmap from 1
    kept = frequent.where(octave >= least)
    rows = kept.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toPandas()
    out = np.zeros((size >> 15, 4096), np.uint8)
    for bucket, bits in zip(rows["bucket"], rows["bits"]):
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def frequent_tokens(sets: DataFrame) -> np.ndarray | None:
    """A bitmap of the tokens that order 1 moves to the end, counted over all texts in a few rounds. Others may share a bit."""
    found: DataFrame | None = None
    bits = None
    for _ in range(ORDER_ROUNDS):
        if bits is None:
            size = F.expr("n - (4 * n + 4) div 5 + 1").cast("int")
            toks = sets.where("toks is not null").select(F.explode(F.slice("toks", F.lit(1), size)).alias("tok"))
        else:
            toks = _moved(sets, bits)
        more = materialize(toks.groupBy("tok").count().where(F.col("count") > FREQUENT), "frequent")
        if more.isEmpty():
            break
        found = more if found is None else found.unionByName(more)
        bits = _bitmap(found)
    return bits


def _runs(rows: DataFrame) -> DataFrame:
    """From rows sorted by tok: (kind 0) a star of candidates per token, (kind 1) the rows of tokens of three or more texts.

    A text is paired with the first of its token in the sort order. Only the token's first row is held. A token that is
    passed on in pieces has all its rows in kind 1, whatever the size of a piece.
    """
    schema = pa.schema([("kind", pa.int8()), ("tok", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        continued = False  # the first token held had rows before

        def out(tok: np.ndarray, key: np.ndarray, at: np.ndarray, pieces: bool) -> pa.RecordBatch:
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
            tok, key, at = tok[new], key[new], at[new]
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            size = np.diff(np.append(first, len(tok)))
            head, size = np.repeat(first, size), np.repeat(size, size)
            n, rest = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
            star = (head != np.arange(len(tok))) & (9 * (1 + np.minimum(rest, rest[head])) >= 4 * (n + n[head])) & (5 * np.minimum(n, n[head]) >= 4 * np.maximum(n, n[head]))
            wide = (size >= 3) | (pieces & (head == 0))
            kind = np.concatenate([np.zeros(star.sum(), np.int8), np.ones(wide.sum(), np.int8)])
            other = np.concatenate([key[head][star], np.zeros(wide.sum(), np.int64)])
            return batch(schema, kind=kind, tok=np.concatenate([tok[star], tok[wide]]), key=np.concatenate([key[star], key[wide]]), at=np.concatenate([at[star], at[wide]]), other=other)

        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(3)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            tok = cols[0]
            if not len(tok):
                continue
            cut = int(np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))[-1])
            if cut == 0 and len(tok) > 1 << 16:
                # a very large token: pass on what there is, and keep its first row as the leader of the rest
                yield out(*cols, True)
                held, continued = [x[:1] for x in cols], True
                continue
            if cut:
                yield out(*[x[:cut] for x in cols], continued)
                continued = False
            held = [x[cut:] for x in cols]
        if held is not None and len(held[0]):
            yield out(*held, continued)

    return rows.mapInArrow(run, "kind tinyint, tok long, key long, at long, other long")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (text and others) with the hash of a row's words as _key, 0 without words."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.concatenate([np.zeros(0, np.int64), *[signed(content_keys(w)) for _, _, w in words_of(b.column(at))]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys)], names=[*names, "_key"])

    return docs.mapInArrow(run, docs.withColumn("_key", F.lit(None).cast("long")).schema)


def _sets_of(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, toks) of each of the keys once."""
    one = sets.where("toks is not null").select("key", "row").join(keys, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    one = materialize(one, "keys")
    wanted = F.broadcast(one) if small(one, MAX_KEYS) else one
    return sets.where("toks is not null").join(wanted, ["key", "row"], "left_semi").select("key", "n", "toks")


def _second_prefixes(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, second, third, twice) of each of the keys: its prefixes under orders 2 and 3, as 32-bit numbers in order.

    twice tells that a number comes twice in a prefix, which then shows no bound.
    """
    rows = _sets_of(sets, keys)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("second", pa.list_(pa.int32())), ("third", pa.list_(pa.int32())), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                o, firsts, twice = _Ordered(b.column(2), None), [], np.zeros(b.num_rows, bool)
                bounds = pa.array(np.concatenate([[0], np.cumsum(o.size)]).astype(np.int32))
                on = o.place < o.size[o.row]
                row = o.row[on]
                for seed in (21, 22):
                    h = mix(o.h, seed) >> np.uint64(32)
                    h = h[np.lexsort((h, o.row))][on]
                    twice[row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])]] = True
                    firsts.append(pa.ListArray.from_arrays(bounds, pa.array(h.astype(np.uint32).view(np.int32))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *firsts, pa.array(twice)], schema=schema)

    packed = {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0", "compression": "none"}
    return materialize(rows.mapInArrow(run, "key long, n int, second array<int>, third array<int>, twice boolean"), "prefixes", **packed)


def _reaches(x: pa.Array, y: pa.Array, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the sets of n and m tokens with prefixes x and y under one order can have Jaccard similarity 4/5."""
    tagged, sizes, last = [], [], []
    for side in (x, y):
        at = side.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(side)), np.diff(at))
        value = side.values.to_numpy()[at[0] : at[-1]].view(np.uint32).astype(np.int64)
        last.append(value[at[1:] - at[0] - 1])
        tagged.append((row, value))
    known = np.minimum(*last)  # all tokens below are in both prefixes
    for k, (row, value) in enumerate(tagged):
        below = value < known[row]
        sizes.append(np.bincount(row[below], minlength=len(n)))
        tagged[k] = (row[below] << 32) | value[below]
    common = np.bincount(np.intersect1d(*tagged, assume_unique=True) >> 32, minlength=len(n))
    most = common + np.minimum(n - sizes[0], m - sizes[1])
    return 9 * most >= 4 * (n + m)


def _filtered(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that both orders 2 and 3 let pass."""
    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    nodes = _second_prefixes(sets, nodes)
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("key").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in nodes.columns[1:]]), end)
    pairs = pairs.select("a", "b", *[f"{c}_{end}" for c in nodes.columns[1:] for end in "ab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole, 256):
                n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                unsure = b.column(8).to_numpy(zero_copy_only=False) | b.column(9).to_numpy(zero_copy_only=False)
                keep = _reaches(b.column(4), b.column(5), n, m) & _reaches(b.column(6), b.column(7), n, m) | unsure
                yield b.select([0, 1]).filter(pa.array(keep))

    left = materialize(pairs.mapInArrow(run, "a long, b long"), "filtered")
    discard(nodes)
    return left


def _texts(docs: DataFrame, members: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text): one text of each of the keys, that of its least doc_id if it has any."""
    one = members.join(keys, "key", "left_semi").groupBy("key", "doc_id").count().groupBy("key")
    one = materialize(one.agg(F.min("doc_id").alias("doc_id"), (F.coalesce(F.min_by("count", "doc_id"), F.max("count")) > 1).alias("again")), "keys")
    again = one.agg(F.coalesce(F.max("again"), F.lit(False))).first()[0]
    ids = one.select("doc_id").distinct().withColumnRenamed("doc_id", "_id")
    rows = _keyed(docs.join(F.broadcast(ids) if small(ids, MAX_KEYS) else ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi"))
    if again:  # rows of one doc_id and the same words
        rows = rows.dropDuplicates(["doc_id", "_key"])
    same = (rows["_key"] == one["key"]) & rows["doc_id"].eqNullSafe(one["doc_id"])
    return rows.join(F.broadcast(one) if small(one, MAX_KEYS) else one, same).select("key", "text")


def _verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that every order lets pass, and whose sets then pass the exact bound.

    b may stand in very many pairs with other a, as a leader does: its side is joined last, so that a leader's text isn't
    sent along with each of its pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    pairs = _filtered(sets, pairs)
    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    texts = materialize(_texts(docs, sets.select("doc_id", "key"), nodes), "texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        found = []
        for _, _, w in words_of(column):
            at, h = shingle_sets(w, WIDTH)
            found += [h[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole, 256):
                keep = []
                for x, y in zip(sets_of(b.column(2)), sets_of(b.column(3))):
                    # 100 common >= 80 (n + m - common)
                    keep.append(180 * len(np.intersect1d(x, y, assume_unique=True)) >= 80 * (len(x) + len(y)))
                yield b.select([0, 1]).filter(pa.array(keep, pa.bool_())).cast(schema)

    links = materialize(both.mapInArrow(run, "a long, b long"), "links")
    discard(texts, pairs)
    return links


def _ordered(df: DataFrame, key: str, leader: str) -> DataFrame:
    """Each pair of different keys once, as (a, b), with b its leader in one of its rows."""
    return df.where(F.col(key) != F.col(leader)).groupBy(F.least(key, leader).alias("lo"), F.greatest(key, leader).alias("hi")).agg(F.max(leader).alias("b")).select(F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b")


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of a that aren't in b in either direction."""
    seen = b.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return a.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(seen, ["lo", "hi"], "left_anti").select("a", "b")


def _homed(rows: DataFrame) -> DataFrame:
    """(key, root, home, blocks, block) of the texts of rows (tok, key, n, root, lead).

    A text goes with the leader that most of its tokens have, the least of several: texts of a group of near copies share
    most tokens, and so their leader. Where many go with one and have several roots, they are a home, which is dealt to
    blocks; any other text is its own home, with no block. Keys are odd, a home of many has an even number.
    """
    votes = rows.groupBy("key", "n", "root", F.col("lead.key").alias("with")).agg(F.count(F.lit(1)).alias("votes"))
    texts = votes.groupBy("key", "n", "root").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "with"))["with"].alias("with"))
    texts = materialize(texts, "homes")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int").alias("blocks")
    many = texts.groupBy("with").agg(F.count(F.lit(1)).alias("texts"), F.min("root").alias("lo"), F.max("root").alias("hi"), blocks)
    texts = texts.join(many.where(F.col("texts") >= HOME).where("lo <> hi").select("with", "blocks"), "with", "left")
    home = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.col("with") - 1)
    return materialize(texts.select("key", "root", home.alias("home"), "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")), "homes")


def _alike(t: pa.Table) -> pa.Table:
    """(key, other): of the texts (i, j, block, key, root, n, toks) of two blocks i and j, or of one, the pairs of different roots whose sets reach the bound."""
    t = t.combine_chunks()
    i, j, block, key, root, n = (t.column(c).to_numpy() for c in ("i", "j", "block", "key", "root", "n"))
    toks = t.column("toks").chunk(0)
    at = toks.offsets.to_numpy().astype(np.int64)
    _, tok, count = np.unique(toks.values.to_numpy()[at[0] : at[-1]], return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(key)), np.diff(at))
    row, tok = row[count[tok] > 1], (np.cumsum(count > 1) - 1)[tok[count[tok] > 1]]
    order = np.argsort(tok, kind="stable")
    row, tok = row[order], tok[order]
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    common = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(tok[-1]) + 1 if len(tok) else 0, COUNTED):
        x, y = np.searchsorted(tok, [low, low + COUNTED])
        held = np.bincount(row[x:y] * COUNTED + tok[x:y] - low, minlength=len(key) * COUNTED).astype(np.float32).reshape(len(key), COUNTED)
        common += held[a] @ held[b].T
    n = n.astype(np.int64)
    keep = (9 * common.astype(np.int64) >= 4 * np.add.outer(n[a], n[b])) & np.not_equal.outer(root[a], root[b])
    if i[0] == j[0]:
        keep = np.triu(keep, 1)
    x, y = np.nonzero(keep)
    return pa.table({"key": key[a][x], "other": key[b][y]})


def _within(sets: DataFrame, homes: DataFrame) -> DataFrame:
    """(key, other): pairs of one home of many texts with different roots, whose sets reach the bound.

    Sets meet by pairs of blocks, so that no pair that fails is ever a row: a set is sent once for each block of its home.
    Tokens are those of the table of sets, so that pairs are to be verified still.
    """
    homes = homes.where("blocks is not null")
    met = _sets_of(sets, homes).join(F.broadcast(homes) if small(homes, MAX_KEYS) else homes, "key")
    met = met.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("home", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "block", "key", "root", "n", "toks")
    return met.groupBy("home", "i", "j").applyInArrow(_alike, "key long, other long")


def _across(rows: DataFrame) -> DataFrame:
    """(key, other): pairs of rows (tok, key, n, rest, root, home) of one token, with different roots and homes, and sizes that allow a link. Without a home a text is its own.

    Of two different homes one isn't the token's main one, so only the texts of the others meet all. Sizes of linked sets
    differ by a factor of 1.25 at most, so rows meet only within a band of sizes and its neighbours. Two texts whose tokens
    before this one are the same have met there already, with more of each to follow, and don't meet again: texts that
    share a run of tokens give one pair for it.
    """
    rows = rows if "home" in rows.columns else rows.withColumn("home", F.col("key"))
    before = F.lag("tok").over(Window.partitionBy("key").orderBy(F.desc("rest")))  # at most a text's prefix
    main = rows.groupBy("tok", "home").agg(F.count(F.lit(1)).alias("texts")).groupBy("tok")
    main = main.agg(F.max(F.struct("texts", "home"))["home"].alias("main"), F.count(F.lit(1)).alias("homes")).where("homes > 1").select("tok", "main")
    rows = rows.withColumns({"before": before, "band": F.floor(F.log("n") / F.log(F.lit(1.26))).cast("int")}).join(main, "tok")
    y = rows.select("tok", F.col("key").alias("other"), F.col("n").alias("m"), F.col("rest").alias("after"), F.col("root").alias("to"), F.col("home").alias("at"), F.col("before").alias("first"), F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    return rows.where("home <> main").join(y, ["tok", "band"]).where("(at = main or key < other) and at <> home and root <> to and coalesce(before <> first, true)").where(FITS)


FITS = "least(n, m) * 5 >= greatest(n, m) * 4 and 9 * (1 + least(rest, after)) >= 4 * (n + m)"


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): the members, and (key, doc_id, root) of each text with words, its least doc_id and its group."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _grouped(docs)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sets = _sets(docs)
    members = sets.select("doc_id", "key", "n")
    rows = _prefixes(sets, frequent_tokens(sets))
    rows = rows.repartition("tok").sortWithinPartitions("tok", "light", "key").select("tok", "key", "at")
    runs = materialize(_runs(rows), "runs")

    tried = materialize(_ordered(runs.where("kind = 0"), "key", "other"), "pairs")
    comp = components(_verify(docs, sets, tried))
    open_rows = runs.where("kind = 1").select("tok", "key", F.shiftright("at", 32).alias("n"), (F.shiftright("at", 32) - F.col("at").bitwiseAND(0xFFFFFFFF)).alias("rest"))
    for k in range(LEADER_ROUNDS + 1):
        left = open_rows.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        lead = F.min(F.struct(F.xxhash64("key", F.lit(k)), "key", "n", "rest", "root")).alias("lead")
        mixed = left.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), lead).where("lo <> hi")
        # the rows of tokens that have several components still, for all uses below
        open_rows = materialize(left.join(mixed, "tok").select("tok", "key", "n", "rest", "root", "lead"), "open")
        if k < LEADER_ROUNDS:
            pairs = open_rows.where("root <> lead.root").select("key", "n", "rest", F.col("lead.key").alias("other"), F.col("lead.n").alias("m"), F.col("lead.rest").alias("after")).where(FITS)
            open_rows = open_rows.select("tok", "key", "n", "rest")
        else:
            homes = _homed(open_rows)
            pairs = _across(open_rows.drop("lead").join(homes.select("key", "home"), "key")).select("key", "other").unionByName(_within(sets, homes))
        pairs = materialize(_same(_ordered(pairs, "key", "other"), tried), "pairs")
        if not pairs.isEmpty():
            found = _verify(docs, sets, pairs)
            tried = tried.unionByName(pairs)
            comp = components(found.unionByName(comp.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if k < LEADER_ROUNDS and open_rows.isEmpty():
            break
    comp = comp.withColumnRenamed("node", "key")
    least = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(comp, "key", "left")
    least = materialize(least.select("key", "doc_id", F.coalesce("root", "key").alias("root")), "least")
    discard(runs)
    return members, least


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that is reached by links of Jaccard similarity 0.8 or more, the row's own included.
    A null or blank text has no shingles and is linked with nothing: its component_id is its doc_id. Rows that repeat a
    doc_id each give a row. A null doc_id stays null, and a group of such rows only has a null component_id. Texts are
    compared by 64-bit hashes of shingles and of whole texts. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members, least = _groups(docs)
    roots = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    keyed = least.join(roots, "root").select("key", "component_id")
    out = members.join(keyed, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id.

    Texts without words are in no group and stay. Of rows that repeat a doc_id and its words one stays; other texts under
    that doc_id are judged by their own group, and a group's smallest doc_id with several of its texts keeps that of the
    least hash. Rows without a doc_id all stay, as nothing tells which came first. All columns of docs are returned as they were.
    """
    named = docs.where("doc_id is not null")
    members, least = _groups(named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    first = least.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    first = first.unionByName(members.where("n = 0").select("doc_id", "key").distinct()).select(F.col("doc_id").alias("_kept"), F.col("key").alias("_words"))
    rows = _keyed(named)
    kept = rows.join(first, (rows["doc_id"] == first["_kept"]) & (rows["_key"] == first["_words"])).dropDuplicates(["doc_id", "_key"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
