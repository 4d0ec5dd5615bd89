"""Benchmark decontamination: a BM25 index of test items, searched by every passage of every text.

Terms are lower-cased runs of letters and digits (bytes above 127 count as letters). The index holds the postings of
each term in item order, in blocks with the largest impact of each block. Impacts are divided by what an item must
score to be retrieved, a share of the score that its own text gets, so that one bound, 1, holds for all items.
Every window of a text, wide enough to hold any item whole, is a query. Of each item, the terms that are rarest among
items, longer ones first, are its essential ones, so many that its other terms together score at most SPARE: a window
that retrieves the item must make up the rest by essential terms. Windows for which no item can are passed over, the
others run block-max WAND over the whole index.
Retrieved items are verified against the whole text: the
shares of their question's and of their answer's word triples that the text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch, materialize, signed, slices, text_buffer, window_hashes

STRIDE = 32
K1, B = 1.2, 0.75
#: An item is retrieved by a passage that scores this share of what the item's own text scores.
RETRIEVE = 0.7
#: What the terms of an item that aren't essential score at most; 1 retrieves it.
SPARE = 0.6
#: Word triples of question and answer that a text must have.
OVERLAP = 0.7
#: Items of one index; there is an index, and a pass over the texts, for each so many items.
SHARD = 50_000
BLOCK = 16
_END = 1 << 60

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLEAN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def terms(offsets: np.ndarray, data: np.ndarray) -> Words:
    part = _CLEAN[data[int(offsets[0]) : int(offsets[-1])]]
    return Words(offsets - offsets[0], part)


def _terms_of(texts: list[str]) -> Words:
    return terms(*text_buffer(pc.utf8_lower(pa.array(texts, pa.string()))))


class Statistics(NamedTuple):
    """Of all items: their number, mean and largest length; and in how many each term of a shard is, terms in order."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    counts: np.ndarray


class Index:
    """Postings by term number, in arrays: items, impacts, and per block its last item and largest impact."""

    def __init__(self, ids: list[int], questions: list[str], answers: list[str], over: Statistics | None = None) -> None:
        """over: the statistics of all items, of which these are a shard; without it these are all."""
        w = _terms_of([f"{q} {a}" for q, a in zip(questions, answers)])
        self.ids = np.array(ids, np.int64)
        length = np.diff(w.first)
        self.vocabulary, code = np.unique(w.hash, return_inverse=True)
        pair, tf = np.unique(code.astype(np.int64) * max(len(ids), 1) + w.row, return_counts=True)
        term, item = pair // max(len(ids), 1), pair % max(len(ids), 1)
        df = np.bincount(term, minlength=len(self.vocabulary))
        items, mean, longest = len(ids), length.mean() if len(ids) else 0.0, int(length.max(initial=0))
        if over is not None:
            items, mean, longest = over.items, over.mean, over.longest
            df = over.counts[np.searchsorted(over.terms, self.vocabulary)]
        idf = np.log1p((items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(mean, 1e-9))) if len(pair) else np.zeros(0)
        own = np.bincount(item, impact, len(ids)) if len(pair) else np.zeros(len(ids))
        impact = impact / np.maximum(RETRIEVE * own[item], 1e-12)
        self.first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.lists = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            starts = np.arange(a, b, BLOCK)
            last = item[np.minimum(starts + BLOCK, b) - 1].tolist()
            self.lists.append((item[a:b].tolist(), impact[a:b].tolist(), last, np.maximum.reduceat(impact, starts).tolist()))
        self.width = longest + STRIDE
        self.most = np.array([max(x[1]) for x in self.lists]) if self.lists else np.zeros(0)
        letters = np.zeros(len(df), np.int64)
        letters[code] = w.end - w.start
        order = np.lexsort((-letters[term], df[term], item))
        left = own / np.maximum(RETRIEVE * own, 1e-12)
        essential = np.zeros(len(term), bool)
        for k, i, gain in zip(order.tolist(), item[order].tolist(), impact[order].tolist()):
            if left[i] > SPARE:
                essential[k] = True
                left[i] -= gain
        self.need = 1 - left
        self.key_item, self.key_impact = item[essential], impact[essential]
        self.key_first = np.searchsorted(term[essential], np.arange(len(df) + 1))
        self.triples = [self._triples(questions), self._triples(answers)]

    @staticmethod
    def _triples(texts: list[str]) -> list[np.ndarray]:
        rows, h = window_hashes(_terms_of(texts), 3)
        at = np.searchsorted(rows, np.arange(len(texts) + 1))
        return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers; -1 for terms of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """(item, score) of every item that scores 1 or more for these distinct terms: block-max WAND."""
        lists = [[self.lists[t], 0, 0, float(self.most[t])] for t in query]  # postings, place, block, largest impact
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][0][x[1]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[3]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1]] == item:
                pivot += 1
            bound, reach = 0.0, _END
            for x in lists[: pivot + 1]:
                last = x[0][2]
                while x[2] < len(last) and last[x[2]] < item:
                    x[2] += 1
                if x[2] < len(last):
                    bound += x[0][3][x[2]]
                    reach = min(reach, last[x[2]] + 1)
            if pivot + 1 < len(lists):
                reach = min(reach, lists[pivot + 1][0][0][lists[pivot + 1][1]])
            if bound >= 1:
                if lists[0][0][0][lists[0][1]] == item:
                    score = 0.0
                    for x in lists[: pivot + 1]:
                        score += x[0][1][x[1]]
                        x[1] += 1
                    if score >= 1:
                        found.append((item, score))
                    lists = [x for x in lists if x[1] < len(x[0][0])]
                    continue
                target = item
            else:
                target = max(reach, item + 1) if reach < _END else item + 1
            for x in lists[: pivot + 1]:
                items = x[0][0]
                while x[1] < len(items) and items[x[1]] < target:
                    x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0][0])]
        return found

    def matches(self, w: Words) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, share of question, share of answer) of retrieved items, not yet judged by their overlap."""
        codes = self.numbers(w.hash)
        held = np.where(codes >= 0, np.diff(self.key_first)[codes], 0) if len(self.vocabulary) else np.zeros(len(codes), np.int64)
        at = np.flatnonzero(held)
        if not len(at):
            return []
        size = held[at]
        at = np.repeat(at, size)
        post = self.key_first[codes[at]] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        pair = w.row[at] * len(self.ids) + self.key_item[post]
        once = np.unique(np.stack([pair, post]), axis=1)
        pairs, back = np.unique(once[0], return_inverse=True)
        reach = np.bincount(back, self.key_impact[once[1]])
        pairs = pairs[reach >= self.need[pairs % len(self.ids)] - 1e-9]
        if not len(pairs):
            return []
        on = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair
        total = np.concatenate([[0.0], np.cumsum(np.bincount(at[on], self.key_impact[post[on]], len(codes)))])
        need = self.need[pairs % len(self.ids)].min()
        count = np.diff(w.first)
        windows = np.where(count > 0, np.maximum(0, -(-(count - self.width) // STRIDE)) + 1, 0)
        rows = np.repeat(np.arange(w.rows), windows)
        start = w.first[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
        stop = np.minimum(start + self.width, w.first[rows + 1])
        searched = 0
        best: dict[tuple[int, int], float] = {}
        for k in np.flatnonzero(total[stop] - total[start] >= need - 1e-9).tolist():
            query = np.unique(codes[start[k] : stop[k]])
            query = query[query >= 0]
            for item, score in self.search(query.tolist()):
                key = (int(rows[k]), item)
                best[key] = max(score, best.get(key, 0.0))
        out, triples = [], {}
        for (row, item), score in sorted(best.items()):
            if row not in triples:
                one = Words.__new__(Words)
                a, b = w.first[row], w.first[row + 1]
                one.hash, one.row, one.first, one.rows = w.hash[a:b], np.zeros(b - a, np.int64), np.array([0, b - a]), 1
                # items of fewer than three words are single windows, so shorter windows count as well
                triples[row] = np.concatenate([window_hashes(one, 3)[1], *[_short(one, k) for k in (1, 2)]])
            shares = [float(np.isin(x[item], triples[row]).mean()) if len(x[item]) else 1.0 for x in self.triples]
            out.append((row, item, score, *shares))
        return out


def _short(one: Words, k: int) -> np.ndarray:
    """Hashes that windows of k words alone would have as a whole text of fewer than three words."""
    from .common import _MULT, mix

    n = len(one.hash)
    if n < k:
        return np.zeros(0, np.uint64)
    mult = np.resize(_MULT, 3) + np.arange(3, dtype=np.uint64) * np.uint64(2)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += one.hash[i : n - k + 1 + i] * mult[i]
    return mix(total, 11)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that has one text: its last quarter of words, one at least, is the answer."""
    words = (text or "").split()
    cut = len(words) - max(1, len(words) // 4) if words else 0
    return " ".join(words[:cut]), " ".join(words[cut:])


def build_indexes(items: DataFrame) -> Iterator[Index]:
    """An index for each SHARD items (item_id, and question and answer or text); items without words are in none.

    The item table is read shard by shard, so that what is broadcast has a fixed bound. Statistics are those of all items, so
    that shards only split the postings and scores don't depend on SHARD.
    """
    if {"question", "answer"} <= set(items.columns):
        items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    else:
        items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("q"), F.lit(None).cast("string").alias("a"))
    items = items.where(F.col("item_id").isNotNull())
    shards = -(-items.count() // SHARD)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int"))
    found = _statistics(items) if shards > 1 else None
    for k in range(shards):
        part: pd.DataFrame = items.where(F.col("shard") == k).drop("shard").orderBy("item_id", "q").toPandas()
        both = [split_item(q) if a is None else (q, a) for q, a in zip(part["q"], part["a"])]
        over = None
        if found is not None:
            counts = found[1].where(F.col("shard") == k).select("term", "n").toPandas()
            term, n = counts["term"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy(np.int64)
            order = np.argsort(term)
            over = Statistics(*found[0], term[order], n[order])
        yield Index(part["item_id"].tolist(), [q for q, _ in both], [a for _, a in both], over)


def _statistics(items: DataFrame) -> tuple[tuple[int, float, int], DataFrame]:
    """Number, mean and largest length of items (q, a, shard), and (shard, term, n): in how many of all items each term of a shard is."""
    schema = pa.schema([("shard", pa.int32()), ("term", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [split_item(q) if a is None else (q, a) for q, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            w = _terms_of([f"{q} {a}" for q, a in both])
            shard = b.column(2).to_numpy()
            once = np.unique(np.stack([w.row.astype(np.uint64), w.hash]), axis=1)
            yield batch(schema, shard=shard[once[0].astype(np.int64)], term=signed(once[1].copy()), tokens=np.zeros(once.shape[1], np.int64))
            # an item's length, in a row without a term
            yield batch(schema, shard=shard, term=pa.nulls(len(shard), pa.int64()), tokens=np.diff(w.first))

    rows = materialize(items.select("q", "a", "shard").mapInArrow(run, "shard int, term long, tokens long"), "item-terms")
    n, total, longest = rows.where("term is null").agg(F.count(F.lit(1)), F.sum("tokens"), F.max("tokens")).first()
    own = rows.where("term is not null").groupBy("shard", "term").agg(F.count(F.lit(1)).alias("own"))
    counts = own.groupBy("term").agg(F.sum("own").alias("n"))
    return (n, total / n, longest), materialize(own.join(counts, "term").select("shard", "term", "n"), "item-counts")


def find_leaks(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), a row for each text and item that it gives away.

    score is the best passage's BM25 score as a multiple of what retrieval takes. Null and empty texts give no row; rows
    that repeat a doc_id give theirs each; other columns of docs are ignored. Whole texts are searched. An item without a
    question or without an answer (fewer than two words) is judged by the other part.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], ddl)
    for index in build_indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets, data = text_buffer(pc.utf8_lower(b.column(1)))
                for i, j in slices(offsets):
                    rows = [x for x in shared.value.matches(terms(offsets[i : j + 1], data)) if x[3] >= overlap and x[4] >= overlap]
                    if rows:
                        row, item, score, q, a = map(list, zip(*rows))
                        yield batch(schema, doc_id=b.column(0).slice(i, j - i).take(pa.array(row)), item_id=shared.value.ids[item], score=score, question_overlap=q, answer_overlap=a)

        found = found.unionByName(docs.mapInArrow(run, ddl))
    return found


def drop_leaking(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """docs without the rows whose text gives an item away; all columns as they were. No shuffle: rows are judged alone."""
    at = docs.columns.index("text")
    for index in build_indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets, data = text_buffer(pc.utf8_lower(b.column(at)))
                keep = np.ones(b.num_rows, bool)
                for i, j in slices(offsets):
                    keep[[i + x[0] for x in shared.value.matches(terms(offsets[i : j + 1], data)) if x[3] >= overlap and x[4] >= overlap]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
