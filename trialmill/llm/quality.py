"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Votes of all texts are counted by pattern, and
expectation-maximisation over these counts estimates each labeller's accuracy under both classes and the share of good
texts; a labeller that doesn't vote says nothing. The posterior of its pattern is a text's label. A hashed linear scorer over words, word shapes and repeats
is fitted to the posteriors of a bounded sample (SAMPLE rows), and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch, give_back, mix, slices, text_buffer

#: Rows that the scorer is fitted on, picked by a hash of their text.
SAMPLE = 4000
#: Hashed features.
DIMS = 1 << 14
#: A text is rejected if its score, the probability that it is good, is below this.
BOUND = 0.5
#: Added to a text's number of words where features are shares of it, so that a few words weigh little.
SHORT = 8
LABELLERS = ["symbols", "bars", "capitals", "repeats", "variety", "word_length", "stops", "function_words"]
GOOD, NONE, BAD = 2, 1, 0
# Frequent function words of four languages.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are with as by an be this from or at "
    "le la les de des du et en un une que qui dans pour sur par est au ne pas "
    "der die das und in den von zu mit sich ist ein eine auf nicht dem im "
    "el los las y en del se por con para una su al lo como"
).split()

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:256] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 57
_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32


def _hash_words(words: list[str]) -> np.ndarray:
    return np.unique(Words(*text_buffer(pa.array([" ".join(words)]))).hash)


def _shapes(w: Words) -> np.ndarray:
    """A hash of each word's character classes, runs of one class being one."""
    kind = _CLASS[w.bytes]
    if not len(w.start):
        return np.zeros(0, np.uint64)
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.start] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    inside = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(keep, mix(kind.astype(np.uint64) * np.uint64(31) + np.uint64(5), 2), np.uint64(0)), dtype=np.uint64)])
    # order inside a shape matters little; its length and parts tell shapes apart
    return mix((inside[w.end] - inside[w.start]) + (before[w.end] - before[w.start]).astype(np.uint64), 4) ^ mix(kind[w.start].astype(np.uint64), 6)


class Texts:
    """Word arrays of a slice of texts, and sums over the words of each text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray) -> None:
        self.w = Words(offsets, data, lower=False)
        self.rows, self.n = self.w.rows, np.diff(self.w.first)
        lower = Words(offsets - offsets[0], _LOWER_TABLE[self.w.bytes], lower=False)
        self.lower = lower.hash
        self.same = np.zeros(len(self.lower), bool)
        self.same[1:] = (self.lower[1:] == self.lower[:-1]) & (self.w.row[1:] == self.w.row[:-1])

    def per_row(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        return total[self.w.first[1:]] - total[self.w.first[:-1]]

    def bytes_per_row(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.w.at[1:]] - total[self.w.at[:-1]]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature number of every hashed feature: word, shape and repeat of each word."""
        mask = np.uint64(DIMS - 1)
        codes = np.stack([mix(self.lower, 31) & mask, mix(_shapes(self.w), 32) & mask, mix(self.same.astype(np.uint64), 33) & mask])
        return np.tile(self.w.row, 3), codes.reshape(-1).astype(np.int64)


_FUNCTION = _hash_words(FUNCTION_WORDS)


def votes(t: Texts) -> np.ndarray:
    """Votes of the labellers, one column each; texts of fewer than five words get none but by symbols and capitals."""
    b = t.w.bytes
    n = np.maximum(t.n, 1)
    solid = np.maximum(t.bytes_per_row(~np.isin(b, (32, 9, 10, 11, 12, 13))), 1)
    odd = t.bytes_per_row(np.isin(b, np.frombuffer(b"#$%&*|!~^<>{}\\=_@", np.uint8))) / solid
    upper = t.bytes_per_row((b >= 65) & (b < 91))
    upper = upper / np.maximum(upper + t.bytes_per_row((b >= 97) & (b < 123)), 1)
    size = t.w.end - t.w.start
    bars = t.per_row((size == 1) & (b[t.w.start] == 124)) / n if len(size) else np.zeros(t.rows)
    repeats = t.per_row(t.same) / n
    key = np.lexsort((t.lower, t.w.row))
    new = np.ones(len(key), bool)
    if len(key):
        new[1:] = (t.lower[key][1:] != t.lower[key][:-1]) | (t.w.row[key][1:] != t.w.row[key][:-1])
    variety = t.per_row(new) / n
    length = t.per_row(size) / n
    stops = t.per_row(np.isin(b[t.w.end - 1], np.frombuffer(b".,;:?", np.uint8))) / n if len(size) else np.zeros(t.rows)
    found = t.per_row(_FUNCTION[np.minimum(np.searchsorted(_FUNCTION, t.lower), len(_FUNCTION) - 1)] == t.lower) / n
    some = t.n >= 5

    def vote(bad: np.ndarray, good: np.ndarray, on: np.ndarray | bool = True) -> np.ndarray:
        return np.where(bad & on, BAD, np.where(good & on, GOOD, NONE))

    return np.stack([
        vote(odd > 0.08, odd < 0.03, t.n > 0), vote(bars > 0.1, bars < 0.02, some), vote(upper > 0.4, upper < 0.2, t.n > 0), vote(repeats > 0.15, repeats < 0.05, some),
        vote(variety < 0.25, variety > 0.35, (t.n >= 20) & (t.n < 2000)), vote((length < 2) | (length > 14), (length > 2.5) & (length < 11), some),
        vote(stops < 0.01, stops > 0.04, t.n >= 25), vote(found < 0.02, found > 0.08, t.n >= 25),
    ], axis=1)


class WeakLabels:
    """Two-class model of votes, independent given the class: prior of good, and rates[class, labeller, vote] of those that vote."""

    def __init__(self, good: float, rates: np.ndarray) -> None:
        self.good, self.rates = good, rates

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> WeakLabels:
        """Expectation-maximisation over vote patterns with their counts; starts from good where no vote is bad, with one smoothing count."""
        m = patterns.shape[1]
        one = np.eye(3)[patterns]
        lead = (patterns == GOOD).sum(axis=1) - m * (patterns == BAD).sum(axis=1)
        q = np.clip(0.5 + lead / (2 * m), 0.05, 0.95)
        good, rates = 0.5, np.full((2, m, 3), 1 / 3)
        for _ in range(steps):
            w = np.stack([counts * (1 - q), counts * q])
            rates = np.einsum("kp,pmo->kmo", w, one) + 1.0
            rates[:, :, NONE] = 0
            rates /= rates.sum(axis=2, keepdims=True)
            # a labeller's bad vote stays evidence of the bad class, or the classes could change places
            flip = rates[0, :, BAD] < rates[1, :, BAD]
            rates[:, flip] = rates[:, flip].mean(axis=0)
            rates[:, :, NONE] = 1
            good = (w[1].sum() + 1) / (w.sum() + 2)
            new = cls(good, rates).posterior(patterns)
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        return cls(good, rates)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern."""
        at = np.arange(patterns.shape[1])
        bad, good = (np.log(self.rates[k][at, patterns]).sum(axis=1) for k in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad - good + np.log1p(-self.good) - np.log(self.good), -50, 50)))


def pattern_codes(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def patterns_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit_weak_labels(docs: DataFrame) -> WeakLabels:
    """The label model from the votes on all texts; what reaches the driver are counts of at most 3^8 patterns."""
    schema = pa.schema([("pattern", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            offsets, data = text_buffer(b.column(0))
            for i, j in slices(offsets):
                counts += np.bincount(pattern_codes(votes(Texts(offsets[i : j + 1], data))), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield batch(schema, pattern=seen, count=counts[seen])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, count long").groupBy("pattern").agg(F.sum("count").alias("count")).orderBy("pattern").toPandas()
    if not len(found):
        return WeakLabels(0.5, np.full((2, len(LABELLERS), 3), 1 / 3))
    return WeakLabels.fit(patterns_of(found["pattern"].to_numpy(np.int64)), found["count"].to_numpy(float))


class Scorer:
    """Weights of hashed features; the score is the probability of good."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Scorer:
        """Logistic regression on soft targets by Adam steps; both classes weigh the same."""
        weights, bias = np.zeros(DIMS), 0.0
        if not len(rows):
            return cls(weights, bias)
        row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
        code, value = np.concatenate([x for x, _ in rows]).astype(np.int64), np.concatenate([y for _, y in rows])
        share = np.where(target >= 0.5, 0.5 / max((target >= 0.5).sum(), 1), 0.5 / max((target < 0.5).sum(), 1))
        m, v = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
        for step in range(1, rounds + 1):
            score = np.bincount(row, value * weights[code], len(rows)) + bias
            error = share * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - target)
            g = np.append(np.bincount(code, value * error[row], DIMS) + ridge * weights, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            weights -= move[:-1]
            bias -= move[-1]
        return cls(weights, bias)

    def score(self, t: Texts) -> np.ndarray:
        row, code = t.features()
        total = np.bincount(row, self.weights[code], t.rows) / (t.n + SHORT)
        return np.where(t.n > 0, 1 / (1 + np.exp(-np.clip(total + self.bias, -50, 50))), 0.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[WeakLabels, Scorer]:
    """Label model from all of docs, and the scorer from at most sample texts with their posterior labels.

    The sample are the distinct texts of the least hashes, in that order, whatever the partitions, so that a text of very
    many copies weighs no more than any other. A sampled text takes 12 bytes a feature, at most 200 KB.
    """
    labels = fit_weak_labels(docs)
    schema = pa.schema([("h", pa.int64()), ("pattern", pa.int64()), ("code", pa.list_(pa.int32())), ("share", pa.list_(pa.float64()))])
    picked = docs.select(F.col("text").cast("string").alias("text")).where("length(text) > 0").select("text", F.xxhash64("text").alias("h"))
    total = picked.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    # a hash bound that passes about 1.2 times the sample, so that little is sorted; the least hashes are the sample
    bound = min(1.0, 1.2 * sample / max(total, 1) + 8 / max(total, 1))
    picked = picked.where((F.col("h") / float(1 << 63) + 1) / 2 <= bound).groupBy("h").agg(F.any_value("text").alias("text")).select("text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(0))
            for i, j in slices(offsets):
                t = Texts(offsets[i : j + 1], data)
                row, code = t.features()
                pair, count = np.unique(row * DIMS + code, return_counts=True)
                at = np.searchsorted(pair // DIMS, np.arange(t.rows + 1))
                share = count / (t.n + SHORT)[pair // DIMS]
                yield batch(schema, h=b.column(1).slice(i, j - i), pattern=pattern_codes(votes(t)), code=[(pair[x:y] % DIMS).astype(np.int32) for x, y in zip(at[:-1], at[1:])], share=[share[x:y] for x, y in zip(at[:-1], at[1:])])

    rows: pd.DataFrame = picked.mapInArrow(run, "h long, pattern long, code array<int>, share array<double>").orderBy("h").limit(sample).toPandas()
    if not len(rows):
        return labels, Scorer(np.zeros(DIMS), 1.0)
    target = labels.posterior(patterns_of(rows["pattern"].to_numpy(np.int64)))
    if target.max() < 0.5 or target.min() >= 0.5:  # one class only: nothing to tell apart
        return labels, Scorer(np.zeros(DIMS), 10.0 if target.min() >= 0.5 else -10.0)
    features = [(np.asarray(c), np.asarray(s)) for c, s in zip(rows["code"], rows["share"])]
    del rows
    scorer = Scorer.fit(features, target)
    del features
    give_back()  # the driver's share of later steps is not to hold the sample
    # the fit takes both classes as equally frequent
    return labels, Scorer(scorer.weights, scorer.bias + float(np.log(labels.good / (1 - labels.good))))


def score_quality(docs: DataFrame, model: tuple[WeakLabels, Scorer] | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with label (posterior of the votes) and score (of the linear scorer), both probabilities of good, from 0 to 1.

    Null, empty and blank texts score 0. Columns of these names give way, others pass through; rows that repeat are scored
    alike. model: by default one trained on docs themselves. If the votes tell no two classes apart, all texts score alike.
    """
    docs = docs.drop("label", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, sample))
    at = docs.columns.index("text")
    out = docs.withColumns({"label": F.lit(0.0), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared.value
        for b in batches:
            offsets, data = text_buffer(b.column(at))
            for i, j in slices(offsets):
                t = Texts(offsets[i : j + 1], data)
                label = np.where(t.n > 0, labels.posterior(votes(t)), 0.0)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(label), pa.array(scorer.score(t))], names=out.names)

    return docs.mapInArrow(run, out)


def keep_good(docs: DataFrame, bound: float = BOUND, model: tuple[WeakLabels, Scorer] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score at least bound, with their columns as they were; null and blank texts go.

    Rows that repeat are judged alike, columns may have any names, an empty table stays empty, and texts of any length
    are scored whole. model: by default one trained on docs themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value[1]
        for b in batches:
            offsets, data = text_buffer(b.column(at).cast(pa.string()))
            for i, j in slices(offsets):
                t = Texts(offsets[i : j + 1], data)
                kept = pa.array((scorer.score(t) >= bound) & (t.n > 0))
                yield b.slice(i, j - i).filter(kept)

    return docs.mapInArrow(run, docs.schema)
