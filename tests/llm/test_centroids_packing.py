"""Centroid clustering against a loop in Python's integers and SQL; packing against the library's ids and bounds."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialmill.llm import centroids, packing
from trialmill.llm.queries import op11_centroid_clustering, op12_best_fit_packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def loop(rows: list[tuple[int | None, list]], k: int = 8, rounds: int = 10) -> list[tuple]:
    kept = [(i, [int(math.floor(1024 * x)) if abs(x) < 1e15 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    for step in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        if step < rounds:
            for j in set(own):
                mine = [v for (_, v), o in zip(kept, own) if o == j]
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    d = [far(v, c[o]) for (_, v), o in zip(kept, own)]
    fit = lambda x: x if x < 1 << 63 else None
    whole = fit(sum(d)) if all(map(fit, d)) or all(x < 1 << 63 for x in d) else None
    out = []
    for (i, _), o, x in zip(kept, own, d):
        mine = [y for y, p in zip(d, own) if p == o]
        out.append((i, o, fit(x), fit(sum(mine)) if all(y < 1 << 63 for y in mine) else None, whole, hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()))
    return out


NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
first = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def clustered(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").write.parquet(f"{tmp_path}/embeddings.parquet")
    return first(tuple(r[c] for c in NAMES) for r in op11_centroid_clustering(spark, str(tmp_path)).collect())


def test_clusters_equal_sql_and_loop(spark, sf_dir):
    got = first(tuple(r[c] for c in NAMES) for r in op11_centroid_clustering(spark, sf_dir).collect())
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert got == first(loop([(r.vec_id, r.embedding) for r in table]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == first(con.sql(f"SELECT {', '.join(NAMES)} FROM ({centroids.oracle()})").fetchall())


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e7, 1e30])
def test_odd_vectors_equal_the_loop(spark, tmp_path, scale):
    """Other lengths, nulls, NaN and infinities, ties, repeats, null ids; sizes beyond doubles' and longs' exact range."""
    r = random.Random(int(scale))
    grid = [[r.choice([-1.0, 0.0, 0.5]) * scale] * 64 for _ in range(60)]  # many ties, equal vectors, empty clusters
    rows = [(k // 2, v) for k, v in enumerate(grid)] + [(100 + k, [r.gauss(0, scale) for _ in range(64)]) for k in range(80)]
    rows += [(None, [scale] * 64), (300, None), (301, []), (302, [1.0] * 63), (303, [None] * 64), (304, [math.nan] * 64), (305, [math.inf] + [0.0] * 63), (306, [-0.0] * 64)]
    assert clustered(spark, tmp_path, rows) == first(loop(rows))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, tmp_path, n):
    rows = [(k, [float(k % 3)] * 64) for k in range(n)]
    assert clustered(spark, tmp_path, rows) == first(loop(rows))


def test_tournament_is_the_nearest_with_ties_to_the_smaller():
    r = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 28, 1 << 40):
        x, c = r.integers(-most, most, (300, 4)), r.integers(-most, most, (7, 4))
        c[5] = c[2]
        d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert centroids.Bisectors(c).winners(x).tolist() == [min(range(7), key=lambda j: (row[j], j)) for row in d.tolist()]


def packed_rows(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id long, text string, length int, sequence_id int").write.parquet(f"{tmp_path}/documents.parquet")
    return op12_best_fit_packing(spark, str(tmp_path)).collect()


def check_packing(rows, got, capacity=2048):
    """Every piece once and right, sequences gapless; gives the number of sequences and the least possible."""
    tokenizer, want = Tokenizer.from_file(WORDS), []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert first((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == first(want)
    groups: dict[int, list] = {}
    for r in got:
        groups.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in groups.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(groups), -(-sum(x[3] for x in want) // capacity)


def test_packing_of_the_corpus(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found, least = check_packing(rows, op12_best_fit_packing(spark, sf_dir).collect())
    assert least <= found <= least + 1


def test_packing_of_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, strings of added tokens, repeats, null ids, clashing names."""
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 9000), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (None, "x y"), (4, "hi " * 2047), (5, "hi " * 2048)]
    check_packing(rows, packed_rows(spark, tmp_path, rows))


def test_empty_table(spark, tmp_path):
    assert packed_rows(spark, tmp_path, []) == []


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 40)) for k in range(200)], "doc_id long, text string")
    pieces = packing.cut_pieces(docs, WORDS, capacity=64)
    packed = packing.pack(pieces, 64)
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    assert sum(map(len, ids.values())) == pieces.selectExpr("sum(length)").first()[0] and max(map(len, ids.values())) <= 64
    assert all(ids[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids) for r in packed.collect())


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


@pytest.mark.parametrize("kind", ["uniform", "long", "short", "one", "few", "thirds"])
def test_program_and_rounding(kind):
    """No length is covered above its count, all pieces are placed, the bound holds, and rounding costs little."""
    r, cap = np.random.default_rng(4), 256
    lengths = {
        "uniform": r.integers(1, cap + 1, 20_000), "long": r.integers(cap // 2 + 1, cap, 5000), "short": r.integers(1, 9, 20_000), "one": np.full(3000, 100),
        "few": r.choice([51, 77, 128, 130, 200], 20_000), "thirds": r.integers(cap // 3 - 2, cap // 3 + 3, 9000),
    }[kind]
    counts = histogram(lengths, cap)
    shares, bound = packing.fractional(counts, cap)
    held = np.zeros(cap + 1)
    for config, x in shares.items():
        assert sum(n * k for n, k in config) <= cap
        for n, k in config:
            held[n] += x * k
    np.testing.assert_allclose(held, counts, rtol=1e-6, atol=1e-6)
    whole, least = packing.configurations(counts, cap)
    placed = np.zeros(cap + 1, np.int64)
    for config, x in whole.items():
        for n, k in config:
            placed[n] += x * k
    assert (placed == counts).all()
    plain = sum(packing.best_fit(counts, cap).values())
    assert least - 1e-6 <= sum(whole.values()) <= plain * 1.001 + 1


def test_work_of_the_driver_is_bounded_by_the_capacity():
    """A million times the pieces: as many runs of the program, and still close to the bound."""
    counts = histogram(np.random.default_rng(2).integers(1, 257, 5000), 256)
    one, _ = packing.configurations(counts, 256)
    many, least = packing.configurations(counts * 1_000_000, 256)
    assert len(many) < 10 * len(one) + 1000 and sum(many.values()) <= least * 1.005 + 1


def test_knapsack_equals_all_combinations():
    r = random.Random(1)
    for _ in range(30):
        value = np.full(13, -np.inf)
        for n in r.sample(range(1, 13), 4):
            value[n] = r.random()
        best, _ = packing.knapsack(value, 12)

        def most(room):
            return max([0.0, *(value[n] + most(room - n) for n in range(1, room + 1) if value[n] > -np.inf)])

        assert best[12] == pytest.approx(most(12))
