"""The n-gram join where a token's texts come in pieces, and where a doc_id is missing or has several texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trialmill.llm import ngram_join

#: 30 words each: B is A with another last word, C is B with another first one. Links are A-B and B-C.
BASE = [f"w{k}" for k in range(30)]
A, B, C = (" ".join(x) for x in (BASE, [*BASE[:-1], "z"], ["y", *BASE[1:-1], "z"]))
OTHER = " ".join(f"q{k}" for k in range(20))


def test_last_row_of_a_very_large_token(spark):
    n = 70_001  # seven batches of 10,000 are passed on, one row follows
    rows = spark.range(n).coalesce(1).select(F.lit(7).cast("long").alias("tok"), F.col("id").alias("key"), F.lit((5 << 32) + 1).alias("at"))
    assert ngram_join._runs(rows).where("kind = 1").select("key").distinct().count() == n


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_texts_of_odd_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(ngram_join, "MAX_KEYS", bound)
    rows = [(1, A), (1, OTHER), (5, OTHER + " more"), (None, B), (None, B), (8, C), (9, "blank"), (9, None), (9, "blank")]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (0, 1), (1, 1), (1, 1), (5, 1), (8, 1), (9, 9), (9, 9), (9, 9)]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_texts_belong_to_their_keys(spark, monkeypatch, bound):
    monkeypatch.setattr(ngram_join, "MAX_KEYS", bound)
    docs = spark.createDataFrame([(1, A), (1, OTHER), (1, OTHER), (None, B), (None, B)], "doc_id long, text string")
    members = ngram_join._sets(docs).select("doc_id", "key", "n")
    got = ngram_join._texts(docs, members, members.select("key").distinct()).collect()
    assert sorted(r.text for r in got) == sorted([A, B, OTHER]) and len({r.key for r in got}) == 3


def test_every_text_of_a_doc_id_is_judged(spark):
    rows = [(1, A, "x"), (1, OTHER, "y"), (1, A, "z"), (2, B, "x"), (0, OTHER + " more", "x"), (3, None, "x"), (3, "alone it stands", "x"), (None, A, "x")]
    got = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect())
    assert kept == sorted([(-1, A), (0, OTHER + " more"), (1, A), (3, ""), (3, "alone it stands")])


@pytest.mark.parametrize("own, during", [("10000", "1024"), ("0", "1024"), ("7", "7")])
def test_python_gets_few_rows_at_a_time(spark, monkeypatch, own, during):
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", set(), ngram_join.materialize

    def noted(df, *args, **options):
        seen.add(spark.conf.get(name))
        return write(df, *args, **options)

    monkeypatch.setattr(ngram_join, "materialize", noted)
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        got = ngram_join.similar_groups(spark.createDataFrame([(1, A), (2, B), (3, OTHER)], "doc_id long, text string"))
        assert spark.conf.get(name) == own and seen == {during}
        assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 3)]
    finally:
        spark.conf.set(name, before)
