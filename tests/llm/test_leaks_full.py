"""Leaks do not depend on the number of index shards, and are those of full BM25 scores of every window."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.llm import decontaminate


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = items.select((F.col("item_id") + 100_000).alias("doc_id"), F.array_join(F.slice(F.split("text", " "), 1, 30), " ").alias("text"))
    return docs.unionByName(part).cache(), items.cache()


def found(docs, items, overlap):
    rows = decontaminate.find_leaks(docs, items, overlap).collect()
    return {(r.doc_id, r.item_id): round(r.score, 9) for r in rows}


def test_shards_change_nothing(tables, monkeypatch):
    docs, items = tables
    whole = found(docs, items, 0.0)
    monkeypatch.setattr(decontaminate, "SHARD", -(-items.count() // 4))
    assert whole and found(docs, items, 0.0) == whole


def test_leaks_equal_full_scores(tables):
    docs, items = tables
    index = next(decontaminate.build_indexes(items))
    want = {}
    for doc_id, text in docs.collect():
        codes = index.numbers(decontaminate._terms_of([(text or "").lower()]).hash)
        for at in range(0, max(1, len(codes) - index.width + decontaminate.STRIDE), decontaminate.STRIDE):
            score = np.zeros(len(index.ids))
            for t in set(codes[at : at + index.width].tolist()) - {-1}:
                score[index.lists[t][0]] += index.lists[t][1]
            for i in np.flatnonzero(score >= 1).tolist():
                key = (doc_id, int(index.ids[i]))
                want[key] = max(want.get(key, 0.0), round(float(score[i]), 9))
    got = found(docs, items, 0.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
