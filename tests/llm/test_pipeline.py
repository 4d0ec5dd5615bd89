"""The stages of the corpus pipeline, each judged on its own input."""

from __future__ import annotations

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).persist()
        assert out.columns == columns, name
        left = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        docs, ids = out, set(left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == ids and all(r.round_trip for r in last)
