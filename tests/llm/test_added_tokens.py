"""op6 against the unmodified library where texts quote an added token."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trialmill.llm import queries

TEXTS = ["a <|endoftext|> b", "a<|endoftext|>b  Word.", "<|STARTOFTEXT|> in capitals", "<|startoftext|>", "cut <|endof text|> é x <|endoftext|>", "plain words, no token", None, ""]


def test_query_equals_the_unmodified_library(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    got, start = {r.doc_id: r for r in queries.op6_orc_token_files(spark, str(tmp_path)).collect()}, 0
    for k, text in enumerate(TEXTS):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)
