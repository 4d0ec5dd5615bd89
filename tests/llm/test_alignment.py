"""Token alignment against plain loops over tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trialmill.llm import token_alignment
from trialmill.llm.queries import op13_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "▁x", "x y", "　wide１", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café \U0001f600\U0001f600 日本語のテキスト",
    "\n\n\t  tabs   and\r\nlines", "\x00nul\x01", "é combining", " " * 5000, " " * 3000 + "x", "word " * 3000, "ab" * 4000, "12345678901234567890", "a​b", "ﬁne",
]


def loop(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    tokenizer, pieces, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), token_alignment.byte_letters()
    tokenizer.encode_special_tokens = True
    groups, held = [], Counter()
    for text in texts:
        found = []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False)
            b = pieces.encode(text, num_threads=1)
            left = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
            right = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right):
                x, y, at_x, at_y = [], [], 0, 0
                right = right[::-1]
                for i, t in left:
                    x.append(i)
                    at_x += len(t)
                    while at_y < at_x:
                        i, t = right.pop()
                        y.append(i)
                        at_y += len(t)
                    if at_x == at_y:
                        found.append((x, y))
                        x, y = [], []
        groups.append(found)
        held.update({(i, j) for x, y in found for i in x for j in y})
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for found in groups:
        links = [(i, j) for x, y in found for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        out.append((sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(spark, tmp_path, rows, schema="doc_id long, text string, key string, copies int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return op13_token_alignment(spark, str(tmp_path))


def test_the_corpus_equals_the_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in op13_token_alignment(spark, sf_dir).collect()}
    assert got == dict(zip((r.doc_id for r in docs), loop([r.text for r in docs])))


@pytest.mark.parametrize("frequent, copies", [(1 << 20, 1000), (50, 1)])
def test_odd_texts_equal_the_loop(spark, tmp_path, monkeypatch, frequent, copies):
    """Nulls, empty and very long texts, special strings, repeats and clashing names; with few pairs broadcast, and hot texts."""
    monkeypatch.setattr(token_alignment, "COPIES", copies)
    measures = token_alignment.measures
    monkeypatch.setattr(token_alignment, "measures", lambda a, c, **more: measures(a, c, frequent, **more))
    r = random.Random(5)
    signs = "".join(chr(c) for c in [*range(32, 127), 0xE9, 0x416, 0x5B57, 0x1F600, 0x301, 0xA0, 0x2028])
    texts = [*ODD, *ODD[8:12], "abc", *["hot text, twice"] * 9, *("".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(200))]
    rows = [(k // 2 if k else None, t, "x", 1) for k, t in enumerate(texts)]
    got = sorted(((x.doc_id or 0, *(x[c] for c in NAMES)) for x in run(spark, tmp_path, rows).collect()))
    assert got == sorted((k // 2, *m) for k, m in enumerate(loop(texts)))


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []).collect() == []


def test_ids_are_the_library_s_for_every_code_point():
    both = token_alignment.encoders(A, B, public_tokenizers.PATTERN)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b" for c in points]
    plain = [x.ids for x in both.plain.encode_batch(texts, add_special_tokens=False)]
    wrong = [hex(c) for c, t, ids in zip(points, texts, plain) if list(both.first(t)) != ids]
    assert wrong == []
