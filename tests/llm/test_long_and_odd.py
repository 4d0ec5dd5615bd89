"""Very long and malformed texts, contract patterns over whole documents, odd rows, and models against plain versions."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from trialmill.llm import byte_bpe, html_text, line_dedup, ngram_join, pii, quality, secret_scan
from trialmill.llm.common import Covered

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def article(body):
    page = html_text.Page(f"<article>{body}</article>")
    return "|".join(x for x in page.text if x)


def test_malformed_markup():
    assert article('q <a href="foo>link</a> rest') == "q link rest"
    assert article('<p title="a > b">t &amp; <b>u</b><p>v') == "t & u|v"
    assert article("value <math>x=3</math> end") == "value x=3 end"
    assert article("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><script>var x='<p>';</script><!-- no -->e") == "a|b|c|d|e"
    assert article("a < b, 3<4") == "a < b, 3<4"


@pytest.mark.parametrize("text", ["<p " * 300_000, '<p "' * 250_000, '<p " ' * 200_000 + ">", '<a href="x>l</a> ' * 60_000, "1" * 1_000_000, "1." * 500_000, "a" * 1_000_000 + "@corp", "token=abcdefghijklmnop sk_live_abcdefghijklmnopqrs " * 20_000])
def test_time_is_linear(text):
    field = pii.ChainField.train(pii.training_table(40), rounds=2)
    began = time.process_time()
    html_text.Page(text)
    secret_scan.find(text)
    pii.added_spans(field, [text], [pii.base_spans(text)])
    assert time.process_time() - began < 40


def test_long_values_are_whole():
    text = f"https://{'u' * 90}:{'p' * 300}@h ghp_{'A' * 400} -----BEGIN RSA PRIVATE KEY-----"
    assert [text[a:b] for _, a, b, _ in secret_scan.find(text)] == [f"{'u' * 90}:{'p' * 300}", f"ghp_{'A' * 400}", "-----BEGIN RSA PRIVATE KEY-----"]


def test_base_spans_equal_the_contract(corpus):
    r = random.Random(3)
    parts = ["token", "PassWord", "api_key", '"', "'", ":", "=", " ", "AKIA", "ABC123XYZ", "0123456789abcdef", "a.b", "@", "x-y.org", "1.2.3.4", "256.1.1.1", "4111111111111111", "+1 (555) 010-2030", "é", "\n", "k/+=_.-9"]
    texts = [t for _, t in corpus] + ["".join(r.choices(parts, k=r.randint(1, 25))) for _ in range(4000)]
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for t in texts:
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == want
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [x[:3] for x in secret_scan.find(t) if x[0] != "live"] == want


def test_ownership(spark):
    key = "https://u:secretpw{}@h"
    rows = [(k, key.format("a"), None) for k in range(5)] + [(10, key.format("b"), None), (11, key.format("c"), "x"), (12, key.format("c"), "x"), (None, key.format("d"), None)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("spans", F.lit(1)), max_repos=1).collect()
    live = {(r.doc_id, s.owners, s.repos) for r in got for s in r.spans if s.kind == "live"}
    # copies without owners are copies; two repositories of one owner are too many here; alone, a value is live
    assert live == {(10, 1, 1), (None, 1, 1)}


def test_covered():
    r = np.random.default_rng(0)
    for _ in range(300):
        spans = [(int(a), int(a + n)) for a, n in zip(r.integers(0, 60, 5), r.integers(1, 9, 5))]
        a = int(r.integers(0, 60))
        b = a + int(r.integers(1, 9))
        assert Covered(spans).meets(a, b) == any(x < b and a < y for x, y in spans)


def test_pieces_equal_the_library(spark):
    coder, r = byte_bpe.ByteBPE(RANKS, PATTERN), random.Random(1)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(t): int(k) for t, k in zip(coder.tokens.to_pylist(), coder.rank)}, special_tokens={})
    signs = ["'", "'s", "'re", "'ll", "'v", "'ve", "'d", " ", "  ", "\n", "\t", "é", "a", "s", "e", "1", "²", "٣", "!", "　", "\x1c", "中", "😀", "\xa0", "word", "word "]
    texts = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(5000)] + ["".join(r.choices(signs, k=5000)), "ab" * 3000, " " * 5000, "x" * 300_000]
    other = byte_bpe.ByteBPE(RANKS, PATTERN + "|never")  # by the regular expression, not by classes
    for one, some in ((coder, texts), (other, texts[:1000])):
        ids, at = one.encode(pa.array(some))
        for k, text in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(text)
        assert [x.as_py() for x in one.decode(ids, at)] == [x.encode() for x in some]
    rows = spark.createDataFrame([(1, [5, None, 6], "x"), (2, None, "y"), (2, [], "y")], "doc_id long, ids array<int>, decoded string")
    got = byte_bpe.decode(rows, RANKS, PATTERN).collect()
    assert [bytes(r.decoded) for r in got] == [bytes(coder.tokens[int(coder.place[5])].as_py() + coder.tokens[int(coder.place[6])].as_py()), b"", b""]
    with pytest.raises(ValueError, match="rank file"):
        coder.decode(np.array([10**6]), np.array([0, 1]))
    assert byte_bpe.encode(rows.limit(0).withColumn("text", F.lit("")), RANKS, PATTERN).count() == 0


def test_sample_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("label"), F.lit("s").alias("score"))
    a, b = quality.train(docs.repartition(3), 60), quality.train(docs.repartition(7, "text").orderBy(F.desc("doc_id")), 60)
    assert np.array_equal(a[1].weights, b[1].weights)
    kept = quality.keep_good(docs, model=a)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_quality(docs, a).where("score >= 0.5").collect()}


def test_expectation_maximisation_equals_a_loop():
    r = np.random.default_rng(5)
    patterns, counts = np.unique(r.integers(0, 3, (200, 3)), axis=0, return_counts=True)
    q = np.clip(0.5 + ((patterns == 2).sum(1) - 3 * (patterns == 0).sum(1)) / 6, 0.05, 0.95)
    for _ in range(2):
        rates = np.ones((2, 3, 3))
        for p, c, g in zip(patterns, counts, q):
            for j, v in enumerate(p):
                rates[0, j, v] += c * (1 - g)
                rates[1, j, v] += c * g
        for k in range(2):
            for j in range(3):
                rates[k, j, [0, 2]] /= rates[k, j, 0] + rates[k, j, 2]
        for j in range(3):
            if rates[0, j, 0] < rates[1, j, 0]:
                rates[:, j, [0, 2]] = rates[:, j, [0, 2]].mean(axis=0)
        good = ((counts * q).sum() + 1) / (counts.sum() + 2)
        new = []
        for p in patterns:
            x, y = 1 - good, good
            for j, v in enumerate(p):
                x, y = x * (1 if v == 1 else rates[0, j, v]), y * (1 if v == 1 else rates[1, j, v])
            new.append(y / (x + y))
        q = np.array(new)
    model = quality.WeakLabels.fit(patterns, counts.astype(float), steps=2)
    assert np.allclose(model.posterior(patterns), q)


def test_line_dedup_of_odd_rows(spark):
    rows = [(k, f"Shared line\nown {k}", f"s{k}", 7) for k in range(6)] + [(0, "Shared line\nown 0", "s0", 7), (None, "Shared line", "s9", 7), (9, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(-1, "", 1, 1), (0, "Shared line\nown 0", 2, 0), (0, "Shared line\nown 0", 2, 0), *[(k, f"own {k}", 2, 1) for k in range(1, 6)], (9, None, 0, 0)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_pairs_of_a_run_of_tokens_come_once(spark):
    rows = [(t, key, 50, 50 - t, key) for key in range(6) for t in range(5)] + [(9, 0, 50, 5, 0), (9, 5, 50, 5, 5)]
    pairs = ngram_join._across(spark.createDataFrame(rows, "tok long, key long, n int, rest long, root long")).select("key", "other").collect()
    assert sorted(map(tuple, pairs)) == [(a, b) for a in range(6) for b in range(a + 1, 6)]


def test_bitmap_holds_frequent_tokens(spark):
    r = np.random.default_rng(7)
    toks = np.unique(r.integers(0, 1 << 48, 3000))
    bits = ngram_join._bitmap(spark.createDataFrame([(int(t), 5) for t in toks], "tok long, count long"))
    x = toks & (8 * len(bits) - 1)
    assert (bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).all() and np.unpackbits(bits).sum() == len(np.unique(x))
