"""The chain field of personal data: held-out lines written by hand, decoding and gradient against brute force."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from trialmill.llm import pii

#: Lines and the spans that the field has to add to the base spans; none of them is made from the templates.
HELD_OUT = [
    ("mail jo.smith [at] example.org today", [("email", "jo.smith [at] example.org")]),
    ("abc [at] def.example.com", [("email", "abc [at] def.example.com")]),
    ("jo (at) corp.com", [("email", "jo (at) corp.com")]),
    ("phone 212-555-0134", [("phone", "212-555-0134")]),
    ("call 212 555 0134", [("phone", "212 555 0134")]),
    ("Please send your CV to hiring [at] northwind [dot] net before Friday.", [("email", "hiring [at] northwind [dot] net")]),
    ("Questions? Contact maria_lopez(at)uni-ulm.de!", [("email", "maria_lopez(at)uni-ulm.de")]),
    ("The editor (editor {at} journal {dot} org) replied.", [("email", "editor {at} journal {dot} org")]),
    ("You can reach the front desk on (415) 555 2671, extension 9.", [("phone", "(415) 555 2671")]),
    ("Emergency contact: 617.555.0199", [("phone", "617.555.0199")]),
    ("Fax: 0351-4634567", [("phone", "0351-4634567")]),
    ("Telephone 0731/5024000 during office hours", [("phone", "0731/5024000")]),
    ("My card is 3782 822463 10005, please charge it.", [("card", "3782 822463 10005")]),
    ("She typed 4111.1111.1111.1111 into the form.", [("card", "4111.1111.1111.1111")]),
    ("Traffic came from 192[.]168[.]10[.]77 all night.", [("ip", "192[.]168[.]10[.]77")]),
    ("Route to 2001:db8:85a3::8a2e:370:7334 is up", [("ip", "2001:db8:85a3::8a2e:370:7334")]),
    ("Write to ann@example.org or call +1 (212) 555-0100.", []),
    ("The war lasted from 1939 to 1945 and cost 60 million lives.", []),
    ("He won 6-4 7-5 6-3 on 2019-07-14.", []),
    ("ISBN 978-0-306-40615-7, 412 pages, published 12.03.1998", []),
    ("Python 3.11.4 was released on June 6, 2023.", []),
    ("The train at 10:45 from platform 12 costs $1,250.50", []),
    ("Meet me [at] the corner, or at 5 @ the office", []),
    ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8 broke it", []),
    ("Table 3: 12 45 230 17 88", []),
    ("Order 100200300 shipped in 3 boxes", []),
    ("Follow @nasa and @esa for news", []),
    ("y = A @ x + b where A is 3 by 3", []),
    ("Room B-204, 2nd floor, ZIP 94110", []),
    ("RFC 2616 section 14.9.3 says so", []),
    ("latitude 48.4011, longitude 9.9876", []),
    ("page 12, lines 101-140, vol. 7 no. 3 (2004) 211-245", []),
    ("Serial 1234 5678 9012 3456 is no valid card", []),
]


#: The same, written after the templates were settled: the field's figure on lines that nothing was fitted to.
FRESH = [
    ("Send the invoice to billing (at) acme-tools (dot) com, thanks", [("email", "billing (at) acme-tools (dot) com")]),
    ("k.tanaka[at]lab.kyoto.ac.jp wrote the paper", [("email", "k.tanaka[at]lab.kyoto.ac.jp")]),
    ("Our help line: 800 555 0147 (weekdays)", [("phone", "800 555 0147")]),
    ("Text 646-555-0172 for details", [("phone", "646-555-0172")]),
    ("Mobile 0171 5550123 or office 030 5550199", [("phone", "0171 5550123"), ("phone", "030 5550199")]),
    ("Amex 371449635398431 was used twice", [("card", "371449635398431")]),
    ("Charge 5555.5555.5555.4444 for the tickets", [("card", "5555.5555.5555.4444")]),
    ("The resolver at 8[.]8[.]8[.]8 timed out", [("ip", "8[.]8[.]8[.]8")]),
    ("fe80::1ff:fe23:4567:890a replied in 3 ms", [("ip", "fe80::1ff:fe23:4567:890a")]),
    ("Between 1850 and 1900 some 2,300,000 people left.", []),
    ("Flight LH 454 leaves at 13:20 from gate B42.", []),
    ("The ratio 3:2 held in 17 of 20 runs (p = 0.003).", []),
    ("Chapter 4, pp. 88-121; see also vol. 12, 1987.", []),
    ("Set @media (max-width: 600px) in the sheet", []),
    ("Invoice 20231107 covers 14 days at 85.50 each", []),
    ("Dinner [at] noon, table 5", []),
]


@pytest.fixture(scope="module")
def field():
    return pii.ChainField.train(pii.training_table())


def test_training_is_quick():
    began = time.process_time()
    pii.ChainField.train(pii.training_table(300))
    assert time.process_time() - began < 10


def accuracy(field, table):
    """The share of words of a table whose kind is right."""
    right = words = 0
    for text, want in table:
        found = [(k, text[a:b]) for k, a, b in pii.added_spans(field, [text], [pii.base_spans(text)])[0]]
        for m in pii._WORD.finditer(text):
            of = [{k for k, x in spans if text.find(x) <= m.start() < text.find(x) + len(x)} for spans in (found, want)]
            words += 1
            right += of[0] == of[1]
    return right / words


def test_lines_written_by_hand(field):
    assert accuracy(field, HELD_OUT) >= 0.95
    assert accuracy(field, FRESH) >= 0.9


@pytest.mark.parametrize("text, want", HELD_OUT[:5])
def test_obfuscated_spans(field, text, want):
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(field, [text], [pii.base_spans(text)])[0]] == want


def test_bounds(field):
    text = 'reach "jo.smith (at) corp.com", or (212-555-0134); cards 4111111111111111 4111111111111111.\nnone here\n(call (212) 555-0134)'
    got = [(k, text[a:b]) for k, a, b in pii.added_spans(field, [text], [pii.base_spans(text)])[0]]
    assert got == [("email", "jo.smith (at) corp.com"), ("phone", "212-555-0134"), ("card", "4111111111111111"), ("card", "4111111111111111"), ("phone", "(212) 555-0134")]


def test_lines_are_read_whole(field):
    far = "the word " * 5000 + "call 212 555 0134 " + "is mine " * 5000
    assert [far[a:b] for _, a, b in pii.added_spans(field, [far], [[]])[0]] == ["212 555 0134"]
    texts = [far, "", "no mark", "phone 212-555-0134\n" * 3]
    together = pii.added_spans(field, texts, [[]] * 4)
    assert together == [pii.added_spans(field, [x], [[]])[0] for x in texts]
    assert len(together[3]) == 3 and together[1] == together[2] == []


def test_decoding_equals_all_paths(field):
    n = len(pii.LABELS)
    step = field.step + pii.BAN
    lines = [["call", "212", "555"], ["jo", "(at)", "corp.com", "x"], ["x"], [], ["4111111111111111", "4111111111111111"]]
    for line, got in zip(lines, field.decode(lines)):
        if not line:
            assert got == []
            continue
        s = field.scores(line)

        def value(path):
            return pii.BAN[0][path[0]] + sum(s[t, x] for t, x in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(n), repeat=len(line)), key=value)
        assert np.isclose(value(tuple(got)), value(best))


def test_gradient_equals_differences():
    r = np.random.default_rng(3)
    n = len(pii.LABELS)
    scores, step = r.normal(size=(3, 4, n)), r.normal(size=(n, n))
    gold = np.array([[0, 1, 2, 0], [3, 4, 0, 0], [5, 6, 6, 7]])
    on = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 1]], bool)
    node, pair, _ = pii.ChainField.gradient(scores, step, gold, on)
    for row, t, label in [(0, 0, 1), (0, 3, 0), (1, 1, 4), (1, 2, 3), (2, 2, 6)]:
        moved = scores.copy()
        moved[row, t, label] += 1e-5
        up = pii.ChainField.gradient(moved, step, gold, on)[2]
        moved[row, t, label] -= 2e-5
        down = pii.ChainField.gradient(moved, step, gold, on)[2]
        assert np.isclose(node[row, t, label], (up - down) / 2e-5, atol=1e-5)
    for a, b in [(0, 1), (1, 2), (3, 4), (6, 6), (2, 0)]:
        moved = step.copy()
        moved[a, b] += 1e-5
        up = pii.ChainField.gradient(scores, moved, gold, on)[2]
        moved[a, b] -= 2e-5
        down = pii.ChainField.gradient(scores, moved, gold, on)[2]
        assert np.isclose(pair[a, b], (up - down) / 2e-5, atol=1e-5)


def test_repeated_rows_empty_table_other_columns(spark):
    rows = [(1, "phone 212-555-0134", 1, "x"), (1, "phone 212-555-0134", 1, "x"), (None, None, 2, "y"), (3, "", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, start string")
    got = pii.digest(pii.find_personal(docs)).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in got) == [(0, ""), (1, "phone:6:18"), (1, "phone:6:18"), (3, "")]
    assert pii.digest(pii.find_personal(docs.where("false"))).count() == 0
