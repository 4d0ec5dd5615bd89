"""Large groups of near copies that are just not linked: no row for each of their pairs, and no link lost."""

from __future__ import annotations

import random

import pytest

from trialmill.llm import ngram_join


def near_copies(texts: int, words: int, changed: int) -> list[tuple[int, str]]:
    """Texts of one base, each with some words of its own: two of them are a little less alike than linked texts are, but some."""
    draw = random.Random(3)
    rows = []
    for k in range(texts):
        text = [f"w{i}" for i in range(words)]
        for i in draw.sample(range(0, words, 5), changed):
            text[i] = f"own{k}x{i}"
        rows.append((k, " ".join(text)))
    rows += [(texts + k, f"{text} last") for k, text in rows[:20]]  # linked with one each
    return rows


def brute_components(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in rows)}
    root = {k: k for k in sets}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("texts, block, keys", [(120, 16, 1 << 18), (100, 512, 0)])
def test_pairs_of_near_copies_that_fail_are_no_rows(spark, monkeypatch, texts, block, keys):
    rows, written, write = near_copies(texts, 200, 3), [], ngram_join.materialize

    def noted(df, name, **options):
        out = write(df, name, **options)
        if name == "pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", noted)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block, raising=False)
    monkeypatch.setattr(ngram_join, "MAX_KEYS", keys)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert sum(written) < 10 * len(rows)
