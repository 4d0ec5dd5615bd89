"""Tags, quotes and comments as HTML reads them, on pages written by hand, and odd rows of the extractor."""

from __future__ import annotations

import time

import pytest

from trialmill.llm import html_text


def texts(body):
    return "|".join(x for x in html_text.Page(f"<article>{body}</article>").text if x)


@pytest.mark.parametrize("body, want", [
    ("<a title=it's>x</a><p>one</p><p>it's two</p>", "x|one|it's two"),
    ('<p class="x"">A</p><p>A 5" pipe.</p><p>B</p>', 'A|A 5" pipe.|B'),
    ("<!-->shown<p>C</p>", "shown|C"), ("<!--->shown<p>C</p>-->", "shown|C|-->"), ("<!-- a -- > b --!>seen", "seen"), ("a<!-- <p>no</p> -->b", "ab"),
    ('q <a href="foo>link</a> rest', "q link rest"), ('<p title="a > b">t &amp; <b>u</b><p>v', "t & u|v"), ("<p a = \"x>y\" b='>' c>z", "z"),
    ("<p/class=x>w</p>", "w"), ('<p =">a', "a"), ("a < b, 3<4", "a < b, 3<4"), ("<p a=>b</p>c", "b|c"), ("<p a='\">b</p>\"'>c", "c"),
])
def test_tags(body, want):
    assert texts(body) == want


def test_only_own_attributes_mark_a_node():
    page = html_text.Page('<div data-class="nav" title="class=\'menu\'">a</div><div CLASS=\'Nav\' id=main>b</div>')
    marks = [(g, b) for t, g, b in zip(page.tag, page.good, page.bad) if t == "div"]
    assert marks == [(0, 0), (1, 1)]


@pytest.mark.parametrize("text", ['<p a=">" ' * 200_000, "<p a='" * 200_001 + ">", "<!--" * 200_000, "<p =" * 200_000 + ">", "<a b=\"c" * 100_000 + "'>", "<p a" * 200_000 + ">"])
def test_time_is_linear(text):
    began = time.process_time()
    html_text.Page(text)
    assert time.process_time() - began < 20


def test_odd_rows(spark):
    story = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>It's paragraph {k} of the story, with a 5\" pipe and enough words to read.</p>" for k in range(8)) + "</article></body></html>"
    rows = [(1, story, "x"), (1, story, "x"), (None, story, "x"), (2, None, "x"), (3, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract_main_text(pages)
    found = [(r.page_id, r.text) for r in got.select("page_id", "text").collect()]
    want = "\n".join(f"It's paragraph {k} of the story, with a 5\" pipe and enough words to read." for k in range(8))
    assert sorted(found, key=str) == sorted([(1, want), (1, want), (None, want), (2, ""), (3, "")], key=str)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0
