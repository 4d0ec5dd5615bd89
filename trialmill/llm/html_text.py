"""Main text of web pages: boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants consistent.

A page becomes a tree of block elements with runs of text as leaves. Each node has features: text and link density of its
subtree, tag, attribute tokens, depth, siblings and what stands above it. Boosted trees, trained on pages that are made
by rule with known content nodes (training_pages), give each node the log odds of belonging to the article. The decoding
takes the best consistent choice: a node that is left out takes its whole subtree with it, so no kept node stands below
a dropped one.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import SLICE_BYTES, slices, text_buffer

#: Attributes: a quote opens a value only after the sign, and one that never closes belongs to a value without quotes.
_NAME, _VALUE = r"(?:=[^\s/>=]*+|[^\s/>=]++)", r"(?:\"[^\"]*\"|'[^']*'|[^\s>]*+)"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
_TAG = re.compile(rf"{_COMMENT}|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)>|<[!?/][^>]*>?", re.S)
#: A tag that would hold all the rest of the page ends at its first bracket.
_PLAIN_TAG = re.compile(rf"{_COMMENT}|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>|<[!?/][^>]*>?", re.S)
_OPEN = re.compile(r"<(?:/?[A-Za-z]|[!?/])")
_ATTR = re.compile(rf"[\s/]*+({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_MARKS = {"class", "id", "role"}
_TOKEN = re.compile(r"[a-z]+")
_RAW = {k: re.compile(rf"</{k}\b[^>]*>?", re.I) for k in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "canvas")}
BLOCKS = set(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"hr"}
_BREAKS = {"br", "wbr"}
#: A start tag of the key closes an open element of the value, up to a container.
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = set("html body div article section main aside nav header footer form ul ol table td th blockquote fieldset figure details dialog".split())
GOOD = set("article content main post entry body story text blog prose single hentry".split())
BAD = set("nav navbar menu menubar header masthead footer foot sidebar side aside ad ads advert advertisement sponsor sponsored banner promo cookie consent gdpr notice alert popup modal newsletter subscribe signup login form search comment comments reply replies respond discuss disqus share social related recommend widget breadcrumb breadcrumbs pagination pager copyright legal tags meta toolbar skip".split())
TAGS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside", "dialog"}, {"form", "button", "fieldset", "label", "legend", "option"}, {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"div", "section"}, {"td", "th", "tr", "table", "tbody"}, {"#text"}, {"head"}]


class Page:
    """Nodes in page order: tag, parent, depth, attribute marks, and the text of leaves."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.depth, self.good, self.bad, self.text, self.linked = ["html"], [-1], [0], [0], [0], [""], [0]
        self.inside: list[bool] | None = None
        stack, anchor, run, run_links, at = [0], 0, [], 0, 0

        def flush() -> None:
            nonlocal run, run_links
            text = " ".join(html.unescape("".join(run)).split()) if run else ""
            if text:
                self._add("#text", stack[-1], 0, 0, text, min(run_links, len(text)))
            run, run_links = [], 0

        n, last, paired = len(source), source.rfind(">"), True
        while at < n:
            first = _OPEN.search(source, at)
            m = None
            if first and (first.start() <= last or source[first.end() - 1] in "!?/"):
                m = _TAG.match(source, first.start()) if paired else None
                if m is None:
                    # the page ends within this tag: from here on tags end at their first bracket
                    paired, m = False, _PLAIN_TAG.match(source, first.start())
            piece = source[at : m.start()] if m else source[at:]
            if piece:
                run.append(piece)
                run_links += len(piece) if anchor else 0
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "a":
                    anchor = 0
                elif name in BLOCKS:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            del stack[k:]
                            break
                continue
            if name in _RAW and not m[3].endswith("/"):
                end = _RAW[name].search(source, at)
                at = end.end() if end else n
                continue
            if name == "a":
                anchor = 1
            elif name in _BREAKS or name == "img":
                run.append(" ")
            elif name in BLOCKS:
                flush()
                if name != "html":
                    self._close(stack, name)
                    if name not in _VOID and not (name == "body" and "body" in (self.tag[k] for k in stack)):
                        if name == "body" or (self.tag[stack[-1]] == "head" and name not in ("head", "hr")):
                            while len(stack) > 1 and self.tag[stack[-1]] == "head":
                                stack.pop()
                        tokens = {t for k, v in _ATTR.findall(m[3]) if k.lower() in _MARKS for t in _TOKEN.findall(v.lower())} if m[3] else ()
                        stack.append(self._add(name, stack[-1], sum(t in GOOD for t in tokens), sum(t in BAD for t in tokens), "", 0))
        flush()

    def _close(self, stack: list[int], name: str) -> None:
        wanted = _CLOSES.get(name, set()) | ({"p"} if name not in ("option", "label", "legend", "button") else set())
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in wanted:
                del stack[k:]
                return
            if tag in _CONTAINERS:
                return

    def _add(self, tag: str, parent: int, good: int, bad: int, text: str, linked: int) -> int:
        for column, value in zip((self.tag, self.parent, self.depth, self.good, self.bad, self.text, self.linked), (tag, parent, self.depth[parent] + 1, good, bad, text, linked)):
            column.append(value)
        return len(self.tag) - 1


_KIND = {tag: k for k, tags in enumerate(TAGS) for tag in tags}


def node_features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the nodes of some pages, one after the other, and the bounds of each page's nodes."""
    size = np.array([len(p.tag) for p in pages])
    root = np.concatenate([[0], np.cumsum(size)])
    join = lambda name, kind: np.array([x for p in pages for x in getattr(p, name)], kind)
    n, page = int(root[-1]), np.repeat(np.arange(len(pages)), size)
    depth = join("depth", np.int64)
    parent = join("parent", np.int64) + root[page]
    parent[root[:-1]] = root[:-1]
    own = np.array([len(x) for p in pages for x in p.text], float)
    kind = np.array([_KIND.get(t, len(TAGS)) for p in pages for t in p.tag])
    marks = np.array([x.count(",") + x.count(".") + x.count(";") if x else 0 for p in pages for x in p.text], float)
    sums = np.stack([own, join("linked", float), np.ones(n), (kind == _KIND["#text"]).astype(float), marks])
    by_depth = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[by_depth], np.arange(1, depth.max() + 2))
    levels = [by_depth[x:y] for x, y in zip(levels[:-1], levels[1:])]
    for level in reversed(levels):
        at = parent[level]
        for row in sums:
            row += np.bincount(at, row[level], n)
    chars, links, nodes, leaves, marks = sums
    child = np.ones(n, bool)
    child[root[:-1]] = False
    kids = np.bincount(parent[child], minlength=n).astype(float)
    by_parent = np.argsort(np.where(child, parent, -1), kind="stable")[len(pages) :]
    order = np.zeros(n)
    held = parent[by_parent]
    order[by_parent] = np.arange(len(held)) - np.searchsorted(held, held)
    good, bad = np.minimum(join("good", float), 3), np.minimum(join("bad", float), 3)
    up_good, up_bad = good + (kind == 0), bad + np.isin(kind, (1, 2, 3, 4, 5, 14))
    for level in levels:
        up_good[level] += up_good[parent[level]]
        up_bad[level] += up_bad[parent[level]]
    siblings = kids[parent]
    numbers = [
        depth, np.log1p(chars), np.log1p(own), chars / nodes, links / np.maximum(chars, 1), np.log1p(nodes), np.log1p(leaves), marks / np.maximum(chars, 1) * 100, kids, siblings,
        order / np.maximum(siblings, 1), chars / np.maximum(chars[parent], 1), chars / np.maximum(chars[root[page]], 1), good, bad, np.minimum(up_good, 4), np.minimum(up_bad, 4), (np.arange(n) - root[page]) / size[page],
        *[kind == k for k in range(len(TAGS))], *[kind[parent] == k for k in range(13)],
    ]
    out = np.empty((n, len(numbers)), np.float32, order="F")
    for k, column in enumerate(numbers):
        out[:, k] = column
    return out, root


def decode(page: Page, score: np.ndarray) -> list[str]:
    """Texts of the kept leaves: the choice of largest total score in which no kept node has a dropped ancestor."""
    n = len(page.tag)
    total = np.clip(score, -6, 6).astype(float)
    for k in range(n - 1, 0, -1):
        total[page.parent[k]] += max(0.0, total[k])
    kept = np.zeros(n, bool)
    kept[0] = True
    out = []
    for k in range(1, n):
        kept[k] = kept[page.parent[k]] and total[k] > 0
        if kept[k] and page.text[k]:
            out.append(page.text[k])
    return out


def training_pages(count: int = 260, seed: int = 3) -> Iterator[tuple[str, set[str]]]:
    """Pages made by rule, with the leaf texts of their articles. Each text is made once, so that it tells its place."""
    r, serial = random.Random(seed), 0

    def words(lo: int, hi: int) -> str:
        nonlocal serial
        serial += 1
        body = [("".join(r.choices("aeinorst", k=r.randint(2, 9)))) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(lo, hi))]
        return " ".join([f"q{serial}", *body]) + r.choice([".", ".", "", "!"])

    for _ in range(count):
        keep: set[str] = set()

        def main_text(lo: int, hi: int) -> str:
            text = words(lo, hi)
            keep.add(text)  # noqa: B023
            return text

        def menu() -> str:
            items = [words(0, 2) for _ in range(r.randint(3, 9))]
            body = "".join(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(items))
            return r.choice([f"<nav><ul>{body}</ul></nav>", f'<div class="menu"><ul>{body}</ul></div>', f'<header><nav><ul>{body}</ul></nav></header>', f'<ul id="nav">{body}</ul>'])

        def boiler() -> str:
            x, y = words(2, 14), words(1, 8)
            return r.choice([
                f'<div class="ad">{x}</div>', f'<div class="ad">{x}</div>', f'<aside class="sidebar"><h3>{y}</h3><p>{x}</p></aside>', f'<div class="sidebar"><ul><li><a href="#">{x}</a></li><li><a href="#">{y}</a></li></ul></div>',
                f'<div class="cookie-notice" role="alert"><p>{x}</p><button>{y}</button></div>', f'<form action="/s"><label>{y}</label><input name="q"><button>{words(0, 1)}</button></form>', f"<header><p>{x}</p></header>",
                f'<div class="promo banner"><p>{x}</p></div>', f'<div id="newsletter"><h4>{y}</h4><form><input><button>{words(0, 1)}</button></form></div>', f'<div class="related"><h3>{y}</h3><ul><li><a href="/r">{x}</a></li></ul></div>',
                f'<section class="comments"><h3>{y}</h3><div class="comment"><p>{x}</p></div><div class="comment"><p>{words(4, 40)}</p></div></section>', f'<ol class="commentlist"><li><p>{words(4, 40)}</p></li></ol>',
            ])

        def paragraph() -> str:
            kind = r.random()
            if kind < 0.7:
                return f"<p>{main_text(0, 90)}</p>"
            if kind < 0.82:
                return f"<p><b>{main_text(0, 40)}<br>"
            if kind < 0.88:
                return f"<h2>{main_text(1, 8)}</h2>"
            if kind < 0.93:
                return "<ul>" + "".join(f"<li>{main_text(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            return f"<blockquote><p>{main_text(3, 40)}</p></blockquote>"

        lines = [f"<h1>{main_text(0, 14)}</h1>", *[paragraph() for _ in range(r.choice([0, 1, 2, 3, 6, 12, 25]))]]
        if r.random() < 0.3:
            lines.insert(r.randint(1, len(lines)), boiler())
        body = "".join(lines)
        if r.random() < 0.2:
            body += boiler()
        body = r.choice([f"<article>{body}</article>"] * 4 + [f"<main>{body}</main>", f'<div class="content">{body}</div>', f'<div id="main"><article class="post">{body}</article></div>', f"<main><article>{body}</article></main>", f'<div class="wrap"><div class="entry-content">{body}</div></div>'])
        foot = r.choice([f"<footer>&copy; {words(1, 9)}</footer>"] * 3 + [f'<div class="footer"><p>{words(1, 9)}</p></div>', f"<footer><ul><li><a>{words(0, 2)}</a></li></ul><p>{words(2, 9)}</p></footer>"])
        page = menu() + "".join(boiler() for _ in range(r.randint(0, 3))) + body + "".join(boiler() for _ in range(r.choice([0, 0, 1, 2]))) + foot
        yield f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var t='</p>';</script></head><body>{page}" + r.choice(["</body></html>", ""]), keep


def train_extractor(pages: Iterator[tuple[str, set[str]]] | None = None) -> BoostedTrees:
    """Trees trained on pages with known leaf texts; a node is content if it holds some, and is no wider than its article."""
    xs, ys = [], []
    for source, keep in pages if pages is not None else training_pages():
        page = Page(source)
        label = np.array([x in keep for x in page.text])
        for k in range(len(label) - 1, 0, -1):
            label[page.parent[k]] |= label[k]
        xs.append(node_features([page])[0][1:])
        ys.append(label[1:])
    return BoostedTrees.train(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_main_text(pages: DataFrame, model: BoostedTrees | None = None, column: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each in place of its html; other columns pass through, one named like the new one does not.

    Null and empty html, and pages without content, give an empty text; rows that repeat are treated alike, an empty table
    stays empty. Every page is parsed whole in one forward pass; where a quote in a tag stays open till the page's end,
    this tag and those after it end at their first bracket. References are decoded,
    white space inside a block becomes one space, and blocks are joined in page order by a line feed. Rows are independent,
    so there is no shuffle; the model is a few kilobytes. model: by default one trained on training_pages().
    """
    rest = [c for c in pages.columns if c not in (column, into)]
    pages = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").cast("string").alias(column))
    out = pages.drop(column).withColumn(into, F.lit("")).schema
    shared = pages.sparkSession.sparkContext.broadcast(model or train_extractor())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(text_buffer(whole.column(len(rest)))[0], 2 * SLICE_BYTES):
                b = whole.slice(i, j - i)
                parsed = [Page(x or "") for x in b.column(len(rest)).to_pylist()]
                features, bounds = node_features(parsed)
                scores = shared.value.predict(features)
                texts = ["\n".join(decode(p, scores[x:y])) for p, x, y in zip(parsed, bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, into])

    return pages.mapInArrow(run, out)
