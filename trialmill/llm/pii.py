"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels the words of each line that holds a digit or an at-sign as outside of personal data, or as the begin or
inside of an email, ip, card or phone. Features of a word are its shape (character classes), digit count and marks, and
those of the words before and after. It is trained by gradient steps on a small labelled table (by default training_table(),
templates filled in by rule), and decoded by Viterbi in numpy over batches of whole lines. The labels set the bounds of the
spans that it adds, without punctuation at their ends; a span must hold as many digits or parts as such data has (_holds)
and touch no base span.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Covered

KINDS = ["email", "ip", "card", "phone"]
# Fixed patterns of the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where its first run of digits does: further on in the run it would fail as well.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if k % 2 == 0 else twice[int(d)] for k, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of LOCAL characters, an at-sign and DOMAIN; looks left from each at-sign, so that long words cost no more."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if any(c in text for c in "0123456789"):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# --- the conditional random field ---

#: Outside, then begin and inside of each kind.
LABELS = ["O", *[f"{at}-{k.upper()}" for k in KINDS for at in "BI"]]
#: Steps that no labels take: to the inside of a kind from anything but its begin or inside; lines start outside or with a begin.
BAN = np.array([[-1e4 if b and b % 2 == 0 and a not in (b - 1, b) else 0.0 for b in range(len(LABELS))] for a in range(len(LABELS))])
#: Words of a line; a colon or equals sign ends one, unless it stands in a number.
_WORD = re.compile(r"(?:[^\s:=]|(?<=[0-9A-Fa-f:]):(?=[0-9A-Fa-f:]))+[:=]*|[:=]+")
#: Lines without such a mark hold no personal data.
_MARKED = re.compile(r"[0-9@]|[\[({]at[\])}]", re.I)
_AT = re.compile(r"@|[\[({]at[\])}]", re.I)
_DOT = re.compile(r"[\[({](?:dot|\.)[\])}]", re.I)
_EDGE = ".,;:!?\"'*#$%&|<>=~/\\-"
#: Templates of the small labelled table: {kind} stands for a value of that kind, {word} for a made-up word, other values for things that are no personal data.
TEMPLATES = [
    "write to {email} for the list", "mail {email} or {email} today", "contact: {email}", "e-mail {email}, please", "{word} {email} {word}", "{word}, {email}.", "ask {word} at {email} for it", "{email}", "reach me via {email} or {phone}", "from {email} to {email}",
    "the host {ip} was down", "from {ip} to {ip} in one hop", "server {ip} answered", "ping {ip}, then {ip}.", "{word} {ip} {word}", "address {ip}", "ip: {ip}", "{ip}", "node {ip} has {count} cores",
    "card {card} was charged", "paid with {card} on monday", "pan {card}", "visa {card}, valid until {date}", "cards {card} {card}.", "{word} {card} {word}", "{card}", "credit card: {card}", "{card} and {card}",
    "call {phone} at noon", "tel {phone} or {phone}", "phone: {phone} office", "call {phone}, not {count} {count}", "{word} {phone} {word}", "phone {phone}", "fax {phone}, mobile {phone}.", "{phone}", "dial {phone} ({word} {word})", "ring us on {phone} before {time}", "my number is {phone}", "call me on {phone} please", "call {phone}", "please call {phone} now", "{word} call {phone} {word}", "phone number {phone}", "mobile: {phone}", "telephone {phone}", "{email} {word}", "{word} {email}",
    "in {year} there were {count} of them", "see page {count} and page {count}", "version {version} of the {word}", "released {version} under {version} terms", "{word} {version}.", "{word} {count} {word}", "{count} {count} {count}", "{count} {count} {count} {count}", "{word} {count} {count} {count} {word}", "{count} {count}", "{count} | {count} | {count}", "{word} {count} {count}", "{word} {date} {word}",
    "order {long} has {count} items", "call 911", "room 12-4 at {time}", "on {date} and {date}", "no numbers here at all", "user @{word} said so", "id {long}", "from {year} to {year}", "{year}-{year}", "pp. {count}-{count}", "isbn {isbn}", "{word} {isbn} {word}",
    "hash {hash}", "{word} {hash} {word}", "{long} is a count", "sums of {sum} and {sum}", "{word} ({year}) {count}, {count}", "met @ {time} [at] the {word}", "{word} (at) {count} {word}", "prices: {sum}, {sum}", "from {time} to {time}", "{word} [at] noon {word}", "sold at @ {sum} each", "{word} {ratio} {word}", "won {ratio} in {year}", "the {word} (at) {word} {word}", "{word} @ {word}", "{word}{count} and {word}{count}", "part {part}, rev {count}", "{word} {part} {word}",
]
_CLASS = {i: "a" if chr(i).islower() else "A" if chr(i).isupper() else "9" if chr(i).isdigit() else chr(i) for i in range(128)}


class _Classes(dict):
    def __missing__(self, key: int) -> str:
        return "x"


_CLASSES = _Classes(_CLASS)
_RUN = re.compile(r"([aAx])\1+")
_ANY_RUN = re.compile(r"(.)\1+", re.S)
_SHORT = 64


def features(word: str) -> list[str]:
    """What a word looks like: its shapes whole, counts and marks, and itself if it has letters only."""
    core = word.strip(_EDGE)
    raw = core.translate(_CLASSES)
    shape = _RUN.sub(r"\1", raw)
    digits, letters = raw.count("9"), raw.count("a") + raw.count("A") + raw.count("x")
    found = ["bias", "s:" + shape, "r:" + _ANY_RUN.sub(r"\1", raw), f"d:{min(digits, 20)}", f"dots:{min(core.count('.'), 4)}", f"colons:{min(core.count(':'), 3)}", f"dashes:{min(core.count('-'), 4)}", f"end:{word[-1:] if word[-1:] in _EDGE else ''}", f"begin:{word[:1] if not word[:1].isalnum() else ''}"]
    if _AT.search(word):
        found.append(f"at:{bool(_AT.match(core))}:{letters + digits > 2}")
    if _DOT.search(word):
        found.append("dot")
    if not digits and letters == len(core):
        found.append("w:" + core.lower())
    if digits and letters:
        found.append("mixed")
    if not letters:
        found.append("bare")
    return found


def training_table(rows: int = 2400, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Words and labels of the templates, filled in by rule, with made-up words around half of them."""
    r = random.Random(seed)

    def digits(n: int) -> str:
        return "".join(r.choices("0123456789", k=n))

    def word() -> str:
        w = "".join(r.choices("etaoinshrdlucmfwypvbgkqjxz", weights=range(27, 1, -1), k=r.randint(1, 9)))
        return r.choice([w, w, w, w.capitalize()])

    def email() -> str:
        name = r.choice(["{a}", "{a}.{b}", "{a}_{b}", "{a}{n}", "{a}.{n}", "{a}-{b}"]).format(a=word(), b=word(), n=digits(2))
        site = r.choice(["{a}", "{a}", "mail{n}.{a}", "{a}.{b}", "{a}.{b}", "{a}-{b}"]).format(a=word().lower(), b=word().lower(), n=digits(1))
        end, at, dot = r.choice(["com", "org", "net", "edu", "de", "fr", "co.uk", "io", "info"]), r.choice(["at", "at", "AT"]), r.choice(["dot", "."])
        a, b = r.choice(["[]", "[]", "()", "()", "{}"])
        form = r.choice(["{x}@{y}.{z}", "{x}@{y}.{z}", "{x} {o}{at}{c} {y}.{z}", "{x} {o}{at}{c} {y}.{z}", "{x}{o}{at}{c}{y}.{z}", "{x} {o}{at}{c} {y} {o}{dot}{c} {z}", "{x}{o}{at}{c}{y}{o}{dot}{c}{z}", "{x} @ {y}.{z}"])
        return form.format(x=name, y=site, z=end, at=at, dot=dot, o=a, c=b)

    def ip() -> str:
        if r.random() < 0.25:
            parts = [f"{r.randrange(1 << 16):x}" for _ in range(8)]
            k = r.randint(1, 6)
            return ":".join(parts) if r.random() < 0.5 else ":".join(parts[:k]) + "::" + ":".join(parts[k + 1 : k + 1 + r.randint(0, 6 - k)] or parts[:1])
        marks = r.choice([[".", ".", "."], ["[.]"] * 3, [".", ".", "[.]"], ["[.]", ".", "."], ["(.)"] * 3])
        return str(r.randint(0, 255)) + "".join(m + str(r.randint(0, 255)) for m in marks)

    def card() -> str:
        x = digits(16) if r.random() < 0.75 else digits(15)
        parts = [x] if r.random() < 0.3 else re.findall("....", x) if len(x) == 16 else [x[:4], x[4:10], x[10:]]
        return r.choice(" -.").join(parts)

    def phone() -> str:
        form = r.choice(["+1 (000) 000-0000", "+00 000 000 0000", "(000) 000-0000", "+0-000-000-0000", "000-000-0000", "000-000-0000", "000 000 0000", "000 000 0000", "000.000.0000", "0-000-000-0000", "(000)000-0000", "(00) 0000 0000", "0000 000 000", "0000 000000", "00 00 00 00 00", "0000/0000000", "0000-0000000", "0000 0000000", "0000 00000000", "(000) 000 0000"])
        return re.sub("0", lambda _: digits(1), form)

    values = {
        "word": word, "email": email, "ip": ip, "card": card, "phone": phone, "hash": lambda: "".join(r.choices("0123456789abcdef", k=r.choice([8, 32, 40]))), "year": lambda: str(r.randint(1700, 2040)),
        "count": lambda: digits(r.randint(1, 4)), "long": lambda: digits(r.choice([6, 7, 8, 9, 11, 12, 13, 20, 21])), "version": lambda: ".".join(digits(r.randint(1, 2)) for _ in range(r.randint(2, 3))), "time": lambda: f"{r.randint(0, 23)}:{digits(2)}",
        "date": lambda: r.choice([f"{r.randint(1800, 2040)}-{digits(2)}-{digits(2)}", f"{digits(2)}-{digits(2)}-{r.randint(1800, 2040)}", f"{digits(2)}.{digits(2)}.{r.randint(1800, 2040)}", f"{digits(1)}/{digits(2)}/{digits(2)}", f"{digits(2)} {word()} {r.randint(1800, 2040)}"]),
        "isbn": lambda: r.choice([f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}"]), "sum": lambda: r.choice(["${},{}.{}", "{},{},{}", "{}.{}.{}"]).format(r.randint(1, 999), digits(3), digits(3)),
        "ratio": lambda: f"{digits(1)}{r.choice('-:/')}{digits(1)}", "part": lambda: f"{digits(3)}-{digits(4)}",
    }
    table = []
    for k in range(rows):
        words, labels = [], []
        text = TEMPLATES[k % len(TEMPLATES)]
        if r.random() < 0.5:
            text = "{word} " * r.randint(0, 3) + text + " {word}" * r.randint(0, 3)
        spans, line = [], ""
        for part in re.split(r"(\{\w+\})", text):
            got = values[part[1:-1]]() if part[:1] == "{" else part
            if part[:1] == "{" and part[1:-1] in KINDS:
                spans.append((len(line), len(line) + len(got), part[1:-1].upper()))
            line += got
        at = 0
        for m in _WORD.finditer(line):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            inside = at < len(spans) and spans[at][0] < m.end()
            labels.append(("B-" if m.start() <= spans[at][0] else "I-") + spans[at][2] if inside else "O")
            words.append(m[0])
        table.append((words, labels))
    return table


class ChainField:
    """Weights of word features by label, for a word itself, as the one before and as the one after, and of label pairs."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray) -> None:
        self.index, self.emit, self.step = index, emit, step
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def around(words: list[str]) -> list[list[str]]:
        """The features of each word of a line and of its neighbours."""
        own = [["edge"], *map(features, words), ["edge"]]
        return [[*own[t], *["<" + f for f in own[t - 1]], *[">" + f for f in own[t + 1]]] for t in range(1, len(own) - 1)]

    @staticmethod
    def gradient(scores: np.ndarray, step: np.ndarray, gold: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the negative log-likelihood of labels gold (row, word): by scores (row, word, label), by step; and its value. on tells words from padding."""
        top = scores.max(axis=2, keepdims=True)
        s, e = np.exp(scores - top), np.exp(step + BAN)
        s[:, 0] *= np.exp(BAN[0])
        rows, length, n = scores.shape
        fwd, bwd, c = np.empty_like(s), np.ones_like(s), np.ones((rows, length, 1))
        c[:, 0] = s[:, 0].sum(axis=1, keepdims=True)
        fwd[:, 0] = s[:, 0] / c[:, 0]
        for t in range(1, length):
            new = (fwd[:, t - 1] @ e) * s[:, t]
            c[:, t] = np.where(on[:, t, None], new.sum(axis=1, keepdims=True), 1)
            fwd[:, t] = np.where(on[:, t, None], new / c[:, t], fwd[:, t - 1])
        for t in range(length - 1, 0, -1):
            bwd[:, t - 1] = np.where(on[:, t, None], (s[:, t] * bwd[:, t] / c[:, t]) @ e.T, 1)
        node = fwd * bwd
        onto = np.where(on[:, 1:, None], s[:, 1:] * bwd[:, 1:] / c[:, 1:], 0)
        pair = e * np.einsum("rta,rtb->ab", fwd[:, :-1], onto)
        row, at = np.nonzero(on)
        loss = (np.log(c) + top)[row, at].sum() - scores[row, at, gold[row, at]].sum()
        node[row, at, gold[row, at]] -= 1
        row, at = np.nonzero(on[:, 1:])
        np.subtract.at(pair, (gold[row, at], gold[row, at + 1]), 1)
        return np.where(on[:, :, None], node, 0), pair, loss - step[gold[row, at], gold[row, at + 1]].sum()

    @classmethod
    def train(cls, table: list[tuple[list[str], list[str]]], rounds: int = 16, rate: float = 0.3, decay: float = 1e-3, least: int = 3, size: int = 48) -> ChainField:
        """Maximum likelihood by AdaGrad over batches of size lines of like length; features seen less than least times are left out."""
        data = sorted(([cls.around(words), [LABELS.index(x) for x in labels]] for words, labels in table if words), key=lambda d: len(d[1]))
        seen = Counter(f for found, _ in data for fs in found for f in fs)
        index = {f: k for k, f in enumerate(f for f, count in seen.items() if count >= least)}
        n, pad = len(LABELS), len(index)
        batches = []
        for i in range(0, len(data), size):
            part = data[i : i + size]
            length, most = len(part[-1][1]), max(len(fs) for found, _ in part for fs in found)
            ids, gold, on = np.full((len(part), length, most), pad), np.zeros((len(part), length), int), np.zeros((len(part), length), bool)
            for k, (found, labels) in enumerate(part):
                gold[k, : len(labels)], on[k, : len(labels)] = labels, True
                for t, fs in enumerate(found):
                    known = [index[f] for f in fs if f in index]
                    ids[k, t, : len(known)] = known
            batches.append((ids, gold, on))
        emit, step = np.zeros((pad + 1, n)), np.zeros((n, n))
        emit_sq, step_sq = np.full_like(emit, 1e-1), np.full_like(step, 1e-1)
        for k in range(rounds):
            for at in random.Random(k).sample(range(len(batches)), len(batches)):
                ids, gold, on = batches[at]
                node, pair, _ = cls.gradient(emit[ids].sum(axis=2), step, gold, on)
                flat = np.repeat(node.reshape(-1, n), ids.shape[2], axis=0)
                g = np.stack([np.bincount(ids.ravel(), flat[:, label], pad + 1) for label in range(n)], axis=1) + decay * emit
                g[pad] = 0
                emit_sq += g * g
                emit -= rate * g / np.sqrt(emit_sq)
                pair = pair + decay * step
                step_sq += pair * pair
                step -= rate * pair / np.sqrt(step_sq)
        return cls(index, emit[:pad], step)

    def score(self, word: str) -> np.ndarray:
        """What a word gives to itself, to the next word and to the one before (3, label)."""
        got = self.known.get(word)
        if got is None:
            found = features(word) if word else ["edge"]
            got = np.stack([self.emit[[self.index[p + f] for f in found if p + f in self.index]].sum(axis=0) for p in ("", "<", ">")])
            if len(word) <= _SHORT:  # longer ones are rare, and would fill the memory
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[word] = got
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        """(word, label) of one line."""
        got = np.stack([self.score(w) for w in ("", *words, "")])
        return got[1:-1, 0] + got[:-2, 1] + got[2:, 2]

    def decode(self, lines: list[list[str]]) -> list[list[int]]:
        """Viterbi labels of each line's words; lines of like length are decoded together."""
        out: list[list[int]] = [[] for _ in lines]
        order = sorted((k for k in range(len(lines)) if lines[k]), key=lambda k: len(lines[k]))
        i = 0
        while i < len(order):
            longest, j = len(lines[order[i]]) * 5 // 4 + 4, i
            while j < len(order) and len(lines[order[j]]) <= longest and (j - i) * longest < 1 << 16:
                j += 1
            group = order[i:j]
            size = np.array([len(lines[k]) for k in group])
            t_max = int(size[-1])
            back = np.zeros((t_max, len(group), len(LABELS)), np.int8)
            scores = np.zeros((t_max, len(group), len(LABELS)))
            for g, k in enumerate(group):
                scores[: size[g], g] = self.scores(lines[k])
            best, step = scores[0] + BAN[0], self.step + BAN
            for t in range(1, t_max):
                way = best[:, :, None] + step[None]
                pick = way.argmax(axis=1)
                new = np.take_along_axis(way, pick[:, None, :], axis=1)[:, 0] + scores[t]
                on = (t < size)[:, None]
                back[t] = np.where(on, pick, np.arange(len(LABELS)))
                best = np.where(on, new, best)
            label = best.argmax(axis=1)
            path = np.empty((t_max, len(group)), np.int8)
            for t in range(t_max - 1, -1, -1):
                path[t] = label
                label = back[t][np.arange(len(group)), label]
            for g, k in enumerate(group):
                out[k] = path[: size[g], g].tolist()
            i = j
        return out


#: Words that are decoded together.
DECODED = 1 << 16
_NUMBER = re.compile(r"[0-9]+")


def _holds(kind: str, text: str) -> bool:
    """Whether a labelled text has the digits or parts that such data has."""
    digits = len(_NOT_DIGIT.sub("", text))
    if kind == "phone":
        return 9 <= digits <= 15
    if kind == "card":
        return 15 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", text))
    if kind == "ip":
        parts = _NUMBER.findall(text)
        return text.count(":") >= 2 and digits > 0 or len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    sides = _AT.split(text)
    return len(sides) == 2 and all(any(c.isalnum() for c in x) for x in sides) and ("." in sides[1] or _DOT.search(sides[1]) is not None)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation, lone brackets and a pair of brackets around it all at its ends."""
    partner: dict[int, int] = {}
    opened: list[int] = []
    for i in range(start, end):
        if text[i] in "([{":
            opened.append(i)
        elif text[i] in ")]}" and opened:
            partner[i] = opened.pop()
            partner[partner[i]] = i

    def loose(i: int) -> bool:
        return text[i] in _EDGE or (text[i] in "([{)]}" and i not in partner)

    while start < end:
        if partner.get(start) == end - 1:
            start, end = start + 1, end - 1
        elif loose(start):
            start += 1
        elif loose(end - 1):
            end -= 1
        else:
            break
    return start, end


def _lines(text: str) -> Iterator[list[tuple[int, int]]]:
    """(start, end) of the words of each marked line."""
    if not _MARKED.search(text):
        return
    start = 0
    for line in text.split("\n"):
        if _MARKED.search(line):
            yield [m.span() for m in _WORD.finditer(text, start, start + len(line))]
        start += len(line) + 1


def added_spans(field: ChainField, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Of each text, the spans that the field finds beside the base spans."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]

    def label(lines: list[tuple[int, list[tuple[int, int]]]]) -> None:
        labels = field.decode([[texts[k][a:b] for a, b in words] for k, words in lines])
        for (k, words), got in zip(lines, labels):
            i = 0
            while i < len(words):
                j = i + 1
                if got[i]:
                    kind = (got[i] - 1) // 2
                    while j < len(words) and got[j] == 2 * kind + 2:
                        j += 1
                    lo, hi = _trimmed(texts[k], words[i][0], words[j - 1][1])
                    if lo < hi and _holds(KINDS[kind], texts[k][lo:hi]) and not taken[k].meets(lo, hi):
                        out[k].append((KINDS[kind], lo, hi))
                i = j

    taken: dict[int, Covered] = {}
    waiting: list[tuple[int, list[tuple[int, int]]]] = []
    words = 0
    for k, text in enumerate(texts):
        for line in _lines(text):
            if k not in taken:
                taken[k] = Covered((a, b) for _, a, b in base[k])
            waiting.append((k, line))
            words += len(line)
            if words >= DECODED:
                label(waiting)
                waiting, words = [], 0
    label(waiting)
    return out


def find_personal(docs: DataFrame, field: ChainField | None = None) -> DataFrame:
    """(doc_id, spans) for every row: an array of structs (kind, start, end, added), by kind, then start.

    start and end count code points; added tells spans of the field from base spans. Null and empty texts have none,
    rows that repeat a doc_id give a row each, an empty table gives none, other columns are ignored. Texts of any length are
    searched whole. field: by default one trained on training_table().
    """
    field = field or ChainField.train(training_table())
    shared = docs.sparkSession.sparkContext.broadcast(field)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                texts = [x or "" for x in b.column(1).to_pylist()]
                base = [base_spans(x) for x in texts]
                more = added_spans(shared.value, texts, base)
                spans = [sorted([(KINDS.index(k), s, e, False) for k, s, e in x] + [(KINDS.index(k), s, e, True) for k, s, e in y]) for x, y in zip(base, more)]
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "added": a} for k, s, e, a in x] for x in spans]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, added boolean>>")


def _is(kind: str, span: F.Column) -> F.Column:
    return span["kind"] == kind


def digest(spans: DataFrame) -> DataFrame:
    """Counts per kind and a digest of the base spans; all spans as text."""

    def text(chosen: F.Column) -> F.Column:
        return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("spans", lambda s: ~s["added"])
    counts = [F.size(F.filter(base, partial(_is, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
