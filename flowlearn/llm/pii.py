"""Personal data by gradient boosting over candidate spans (operator 8).

Exact patterns give base spans (e-mail, IPv4, payment card, phone), which always stay. They
miss what touches other digits or is written unusually, so high-recall generators propose
overlapping candidates: every run of neighbouring digit groups of a fitting length, every
four-part number, every e-mail-like text. Boosted trees judge each candidate by its format
and its context; a candidate stays if its probability reaches the threshold of its kind,
which was calibrated on held-out examples to a stated precision, and if it overlaps no
span that was taken before (base spans first, then by probability).

The trees are trained on generated examples with known spans (no table has any labels),
from a fixed seed; the model is the same for all inputs.

Defined results: a null text is empty and has no spans; repeated rows are judged each; very
long texts are searched whole, in time linear in their length. Extra columns are dropped first.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import Memo, map_text
from .boosting import Boosted

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match ends where a run of digits ends, so it can only start where one starts.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_REGION = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])+")
_GROUP = re.compile("[0-9]+")
_AT = re.compile(r"\s?(?:@|[(\[{]\s?at\s?[)\]}]|\sat\s)\s?", re.IGNORECASE)
_DOT = r"(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_NAME = re.compile(r"[\w.%+-]{1,64}$")
_DOTTED_NAME = re.compile(rf"(?:[\w.%+-]{{1,64}}{_DOT}){{1,4}}[\w.%+-]{{1,64}}$", re.IGNORECASE)
_DOT_BEFORE = re.compile(_DOT + "$", re.IGNORECASE)
_HOST = re.compile(r"[\w-]{1,63}(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)[\w-]{1,63}){1,4}", re.IGNORECASE)
#: Words that announce a number.
_HINTS = {"phone": re.compile(r"tel|phone|call|fax|mobile|dial", re.IGNORECASE), "card": re.compile(r"card|visa|credit|master|amex", re.IGNORECASE), "ip": re.compile(r"\bip|host|server|addr", re.IGNORECASE), "email": re.compile(r"mail|contact|write", re.IGNORECASE)}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, by kind and start."""
    out: list[Span] = []
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            taken = m.end()
            at = text.find("@", taken)
        else:
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal data; many overlap."""
    for m in _AT.finditer(text):
        name = _NAME.search(text, max(0, m.start() - 64), m.start())
        host = _HOST.match(text, m.end())
        if name and host:
            yield "email", name.start(), host.end()
            if dotted := _DOTTED_NAME.search(text, max(0, m.start() - 192), m.start()):
                yield "email", dotted.start(), host.end()
    if not _DIGIT.search(text):
        return
    for region in _REGION.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *region.span())]
        for i, (a, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):  # 19 digits at most
                b = groups[j][1]
                n += b - groups[j][0]
                if n > 19:
                    break
                if 13 <= n:
                    yield "card", a, b
                if 7 <= n <= 15:
                    yield "phone", a, b
                    start = a
                    while start > region.start() and start > a - 2 and text[start - 1] in "+(":
                        start -= 1
                        yield "phone", start, b
                if j == i + 3 and n <= 12 and text[a:b].count(".") == 3 and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, j)):
                    yield "ip", a, b


def _sort_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else {".": 3, ",": 3, "-": 4, "+": 5, "(": 6, ")": 6, "=": 7, '"': 7, "@": 8}.get(c, 9)


def _touching(text: str, at: int, step: int) -> int:
    """How digits go on beyond a span: 0 not, 1 at once, 2 after space, 3 after other signs."""
    i = at
    while 0 <= i < len(text) and abs(i - at) < 3 and text[i] in " ().-+":
        i += step
    if not (0 <= i < len(text) and text[i].isdigit()):
        return 0
    between = text[min(i, at) : max(i, at)]
    return 1 if i == at else 2 if between.strip() == "" or step < 0 and text[i + 1 : i + 2] == " " else 3


def features(text: str, span: Span) -> tuple[int, ...]:
    """Format and context of a candidate as small integers."""
    kind, a, b = span
    body = text[a:b]
    sizes = [len(g) for g in _GROUP.findall(body)]
    seps = {c for c in body if not c.isalnum()}
    digits = "".join(_GROUP.findall(body))
    before, after = text[a - 1 : a], text[b : b + 1]
    sign = 0
    if kind == "email":
        sign = 1 if "@" in body else 2 if re.search(r"[(\[{]\s?at", body, re.IGNORECASE) else 3
    shape = "-".join(map(str, sizes))
    return (
        KINDS.index(kind),
        len(digits),
        len(sizes),
        sizes[0] if sizes else 0,
        sizes[-1] if sizes else 0,
        max(sizes, default=0),
        min(sizes, default=0),
        int(bool(digits) and luhn(digits)),
        int("+" in seps),
        int("(" in seps and ")" in seps) + 2 * int(("(" in seps) != (")" in seps)),
        int(" " in seps) + 2 * int("-" in seps) + 4 * int("." in seps),
        _sort_of(before),
        _sort_of(after),
        _touching(text, a - 1, -1),
        _touching(text, b, 1),
        int(digits[:1] or 0),
        int(digits[:2] in ("34", "37")) + 2 * int(digits[:2] == "00"),
        {"3-3-4": 1, "1-3-3-4": 2, "4-4-4-4": 3, "2-3-3-4": 2, "2-3-4-4": 2, "1-3-7": 2, "16": 3, "2-3-7": 2, "3-7": 4, "3-4": 5}.get(shape, 0),
        int(kind == "ip" and _octets(body)) + 2 * int(kind == "ip" and any(g[0] == "0" and len(g) > 1 for g in body.split("."))),
        int(bool(_HINTS[kind].search(text, max(0, a - 24), a))),
        sign,
        min(31, len(re.split(r"[.\s)\]}]", body)[-1])) if kind == "email" else 0,
        int(bool(re.search(r"\sdot\s|[(\[{]\s?dot", body, re.IGNORECASE))) + 2 * int(kind == "email" and "." in body) if kind == "email" else 0,
        min(2, len(seps)),
        int(kind == "email" and bool(_DOT_BEFORE.search(text, max(0, a - 12), a))),
    )


# ---------------------------------------------------------------- generated examples


def _with_luhn(rng: random.Random, head: str, n: int) -> str:
    body = head + "".join(rng.choice("0123456789") for _ in range(n - len(head) - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _digits(rng: random.Random, n: int) -> str:
    return rng.choice("123456789") + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _word(rng: random.Random) -> str:
    w = "".join(rng.choice(["th", "er", "on", "an", "re", "ou", "en", "ti", "sh", "le", "da", "mi"]) for _ in range(rng.randint(1, 4)))
    return w.capitalize() if rng.random() < 0.1 else w


def _personal(rng: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(rng, n)
    kind = rng.choice(KINDS)
    if kind == "email":
        at = rng.choice(["@", "@", " at ", "(at)", " [at] ", " (At) ", "@"])
        dot = "." if at == "@" or rng.random() < 0.3 else rng.choice([" dot ", "(dot)", " [dot] "])
        if at != "@" and rng.random() < 0.4:  # with @ the last part is a base span, which stays
            first = rng.choice([" dot ", "(dot)", " [dot] "]).join(_word(rng).lower() for _ in range(rng.choice([2, 2, 3])))
            return kind, f"{first}{at}{rng.choice(['mail', 'post', 'web', 'example'])}{rng.choice(['', '1'])}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
        return kind, f"{_word(rng).lower()}{rng.choice(['', '.', '_'])}{rng.choice(['é', 'x', '7', '42'])}{at}{rng.choice(['mail', 'post', 'web'])}{rng.randint(0, 9)}{dot}{rng.choice(['com', 'org', 'net', 'de', 'example.com'])}"
    if kind == "ip":
        return kind, ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        s = _with_luhn(rng, rng.choice(["4", "5", "6", "3"]), 16) if rng.random() < 0.85 else _with_luhn(rng, rng.choice(["34", "37"]), 15)
        if rng.random() < 0.1:
            return kind, " ".join(s)
        sep = rng.choice(["", "", " ", "-"])
        return kind, sep.join(s[i : i + 4] for i in range(0, len(s), 4)) if len(s) == 16 else s
    return kind, rng.choice(
        [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+1 {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1.{d(3)}.{d(3)}.{d(4)}", f"+{d(11)}", " ".join("0" + d(9)), f"00{d(2)} {d(2)} {d(7)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"00{d(2)}-{d(3)}-{d(7)}"]
    )


def _harmless(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    bad16 = d(16)
    while luhn(bad16):
        bad16 = d(16)
    y = rng.randint(1900, 2030)
    return rng.choice(
        [f"{y}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{y}-{y + 3}", f"{d(1)} {d(3)} {d(3)}", bad16, d(8), d(9), d(10), d(13), d(14), f"{d(1)}.{d(2)} {d(1)}.{d(2)} {d(1)}.{d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)}.{rng.randint(256, 999)}.{d(3)}.{d(2)}", f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"password={''.join(rng.choice('0123456789abcdef') for _ in range(18))}", f"{_word(rng)} at {_word(rng)} dotted", f"{_word(rng)} dot {_word(rng)}", f"0{d(3)} {d(2)}", f"00{d(3)}", f"look at {_word(rng)}.", f"{d(4)} - {d(4)}", f"{d(3)},{d(3)},{d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(5)}-{d(4)}", f"AKIA{d(3)}XYZ{d(4)}"]
    )


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A short text and the personal data in it."""
    text, spans = " ".join(_word(rng) for _ in range(rng.randint(0, 4))), []
    for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
        if text:
            text += rng.choice([" ", " ", " ", ", ", " (", "\n"])
        if rng.random() < 0.6:
            kind, s = _personal(rng)
            if rng.random() < 0.1:
                text += rng.choice({"phone": ["call ", "Tel: "], "card": ["card ", "visa: "], "ip": ["ip ", "host "], "email": ["mail ", "contact: "]}[kind])
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
        else:
            text += _harmless(rng)
        if rng.random() < 0.5:
            text += rng.choice([" ", " ", ". ", ", ", ") "]) + " ".join(_word(rng) for _ in range(rng.randint(1, 3)))
    return text, spans


@functools.cache
def model(examples: int = 6000, seed: int = 7) -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the least threshold of the wanted precision."""
    rng = random.Random(seed)
    rows, labels, held = [], [], []
    for i in range(examples):
        text, spans = example(rng)
        for c in candidates(text):
            rows.append(features(text, c))
            labels.append(c in spans)
            held.append(i % 4 == 0)
    x, y, h = np.array(rows), np.array(labels, dtype=float), np.array(held)
    trees = Boosted().fit(x[~h], y[~h])
    seen = Memo(lambda r: trees.probability(r))
    p = np.array([seen[tuple(r)] for r in x[h].tolist()])
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = x[h][:, 0] == k
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[h][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return trees, thresholds


class Finder:
    def __init__(self, trees: Boosted, thresholds: dict[str, float]):
        self.thresholds = thresholds
        self.probability = Memo(trees.probability, 50_000)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans, each by kind and start."""
        base = base_spans(text)
        found = []
        for c in dict.fromkeys(candidates(text)):
            p = self.probability[features(text, c)]
            if p >= self.thresholds[c[0]]:
                found.append((-p, c[1] - c[2], c))
        taken = Taken([(a, b) for _, a, b in base])
        added = [c for _, _, c in sorted(found) if taken.add(c[1], c[2])]
        by = lambda s: (KINDS.index(s[0]), s[1], s[2])
        return sorted(base, key=by), sorted(base + added, key=by)


class Taken:
    """Disjoint ranges of a text; touching or overlapping ones are united."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(ranges):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Whether [a, b) was free; then it is taken."""
        i = bisect_right(self.starts, a)
        if i and self.ends[i - 1] > a or i < len(self.starts) and self.starts[i] < b:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


_finder: list[Finder] = []


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or chain of overlapping ones, replaced by its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``base`` and ``spans`` (arrays of kind, start, end in code
    points, by kind and start) and ``redacted``, the text without the spans. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    ddl = "array<struct<kind: string, start: int, end: int>>"

    def work(batch: list[str]) -> dict[str, pa.Array]:
        if not _finder:
            _finder.append(Finder(*sent.value))
        found = [_finder[0].spans(t) for t in batch]
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return {
            "base": pa.array([rows(b) for b, _ in found], kind),
            "spans": pa.array([rows(s) for _, s in found], kind),
            "redacted": pa.array([redacted(t, s) for t, (_, s) in zip(batch, found)], pa.string()),
        }

    return map_text(docs, ["doc_id"] if keep is None else keep, text, work, f"base {ddl}, spans {ddl}, redacted string")
