"""Quality rules by distribution divergence (operator 4).

Each language has two references over all its documents: the histogram of character
classes, and that of its common words (those with at least ``share`` of its words, so at
most ``1 / share`` of them, and all others as one). A document is kept if the Jensen-Shannon
distances (base 2, 0 to 1) of its own histograms to both stay within limits. The limits
fall with the length, since short texts stray by chance; below ``least_words`` words, or
where repetition rules out a text, no distance is asked for and the base rule decides.

What is unusual must not become the norm: the references count all texts that pass the base
rule and whose character classes don't stray from the median of all such texts of their
language, each different text once. Only equal texts are copies: texts that share a passage
count each, and so do near copies. The references so don't depend on the order or split of the
rows. A language in which no text passes the base rule has no reference of its own.

Defined results: null and empty texts have no words and fail the base rule; documents
without a language, or with one that has no words, are held against the reference of all
languages; repeated rows are judged each. Extra columns are dropped first.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, texts

LEAST_WORDS, SHARE = 50, 0.001
#: Greatest distances for n words: base + spread / sqrt(n), for words at most the limit.
CLASS_BASE, CLASS_SPREAD = 0.15, 0.4
WORD_LIMIT, WORD_BASE, WORD_SPREAD = 0.6, 0.2, 5.0
#: Texts of a language beyond this distance from its median histogram aren't part of the
#: reference; medians are taken of shares in so many steps.
TRIM, STEPS = 0.15, 10_000
#: How hard words are packed for the way from the first pass to the references.
PACK_LEVEL = 6

#: Texts of which a task remembers the hash, so that it passes exact copies on once; a bound of
#: memory only, as copies of several tasks meet afterwards.
SEEN = 500_000
#: Distinct words that a task holds before it passes their counts on, and the partitions of texts
#: that it counts together: a word is shuffled once a task, so fewer tasks write less.
HELD_WORDS, TOGETHER = 600_000, 3

#: White space that parts words; signs counted as symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_MARKS = frozenset(".,;:?'\"()-")
CLASSES = ("space", "lower", "upper", "letter", "digit", "mark", "sign")


def class_of(c: str) -> int:
    return 0 if c in SPACE else 1 if c.islower() else 2 if c.isupper() else 3 if c.isalpha() else 4 if c.isdigit() else 5 if c in _MARKS else 6


#: The class of each ASCII character; of others by ``class_of``.
_ASCII = np.array([class_of(chr(b)) for b in range(128)] + [len(CLASSES)] * 128)
_OTHERS = re.compile(r"[^\x00-\x7f]")
_SPACES, _SIGNS = ([ord(c) for c in group] for group in (SPACE, SYMBOLS))
_STRIPPED = b".,;:!?'\"()|%&$#*<>-"


def plain(word: bytes) -> bytes:
    """A word in lower case without signs at its ends."""
    return (word.lower() if word.isascii() else word.decode().lower().encode()).strip(_STRIPPED)


def copy_key(raw: bytes) -> bytes:
    """A hash of 128 bits of a whole text; texts that share it count as copies."""
    return xxhash.xxh3_128_digest(raw)


class Text:
    """What both passes ask of a text; words are kept as UTF-8."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode()
        found = self.raw.split()  # of bytes: white space is that of SPACE
        code: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.n = len(found)
        self.ids = np.fromiter(map(code.__getitem__, found), dtype=np.int64, count=self.n)
        self.distinct = list(code)
        self._bytes = np.bincount(np.frombuffer(self.raw, dtype=np.uint8), minlength=256)

    def class_counts(self) -> np.ndarray:
        out = np.bincount(_ASCII, weights=self._bytes, minlength=len(CLASSES) + 1)[: len(CLASSES)]
        if len(self.raw) > len(self.text):
            for c, n in Counter(_OTHERS.findall(self.text)).items():
                out[class_of(c)] += n
        return out

    def repeat_words(self) -> int:
        """Words inside three-word windows that occur twice or more."""
        n, m = self.n, len(self.distinct)
        if n < 4 or m == n:  # no window fits twice, or all words differ
            return 0
        ids = self.ids
        window = ids[:-1] * m + ids[1:]
        if m >= 1 << 20:  # of that many words three don't fit into a number
            window = np.unique(window, return_inverse=True)[1]
        window = window[:-1] * m + ids[2:]
        ordered = np.sort(window)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        hit = np.isin(window, twice)
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        return int(covered.sum())

    def base_counts(self) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        seen: set[bytes] = set()
        dup = 0
        for line in self.raw.split(b"\n"):
            if line.strip():
                dup += line in seen
                seen.add(line)
        return self.n, len(self.text) - int(self._bytes[_SPACES].sum()), int(self._bytes[_SIGNS].sum()), dup, self.repeat_words()

    def packed_words(self) -> bytes:
        """The plain words with their counts: a line for each count, its words sorted."""
        own: defaultdict[bytes, int] = defaultdict(int)
        for w, n in zip(map(plain, self.distinct), np.bincount(self.ids, minlength=len(self.distinct)).tolist()):
            own[w] += n
        own.pop(b"", None)
        by: defaultdict[int, list[bytes]] = defaultdict(list)
        for w in sorted(own):
            by[own[w]].append(w)
        return b"\n".join(b"%d %s" % (n, b" ".join(found)) for n, found in by.items())

    def copy_key(self) -> bytes:
        return copy_key(self.raw)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1."""
    p, q = p / p.sum(), q / q.sum()
    at = np.flatnonzero(p)  # elsewhere the middle is half of q, which is one bit for all of q
    a, b = p[at], q[at]
    m = (a + b) / 2
    both = b > 0
    gain = float((a * np.log2(a / m)).sum() + (b[both] * np.log2(b[both] / m[both])).sum()) + 1.0 - float(b.sum())
    return math.sqrt(max(0.0, gain / 2))


class Reference:
    def __init__(self, classes: list[float], common: dict[str, float], total: float):
        self.classes = np.array(classes, dtype=float)
        self.place = {w.encode(): i for i, w in enumerate(common)}
        self.words = np.array([*common.values(), max(0.0, total - sum(common.values()))], dtype=float)

    def distances(self, t: Text) -> tuple[float, float]:
        get, other = self.place.get, len(self.place)
        at = np.fromiter((get(plain(w), other) for w in t.distinct), dtype=np.int64, count=len(t.distinct))
        own = np.bincount(at[t.ids], minlength=other + 1)
        return distance(t.class_counts(), self.classes), distance(own, self.words)


def able_texts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``classes`` (counts) and ``packed`` words of all different texts that pass the base
    rule, once in a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=PACK_LEVEL).compress, set()
        for b in batches:
            rows = []
            for t, name in zip(texts(b.column(0)), b.column(1).to_pylist()):
                key = copy_key(t.encode())
                if (name, key) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add((name, key))
                own = Text(t)
                if own.n >= LEAST_WORDS and 2 * own.repeat_words() <= own.n:
                    rows.append((name, key, [int(n) for n in own.class_counts()], pack(own.packed_words())))
            kinds = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["lang", "key", "classes", "packed"])

    own = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    found = own.mapInArrow(run, "lang string, key binary, classes array<long>, packed binary")
    return found.groupBy("lang", "key").agg(F.first(F.struct("classes", "packed")).alias("one")).select("lang", "one.classes", "one.packed")


def medians(able: DataFrame) -> dict[str | None, np.ndarray]:
    """By language the median share of each character class, to a step of 1 / ``STEPS``."""
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda x, n: x + n)
    steps = able.select("lang", F.posexplode(F.transform("classes", lambda n: F.floor(n * STEPS / total))).alias("kind", "step"))
    counted = steps.groupBy("lang", "kind", "step").agg(F.count(F.lit(1)).alias("n"))
    found: dict[str | None, list[Counter[int]]] = {}
    for r in counted.collect():  # at most STEPS + 1 rows for each class of each language
        found.setdefault(r.lang, [Counter() for _ in CLASSES])[r.kind][r.step] = r.n
    out = {}
    for name, kinds in found.items():
        out[name] = np.full(len(CLASSES), 1e-9)
        for k, steps_of in enumerate(kinds):
            left = sum(steps_of.values()) / 2
            for step in sorted(steps_of):
                left -= steps_of[step]
                if left <= 0:
                    out[name][k] += step / STEPS
                    break
    return out


def references(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> dict[str | None, Reference]:
    """The reference of each language, and under None that of all."""
    able = cut(able_texts(docs, text, lang))
    sent = docs.sparkSession.sparkContext.broadcast(medians(able))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: defaultdict[str | None, Counter[bytes]] = defaultdict(Counter)
        classes: dict[str | None, np.ndarray] = {}
        median, unpack = sent.value, zstandard.ZstdDecompressor().decompress

        def flush() -> pa.RecordBatch:
            rows = [(name, w, n) for name, words in count.items() for w, n in words.items()]
            count.clear()
            return pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "kind": pa.array([0] * len(rows), pa.int32()), "word": pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

        for b in batches:
            for name, own, packed in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = np.array(own, dtype=float)
                if distance(own, median[name]) <= TRIM:
                    own_count = count[name]
                    for line in unpack(packed).split(b"\n"):
                        n, *found = line.split(b" ")
                        if n == b"1":
                            own_count.update(found)
                        else:
                            for w in found:
                                own_count[w] += int(n)
                    classes[name] = classes.get(name, 0) + own
            if sum(map(len, count.values())) > HELD_WORDS:
                yield flush()
        yield flush()
        rows = [(name, i, int(n)) for name, c in classes.items() for i, n in enumerate(c)]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "kind": pa.array([1] * len(rows), pa.int32()), "word": pa.array([str(r[1]) for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, able.rdd.getNumPartitions() // TOGETHER)
    found = able.coalesce(tasks).mapInArrow(run, "lang string, kind int, word string, n long")
    counts = cut(found.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")))
    everything = counts.groupBy("kind", "word").agg(F.sum("n").alias("n"))
    out: dict[str | None, Reference] = {}
    totals = {r.lang: r.n for r in counts.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    whole = sum(totals.values())
    limits = F.create_map(*[F.lit(x) for k, v in totals.items() if k is not None for x in (k, v * share)]) if any(k is not None for k in totals) else None
    by: dict[str | None, tuple[list[float], dict[str, float]]] = {}
    # At most 1 / share words of each language.
    own = counts.where((F.col("kind") == 1) | (F.col("n") >= limits[F.col("lang")])).where("lang is not null") if limits is not None else None
    for part, name in ((own, 0), (everything.where((F.col("kind") == 1) | (F.col("n") >= share * whole)).withColumn("lang", F.lit(None).cast("string")), None)):
        if part is None:
            continue
        for r in part.select("lang", "kind", "word", "n").collect():
            classes, common = by.setdefault(r.lang, ([0.0] * len(CLASSES), {}))
            if r.kind:
                classes[int(r.word)] = float(r.n)
            else:
                common[r.word] = float(r.n)
    for name, (classes, common) in by.items():
        total = whole if name is None else totals.get(name, 0)
        if total and sum(classes):
            out[name] = Reference(classes, dict(sorted(common.items())), total)
    return out


def class_limit(n: int) -> float:
    return CLASS_BASE + CLASS_SPREAD / math.sqrt(n)


def word_limit(n: int) -> float:
    return min(WORD_LIMIT, WORD_BASE + WORD_SPREAD / math.sqrt(n))


_held: dict[str, dict] = {}


def verdicts(docs: DataFrame, refs: dict[str | None, Reference], keep: list[str] | None = None, text: str = "text", lang: str = "lang", least_words: int = LEAST_WORDS) -> DataFrame:
    """Columns ``keep`` with the base counts, both distances (null where none is asked for),
    ``base_failed`` and ``kept``."""
    keep = ["doc_id"] if keep is None else keep
    sent, name = docs.sparkSession.sparkContext.broadcast(refs), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if name not in _held:
                _held.clear()
                _held[name] = sent.value
            known, rows = _held[name], []
            for t, l in zip(texts(b.column(len(keep))), b.column(len(keep) + 1).to_pylist()):
                own = Text(t)
                base = own.base_counts()
                failed = base[0] < least_words or 100 * base[4] > 50 * base[0]
                ref = known.get(l) or known.get(None)
                d = ref.distances(own) if ref and not failed else (None, None)
                rows.append((*base, *d, failed, not failed and (d[0] is None or d[0] <= class_limit(base[0]) and d[1] <= word_limit(base[0]))))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds))], names=[*keep, *names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[k] for k in keep)), "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"])
    return docs.select(*[F.col(f"`{k}`").alias(f"kept {i}") for i, k in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text to map"), F.col(f"`{lang}`").cast("string").alias("language of it")).mapInArrow(run, ddl)
