"""Toxicity scores of deobfuscated text (operator 10).

Words that were written to evade a filter pass through a noisy channel: letters become
look-alike digits or symbols, letters are set apart, letters are repeated. A segment that
may be such a word becomes a character lattice (what each sign may stand for, what may be
dropped, what may end a word), and Viterbi search finds the reading that a character trigram
model and the channel together like best. The trigram model comes from the counts of all
words of all documents. Besides, every token, and every run of tokens or pieces, is read
against the words of the lexicon themselves: any choice of look-alikes, dropped signs and
repetitions that spells one counts. What clean documents hold stands as written (``loose``,
``worth less``), as do plain numbers. The restored words are scored by a lexicon of words and word
beginnings, learnt from labelled documents: a feature weighs as much as the lower confidence
bound of its share of toxic documents exceeds the base rate, and a text scores the
probability that at least one of its words is to be believed.

The lexicon is fitted on at most ``sample_rows`` labelled documents, those with the least
hashes of their ids; near copies among them count once. Everything else covers all rows.

Defined results: null and empty texts score 0; repeated rows score alike; without a usable
label all scores are 0; several labels of one document count as their maximum; null labels
count as none. Extra columns are dropped first.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Memo, cut, map_text, texts

#: Documents that the lexicon is fitted on, at most.
SAMPLE_ROWS = 8_000
#: The character model knows letters of at least this share of all, the others as one, and
#: trigrams of at least this share; so at most the inverses of these reach the driver.
LETTER_SHARE, TRIGRAM_SHARE = 1e-5, 1e-6
#: Standard deviations of the lower bound; least weight of a lexicon entry; word beginnings used.
SIGMA, LEAST_WEIGHT, PREFIXES = 3.0, 0.4, (3, 4, 5, 6)
#: Least share of all letters' mass that a lexicon word has in the character model.
LEXICON_MASS = 1e-4
THRESHOLD = 0.5

#: The letters that a sign is commonly written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
#: Signs that set letters apart.
SEPARATORS = " .-_*/|,~'"
#: Log costs of the channel: a sign for a letter, a wildcard, a dropped separator, another dropped
#: sign, a word end at a separator, dropped repetitions, a sign that stands for itself.
SWAP, WILD, JOIN, DROP, SPLIT, REPEAT, AS_IS = -0.7, -2.5, -0.2, -6.0, -4.0, -0.3, -9.0

_WORD = regex.compile(r"\p{L}+")
_EDGE = ".,;:?'\"()[]{}<>#%&*|~^=/\\-_+`"  # and ! at the end
_APART = regex.compile(r"(?<!\S)[\p{L}\p{N}@$!|+*](?:[\s.\-_*/|,~']{1,3}[\p{L}\p{N}@$!|+*]){2,}(?![\p{L}\p{N}])")
_ODD = regex.compile(r"\p{L}.*[^\p{L}\p{M}'’].*|[^\p{L}\p{M}'’].*\p{L}.*|.*(\p{L})\1\1.*", regex.DOTALL)
_APART_HINT = re.compile(r"(?:^|\s)\S[\s.\-_*/|,~']{1,3}\S[\s.\-_*/|,~']")
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: A number stands as written, whatever its digits look like.
_NUMBER = re.compile(r"[-+#$€£¢<(*~]*+\d[\d.,:/-]*+[%)*+€$£¢.,:;!?]*+")
#: Signs stripped at word edges though they may stand for letters, and those that never do.
_PLAIN_EDGE = "".join(c for c in _EDGE if c not in LOOKALIKES)


class CharModel:
    """Interpolated trigram model over letters; ``counts`` are of (class, class, class), of which
    0 is a word's bound, 1 any letter but ``letters``, and 2 on these. Only what occurs is held."""

    def __init__(self, letters: list[str], counts: dict[tuple[int, int, int], int], lexicon: list[str] = ()):
        self.code = {c: i + 2 for i, c in enumerate(letters)} | {" ": 0}
        self.tri = Counter(counts)
        least = max(1.0, sum(counts.values()) * LEXICON_MASS)
        for word in lexicon:
            ids = [0, 0, *(self.code.get(c, 1) for c in word), 0]
            for t in zip(ids, ids[1:], ids[2:]):
                self.tri[t] += least
        self.bi, self.one, self.after_two, self.after_one = Counter(), Counter(), Counter(), Counter()
        for (x, y, z), n in self.tri.items():
            self.bi[y, z] += n
            self.one[z] += n
            self.after_two[x, y] += n
            self.after_one[y] += n
        self.total = sum(self.one.values())

    @functools.cached_property
    def logs(self) -> Memo:
        """The log probability of the last of three letters after the other two."""
        return Memo(self._log, 200_000)

    def _log(self, letters: str) -> float:
        x, y, z = (self.code.get(c, 1) for c in letters)
        n = len(self.code) + 1
        p1 = (self.one[z] + 0.5) / (self.total + 0.5 * n)
        p2 = (self.bi[y, z] + 5 * p1) / (self.after_one[y] + 5)
        return math.log((self.tri[x, y, z] + 5 * p2) / (self.after_two[x, y] + 5))

    def score(self, a: str, b: str, c: str) -> float:
        return self.logs[a + b + c]


def arcs(segment: str) -> list[list[tuple[int, str, float]]]:
    """For each place the arcs that leave it: signs taken, what they read as, channel cost.
    Places with the same sign and as many of it ahead share their list."""
    known: dict[tuple[str, int], list[tuple[int, str, float]]] = {}
    out, run, after = [], 0, ""
    for c in reversed(segment):
        run = run + 1 if c == after else 1
        after = c
        if (c, run) not in known:
            known[c, run] = _arcs(c, run)
        out.append(known[c, run])
    return out[::-1]


def _arcs(c: str, run: int) -> list[tuple[int, str, float]]:
    here: list[tuple[int, str, float]] = []
    if c.isalpha():
        here.append((1, c, 0.0))
        if run > 1:
            here += [(run, c, REPEAT), (run, c + c, REPEAT)]
        return here
    reads = LOOKALIKES.get(c, "")
    cost = WILD if len(reads) > 2 else SWAP
    for r in reads:
        here.append((1, r, cost))
        if run > 1:
            here += [(run, r, cost + REPEAT), (run, r + r, cost + REPEAT)]
    apart = c.isspace() or c in SEPARATORS
    here += [(1, "", JOIN if apart else DROP), (1, " ", SPLIT)]
    if not c.isspace():
        here.append((1, c, AS_IS))
    return here


def decode(segment: str, model: CharModel) -> str:
    """The best reading of a segment; words in it are set apart by single spaces.

    A state is the last two letters read; it keeps its score and a link back to the states it
    came through, so time and memory grow in proportion to the segment."""
    logs, lattice, n = model.logs, arcs(segment), len(segment)
    best: dict[int, dict[str, tuple[float, tuple | None]]] = {0: {"  ": (0.0, None)}}
    for i in range(n):
        for state, (score, path) in best.pop(i, {}).items():
            for taken, reads, cost in lattice[i]:
                x, s = state, score + cost
                for c in reads:
                    if c == " " == x[1]:
                        continue
                    x += c
                    s += logs[x]
                    x = x[1:]
                to = best.setdefault(i + taken, {})
                if x not in to or s > to[x][0]:
                    to[x] = (s, (path, reads) if reads else path)
    _, path = max(((s + logs[x + " "] * (x[1] != " "), p) for x, (s, p) in best[n].items()), key=lambda end: end[0])
    read = []
    while path:
        path, letters = path
        read.append(letters)
    return " ".join("".join(reversed(read)).split())


def bare(token: str, edge: str, end: str) -> str:
    """A token without signs of ``edge`` at its start and of ``end`` at its end, and without any
    sign that stands there three times or more."""
    lo, hi, before = 0, len(token), None
    sign = lambda c: not c.isalnum() and not c.isspace()
    while lo < hi and before != (lo, hi):
        before = lo, hi
        while lo < hi and token[lo] in edge:
            lo += 1
        while lo < hi and token[hi - 1] in end:
            hi -= 1
        if hi - lo > 2 and token[lo] == token[lo + 1] == token[lo + 2] and sign(c := token[lo]):
            while lo < hi and token[lo] == c:
                lo += 1
        if hi - lo > 2 and token[hi - 1] == token[hi - 2] == token[hi - 3] and sign(c := token[hi - 1]):
            while lo < hi and token[hi - 1] == c:
                hi -= 1
    return token[lo:hi]


def core(token: str) -> str:
    return token if token.isalpha() else bare(token, _EDGE, _EDGE + "!")


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def _squeezed(word: str) -> str:
    return regex.sub(r"(.)\1+", r"\1", word)


class Speller:
    """Which of some words obfuscated tokens spell, by all choices of look-alikes, dropped
    signs and repeated letters; a letter is never read less often than the word has it."""

    #: Signs that may be dropped; ``*``, ``#`` and ``%`` stand for any letter if there is one of them.
    SIGNS, WILDS = frozenset(SEPARATORS + _EDGE + "!"), "*#%"

    def __init__(self, words: set[str]):
        self.words = words
        self.heads = {w[:i] for w in words for i in range(1, len(w) + 1)}
        self.parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)} | {""}
        self.letters = "".join(sorted({c for w in words for c in w}))

    def piece(self, token: str) -> tuple[str, ...] | None:
        """Parts of words that the whole token may be; None if it only sets others apart."""
        word = token.rstrip(".,;:?")
        if word.isalpha() and not _DOUBLE.search(word):
            return (word,) if word in self.parts else ()
        any_letter = sum(token.count(c) for c in self.WILDS) == 1 and sum(map(str.isalpha, token)) > 2
        parts, found = self.parts, {""}
        for c in token:
            reads = c if c.isalpha() else self.letters if any_letter and c in self.WILDS else LOOKALIKES.get(c, "")
            to = {s + r for s in found for r in reads} & parts
            to |= {s for s in found if s and s[-1] in reads}
            if c in self.SIGNS:
                to |= found
            if not to:
                return ()
            found = to
        return tuple(sorted(found - {""})) or (None if found else ())

    def joined(self, run: list[tuple[str, tuple[str, ...]]], plain: set[str]) -> Iterator[tuple[str, str]]:
        """Runs of two and more tokens (with their pieces) that spell a word, and the word."""
        for i, (token, piece) in enumerate(run):
            if i and run[i - 1][1] == piece:
                continue  # read by the start before, as a repetition
            states = self.heads.intersection(piece)
            for j in range(i + 1, len(run)):
                if not states:
                    break
                states = {t for s in states for p in run[j][1] for t in ((s + p, s + p[1:]) if s[-1] == p[0] else (s + p,))} & self.heads
                if not self.words.isdisjoint(states):
                    seen = [t for t, _ in run[i : j + 1]]
                    several = [c for c in map(core, seen) if len(c) > 1]
                    if any(map(str.isalpha, "".join(seen))) and (not all(c in plain for c in several) if several else len(seen) > 2):
                        yield from ((" ".join(seen), w) for w in self.words.intersection(states))


class Scorer:
    def __init__(self, lexicon: dict[str, float], model: CharModel):
        self.lexicon, self.model = lexicon, model
        #: No word that starts otherwise has weight.
        self.starts = {f[1:][: PREFIXES[0]] for f in lexicon if f[0] != "!"}
        self.speller = Speller({f[1:] for f in lexicon if f[0] == "="})
        #: Tokens that clean documents hold, so they stand as written.
        self.plain = {f[1:] for f in lexicon if f[0] == "!"}
        #: For a token its pieces with the words that it spells alone, () or None without pieces.
        self.piece = Memo(self._piece, 200_000)
        self.of_word = Memo(lambda w: max((self.lexicon.get(f, 0.0) for f in features(w)), default=0.0))
        self.of_odd = Memo(self._odd, 50_000)
        #: Words by their letters without repetition: how often a letter was repeated is lost.
        self.once: dict[str, float] = {}
        for f, w in lexicon.items():
            if f[0] == "=":
                self.once[_squeezed(f[1:])] = max(w, self.once.get(_squeezed(f[1:]), 0.0))

    def _odd(self, token: str) -> tuple[dict[str, float], str]:
        """The weighty words of a token that isn't one plain word, and its reading if it was
        decoded. Both the words as they stand and the reading count: decoding hides no word."""
        inner, full = core(token), bare(token, _PLAIN_EDGE, _PLAIN_EDGE)
        words, read = _WORD.findall(inner), ""
        found = {w: self.of_word[w] for w in words if w[: PREFIXES[0]] in self.starts}
        if token in self.plain or inner in self.plain or _NUMBER.fullmatch(token):
            return {w: x for w, x in found.items() if x > 0}, read
        # With the signs at the edges, which may be letters, as well as without.
        odd = [x for x in dict.fromkeys((inner, full)) if (_ODD.fullmatch(x) if words else len(LOOKALIKES.keys() & x) > 2)]
        for x in odd:
            got = decode(x, self.model)
            for w in _WORD.findall(got):
                weight = max(self.of_word[w], self.once.get(_squeezed(w), 0.0))
                found[w] = max(weight, found.get(w, 0.0))
                if weight > 0 or not read:
                    read = got
        return {w: x for w, x in found.items() if x > 0}, read

    def _piece(self, token: str) -> tuple[tuple[str, ...], list[str]] | tuple[()] | None:
        piece = self.speller.piece(token)
        if not piece:
            return piece
        words = self.speller.words.intersection(piece) - {token}
        if words:
            inner = core(token)
            words = set() if token in self.plain or inner in self.plain or _NUMBER.fullmatch(token) else words - {inner}
        return piece, sorted(words)

    def _spelt(self, tokens: list[str]) -> set[tuple[str, str]]:
        """Tokens, and runs of them, that spell weighty words otherwise than written."""
        pieces = [*map(self.piece.__getitem__, tokens)]
        out: set[tuple[str, str]] = set()
        run: list[tuple[str, tuple[str, ...]]] = []
        last = -1
        for i in [i for i, p in enumerate(pieces) if p]:
            piece, words = pieces[i]
            if words:
                out.update((tokens[i], w) for w in words)
            if last + 1 < i and any(p is not None for p in pieces[last + 1 : i]):
                if len(run) > 1:
                    out.update(self.speller.joined(run, self.plain))
                run = []
            run.append((tokens[i], piece))
            last = i
        if len(run) > 1:
            out.update(self.speller.joined(run, self.plain))
        return out

    def judged(self, text: str) -> tuple[float, list[tuple[str, str]]]:
        """The score of a text; the segments that hid a weighty word, and their readings."""
        low = text.lower()
        found: dict[str, float] = {}
        hidden: list[tuple[str, str]] = []
        starts, k, of_word, odd = self.starts, PREFIXES[0], self.of_word, []
        tokens = low.split()
        for token in set(tokens):
            word = token if token.isalpha() else token.rstrip(".,;:?!")
            if not word.isalpha():
                if word:
                    odd.append(token)
            elif word[:k] in starts:
                found[word] = of_word[word]
        if _TRIPLE.search(low):
            odd += [t for t in set(tokens) if _TRIPLE.search(t)]
        if _APART_HINT.search(low):
            odd += [m.group() for m in _APART.finditer(low)]
        for token in dict.fromkeys(odd):
            words, read = self.of_odd[token]
            if words:
                found |= words
                if read:
                    hidden.append((token, read))
        restored = self._spelt(tokens)
        for _, word in restored:
            found[word] = max(self.lexicon["=" + word], found.get(word, 0.0))
        known = {" ".join(seen.split()) for seen, _ in hidden}
        hidden += dict(sorted((seen, w) for seen, w in restored if seen not in known)).items()
        weights = [w for w in found.values() if w > 0]
        return (1.0 - math.prod(1.0 - w for w in weights) if weights else 0.0), sorted(hidden)

    def score(self, text: str) -> float:
        return self.judged(text)[0]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n`` for all lower-cased words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})
        for b in batches:
            for t in texts(b.column(0)):
                count.update(t.lower().split())
            if len(count) > 200_000:
                yield flush()
                count.clear()
        yield flush()

    letters = F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "")
    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.select(letters.alias("word"), "n").where(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.sum("n").alias("n"))


def char_model(counts: DataFrame, lexicon: dict[str, float], letter_share: float = LETTER_SHARE, trigram_share: float = TRIGRAM_SHARE) -> CharModel:
    """The trigram model of word counts, in which the words of the lexicon have a least mass.
    It grows with the letters and trigrams that the corpus has, up to the inverses of the shares."""
    letters = counts.select("n", F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy("c").agg(F.sum("n").alias("n"))
    total = letters.agg(F.sum("n")).first()[0] or 0
    known = sorted(r.c for r in letters.where(F.col("n") >= letter_share * total).select("c").collect())  # at most 1 / letter_share
    sent = counts.sparkSession.sparkContext.broadcast({c: i + 2 for i, c in enumerate(known)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[tuple[int, int, int]] = Counter()
        code = sent.value
        flush = lambda: pa.RecordBatch.from_pydict({"a": pa.array([t[0] for t in count], pa.int32()), "b": pa.array([t[1] for t in count], pa.int32()), "c": pa.array([t[2] for t in count], pa.int32()), "n": pa.array(list(count.values()), pa.int64())})
        for b in batches:
            for w, n in zip(texts(b.column(0)), b.column(1).to_pylist()):
                ids = [0, 0, *(code.get(c, 1) for c in w), 0]
                for t in zip(ids, ids[1:], ids[2:]):
                    count[t] += n
            if len(count) > 200_000:
                yield flush()
                count.clear()
        yield flush()

    tri = counts.select("word", "n").mapInArrow(run, "a int, b int, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    tri = tri.where(F.col("n") >= trigram_share * total).orderBy("a", "b", "c")
    return CharModel(known, {(r.a, r.b, r.c): r.n for r in tri.collect()}, [f[1:] for f in sorted(lexicon) if f[0] == "="])  # at most about 1 / trigram_share


def lower_bound(k: int, n: int, z: float = SIGMA) -> float:
    """Wilson's lower bound of a share of k in n."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit_lexicon(rows: Iterator[tuple[str, int]]) -> dict[str, float]:
    """Weights of features, from texts with labels; all texts with label 1 come first."""
    seen: list[set[int]] = [set() for _ in range(8)]
    mixes = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 for i in range(8)], dtype=np.uint64)

    def copy(words: list[str]) -> bool:
        """Whether one of eight least hashed five-word shingles was met before."""
        grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        h = np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64)
        least = [int(x) for x in (h[:, None] * mixes[None, :] ^ (h[:, None] >> np.uint64(29))).min(axis=0)]
        old = any(m in s for m, s in zip(least, seen))
        for m, s in zip(least, seen):
            s.add(m)
        return old

    # Documents by word; words that no toxic document has, by the longest word beginning.
    longest, shortest = PREFIXES[-1], PREFIXES[0]
    of_word: dict[str, array] = defaultdict(lambda: array("i"))
    others: dict[str, array] = defaultdict(lambda: array("i"))
    total, began = [0, 0], set()
    held = (Counter(), Counter())  # documents by token, clean and toxic
    for text, label in rows:
        words = text.lower().split()
        if not words or copy(words):
            continue
        own = {w for w in map(core, words) if w.isalpha()}
        doc = sum(total)
        total[label] += 1
        held[label].update(set(words))
        if label:
            for w in own:
                of_word[w].append(doc)
                began.add(w[:shortest])
        else:
            for w in own:
                if w in of_word:
                    of_word[w].append(doc)
                elif w[:shortest] in began:
                    others[w[:longest]].append(doc)
    if not total[1]:
        return {}
    base, toxic = total[1] / sum(total), total[1]

    def weight(docs: set[int]) -> float:
        k = sum(d < toxic for d in docs)
        w = (lower_bound(k, len(docs)) - base) / max(1e-9, 1 - base) if k >= 3 else 0.0
        return min(w, 0.999) if w >= LEAST_WEIGHT else 0.0

    out = {"=" + w: x for w, docs in of_word.items() if (x := weight(set(docs)))}
    # A beginning is judged by those words alone that nothing more special explains.
    left = {w: docs for w, docs in of_word.items() if "=" + w not in out}
    for k in reversed(PREFIXES):
        by: dict[str, list] = defaultdict(list)
        for w, docs in left.items():
            if len(w) >= k:
                by[w[:k]].append(docs)
        clean: dict[str, list] = defaultdict(list)
        for w, docs in others.items():
            if len(w) >= k and w[:k] in by:
                clean[w[:k]].append(docs)
        for start, found in by.items():
            if len(found) > 1 and (x := weight(set().union(*found, *clean.get(start, ())))):
                out["^" + start] = x
        left = {w: docs for w, docs in left.items() if "^" + w[:k] not in out}
    return out | {"!" + t: 0.0 for t in plain_tokens(*held, {f[1:] for f in out if f[0] == "="})}


def plain_tokens(clean: Counter, toxic: Counter, words: set[str]) -> set[str]:
    """Tokens that could be (a part of) an obfuscated word but that at least two clean documents
    hold, and no fewer than toxic ones."""
    speller, out = Speller(words), set()
    for token, n in clean.items():
        if n >= max(2, toxic[token]) and speller.piece(token):
            out |= {token, core(token)} - words - {""}
    return {t for t in out if len(t) > 1}


def learn_lexicon(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """The lexicon from the labelled documents that ``usable`` (of ``id``) admits. Of several
    texts of one id that of the least hash counts, of several labels the greatest."""
    chosen = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & usable)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fit_lexicon((t, y) for b in batches for t, y in zip(texts(b.column(0)), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(found), pa.string()), "weight": pa.array(list(found.values()), pa.float64())})

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    # The chosen ids are at most ``sample_rows``, so they go to every executor.
    one = own.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("first"))
    rows = one.select("first.t", "label", F.xxhash64("id").alias("h"), "id")
    fitted = rows.repartition(1).sortWithinPartitions(F.desc("label"), "h", "id").select("t", "label").mapInArrow(run, "feature string, weight double")
    return {r.feature: r.weight for r in fitted.collect()}


_scorers: dict[str, Scorer] = {}


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], CharModel]:
    lexicon = learn_lexicon(docs, labels, F.lit(True) if usable is None else usable, id_col, text, label, sample_rows)
    return lexicon, char_model(cut(word_counts(docs, text)), lexicon)


def score(docs: DataFrame, model: tuple[dict[str, float], CharModel], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``score`` and ``restored`` (segments that hid a weighty word, and
    their readings)."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def work(batch: list[str]) -> dict[str, pa.Array]:
        s = _scorers.get(name)
        if s is None:
            _scorers.clear()
            s = _scorers[name] = Scorer(*sent.value)
        pair = pa.struct([("seen", pa.string()), ("read", pa.string())])
        found = [s.judged(t) for t in batch]
        return {"score": pa.array([x for x, _ in found], pa.float64()), "restored": pa.array([[{"seen": a, "read": b} for a, b in h] for _, h in found], pa.list_(pair))}

    return map_text(docs, ["doc_id"] if keep is None else keep, text, work, "score double, restored array<struct<seen: string, read: string>>")
