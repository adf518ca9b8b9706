"""Quality classifier from weak labels (operator 7).

Heuristic labellers vote good, bad or nothing on each text. Their accuracies aren't known;
expectation-maximisation estimates them, with the share of good texts, from how often they
agree, taking votes as independent given the true label. All it needs is the count of each
vote pattern over all documents, of which there are at most 3 to the number of labellers.
The posterior of its pattern is then a document's soft label, and a linear scorer over hashed
features of the text is fitted to these by logistic regression.

The scorer is fitted on at most ``sample_rows`` documents, those with the least hashes;
patterns, accuracies and scores cover all rows.

Defined results: null and empty texts get no votes but those on emptiness and a score like any
other text; an empty table fits a scorer that answers 0.5; repeated rows score alike. Extra
columns are dropped first.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Memo, map_text

GOOD, BAD, NONE = 1, 0, -1
SAMPLE_ROWS, BUCKETS = 6000, 1 << 14
EPOCHS, RATE, L2 = 25, 2.0, 1e-4


def _measures(text: str) -> tuple[dict[str, float], Counter]:
    """Measures of a text, and its words by count."""
    words = text.split()
    n, chars, count = len(words), max(1, len(text)), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda good: sum(k for w, k in count.items() if good(w)) / max(1, n)
    return {
        "n": n,
        "symbols": sum(map(text.count, "#*$%&|<>~^_={}[]\\")) / chars,
        "marks": sum(map(text.count, "!?")) / chars,
        "upper": share(lambda w: len(w) > 1 and w.isupper()),
        "top": max(count.values(), default=0) / max(1, n),
        "pairs": 1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters": share(lambda w: w.isalpha() or w[:-1].isalpha()),
        "length": sum(len(w) * k for w, k in count.items()) / max(1, n),
        "stops": sum(text.count(x) for x in (". ", ", ", ".\n")) / max(1, n),
    }, count


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: The labellers, by name: a vote from the measures of a text.
LABELLERS = {
    "symbols": lambda m: _vote(m["symbols"] < 0.002, m["symbols"] > 0.02),
    "shouting": lambda m: _vote(m["upper"] < 0.02, m["upper"] > 0.3),
    "marks": lambda m: _vote(m["marks"] < 0.002, m["marks"] > 0.02),
    "repetition": lambda m: _vote(m["pairs"] < 0.2, m["pairs"] > 0.5),
    "one_word": lambda m: _vote(m["n"] > 50 and m["top"] < 0.12, m["n"] > 10 and m["top"] > 0.25),
    "lines": lambda m: _vote(False, m["lines"] > 0.3),
    "letters": lambda m: _vote(m["letters"] > 0.97, m["letters"] < 0.6),
    "length": lambda m: _vote(m["n"] >= 80, m["n"] < 20),
    "sentences": lambda m: _vote(0.05 < m["stops"] < 0.4, m["n"] > 40 and m["stops"] < 0.01),
}


def votes(text: str) -> tuple[int, ...]:
    m, _ = _measures(text)
    return tuple(f(m) for f in LABELLERS.values())


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good texts, and for each labeller and true label (bad, good) the
    probabilities of the votes (bad, good, none)."""
    v = np.array(list(patterns), dtype=np.int64).reshape(len(patterns), -1)
    w = np.array(list(patterns.values()), dtype=float)
    which = np.where(v == NONE, 2, v)
    # The first guess is the majority of the votes.
    p = np.clip(0.5 + 0.12 * ((v == GOOD).sum(1) - 2 * (v == BAD).sum(1)), 0.05, 0.95)
    share, table = 0.5, np.empty((v.shape[1], 2, 3))
    for _ in range(rounds):
        share = float(np.clip((w * p).sum() / w.sum(), 1e-4, 1 - 1e-4))
        for j in range(v.shape[1]):
            for y, q in ((0, 1 - p), (1, p)):
                c = np.bincount(which[:, j], w * q, 3) + 0.1
                table[j, y] = c / c.sum()
        new = posterior(v, share, table)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return share, table


def posterior(v: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    which = np.where(v == NONE, 2, v)
    logs = np.log(table)
    d = math.log(share / (1 - share)) + sum(logs[j, 1, which[:, j]] - logs[j, 0, which[:, j]] for j in range(v.shape[1]))
    return 1 / (1 + np.exp(-np.clip(d, -50, 50)))


def _shape(word: str) -> int:
    """The bucket of a word's shape: the kinds of its letters, runs as one."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word]
    return _bucket("s" + "".join(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]))


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


_shapes = Memo(_shape, 300_000)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's features: shapes of words and binned measures."""
    m, count = _measures(text)
    rows: dict[int, float] = {}
    for w, k in count.items():
        b = _shapes[w]
        rows[b] = rows.get(b, 0) + k
    total = max(1, m["n"])
    rows = {b: math.sqrt(k / total) for b, k in rows.items()}
    for name, x in m.items():
        rows[_bucket(f"m{name}:{min(20, int(math.log1p(x) * 4)) if name in ('n', 'length') else int(min(x, 1) * 40)}")] = 0.5
    return np.fromiter(rows, dtype=np.int64), np.fromiter(rows.values(), dtype=float)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by averaged gradient steps."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    squares, bias_squares = np.full(BUCKETS, 1e-6), 1e-6
    for _ in range(EPOCHS * 4):
        z = np.bincount(row, x * weights[at], len(rows)) + bias
        e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.bincount(at, x * e[row], BUCKETS) / len(rows) + L2 * weights
        squares += g * g
        weights -= RATE * 0.2 * g / np.sqrt(squares)
        bias_squares += float(e.mean()) ** 2
        bias -= RATE * 0.2 * float(e.mean()) / math.sqrt(bias_squares)
    return weights, bias


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, dict]:
    """Weights and bias of the scorer, and what was estimated of each labeller."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))

    def pattern(batch: list[str]) -> dict[str, pa.Array]:
        return {"v": pa.array([",".join(map(str, votes(t))) for t in batch], pa.string())}

    counted = map_text(own, [], "t", pattern, "v string").groupBy("v").count()
    patterns = {tuple(map(int, r.v.split(","))): r["count"] for r in sorted(counted.collect())}  # at most 3 ** labellers rows
    if not patterns:
        return np.zeros(BUCKETS), 0.0, {}
    share, table = expectation_maximisation(patterns)

    def features(batch: list[str]) -> dict[str, pa.Array]:
        found = [hashed(t) for t in batch]
        return {
            "v": pa.array([list(votes(t)) for t in batch], pa.list_(pa.int32())),
            "at": pa.array([a.tolist() for a, _ in found], pa.list_(pa.int64())),
            "x": pa.array([x.tolist() for _, x in found], pa.list_(pa.float64())),
        }

    chosen = own.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample_rows)
    some = own.join(F.broadcast(chosen.select("id").distinct()), "id")  # at most ``sample_rows`` ids
    rows = [(np.array(r.at), np.array(r.x), float(posterior(np.array([r.v]), share, table)[0])) for r in map_text(some, ["id"], "t", features, "v array<int>, at array<long>, x array<double>").orderBy("id").limit(sample_rows).collect()]
    weights, bias = fit_scorer(rows)
    told = {name: {"good_vote_if_good": float(table[j, 1, 1]), "bad_vote_if_bad": float(table[j, 0, 0])} for j, name in enumerate(LABELLERS)}
    return weights, bias, {"share_good": share, "labellers": told, "table": table}


_models: dict[str, tuple] = {}


def score(docs: DataFrame, model: tuple[np.ndarray, float, dict], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``score``, the probability that a text is good, and ``good``."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model[:2]), uuid.uuid4().hex

    def work(batch: list[str]) -> dict[str, pa.Array]:
        if name not in _models:
            _models.clear()
            _models[name] = sent.value
        weights, bias = _models[name]
        z = np.array([float(x @ weights[at]) + bias for at, x in map(hashed, batch)]) if batch else np.zeros(0)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return {"score": pa.array(p), "good": pa.array(p >= 0.5)}

    return map_text(docs, ["doc_id"] if keep is None else keep, text, work, "score double, good boolean")
