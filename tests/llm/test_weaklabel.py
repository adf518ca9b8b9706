import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlearn.llm import weaklabel as w
from flowlearn.llm.base import table
from flowlearn.llm.queries import QUERIES


def test_em_recovers_accuracies():
    rng = random.Random(5)
    accuracy, seen = [0.9, 0.8, 0.7, 0.85], Counter()
    for _ in range(40_000):
        y = rng.random() < 0.7
        seen[tuple(-1 if rng.random() < 0.2 else int(y == (rng.random() < a)) for a in accuracy)] += 1
    share, t = w.expectation_maximisation(seen)
    assert abs(share - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        assert abs(t[j, 1, 1] / (1 - t[j, 1, 2]) - a) < 0.04 and abs(t[j, 0, 0] / (1 - t[j, 0, 2]) - a) < 0.05


def test_held_out_quality(spark):
    p = "/root/testdata/sf0.1"
    got = QUERIES["op7_weak_label_quality"](spark, p).join(table(spark, p, "labels"), "doc_id")
    r = got.agg(F.avg((F.col("good").cast("int") == F.col("quality")).cast("double")).alias("acc"), F.avg(F.when(F.col("quality") == 1, F.col("good").cast("double"))).alias("kept")).first()
    assert r.acc > 0.9 and r.kept > 0.95


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "some words here", 1), (3, "### " * 80, 1), (3, "### " * 80, 1)], "doc_id long, text string, score int")
    got = w.score(df, w.fit(df)).collect()
    assert [r.doc_id for r in got] == [1, 2, None, 3, 3] and all(0 <= r.score <= 1 for r in got) and got[3].score == got[4].score
    none = w.fit(df.limit(0))
    assert w.score(df.limit(0), none).count() == 0 and {r.score for r in w.score(df, none).collect()} == {0.5}


def test_fit_is_deterministic(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    a, b = w.fit(docs), w.fit(docs.repartition(3))
    assert np.allclose(a[0], b[0]) and a[1] == b[1]


def plain_em(patterns, rounds=200):
    """The share of good texts and the vote probabilities, vote by vote."""
    p = {v: min(0.95, max(0.05, 0.5 + 0.12 * (v.count(1) - 2 * v.count(0)))) for v in patterns}
    n = len(next(iter(patterns)))
    for _ in range(rounds):
        total = sum(patterns.values())
        share = min(1 - 1e-4, max(1e-4, sum(k * p[v] for v, k in patterns.items()) / total))
        chance = {}
        for j in range(n):
            for y in (0, 1):
                of = {vote: 0.1 + sum(k * (p[v] if y else 1 - p[v]) for v, k in patterns.items() if v[j] == vote) for vote in (0, 1, -1)}
                chance[j, y] = {vote: x / sum(of.values()) for vote, x in of.items()}
        new = {}
        for v in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[j, 1][v[j]]) - math.log(chance[j, 0][v[j]]) for j in range(n))
            new[v] = 1 / (1 + math.exp(-min(50, max(-50, odds))))
        settled = max(abs(new[v] - p[v]) for v in p) < 1e-9
        if settled:
            break
        p = new
    return share, chance, new


def plain_scorer(rows):
    """Averaged gradient steps of logistic regression, each scaled by its past."""
    weights, squares, bias, bias_squares = Counter(), Counter(), 0.0, 1e-6
    used = {f for x, _ in rows for f in x}
    for _ in range(4 * w.EPOCHS):
        errors = [1 / (1 + math.exp(-min(50, max(-50, sum(weights[f] * v for f, v in x.items()) + bias)))) - y for x, y in rows]
        slope = Counter()
        for (x, _), e in zip(rows, errors):
            for f, v in x.items():
                slope[f] += v * e / len(rows)
        for f in used:
            g = slope[f] + w.L2 * weights[f]
            squares[f] += g * g
            weights[f] -= w.RATE * 0.2 * g / math.sqrt(1e-6 + squares[f])
        mean = sum(errors) / len(errors)
        bias_squares += mean * mean
        bias -= w.RATE * 0.2 * mean / math.sqrt(bias_squares)
    return weights, bias


def test_against_a_plain_version(spark):
    """Votes, expectation-maximisation, fit and scores of a whole table, without arrays."""
    p = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in table(spark, p, "documents").collect()}
    assert len(docs) < w.SAMPLE_ROWS
    vote = {i: w.votes(t) for i, t in docs.items()}
    share, chance, posterior = plain_em(Counter(vote.values()))
    got_share, got = w.expectation_maximisation(Counter(vote.values()))
    assert abs(share - got_share) < 1e-6
    assert all(abs(chance[j, y][v] - got[j, y, 2 if v < 0 else v]) < 1e-6 for j, y in chance for v in (0, 1, -1))
    features = {i: dict(zip(*(x.tolist() for x in w.hashed(t)))) for i, t in docs.items()}
    weights, bias = plain_scorer([(features[i], posterior[vote[i]]) for i in sorted(docs)])
    for r in QUERIES["op7_weak_label_quality"](spark, p).collect():
        z = sum(weights[f] * v for f, v in features[r.doc_id].items()) + bias
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-5 and r.good == (r.score >= 0.5)


def test_measures_and_shapes():
    text = "BIG words!! here #tag\nbig WORDS here\nbig WORDS here"
    m, _ = w._measures(text)
    want = {"n": 10, "upper": 3 / 10, "lines": 1 / 3, "top": 3 / 10, "marks": 2 / len(text), "symbols": 1 / len(text)}
    assert {k: pytest.approx(m[k]) for k in want} == want
    long = "a" * 30 + "9" + "b" * 30
    assert w._shape(long) == w._shape("a9b") != w._shape("ab") and w._shape("x" * 100) == w._shape("y")


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 500_000), (2, "x" * 3_000_000), (3, " ".join(f"w{i}" for i in range(200_000)))], "doc_id long, text string")
    assert [r.doc_id for r in w.score(df, w.fit(df)).collect()] == [1, 2, 3]
