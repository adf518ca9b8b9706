import hashlib
import re

import numpy as np
import pytest

from flowlearn.llm.decontaminate import Index, _bloom, _passing, contamination, words
from flowlearn.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(t):
    return WORD.findall((t or "").translate(UP))


def brute(docs, items):
    """(n_words, hit positions, item ids) of each document, window by window."""
    out = []
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s : s + 10]), set()).add(i)
    sizes = {len(w) for w in wins}
    for d, t in docs:
        w, hit, got = plain_words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    got |= wins[g]
        out.append((d, len(w), len(hit), sorted(x for x in got if x is not None)))
    return out


def test_words():
    for t in ["", "Ab-c éÀ x1 {y}~\x7f z", "ÄB İ ß\x00q"]:
        assert [w.decode() for w in words(t)] == plain_words(t)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "tiny item"), (3, ""), (4, None), (5, "the the the the the the the the the the the"), (None, "no id here"), (2, "tiny item"), (6, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 x y")]
DOCS = [
    (1, LONG), (2, None), (3, ""), (4, "a tiny item, TINY-ITEM."), (5, " ".join(["the"] * 30)), (6, "w0 w1 w2 w3"), (None, "no id here"),
    (7, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (8, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (9, "q " * 20000 + LONG + " q" * 20000), (7, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (10, "w30 w31 w32 w33 w34 w35 w36 w37 w38 w39 z"),
]


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_brute_force(spark, limit):
    docs = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id long, text string, items int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"])) for r in contamination(docs, items, broadcast_bytes=limit).collect()]
    assert sorted(got, key=str) == sorted(brute(DOCS, ITEMS), key=str)
    assert contamination(docs.limit(0), items, broadcast_bytes=limit).count() == 0
    assert all(not r.spans for r in contamination(docs, items.limit(0), broadcast_bytes=limit - 1).collect())


def test_query_on_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {(d, n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)}
    got = {tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in QUERIES["op1_decontaminate"](spark, d).collect()}
    assert got == want
    assert any(x[-1] for x in got)


def test_both_ways_at_the_limit(spark):
    """A benchmark of the size of the limit is sent, one byte more is joined by shuffles."""
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    size = items.where("text is not null").selectExpr("sum(octet_length(text) + 32)").first()[0]
    seen = []
    for limit in (size, size - 1):
        found = contamination(docs, items, broadcast_bytes=limit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Join" in plan) == (limit < size)
        seen.append(sorted((r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r["items"]) for r in found.collect()))
    assert seen[0] == seen[1] and any(spans for _, _, spans, _ in seen[0])


def test_index_memory():
    """Bytes of an index for each byte of its benchmark, as the limit promises."""
    import pickle
    import random

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(100))) for i in range(1500)]
    index = Index(items, 10, 5)
    index.choose({k: np.ones(len(c), dtype=np.int64) for k, c in index.shingles.items()})
    assert len(pickle.dumps(index)) < 20 * sum(len(t) for _, t in items)


def test_bloom_lets_every_code_pass(spark):
    codes = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 200_000, dtype=np.int64)
    bloom = _bloom(spark.createDataFrame([(int(c),) for c in codes[:100_000]], "code long").repartition(3))
    assert len(_passing(codes[:100_000].view(np.uint64), bloom)) == 100_000
    assert len(_passing(codes[100_000:].view(np.uint64), bloom)) < 2_000
