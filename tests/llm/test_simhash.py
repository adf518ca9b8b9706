import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlearn.llm.components import components
from flowlearn.llm.queries import QUERIES
from flowlearn.llm import simhash
from flowlearn.llm.simhash import fingerprint, near_duplicates, representatives, tables, trie_classes


def plain_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_classes(fps, budget=3):
    """Least place of each class, by comparing all pairs."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(fps))]


def clumps(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def test_fingerprint():
    for t in ["", None, " ", "A", "one Two", "a b c", "É é\x0b\x0cx y z z z z z", "w " * 500, "x y z q", "İ ß K k"]:
        assert fingerprint(t) == plain_fingerprint(t)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_trie_against_all_pairs(seed):
    rng = random.Random(seed)
    groups = [clumps(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 5))]
    starts = np.cumsum([0, *map(len, groups)])
    got = trie_classes(np.array([x for g in groups for x in g], dtype=np.uint64), starts)
    assert got.tolist() == [s + c for s, g in zip(starts.tolist(), groups) for c in plain_classes(g)]


def test_tables_cover_all_links():
    rng = random.Random(1)
    for n in (10, 10**8, 10**11):
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for _ in range(3):
                y ^= 1 << rng.randrange(64)
            assert any(all((x ^ y) >> low & ((1 << w) - 1) == 0 for low, w in parts) for parts in tables(n))


def test_components(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if None not in (a, b):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("rows", [8192, 3])
def test_rows(spark, rows):
    data = [(5, None, 1), (3, "", 1), (7, "a b c d e f", 1), (2, "A b c d e f", 1), (2, "A b c d e f", 1), (9, "q r s t", 1), (None, "lone text of no id", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component) for r in near_duplicates(df, bucket_rows=rows).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 2), (2, 2), (2, 2), (9, 9), (None, None)], key=str)
    kept = representatives(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 9, None]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [8192, 2])
def test_query_against_all_pairs(spark, rows):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {(docs[i][0], f"{fps[i]:016x}", docs[c][0]) for i, c in enumerate(plain_classes(fps))}
    if rows == 2:
        found = near_duplicates(spark.read.parquet(f"{d}/documents.parquet"), bucket_rows=2)
        assert {(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in found.collect()} == want
    else:
        assert {tuple(r) for r in QUERIES["op5_simhash"](spark, d).collect()} == want


def test_rows_that_share_an_id_but_not_the_class(spark):
    """Both classes named by the id keep a row; a row whose class another id names goes."""
    a, b, c = (" ".join(f"{x}{i * 7 % 31}" for i in range(40)) for x in "abc")
    rows = [(1, a, 0), (1, b, 0), (1, b, 0), (2, c, 0), (3, c, 0), (3, " ".join("xyz"), 0), (4, b, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)
    got = sorted((r.doc_id, r.text) for r in representatives(df).collect())
    assert got == sorted([(1, a), (1, b), (2, c), (3, "x y z")])


def test_buckets_whose_members_share_bits(spark):
    """Fingerprints that agree in most bits, as those of templates do, are split by the others."""
    rng = np.random.default_rng(5)
    free = [3, 9, 17, 20, 22, 31, 33, 40, 41, 47, 50, 52, 55, 58, 60, 61, 62, 63]
    values = sorted({sum(1 << b for b in free if rng.random() < 0.5) for _ in range(1500)})
    fps = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(fps, len(values), bucket_rows=100).collect()]
    assert all((a ^ b).bit_count() <= 3 * 40 for a, b in edges)
    place = {v: i for i, v in enumerate(values)}
    mine, want = list(range(len(values))), list(range(len(values)))

    def joined(parent, pairs):
        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
        return [top(i) for i in range(len(parent))]

    v = np.array(values, dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    assert joined(mine, [(place[a], place[b]) for a, b in edges]) == joined(want, near.tolist())


def test_very_long_text(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(600_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "x" * 3_000_000), (4, "short")], "doc_id long, text string")
    assert {r.doc_id: r.component for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
