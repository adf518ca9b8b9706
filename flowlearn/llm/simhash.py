"""SimHash near-duplicates by a binary trie self-join (operator 5).

Fingerprints: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of a
text's word shingles. Two fingerprints *link* at ``budget`` or fewer differing bits, and a
document's class is its connected component.

The join works on distinct fingerprints. The 64 bits are cut into blocks; two fingerprints
that differ in at most ``budget`` bits agree in at least ``blocks - budget`` of them, so all
that agree in one such choice of blocks form a bucket, and no link crosses all buckets. The
number of blocks follows the number of fingerprints, so that the mean bucket is small at any
size. A bucket beyond ``bucket_rows`` is split in the same way by those bits that divide its
members best, again and again. In each bucket a binary trie is joined with itself: pairs of
nodes descend together, differing bits add up, and a pair is dropped as soon as they exceed the
budget. From each bucket only its spanning stars go on, never its pairs; these join into components.

Defined results: a null text is the empty text, whose fingerprint is zero and links like any
other; repeated rows share a class; a class whose document ids are all null has a null
component. Extra columns are dropped first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, map_text
from .components import brought_back, components, least_of, salted

BUDGET, SHINGLE, SEED = 3, 3, 42
#: A bucket of more fingerprints is split by so many bits, and what is left large again, at most
#: so often: members of one that stays large differ in few bits, and a task joins them as they are.
BUCKET_ROWS, SPLIT_BITS, SPLITS = 8192, 32, 3
#: The mean bucket has at most about so many fingerprints.
MEAN_BUCKET = 512
#: Pairs of trie nodes, and fingerprints, that a task holds at once (a whole bucket at least).
FRONTIER, CHUNK = 500_000, 50_000

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is space and \t to \r
    if not w:
        return 0
    of, seed = xxhash.xxh64_intdigest, SEED
    if len(w) <= shingle:
        return of(b" ".join(w), seed)
    h = np.array([of(b" ".join(g), seed) for g in zip(*(w[i:] for i in range(shingle)))], dtype=">u8")
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(counts @ _BITS_OF_BYTE * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` with ``fp``, the fingerprint of the text as a signed long."""

    def work(batch: list[str]) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))}

    return map_text(docs, ["doc_id"] if keep is None else keep, text, work, "fp long")


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of a[i] and b[i]; ``parent`` leads to the least member of a class."""
    while len(a):
        while not np.array_equal(up := parent[a], a):
            a = up
        while not np.array_equal(up := parent[b], b):
            b = up
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def trie_classes(v: np.ndarray, starts: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each fingerprint the place of the least one in its class.

    ``v`` holds groups of ascending, distinct unsigned fingerprints; ``starts`` their bounds.
    A trie node is a range of ``v`` under a common prefix.
    """
    parent = np.arange(len(v))
    ones: dict[int, np.ndarray] = {}  # by depth: how many fingerprints before each have the next bit
    lo, hi = starts[:-1], starts[1:]
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, dist = stack.pop()
        if len(alo) > FRONTIER:
            stack += [(depth, *(x[i : i + FRONTIER // 2] for x in (alo, ahi, blo, bhi, dist))) for i in range(0, len(alo), FRONTIER // 2)]
            continue
        # Two leaves: what is left of both paths is compared at once.
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        i, j = alo[leaf], blo[leaf]
        near = (np.bitwise_count(v[i] ^ v[j]) <= budget) & (i != j)
        _joined(parent, i[near], j[near])
        alo, ahi, blo, bhi, dist = (x[~leaf] for x in (alo, ahi, blo, bhi, dist))
        if not len(alo):
            continue
        if depth not in ones:
            bit = (v >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        other = alo != blo
        pairs = [(alo, amid, blo, bmid, dist), (amid, ahi, bmid, bhi, dist), (alo, amid, bmid, bhi, dist + 1)]
        pairs.append(tuple(x[other] for x in (amid, ahi, blo, bmid, dist + 1)))
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*pairs))
        live = (a1 > a0) & (b1 > b0) & (d <= budget)
        stack.append((depth + 1, a0[live], a1[live], b0[live], b1[live], d[live]))
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _stars(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the buckets, which come one after another."""

    def made(groups: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fps, groups))
        g, v = groups[order], fps[order]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        g, v = g[fresh], v[fresh]
        starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        root = trie_classes(v, starts, budget)
        at = np.flatnonzero(root != np.arange(len(v)))
        return pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(v[root[at]].view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, seen, last = 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        t, key, fp = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in range(3))
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
        new[0] = last != (t[0], key[0])
        last = (t[-1], key[-1])
        groups = seen + np.cumsum(new)
        seen = int(groups[-1])
        fps = fp.astype(np.int64).view(np.uint64)
        if rows + len(fps) > CHUNK and (at := np.flatnonzero(new)).size:
            # All buckets that ended are joined; the last, which may go on, is kept.
            k = int(at[-1])
            held.append((groups[:k], fps[:k]))
            yield made(*(np.concatenate(x) for x in zip(*held))) if rows + k else pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            held, rows = [(groups[k:], fps[k:])], len(fps) - k
        else:
            held.append((groups, fps))
            rows += len(fps)
    if rows:
        yield made(*(np.concatenate(x) for x in zip(*held)))


def tables(n: int, budget: int = BUDGET, mean: int = MEAN_BUCKET) -> list[list[tuple[int, int]]]:
    """For each bucket key its parts as (lowest bit, bits), for ``n`` fingerprints."""
    for blocks in range(budget + 1, 12):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
        chosen = [list(c) for c in combinations(parts, blocks - budget)]
        if n >> min(sum(w for _, w in c) for c in chosen) <= mean:
            break
    return chosen


def _bit(name: str, at) -> Column:
    return F.shiftrightunsigned(name, at).bitwiseAND(F.lit(1).cast("long"))


def _split(large: DataFrame, budget: int) -> DataFrame:
    """The members of large buckets in smaller ones. A bucket's ``SPLIT_BITS`` most even bits are
    dealt into ``budget`` + 1 blocks; what links agrees in one block at least, so a member goes
    to a bucket for each block. Bits are counted anew for each bucket, whatever its members share."""
    ones = large.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(_bit("fp", i)).alias(f"b{i}") for i in range(64)])
    evenness = F.array(*[F.struct(F.least(F.col(f"b{i}"), F.col("n") - F.col(f"b{i}")).alias("even"), F.lit(i).alias("bit")) for i in range(64)])
    bits = ones.select("t", "key", F.slice(F.reverse(F.array_sort(evenness)), 1, SPLIT_BITS).alias("bits"))
    per = SPLIT_BITS // (budget + 1)
    value = lambda block: F.concat_ws("", *[_bit_at(block + j * (budget + 1)) for j in range(per)])
    blocks = F.array(*[F.xxhash64("key", F.lit(k), value(k)) for k in range(budget + 1)])
    return large.join(bits, ["t", "key"]).select("t", F.explode(blocks).alias("key"), "fp")


def _bit_at(k: int) -> Column:
    """The bit of ``fp`` at the k-th of ``bits``, as text."""
    return F.substring(F.lpad(F.bin("fp"), 64, "0"), F.lit(64) - F.get("bits", k)["bit"], F.lit(1))


def links(fps: DataFrame, n: int, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS, mean: int = MEAN_BUCKET) -> DataFrame:
    """Edges (a, b) that connect the same distinct fingerprints as all links do."""
    keyed = []
    for t, parts in enumerate(tables(n, budget, mean)):
        key, taken = F.lit(0).cast("long"), 0
        for low, width in parts:
            key = key + F.shiftleft(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long")), taken)
            taken += width
        keyed.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    dealt, done = fps.select("fp", F.explode(F.array(*keyed)).alias("k")).select("k.*", "fp"), None
    for _ in range(SPLITS):
        large = cut(dealt.groupBy("t", "key").count().where(F.col("count") > bucket_rows).select("t", "key"))
        if large.isEmpty():
            break
        small = dealt.join(large, ["t", "key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        dealt = _split(dealt.join(large, ["t", "key"], "left_semi"), budget)
    dealt = dealt if done is None else done.unionByName(dealt)
    dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(lambda batches: _stars(batches, budget), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS, mean: int = MEAN_BUCKET) -> DataFrame:
    """``id_col``, ``fp`` (signed long) and ``component``, the least id of the class."""
    return classes_of(docs, id_col, text, budget, shingle, bucket_rows, mean).select(F.col("id").alias(id_col), "fp", "component")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS, mean: int = MEAN_BUCKET) -> DataFrame:
    """``id``, ``fp``, ``component`` and ``root``, which tells classes apart even where one id is
    the least of several."""
    own = cut(fingerprints(docs, [id_col], text, shingle).select(F.col(f"`{id_col}`").alias("id"), "fp"))
    spread = salted(own, F.col("id"))
    per_fp = cut(least_of(spread, "fp", "id").withColumnRenamed("least", "first_id"))
    roots = components(links(per_fp.select("fp"), per_fp.count(), budget, bucket_rows, mean))
    rooted = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = salted(rooted.withColumnRenamed("salts", "id_salts"), F.col("fp"))
    classes = brought_back(classes, "root", least_of(classes, "root", "first_id").withColumnRenamed("least", "component"))
    back = brought_back(spread, "fp", classes.select("fp", "component", "root", F.col("id_salts").alias("salts")))
    return back.select("id", "fp", "component", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, one of each class: that with the least id, of repeated rows one.

    Rows that share an id but not the class are no repeats: each is judged with its own class.
    Documents without an id can't be named as a class, so they all stay."""
    found = classes_of(docs, id_col, text, **how)
    kept = found.where(F.col("id") == F.col("component")).groupBy("root").agg(F.min(F.struct("id", "fp")).alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.fp").alias("kept_fp"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # those of the documents may clash with fp
    at = lambda c: F.col(names[docs.columns.index(c)])
    own = fingerprints(docs.where(F.col(f"`{id_col}`").isNotNull()).toDF(*names), names, names[docs.columns.index(text)], how.get("shingle", SHINGLE))
    one = own.join(kept, (at(id_col) == F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")), "left_semi").dropDuplicates([names[docs.columns.index(id_col)], "fp"])
    return one.drop("fp").toDF(*docs.columns).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
