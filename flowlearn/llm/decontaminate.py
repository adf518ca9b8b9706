"""Benchmark decontamination by a prefix-filtered containment join (operator 1).

An item is cut into windows of ``window`` consecutive words (an item of fewer words, but
not none, is one window); a window *occurs* in a document where all its words stand side by
side. A window must be contained whole, so all its shingles of ``shingle`` words have to
occur, and the necessary prefix of its shingles, ordered from rare to frequent, is the first
alone. The join therefore indexes each window by its rarest shingle (by its count over all
documents; ties by the shingle), looks up the document's shingles, drops candidates that
would start before the document or end after it (length and positional bounds), and
verifies the remaining ones word by word.

The benchmark's index is sent to the executors only if its text is at most ``broadcast_bytes``
long (about 20 bytes in each Python worker for a byte of text); a larger one is joined by a
shuffle on the rarest shingle, to which only the places of documents come that pass a Bloom
filter of the benchmark's shingles. Both ways give the same rows.

Defined results: a null text has no words; a document without words has no hits; an item
without words has no windows; items with a null id mark words but aren't listed; repeated
documents are judged each, repeated items count once; with an empty benchmark nothing is
contaminated. Columns that are not asked for are dropped first, so clashing names do no harm.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, map_text, texts

WINDOW, SHINGLE = 10, 5
#: Benchmarks of up to so many bytes of text go to every executor.
BROADCAST_BYTES = 4 << 20
#: Bytes of a block of the Bloom filter, and the most blocks: 64 MB.
BLOOM_BLOCK, BLOOM_BLOCKS = 1 << 16, 1024

#: Bytes of words stay, A-Z are lower-cased, all other ASCII is white space.
_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def windows(of: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(of[i : i + size]) for i in range(max(1, len(of) - size + 1))] if of else []


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of the k-word shingle at each place of the last axis; 0 where a word is unknown."""
    n = max(0, ids.shape[-1] - k + 1)
    code, known = np.ones((*ids.shape[:-1], n), dtype=np.uint64), np.ones((*ids.shape[:-1], n), dtype=bool)
    for j in range(k):
        part = ids[..., j : j + n]
        known &= part >= 0
        code = code * _FACTOR + (part + 2).astype(np.uint64)
    return np.where(known, code | np.uint64(1), np.uint64(0))


class Index:
    """The windows of a benchmark, looked up by one shingle each. All but the vocabulary is held
    in arrays: for each window size the distinct windows as word ids, and their items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({x for x, _ in items if x is not None})
        place = {x: i for i, x in enumerate(self.names)}
        found: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(text)], dtype=np.int32)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                for held, x in zip(found[rows.shape[1]], (rows, np.full(len(rows), place.get(item, -1), dtype=np.int32))):
                    held.append(x)
        #: By window size: the windows; where each one's items start, and these; the shingle size.
        self.windows: dict[int, np.ndarray] = {}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.k = {size: min(shingle, size) for size in found}
        codes: dict[int, list[np.ndarray]] = defaultdict(list)
        for size, (rows, owners) in found.items():
            self.windows[size], at = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            owner = np.concatenate(owners)
            own = np.unique(np.stack([at.ravel()[owner >= 0], owner[owner >= 0]]), axis=1)
            self.items[size] = np.searchsorted(own[0], np.arange(len(self.windows[size]) + 1)), own[1].astype(np.int32)
            codes[self.k[size]].append(np.unique(_codes(self.windows[size], self.k[size])))
        #: All shingles by their size, sorted by code.
        self.shingles = {k: np.unique(np.concatenate(c)) for k, c in codes.items()}
        self.first: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Index each window by its rarest shingle, by ``counts`` of ``shingles``; ties by code."""
        parts: dict[int, list] = defaultdict(list)
        for size, rows in self.windows.items():
            k = self.k[size]
            codes = _codes(rows, k)
            n = counts[k][np.searchsorted(self.shingles[k], codes)]
            offset = np.where(n == n.min(axis=1, keepdims=True), codes, np.uint64((1 << 64) - 1)).argmin(axis=1)
            parts[k].append((codes[np.arange(len(rows)), offset], np.full(len(rows), size, dtype=np.int32), np.arange(len(rows), dtype=np.int32), offset.astype(np.int32)))
        for k, found in parts.items():
            columns = [np.concatenate(c) for c in zip(*found)]
            order = np.argsort(columns[0], kind="stable")
            self.first[k] = tuple(c[order] for c in columns)

    def flat(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, -1 for other words and after each text; the texts' bounds."""
        get, out, ends = self.vocabulary.get, [], [0]
        for t in batch:
            out += [get(w, -1) for w in words(t)]
            out.append(-1)
            ends.append(len(out))
        return np.array(out, dtype=np.int64), np.array(ends)

    @staticmethod
    def found(ids: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and codes of the shingles in ``ids`` that are among the sorted ``known``."""
        codes = _codes(ids, k)
        at = np.flatnonzero(codes)
        at = at[known[np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)] == codes[at]]
        return at, codes[at]

    def matches(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Text, first word and end (from the text's own) and items of each occurrence."""
        for k, (known, sizes, rows, offsets) in self.first.items():
            at, codes = self.found(ids, k, known)
            owner = np.searchsorted(ends, at, side="right") - 1
            lows, highs = np.searchsorted(known, codes, side="left"), np.searchsorted(known, codes, side="right")
            for p, low, high, t in zip(at.tolist(), lows.tolist(), highs.tolist(), owner.tolist()):
                for i in range(low, high):
                    size, row, start = int(sizes[i]), rows[i], p - int(offsets[i])
                    if start >= ends[t] and start + size < ends[t + 1] and np.array_equal(ids[start : start + size], self.windows[size][row]):
                        bounds, of = self.items[size]
                        yield t, start - int(ends[t]), start - int(ends[t]) + size, of[bounds[row] : bounds[row + 1]]


def _shingle_counts(docs: DataFrame, text: str, sent: Broadcast, index: Index) -> dict[int, np.ndarray]:
    """How often each shingle of the benchmark occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = {k: np.zeros(len(known), dtype=np.int64) for k, known in own.shingles.items()}
        for b in batches:
            ids, _ = own.flat(texts(b.column(0)))
            for k, known in own.shingles.items():
                codes, n = np.unique(own.found(ids, k, known)[1], return_counts=True)
                total[k][np.searchsorted(known, codes)] += n
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k, dtype=np.int32)), "place": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "k int, place int, n long").groupBy("k", "place").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most as many rows as the benchmark has shingles
    k, place, n = (found.column(c).to_numpy() for c in ("k", "place", "n"))
    out = {size: np.zeros(len(known), dtype=np.int64) for size, known in index.shingles.items()}
    for size, counts in out.items():
        counts[place[k == size]] = n[k == size]
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _by_broadcast(docs: DataFrame, rows: list[tuple], keep: list[str], text: str, kind: str, window: int, shingle: int) -> DataFrame:
    index, context = Index(rows, window, shingle), docs.sparkSession.sparkContext
    if index.shingles:
        plain = context.broadcast(index)
        index.choose(_shingle_counts(docs, text, plain, index))
        plain.unpersist()
    sent = context.broadcast(index)

    def work(batch: list[str]) -> dict[str, pa.Array]:
        index = sent.value
        ids, ends = index.flat(batch)
        spans: list[list] = [[] for _ in batch]
        items: list[set] = [set() for _ in batch]
        for t, start, end, own in index.matches(ids, ends):
            spans[t].append((start, end))
            items[t].update(own.tolist())
        return {
            "n_words": pa.array(np.diff(ends) - 1, pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in _merged(s)] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "items": pa.array([[index.names[i] for i in sorted(s)] for s in items], pa.list_(pa.string())),
        }

    out = map_text(docs, keep, text, work, "n_words long, spans array<struct<start: long, end: long>>, items array<string>")
    return out.withColumn("items", F.col("items").cast(f"array<{kind}>"))


# ---------------------------------------------------------------- a benchmark of any size


def _hashed(of: list[bytes], k: int) -> np.ndarray:
    """A 64-bit code of each k-word shingle, without a vocabulary."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in of], dtype=np.uint64)
    n = max(0, len(h) - k + 1)
    code = np.ones(n, dtype=np.uint64)
    for j in range(k):
        code = (code ^ h[j : j + n]) * _FACTOR
        code ^= code >> np.uint64(29)
    return code


def _bits(codes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each code and its three bits there."""
    block = (codes % np.uint64(blocks)).astype(np.int64)
    mixed = codes * _FACTOR
    return block, np.stack([(mixed >> np.uint64(s)).astype(np.int64) & (8 * BLOOM_BLOCK - 1) for s in (3, 23, 43)])


def _bloom(codes: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of codes, by blocks: 16 bits a code, at most ``BLOOM_BLOCKS``
    blocks. Each block is made in one task; what reaches the driver is bounded by their number."""
    n = codes.agg(F.approx_count_distinct("code")).first()[0]
    blocks = min(BLOOM_BLOCKS, max(1, 2 * n // BLOOM_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            block, bits = _bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            for k in np.unique(block).tolist():
                own = made.setdefault(k, np.zeros(BLOOM_BLOCK, dtype=np.uint8))
                at = bits[:, block == k].ravel()
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(made), pa.int32()), "bits": pa.array([x.tobytes() for x in made.values()], pa.binary())})

    # The remainder of the code as an unsigned number.
    block = F.expr(f"cast(pmod(pmod(code, {blocks}) + if(code < 0, {(1 << 64) % blocks}, 0), {blocks}) as int)")
    out = np.zeros((blocks, BLOOM_BLOCK), dtype=np.uint8)
    for r in codes.repartition(block).select("code").mapInArrow(run, "block int, bits binary").collect():
        out[r.block] |= np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def _passing(codes: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    block, bits = _bits(codes, len(bloom))
    ok = np.ones(len(codes), dtype=bool)
    for at in bits:
        ok &= bloom[block, at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
    return np.flatnonzero(ok)


def _by_shuffle(docs: DataFrame, bench: DataFrame, keep: list[str], text: str, kind: str, window: int, shingle: int) -> DataFrame:
    """The same join by shuffles. A Bloom filter of the benchmark's shingles goes to the executors;
    only places of documents that pass it are dealt out, each with the words around it."""

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                made = windows(words(body), window)
                k = min(shingle, len(made[0])) if made else 0
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(made), pa.string()), "win": pa.array([[x.decode() for x in w] for w in made], pa.list_(pa.string())), "k": pa.array([k] * len(made), pa.int32()), "codes": pa.array([_hashed(list(w), k).view(np.int64).tolist() for w in made], pa.list_(pa.int64()))})

    w = bench.select("item", "body").mapInArrow(cut_windows, "item string, win array<string>, k int, codes array<long>")
    w = cut(w.groupBy("win", "k", "codes").agg(F.collect_set("item").alias("items")))
    sizes = sorted(r.k for r in w.select("k").distinct().collect())  # at most ``shingle`` of them
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(w.select(F.explode("codes").alias("code")).distinct()) if sizes else None)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"row": pa.binary(), "k": pa.int32(), "p": pa.int32(), "code": pa.int64(), "near": pa.list_(pa.string())}
        for b in batches:
            found: list[tuple] = []
            for row, body in zip(b.column(0).to_pylist(), texts(b.column(1))):
                of = words(body)
                for k in sizes:
                    codes = _hashed(of, k)
                    at = _passing(codes, sent.value)
                    for p, code in zip(at.tolist(), codes[at].view(np.int64).tolist()):
                        found.append((row, k, p, code, [x.decode() for x in of[max(0, p - window + 1) : p + window]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 5, kinds.values())], names=list(kinds))

    # A row is known by its kept columns and its text: equal rows have equal results.
    named = [F.col(f"`{c}`").alias(f"key{i}") for i, c in enumerate(keep)]
    d = docs.select(*named, F.col(f"`{text}`").cast("string").alias("body"))
    d = d.withColumn("row", F.unhex(F.sha2(F.to_json(F.struct(*[f"key{i}" for i in range(len(keep))], "body"), {"ignoreNullFields": "false"}), 256)))
    counted = map_text(d, [f"key{i}" for i in range(len(keep))] + ["row"], "body", lambda batch: {"n_words": pa.array([len(words(t)) for t in batch], pa.int64())}, "n_words long")
    none = F.expr("cast(array() as array<string>)")
    if not sizes:
        out = counted.withColumn("spans", F.expr("cast(array() as array<struct<start: long, end: long>>)")).withColumn("items", none)
    else:
        # Rows that are repeated give their places several times; hits are distinct again.
        at = cut(d.select("row", "body").mapInArrow(places, "row binary, k int, p int, code long, near array<string>"))
        seen = at.groupBy("k", "code").agg(F.count(F.lit(1)).alias("c"))
        ranked = w.select("win", "items", "k", F.posexplode("codes").alias("offset", "code")).join(seen, ["k", "code"], "left")
        rare = ranked.groupBy("win").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "code", "offset")).alias("m"), F.first("items").alias("items"), F.first("k").alias("k"))
        found = at.join(rare.select("win", "items", "k", "m.code", "m.offset"), ["k", "code"]).withColumn("start", F.col("p") - F.col("offset"))
        # Before the start of the document there is no word; beyond its end the slice is too short.
        first = F.col("start") - F.greatest(F.col("p") - window + 1, F.lit(0))
        found = found.where((F.col("start") >= 0) & (F.slice("near", F.greatest(first, F.lit(0)) + 1, F.size("win")) == F.col("win")))
        hits = found.select("row", F.col("start").cast("long").alias("start"), (F.col("start") + F.size("win")).cast("long").alias("end"), "items")
        # Spans that touch or overlap are united: a gap before a span starts another.
        by_start = Window.partitionBy("row").orderBy("start", "end")
        gap = F.coalesce(F.col("start") > F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        united = hits.select("row", "start", "end").distinct().withColumn("gap", gap.cast("int")).withColumn("g", F.sum("gap").over(by_start))
        spans = united.groupBy("row", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
        items = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
        by = spans.join(items, "row", "left").withColumnRenamed("row", "of row")
        out = counted.join(by, F.col("row") == F.col("of row"), "left")
        out = out.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: long, end: long>>)"))).withColumn("items", F.coalesce("items", none))
    return out.select(*[F.col(f"key{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", F.col("items").cast(f"array<{kind}>").alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Columns ``keep`` with ``n_words``, ``spans`` (merged word ranges that occur in the
    benchmark, end exclusive) and ``items`` (ids of the items that have occurring windows)."""
    keep = ["doc_id"] if keep is None else keep
    kind = benchmark.schema[item_id].dataType.simpleString()
    bench = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("body")).where("body is not null")
    size = bench.agg(F.sum(F.octet_length("body") + 32)).first()[0] or 0
    if size > broadcast_bytes:
        return _by_shuffle(docs, bench, keep, text, kind, window, shingle)
    return _by_broadcast(docs, [tuple(r) for r in bench.collect()], keep, text, kind, window, shingle)
