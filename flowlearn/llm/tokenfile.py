"""Token ids in Arrow stream files of equal-length sequences (operator 9).

Documents are dealt out by ranges of their id and sorted, so the files, in order, hold all
documents in ascending order of id. Each task writes one pair of Arrow streams to the shared
folder: the sequences (``tokens`` and ``mask``, both fixed-size lists, in record batches of
equal size, so that sequence k is found without a search and read without a copy) and the
documents' places. A document's ids follow those of the document before it and end with
``end_id``; only the last sequence of a file is padded, and its mask says how far it is real.

A task names its file freshly and reports the name: the manifest holds those of tasks that
succeeded, so lost executors and second attempts do no harm.

Ids are those of the tokenizers library, which finds its added tokens in the raw text before
anything else; so does this. White space ends a word for this tokenizer's normalizer and
splitter, so each chunk between ASCII white space is encoded on its own and remembered; of
chunks in printable ASCII and Latin letters the pieces are handed to the library's BPE model
directly, any other chunk to the whole library.

Defined results: a null text is empty and has the end id alone; null ids come first; repeated
rows are stored each, in the order of their texts' hashes; an empty table makes no file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..sources.shared import shared_dir
from .base import Memo

LENGTH, END_ID, PAD_ID = 2048, 2, 0
#: Sequences of a record batch.
BATCH = 128

#: Chunks whose lower case, composition and splitting need no tables: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: how the tokenizer's own pattern splits such a chunk, in lower case.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers show each byte as: printable Latin-1 as itself,
    the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, content: str):
        self.library = Tokenizer.from_str(content)
        self.library.no_padding()
        self.library.no_truncation()
        added = self.library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that depend on their neighbours aren't supported")
        self.added = {t.content: i for i, t in added.items()}
        self.at_added = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        letters = _byte_letters()
        self.shown = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.raw = [i.to_bytes(np.dtype(self.dtype).itemsize, "little") for i in range(self.library.get_vocab_size())]
        self.tokenize = self.library.model.tokenize
        self.of_piece = Memo(self._piece)
        self.of_chunk = Memo(self._chunk)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self.shown)
        return b"".join([self.raw[t.id] for t in self.tokenize(shown)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if (text.isascii() and text.isprintable()) or _PLAIN.fullmatch(text):
            low, of = text.lower(), self.of_piece
            return of[low] if low.isalpha() else b"".join([of[p] for p in _PIECES.findall(low)])
        return b"".join([self.raw[i] for i in self.library.encode(text, add_special_tokens=False).ids])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as raw bytes of ``dtype``."""
        if not any(t in text for t in self.added):
            return self._words(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self._words(text[at : m.start()]), self.raw[self.added[m.group()]]]
            at = m.end()
        return b"".join([*out, self._words(text[at:])])

    def _words(self, text: str) -> bytes:
        of = self.of_chunk
        return b"".join([of[c] for c in text.encode().split()])


_encoders: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]


class Writer:
    """One pair of stream files: sequences, and the documents' places in them."""

    def __init__(self, folder: str, name: str, dtype: str, id_type: pa.DataType, length: int, end_id: int):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.dtype, self.length, self.id_type = name, np.dtype(dtype), length, id_type
        self.end = np.array([end_id], dtype=dtype).tobytes()
        self.kind = pa.list_(pa.uint16() if self.dtype.itemsize == 2 else pa.uint32(), length)
        self.tokens_out = self.system.open_output_stream(f"{self.root}/{name}.tokens.arrows")
        self.docs_out = self.system.open_output_stream(f"{self.root}/{name}.docs.arrows")
        self.tokens = ipc.new_stream(self.tokens_out, pa.schema([("tokens", self.kind), ("mask", pa.list_(pa.bool_(), length))]))
        self.docs = ipc.new_stream(self.docs_out, pa.schema([("id", id_type), ("start", pa.int64()), ("n", pa.int64())]))
        self.held, self.held_bytes, self.total, self.n_docs = [], 0, 0, 0
        self.rows: list[tuple] = []

    def add(self, doc_id, raw: bytes) -> None:
        raw += self.end
        n = len(raw) // self.dtype.itemsize
        self.rows.append((doc_id, self.total, n))
        self.total += n
        self.n_docs += 1
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= BATCH * self.length * self.dtype.itemsize:
            self._flush(False)
        if len(self.rows) >= 4096:
            self._flush_docs()

    def _flush_docs(self) -> None:
        ids, starts, ns = zip(*self.rows) if self.rows else ((), (), ())
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, self.id_type), pa.array(starts, pa.int64()), pa.array(ns, pa.int64())], names=["id", "start", "n"]))
        self.rows = []

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        step = BATCH * self.length
        whole = len(ids) // step * step
        for i in range(0, whole, step):
            self._batch(ids[i : i + step], step)
        rest = ids[whole:]
        if last and len(rest):
            padded = np.full(-(-len(rest) // self.length) * self.length, PAD_ID, dtype=self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
            rest = rest[:0]
        self.held, self.held_bytes = ([rest.tobytes()], rest.nbytes) if len(rest) else ([], 0)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind.value_type), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], names=["tokens", "mask"]))

    def close(self) -> None:
        self._flush(True)
        if self.rows:
            self._flush_docs()
        for x in (self.tokens, self.docs, self.tokens_out, self.docs_out):
            x.close()


class Reader:
    """Random access to a pair of stream files; local files are mapped, not read."""

    def __init__(self, folder: str, name: str):
        system, root = fs.FileSystem.from_uri(folder)
        self.batches, self.docs = (list(self._stream(system, f"{root}/{name}.{what}.arrows")) for what in ("tokens", "docs"))
        self.length = self.batches[0].schema.field("tokens").type.list_size if self.batches else 0

    @staticmethod
    def _stream(system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else pa.BufferReader(system.open_input_file(path).read_buffer())
        yield from ipc.open_stream(source)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> np.ndarray:
        """The ids of sequence k, a view of the file."""
        return self._values(self.batches[k // BATCH])[k % BATCH * self.length : (k % BATCH + 1) * self.length]

    def mask(self, k: int) -> pa.BooleanArray:
        return self.batches[k // BATCH].column(1)[k % BATCH].values

    @staticmethod
    def _values(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, across sequences and batches."""
        step, out = BATCH * self.length, []
        while n > 0:
            k, i = divmod(start, step)
            part = self._values(self.batches[k])[i : i + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def write(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, folder: str | None = None, files: int | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """Write all documents; the folder and, in order, (name, documents, ids) of each file.

    ``files`` is the number of files wanted; by default Spark's shuffle partitions, which
    adaptive execution may unite."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    with open(tokenizer_file, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, out = encoder(content.value), TaskContext.get().partitionId(), None
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    out = Writer(folder, f"part-{part:05d}-{uuid.uuid4().hex[:12]}", enc.dtype, b.schema.field(0).type, length, end_id)
                out.add(doc_id, enc.encode(t or ""))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [out.name], "docs": pa.array([out.n_docs], pa.int64()), "ids": pa.array([out.total], pa.int64())})

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    dealt = own.repartitionByRange(files, "id") if files else own.repartitionByRange("id")
    made = dealt.sortWithinPartitions("id", F.xxhash64("t"), "t").mapInArrow(run, "part int, name string, docs long, ids long")
    return folder, [(r.name, r.docs, r.ids) for r in sorted(made.collect())]  # a row for each file


def read(spark, folder: str, manifest: list[tuple[str, int, int]], id_type: str = "long", chunk: int = 512) -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n`` and ``ids`` (binary, unsigned
    little-endian 32-bit) of each document, from the files."""
    if not manifest:
        return spark.createDataFrame([], f"id {id_type}, start long, n long, ids binary")
    bases = np.concatenate([[0], np.cumsum([n for _, _, n in manifest])]).tolist()
    sent = spark.sparkContext.broadcast((folder, [m[0] for m in manifest], bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, names, base = sent.value
        for b in batches:
            for k in b.column(0).to_pylist():
                r = Reader(where, names[k])
                for d in r.docs:
                    for i in range(0, d.num_rows, chunk):
                        part = d.slice(i, chunk)
                        raw = [r.ids(s, n).astype("<u4").tobytes() for s, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                        yield pa.RecordBatch.from_arrays([part.column(0), pc.add(part.column(1), base[k]), part.column(2), pa.array(raw, pa.binary())], names=["id", "start", "n", "ids"])

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(run, f"id {id_type}, start long, n long, ids binary")
