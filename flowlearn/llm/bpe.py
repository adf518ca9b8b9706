"""Byte-level BPE encoding and decoding in linear time (operator 6).

Each pre-token is encoded by backtracking over longest vocabulary matches: an Aho-Corasick
automaton over the bytes mapped to Latin-1 gives the longest token that starts at every
byte; tokens are laid left to right, and a token may follow another only if the pair is
*compatible*, i.e. if merging by rank the bytes of both leaves exactly these two tokens.
When no prefix of the longest match fits, the last token is taken back and its end marked
as dead, so that every byte position is given up at most once.

Why this equals merging by rank: a token sequence is the result of the merges if and only
if every two neighbours are, and at most one such sequence exists for a text.

Defined results: null text is the empty text; the empty text has no ids and decodes to no
bytes; repeated rows are encoded each; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import Memo, list_array, map_text

#: A space after anything but white space starts a chunk whose matches don't depend on its
#: neighbours. Most texts have no other spaces; those that have are split by the pattern below.
_AFTER_SPACE, _CHUNK_START = re.compile(r"\s "), re.compile(r"(?<=\S) ")


#: Remembered pairs of tokens.
FITS_ENTRIES = 400_000


class Fits(dict):
    """Whether a token may follow another, by ``left * size + right``; begun afresh when full."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, pair: int) -> bool:
        if len(self) >= FITS_ENTRIES:
            self.clear()
        known = self[pair] = self.bpe._fits(*divmod(pair, self.bpe.size))
        return known


class ByteBPE:
    """A byte-level BPE given by the ranks of its tokens (their ids).

    ``ranks`` maps the bytes of each token to its id; a lower id merges earlier, and all 256
    single bytes are tokens.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = 1 + max(ranks.values())
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.raw = [i.to_bytes(4, "little") for i in range(self.size)]
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix(t) for t in self.bytes_of]
        self._read_merges()
        self.fits = Fits(self)
        self.of_piece = Memo(self._piece_raw, 200_000)
        self.of_chunk = Memo(self._chunk)

    @classmethod
    def from_rank_file(cls, content: bytes, pattern: str) -> ByteBPE:
        """From lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}, pattern)

    def _longest_prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _read_merges(self) -> None:
        """The two tokens whose merge makes each token, in rank order."""
        self.merged: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(self.size)]
        for rank, token in enumerate(self.bytes_of):
            left = self.shorter[rank]
            while left >= 0:
                right = self.ranks.get(token[self.length[left] :], self.size)
                if max(left, right) < rank and self._fits(left, right):
                    self.merged[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by rank leaves exactly both.

        Undoes merges from the latest on, on either side of the seam; the pair is broken if
        two pieces that once met at the seam would have merged before the pieces did.
        """
        below = self.size
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < below:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            can_left, can_right = inner_left != left, inner_right != right
            if not (can_left or can_right):
                return True
            # The later of both merges is undone first; of a base token there is none.
            if can_left and (left > right or not can_right):
                below, left = left, inner_left
            elif can_right and (right >= left or not can_left):
                below, right = right + 1, inner_right

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, as merging by rank gives them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, length, fits, shorter = len(piece), self.size, self.length, self.fits, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # of one start, later ends are longer
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] * size if out else -1
            while token >= 0 and not (alive[at + length[token]] and (before < 0 or fits[before + token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, given without the space that it starts with."""
        return self._pieces(" " + chunk)

    def _pieces(self, text: str) -> bytes:
        of = self.of_piece
        return b"".join([of[p] for p in self.pattern.findall(text)])

    def encode_raw(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        first, *rest = _CHUNK_START.split(text) if _AFTER_SPACE.search(text) else text.split(" ")
        of = self.of_chunk
        return b"".join([self._pieces(first), *[of[c] for c in rest]])

    def _piece_raw(self, piece: str) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in self.encode_piece(piece.encode("utf-8", "surrogatepass"))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(content: bytes, pattern: str) -> ByteBPE:
    """The coder of a rank file, built once in each Python worker."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE.from_rank_file(content, pattern)
    return _coders[key]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``ids`` (array of int) and ``decoded`` (binary) of each text.

    ``rank_file`` is read on the driver and sent to the executors: its size is that of a
    vocabulary and doesn't depend on the documents. No shuffle.
    """
    with open(rank_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batch: list[str]) -> dict[str, pa.Array]:
        bpe = coder(content.value, pattern)
        raw = [bpe.encode_raw(t) for t in batch]
        decoded = [bpe.decode(np.frombuffer(r, dtype="<i4").tolist()) for r in raw]
        return {"ids": list_array(raw, "<i4", pa.int32()), "decoded": pa.array(decoded, pa.binary())}

    return map_text(docs, ["doc_id"] if keep is None else keep, text, work, "ids array<int>, decoded binary")
