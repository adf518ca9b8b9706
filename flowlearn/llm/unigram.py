"""Token counts by count-only Viterbi (operator 3).

A unigram tokenizer cuts each word into the vocabulary pieces of the greatest total score.
Only the number of tokens is wanted, so an Aho-Corasick automaton enumerates all pieces that
end at each letter, and dynamic programming carries the best score and its token count, no
path. Ties go as in the tokenizers library: pieces are tried by ascending start, and only a
strictly better score replaces the best so far. Where no piece of one letter covers a
letter, an unknown token of the least score less ten does; neighbouring unknown letters make
one unknown token, which counts as its bytes if the vocabulary has all of them.

Words are what white space parts; each is encoded with a mark in front, so equal words count
alike and are remembered.

Defined results: null and empty texts have no tokens; repeated rows are counted each; very
long texts and words are counted whole. Extra columns are dropped first.
"""

from __future__ import annotations

import uuid
from collections import Counter

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .base import Memo, map_text

MARK, UNKNOWN_PENALTY = "▁", 10.0

Pieces = list[tuple[str, float]]


def pieces_of(model_file: str) -> Pieces:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts the tokens of words under unigram scores."""

    def __init__(self, pieces: Pieces, unknown_id: int = 0):
        self.score: dict[str, float] = dict(pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in self.score for b in range(256))
        self.unknown_piece = pieces[unknown_id][0]
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.score.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.of_word = Memo(self.count_word)

    def count_word(self, word: str) -> int:
        """Tokens of one word, its mark included."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(word):
            ends[end + 1].append(piece)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)  # tokens on the best path, without unknown letters before the end
        run = [0] * (n + 1)  # bytes of the unknown letters that the path ends with
        for end in range(1, n + 1):
            found = sorted(ends[end], reverse=True)  # longest first: ascending start
            top = None
            for length, score in found:
                s = best[end - length] + score
                if top is None or s > top:
                    top, count[end], run[end] = s, self._closed(count, run, end - length) + 1, 0
            if not found or found[-1][0] != 1:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, count[end], run[end] = s, count[end - 1], run[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end] = top
        return self._closed(count, run, n)

    def _closed(self, count: list[int], run: list[int], at: int) -> int:
        return count[at] + (run[at] and (run[at] if self.bytes_known else 1))

    def count(self, text: str) -> int:
        of = self.of_word
        return sum(of[MARK + w] * n for w, n in Counter(text.split()).items())


_counters: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, pieces: Pieces, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``n_tokens`` of each text. No shuffle; the vocabulary is sent."""
    sent, name = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def work(batch: list[str]) -> dict[str, pa.Array]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = UnigramCounter(sent.value)
        return {"n_tokens": pa.array([_counters[name].count(t) for t in batch], pa.int64())}

    return map_text(docs, ["doc_id"] if keep is None else keep, text, work, "n_tokens long")
