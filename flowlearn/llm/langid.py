"""Language identification by compression (operator 2).

For each language a zstandard raw-content dictionary is made of labelled texts. A text is
cut into blocks, each block compressed with each dictionary, and the language of the least
total size wins (ties: the first in order). Where the runner-up comes within ``margin`` of
the winner, relative to the text's length, the answer is rejected as ``und``.

Each dictionary is fitted on at most ``sample_docs`` labelled texts of its language, those with
the least hashes among all that differ, so copies count once. A dictionary has bounded room, so
a text of more than ``sample_letters`` letters gives pieces of equal size spread from its start
to its end. Texts to be told are compressed whole. Letters are Unicode's.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
labelled text every answer is ``und``; repeated rows are answered each. Extra columns are
dropped first.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_text

#: Bounds of the training sample, for each language; letters of a piece of a longer text.
SAMPLE_DOCS, SAMPLE_LETTERS, PIECE = 192, 600, 150
#: Bytes compressed at once; the longer, the more a text explains itself.
BLOCK, LEVEL, MARGIN = 1024, 5, 0.01
UNKNOWN = "und"
#: Signs that aren't letters tell nothing of a language; runs of them count as one space.
_OTHER = re.compile(r"[\W\d_]+")
#: What the above leaves besides letters: numerals such as those of fractions and Roman ones.
_NO_LETTER = regex.compile(r"\P{L}+")


def plain(text: str) -> bytes:
    """Letters in lower case, as UTF-8."""
    found = _OTHER.sub(" ", text.lower())
    return (found if found.replace(" ", "").isalpha() else _NO_LETTER.sub(" ", found)).encode()


class Identifier:
    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.packers = []
        for lang in self.langs:
            raw = b" ".join(map(plain, samples[lang])) + b" " * 8  # at least eight bytes
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def tell(self, text: str) -> tuple[str, float, bool]:
        """Language of the least size, score, and whether the margin is too narrow."""
        raw = plain(text)
        if not raw.strip() or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(raw)
        best = min(sizes)
        # A byte more is a factor of two less likely, up to a bound that floats can hold.
        score = 1.0 / sum(2.0 ** -min(60, s - best) for s in sizes)
        runner_up = sorted(sizes)[1] if len(sizes) > 1 else best + len(raw)
        return self.langs[sizes.index(best)], score, runner_up - best < max(1.0, MARGIN * len(raw))


def spread_pieces(t: Column, letters: int, piece: int = PIECE) -> Column:
    """A text of at most ``letters`` letters as it is; of a longer one pieces as long together."""
    k, n = max(1, letters // piece), F.length(t)
    at = lambda i: (F.floor(i * (n - piece) / max(1, k - 1)) + 1).cast("int")
    return F.when(n <= letters, t).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substr(t, at(i), F.lit(piece))), " "))


def learn(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> dict[str, list[str]]:
    """Sample texts by language, from the rows that ``usable`` (of ``id``) admits."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}") & (F.lit(True) if usable is None else usable))
    own = own.select("lang", "t", F.xxhash64("t").alias("h")).withColumn("place", F.pmod("h", F.lit(1 << 30)))
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    # Hashes below a share of their range leave about three times the sample of each language.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3.0 * sample_docs / max(1, n)))])[F.col("lang")]
    some = own.where(F.col("place") < share * (1 << 30)).groupBy("lang", "place", "h").agg(F.min(spread_pieces(F.col("t"), sample_letters)).alias("t"))
    first = some.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "h", "t"))), 1, sample_docs).alias("s"))
    return {r.lang: [x.t for x in r.s] for r in first.collect()}  # at most ``sample_docs`` texts of each language


_known: dict[str, Identifier] = {}


def identify(docs: DataFrame, samples: dict[str, list[str]], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``best`` (the likeliest language), ``score``, ``rejected`` and
    ``language`` (``best``, or ``und`` if rejected). No shuffle."""
    sent, name = docs.sparkSession.sparkContext.broadcast(samples), uuid.uuid4().hex

    def work(batch: list[str]) -> dict[str, pa.Array]:
        if name not in _known:
            _known.clear()
            _known[name] = Identifier(sent.value)
        got = [_known[name].tell(t) for t in batch]
        return {
            "best": pa.array([g[0] for g in got], pa.string()),
            "score": pa.array([g[1] for g in got], pa.float64()),
            "rejected": pa.array([g[2] for g in got], pa.bool_()),
            "language": pa.array([UNKNOWN if g[2] else g[0] for g in got], pa.string()),
        }

    return map_text(docs, ["doc_id"] if keep is None else keep, text, work, "best string, score double, rejected boolean, language string")
