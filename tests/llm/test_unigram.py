import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from flowlearn.llm import unigram
from flowlearn.llm.queries import QUERIES

PIECES = unigram.pieces_of(P.path("piece_bpe_32k.model"))
LIBRARY = Tokenizer(models.Unigram(PIECES, unk_id=0, byte_fallback=True))
OURS = unigram.UnigramCounter(PIECES)
SMALL = [("<unk>", 0.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.5), ("aba", -3.5), ("▁", -0.5), ("▁a", -1.5)]


def plain(text):
    return sum(len(LIBRARY.encode(unigram.MARK + w).ids) for w in text.split())


def test_odd_texts():
    for t in ["", " ", "Hello world", "x" * 300, "日本語 🙂🙂 \x00\x01", "thedble onanea", "<0x41> <s> </s>", "naïve é1234", "▁▁ a"]:
        assert OURS.count(t) == plain(t), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeioutnhsrl é."), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_any_text(t):
    assert OURS.count(t) == plain(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc▁é", max_size=14), st.booleans())
def test_ties(t, with_bytes):
    pieces = SMALL + [(f"<0x{b:02X}>", -9.0) for b in range(256)] * with_bytes
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=with_bytes))
    assert unigram.UnigramCounter(pieces).count_word(t) == len(library.encode(t).ids)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "two words", 1), (3, "two words", 1), (3, "two words", 1)], "doc_id long, text string, n_tokens int")
    n = plain("two words")
    assert [(r.doc_id, r.n_tokens) for r in unigram.token_counts(df, PIECES).collect()] == [(1, 0), (2, 0), (None, n), (3, n), (3, n)]
    assert unigram.token_counts(df.limit(0), PIECES).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op3_unigram_counts"](spark, d).collect()} == want
