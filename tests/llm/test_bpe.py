import base64
import hashlib

import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlearn.llm import bpe
from flowlearn.llm.bpe import coder, encode_decode

CONTENT = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  ", "a  b", "a \n b", "a\t b", "a   b \n\n c", "I'm we'll 's", "x" * 5000, "ab" * 3000 + " " * 700 + "z", "naïve 日本語 🙂🙂 1234567", "\x00\x1c\x85 \xa0é", "!!!??? ###$$$ &&&", " lead", "trail ", "\n\n", "a 　 b"]


def test_odd_texts_match():
    c = coder(CONTENT, P.PATTERN)
    for t in ODD:
        assert c.encode(t) == ORACLE.encode_ordinary(t), t[:40]
        assert c.decode(c.encode(t)) == t.encode()


def test_spaces_after_white_space_and_small_memo(monkeypatch):
    monkeypatch.setattr(bpe, "FITS_ENTRIES", 1)
    c = bpe.ByteBPE.from_rank_file(CONTENT, P.PATTERN)
    for gap in ("  ", " \n ", "\t ", "   ", "\u3000 ", "\x85 ", "\x1c ", " \xa0 "):
        for t in (f"unbelieveable{gap}thatthtiorin, 123{gap}'s", f"{gap}a b", f"a b{gap}", gap):
            assert c.encode(t) == ORACLE.encode_ordinary(t), repr(t)
    assert len(c.fits) <= 1


def test_every_token_is_itself():
    c = coder(CONTENT, P.PATTERN)
    for token, rank in RANKS.items():
        if rank % 7 == 0:
            assert c.encode_piece(token) == ORACLE._core_bpe.encode_single_piece(token)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeiourstn thl \n'.0"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_matches(t):
    assert coder(CONTENT, P.PATTERN).encode(t) == ORACLE.encode_ordinary(t)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_any_bytes_match(b):
    assert coder(CONTENT, P.PATTERN).encode_piece(b) == ORACLE._core_bpe.encode_single_piece(b)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "hello world", "z"), (3, "hello world", "z"), (3, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    e = ORACLE.encode_ordinary("hello world")
    assert sorted(got, key=str) == sorted([(1, [], b""), (2, [], b""), *[(k, e, b"hello world") for k in (None, 3, 3)]], key=str)
    assert encode_decode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["op6_byte_bpe"])
def test_query_against_library(spark, name):
    from flowlearn.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = ORACLE.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES[name](spark, d).collect()} == want
