import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlearn.llm import tokenfile
from flowlearn.llm.queries import QUERIES

FILE = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
CONTENT = open(FILE, encoding="utf-8").read()


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ours(text):
    e = tokenfile.encoder(CONTENT)
    return np.frombuffer(e.encode(text), dtype=e.dtype).tolist()


def test_odd_texts():
    for t in ["", " ", "Hello, World!!", "I'll don't 'S it's", "a\x1cb\x85c\xa0d e", "ÀÉ ß ÿ Éé Ǆ İ ΑΣ ς", "é ́x", "日本 🙂 <|endoftext|>", "x" * 3000, "123 4.5 ½ ª º µ", "\x00\x7f a\x0bb\x0cc", "naïve—dash…"]:
        assert ours(t) == plain(t), t


ADDED = ["<|startoftext|>", "<|endoftext|>"]


def test_added_tokens():
    a, b = ADDED
    for t in [a, b, a + b, b + b + b, f"a{b}b", f"a {b} b", f"{a} hello{b}\n{a}", f"x<{a}>|{b}|", "<|ENDOFTEXT|>", "<|endoftext|", f"é{b}́ x", f"don't{b}'t"]:
        assert ours(t) == plain(t), t
    assert ours(f"a {b} b") == [320, 49407, 321]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*ADDED, "<|", "|>", " ", "text", "don'", "t"]), st.text(max_size=4)), max_size=8).map("".join))
def test_added_tokens_among_others(t):
    t = t.encode("utf-8", "ignore").decode()
    assert ours(t) == plain(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeiou nst'.,!LDSé\n ß1"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(t):
    assert ours(t) == plain(t)


def test_every_bmp_letter():
    for start in range(0, 0x3000, 64):
        t = " ".join(f"a{chr(c)}b {chr(c)}" for c in range(start, start + 64))
        assert ours(t) == plain(t), hex(start)


def test_files(spark, tmp_path):
    rows = [(5, "one two three", "a"), (None, "no id", "b"), (2, None, "c"), (3, "", "d"), (3, "later text", "e"), (9, "word " * 700, "f"), (7, "same", "g"), (7, "same", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    for files in (1, 3):
        folder, manifest = tokenfile.write(docs, FILE, length=16, files=files, folder=f"file://{tmp_path}/{files}")
        got = sorted(tokenfile.read(spark, folder, manifest).collect(), key=lambda r: r.start)
        assert [r.id for r in got] == [None, 2, 3, 3, 5, 7, 7, 9]
        ids = [np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in got]
        assert sorted(ids) == sorted([*plain(t), 2] for _, t, _ in rows)
        assert [r.start for r in got] == np.cumsum([0, *map(len, ids)]).tolist()[:-1]
        flat, seen = [i for x in ids for i in x], []
        for name, _, n in manifest:
            r = tokenfile.Reader(folder, name)
            own = []
            for k in range(len(r)):
                assert len(r.sequence(k)) == 16 and not r.sequence(k).flags.owndata
                own += [int(i) for i, real in zip(r.sequence(k), r.mask(k).to_pylist()) if real]
            assert len(own) == n and all(b.num_rows == tokenfile.BATCH for b in r.batches[:-1])
            seen += own
        assert seen == flat
    folder, manifest = tokenfile.write(docs.limit(0), FILE)
    assert manifest == [] and tokenfile.read(spark, folder, manifest).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    want, at = {}, 0
    for r in sorted(spark.read.parquet(f"{d}/documents.parquet").collect()):
        ids = [*plain(r.text), 2]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_files"](spark, d).collect()} == want
