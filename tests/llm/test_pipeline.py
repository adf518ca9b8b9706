"""Each stage against its operator or brute force, on what the stage before kept."""

import base64

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from flowlearn.llm import pii, toxicity
from tests.llm.test_decontaminate import brute as windows_hit
from tests.llm.test_simhash import plain_classes, plain_fingerprint

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    where, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{D}/documents.parquet"), []
    out.append((docs.columns, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(f"file://{where}/{name}")
        docs = spark.read.parquet(f"file://{where}/{name}")
        out.append((docs.columns, docs.collect()))
    return out


def test_columns(kept):
    assert all(c == kept[0][0] for c, _ in kept[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_toxicity(spark, kept):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    s = toxicity.Scorer(*toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet")))
    assert {r.doc_id for r in kept[1][1]} == {r.doc_id for r in kept[0][1] if s.score(r.text) < 0.5}


def test_near_duplicates(kept):
    rows = sorted((r.doc_id, r.text) for r in kept[1][1])
    classes = plain_classes([plain_fingerprint(t) for _, t in rows])
    assert sorted((r.doc_id, r.text) for r in kept[2][1]) == [rows[i] for i in sorted(set(classes))]


def test_decontamination(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in kept[2][1]]
    assert {r.doc_id for r in kept[3][1]} == {d for d, _, hit, _ in windows_hit(docs, items) if not hit}
    assert 0 < len(kept[3][1]) < len(docs)


def test_pii(kept):
    f = pii.Finder(*pii.model())
    assert {r.doc_id: r.text for r in kept[4][1]} == {r.doc_id: pii.redacted(r.text, f.spans(r.text)[1]) for r in kept[3][1]}


def test_byte_bpe(kept):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = {r.doc_id: r.text for r in kept[4][1]}
    assert {r.doc_id: (r.text, r.ids) for r in kept[5][1]} == {k: (t, oracle.encode_ordinary(t)) for k, t in before.items()}


def test_run_and_odd_rows(spark, kept, tmp_path):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, D).collect()) == sorted(r.doc_id for r in kept[5][1])
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "some words here", "en", "x", 3), (2, "", "en", "x", 0), (2, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    for name, d in (("rows", docs), ("none", docs.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, d, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{name}{k}")
            d = spark.read.parquet(f"file://{tmp_path}/{name}{k}")
        assert d.count() == (2 if name == "rows" else 0)


def test_one_id_with_several_texts_and_a_very_long_one(spark, tmp_path):
    """Rows that share an id are judged each; a text of a million words goes through all stages."""
    long = " ".join(f"word{i % 70_000}" for i in range(1_000_000))
    first, second = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(1, first), (1, second), (2, first), (3, long), (4, second + " "), (5, "mail ann@example.org")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert got == {(1, first), (1, second), (3, long), (5, "mail [EMAIL]")}
