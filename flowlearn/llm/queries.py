"""The registered query of each training-data operator, over whole tables.

Defined results are those of the operators, as their modules state them. All queries give a row
for each row of the table, so rows that are repeated, or share an id, are answered each (op9: in
the order of the id, then of the text's hash); nulls, empty and very long texts are answered as
their operator states; columns that the tables have besides are dropped first; an empty table
gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, langid, pii, simhash, tokenfile, toxicity, unigram, weaklabel
from .base import sha, table

BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    told = langid.identify(docs, langid.learn(docs, ~held_out("id")))
    return told.select("doc_id", held_out("doc_id").alias("held_out"), F.col("best").alias("lang_pred"), "score", "rejected")


def op3_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), unigram.pieces_of(public_tokenizers.path(PIECE_MODEL)))


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = divergence.verdicts(docs, divergence.references(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weaklabel.score(docs, weaklabel.fit(docs)).select("doc_id", F.round("score", 9).alias("score"), "good")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, sha(listed("base")).alias("base_sha256"), listed("spans").alias("spans"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, manifest = tokenfile.write(docs, public_tokenizers.path(WORD_BPE))
    stored = tokenfile.read(spark, folder, manifest, docs.schema["doc_id"].dataType.simpleString())
    return stored.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out("id")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("restored").alias("n_restored"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_compression_langid,
        op3_unigram_counts,
        op4_divergence,
        op5_simhash,
        op6_byte_bpe,
        op7_weak_label_quality,
        op8_pii,
        op9_token_files,
        op10_toxicity,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

ORACLES = {
    "op1_decontaminate": f"""
WITH i AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS gram FROM i, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
q AS (SELECT r, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS gram FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
m AS (SELECT r, p, k, item_id FROM q JOIN g USING (k, gram)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) WHERE x IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
}
