"""The corpus pipeline: from documents to decoded, redacted, unique, clean texts.

Stages, in order: toxicity (rejected documents go), SimHash near-duplicates (one document of
each class stays), benchmark decontamination (documents that hold a benchmark
window go), personal data (spans are replaced), byte-level BPE (ids, and the text decoded from
them). Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the
stage before kept, written as parquet and read again.

Defined results: null and empty texts are clean and stay (one of their near-duplicate class, as
they share a fingerprint; null stays null until it is decoded, from no ids, as empty); rows without
an id stay; of repeated rows one stays, and rows that share an id but not the class are judged
each; ties go to the least id; texts of any length are handled whole; an empty table gives an
empty one; columns beside those of ``documents`` are dropped first.

The near-duplicate stage links as the operator does by default: three-word shingles, at most three
of 64 bits. It finds exact copies and the closest of others; see the README for its reach.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlearn.llm import bpe, decontaminate, pii, simhash, toxicity
from flowlearn.llm.base import bound_batches, table
from flowlearn.llm.queries import BYTE_RANKS
from flowlearn.sources.shared import fresh_folder, removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose deobfuscated text scores below the threshold. The lexicon is learnt from
    the labels of ``sf_dir`` and the texts at hand; a null text is clean."""
    bound_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class."""
    bound_batches(spark)
    return simhash.representatives(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    bound_batches(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    bound_batches(spark)
    found = pii.personal_data(docs, keep=COLUMNS)
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids`` and ``n_tokens``; ``text`` is what the ids decode to."""
    bound_batches(spark)
    coded = bpe.encode_decode(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, keep=COLUMNS)
    return coded.select("doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_copies), ("decontamination", decontaminated), ("pii", redact), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; the
    table of a stage goes once the next has been written, that of the last is the result."""
    where, before = fresh_folder(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if before:
            removed(spark, f"{where}/{before}")
        before = name
    return docs


#: Learnt lexicons, boosted trees and merges aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None
