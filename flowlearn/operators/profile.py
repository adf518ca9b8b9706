"""Profiles of scenarios: counts, vocabularies and quality of values."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flow
from ..sources.delimited import inferred_schema
from ..sources.flowlog import parts, scan

NUMERICS = ["duration", "orig_bytes", "resp_bytes"]


def _observed(name: str) -> Column:
    """A field that a comma ends and that isn't of zero length; null otherwise.

    The profile reads what it can of malformed lines too."""
    i = flow.FIELDS.index(name)
    return F.when((F.size("parts") > i + 1) & (F.length(F.get("parts", i)) > 0), F.get("parts", i))


def _quality(name: str) -> list[Column]:
    raw = _observed(name)
    text = flow.stripped(raw)
    # Numbers are whatever spells a number here: negative and infinite ones too.
    spelled = flow.number(raw).isNotNull() | F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)$")
    return [
        F.count_if(text == "-").alias(f"{name}_dash"),
        F.count_if(text == "?").alias(f"{name}_question"),
        F.count_if(text == "").alias(f"{name}_empty"),
        F.lit(0).cast("long").alias(f"{name}_missing"),
        F.count_if(text.isNotNull() & ~text.isin("-", "?", "") & ~spelled).alias(f"{name}_other_invalid"),
    ]


def _with_label(lines: DataFrame) -> DataFrame:
    label = F.when(F.size("parts") == len(flow.FIELDS), flow.label_parts(F.element_at("parts", -1)))
    return parts(lines).withColumn("lab", label)


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Profiles of scenario files with ``columns``, ``schema_matches``, ``inferred_types`` (from
    the first 10,000 rows) and ``elapsed_seconds`` (of the one job that profiles them all)."""
    began = time.time()
    found = scenarios(scan(spark, paths)).collect()  # a row for each scenario
    took, rows = round(time.time() - began, 3), []
    for path in paths:
        names, types = inferred_schema(spark, path)
        rows.append((path.rsplit("/", 1)[-1], len(names), names == flow.FIELDS, types, took))
    about = spark.createDataFrame(rows, "scenario string, columns int, schema_matches boolean, inferred_types string, elapsed_seconds double")
    return spark.createDataFrame(found, scenarios(scan(spark, paths)).schema).join(about, "scenario")


def scenarios(lines: DataFrame) -> DataFrame:
    """A row for each scenario of ``lines`` (scenario, value, and size_bytes if known): rows, label counts, sorted
    vocabularies joined by |, and how often numbers are dashes, question marks and so on.

    One aggregation with partial sums; vocabularies are sets of short codes."""
    words = lambda n: F.array_join(F.array_sort(F.collect_set(flow.stripped(_observed(n)))), "|").alias(f"{n}_values")
    label = F.get("lab", 1)
    size = [F.max("size_bytes").alias("size_bytes")] if "size_bytes" in lines.columns else []
    return _with_label(lines).groupBy("scenario").agg(
        *size,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(label.isin(flow.BENIGN)).alias("benign"),
        F.count_if(label.isin(flow.MALICIOUS)).alias("malicious"),
        F.count_if(F.col("lab").isNotNull() & ~label.isin([*flow.BENIGN, *flow.MALICIOUS])).alias("unknown_label"),
        F.count_if(F.col("lab").isNull()).alias("label_parse_errors"),
        F.count_distinct(F.get("lab", 2)).alias("detailed_label_classes"),
        *[words(n) for n in flow.CATEGORIES],
        *[q for n in NUMERICS for q in _quality(n)],
    )


def detailed_labels(lines: DataFrame) -> DataFrame:
    """``scenario``, ``detailed_label`` and ``n``, of every line whose label has three parts."""
    return _with_label(lines).where("lab is not null").groupBy("scenario", F.get("lab", 2).alias("detailed_label")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The sorted distinct values of a column, joined by |."""
    return df.groupBy(*(by or [])).agg(F.array_join(F.array_sort(F.collect_set(column)), "|").alias("values"))
