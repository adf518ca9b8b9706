"""Delimited numeric datasets with a target column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.flow import number, stripped
from .shared import listed


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files of a folder that end in .csv, in any case, sorted. ValueError if none."""
    found = [p for p in listed(spark, folder, "*") if p.lower().endswith(".csv")]
    if not found:
        raise ValueError(f"no CSV file in {folder}")
    return found


def load_dataset(spark: SparkSession, path: str, target: str | int = "last", delimiter: str = ",", header: bool = True) -> tuple[DataFrame, list[str], str]:
    """A checked dataset: the frame (double features, then the target), the features' names
    and the target's. ``target`` is "last", a 1-based position or a column name; a column that
    is itself named "last" is found by position only.

    ValueError for a missing or empty file, fewer than two columns, an unknown target and
    cells that aren't finite numbers (the first such column is named); IndexError for a
    position out of range. Text targets lose white space at both ends.
    """
    reader = spark.read.option("header", header).option("sep", delimiter).option("inferSchema", False)
    try:
        raw = reader.csv(path)
    except Exception as e:
        raise ValueError(f"dataset file does not exist: {path}") from e
    names = raw.columns
    if len(names) < 2:
        raise ValueError("a dataset must hold features and a target")
    if target == "last":
        at = len(names) - 1
    elif isinstance(target, bool) or not isinstance(target, (int, str)):
        raise ValueError("target must be 'last', a position or a column name")
    elif isinstance(target, int):
        if not 1 <= target <= len(names):
            raise IndexError(f"target position {target} is outside 1..{len(names)}")
        at = target - 1
    else:
        if not header:
            raise ValueError("a target by name needs a header")
        if target not in names:
            raise ValueError(f"target column '{target}' was not found")
        at = names.index(target)
    features = [n for i, n in enumerate(names) if i != at]
    typed = raw.select(*[F.coalesce(number(F.col(f"`{n}`")), stripped(F.col(f"`{n}`")).try_cast("double")).alias(n) for n in features], stripped(F.col(f"`{names[at]}`")).alias(names[at]))
    broken = lambda n: F.count_if(F.col(f"`{n}`").isNull() | F.isnan(f"`{n}`") | (F.abs(f"`{n}`") == float("inf")))
    found = typed.agg(F.count(F.lit(1)).alias("rows"), *[broken(n).alias(f"bad{i}") for i, n in enumerate(features)]).first()
    if not found.rows:
        raise ValueError("the dataset has no data rows")
    for i, n in enumerate(features):
        if found[f"bad{i}"]:
            raise ValueError(f"{found[f'bad{i}']} cells of column '{n}' aren't finite numbers")
    return typed, features, names[at]


def inferred_schema(spark: SparkSession, path: str, rows: int = 10_000) -> tuple[list[str], str]:
    """Column names, and ``name::type;...`` as inferred from the first ``rows`` rows of a file:
    the sample is what is asked for. These rows go through the driver in the order of the
    file; a limit within a plan would take the splits as they arrive from the executors."""
    kind = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    first = getattr(spark.read.text(path)._jdf, "as")(kind).takeAsList(rows + 1)
    lines = spark._jsparkSession.createDataset(first, kind)
    sample = DataFrame(spark.read.option("header", True).option("inferSchema", True)._jreader.csv(lines), spark)
    return sample.columns, ";".join(f"{n}::{t}" for n, t in sample.dtypes)


def describe(df: DataFrame) -> DataFrame:
    """``column``, ``type``, ``rows`` and ``nulls`` of each column, and ``mean``, ``min`` and ``max``
    of numeric ones."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    sums = lambda i, c: [f(F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")).alias(f"{k}{i}") for k, f in (("a", F.avg), ("l", F.min), ("h", F.max))]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, c in enumerate(df.columns) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), *sums(i, c))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"a{i}").alias("mean"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.explode(pairs).alias("c")).select("c.*")


def inspect(spark: SparkSession, folder: str, rows: int = 5) -> tuple[str, DataFrame, DataFrame]:
    """Of the first CSV file of a folder its path, ``describe`` and its first rows."""
    path = list_csv(spark, folder)[0]
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return path, describe(df), df.limit(rows)
