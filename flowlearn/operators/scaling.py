"""Column scaling and label encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("zscore", "minmax")


@dataclass
class Scaling:
    method: str
    columns: list[str]
    offset: list[float]
    scale: list[float]


def check_finite(df: DataFrame, columns: list[str]) -> int:
    """The number of rows; ValueError if there are none or a value isn't a finite number."""
    bad = [F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) | (F.abs(F.col(f"`{c}`").cast("double")) == float("inf"))).alias(f"b{i}") for i, c in enumerate(columns)]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *bad).first()
    if not found.rows or not columns:
        raise ValueError("there are no features")
    if wrong := [c for i, c in enumerate(columns) if found[f"b{i}"]]:
        raise ValueError(f"not finite numbers: {', '.join(wrong)}")
    return found.rows


def fit_scaling(df: DataFrame, columns: list[str], method: str = "zscore") -> Scaling:
    """Offsets and scales from one aggregation; a zero scale becomes 1."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    check_finite(df, columns)
    low, span = (F.avg, F.stddev_pop) if method == "zscore" else (F.min, lambda c: F.max(c) - F.min(c))
    double = lambda c: F.col(f"`{c}`").cast("double")
    found = df.agg(*[f(double(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("o", low), ("s", span))]).first()
    return Scaling(method, list(columns), [found[f"o{i}"] for i in range(len(columns))], [found[f"s{i}"] or 1.0 for i in range(len(columns))])


def apply_scaling(df: DataFrame, scaling: Scaling, columns: list[str] | None = None) -> DataFrame:
    columns = columns or scaling.columns
    if len(columns) != len(scaling.columns):
        raise ValueError(f"{len(columns)} columns, but {len(scaling.columns)} were fitted")
    return df.withColumns({c: (F.col(f"`{c}`").cast("double") - o) / s for c, o, s in zip(columns, scaling.offset, scaling.scale)})


def classes_of(df: DataFrame, label: str, order: str) -> list:
    """Distinct labels in the order of their first rows."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("at")).orderBy("at").collect()  # a row for each class
    if not rows:
        raise ValueError("there are no labels")
    return [r[label] for r in rows]


def encode_labels(df: DataFrame, label: str, order: str, classes: list | None = None) -> tuple[DataFrame, list]:
    """``df`` with ``class_index`` (from 0) and ``one_hot``; an unknown label raises when read."""
    classes = classes_of(df, label, order) if classes is None else list(classes)
    if not classes:
        raise ValueError("classes must not be empty")
    if len(set(classes)) != len(classes):
        raise ValueError("classes must not repeat")
    at = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    index = F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("long"))
    return df.withColumn("class_index", index.cast("int")).withColumn("one_hot", F.array(*[(F.col("class_index") == i).cast("double") for i in range(len(classes))])), classes
