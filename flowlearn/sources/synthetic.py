"""Generated data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def two_gaussians(spark: SparkSession, per_class: int = 100, center: float = 1.0, spread: float = 0.35, seed: int = 42) -> DataFrame:
    """``id``, ``x1``, ``x2`` and ``label``: class 0 around -center, class 1 around +center."""
    side = F.when(F.col("id") % 2 == 0, -center).otherwise(center)
    return spark.range(2 * per_class).select("id", (side + spread * F.randn(seed)).alias("x1"), (side + spread * F.randn(seed + 1)).alias("x2"), (F.col("id") % 2).cast("int").alias("label"))
