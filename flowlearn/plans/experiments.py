"""Small experiments: a generated problem, and any delimited dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, sampling, scaling
from ..operators.classifier import RandomFeatureClassifier
from ..sources import delimited, synthetic


def held_out(df: DataFrame, id_col: str, features: list[str], label: str, model: RandomFeatureClassifier, test_size: float, seed: int = 42) -> dict[str, float]:
    """Metrics on held-out rows; scales are fitted on the training rows alone."""
    split = sampling.train_test_split(df, id_col, test_size, seed)
    fitted = scaling.fit_scaling(split.where("not is_test"), features)
    x = scaling.apply_scaling(split, fitted).withColumn("features", F.array(*[F.col(f"`{c}`") for c in features])).select(id_col, "features", F.col(f"`{label}`").alias("label"), "is_test")
    model.fit(x.where("not is_test"), order=id_col)
    return evaluate.scores(model.predict(x.where("is_test").select(id_col, "features", "label")), "label", "predicted", order=id_col)


def validate(spark: SparkSession, seed: int = 42) -> dict[str, float]:
    """Two well separated classes: 100 hidden units, a quarter of the rows held out."""
    return held_out(synthetic.two_gaussians(spark, seed=seed), "id", ["x1", "x2"], "label", RandomFeatureClassifier(100, seed=seed), 0.25, seed)


def dataset_experiment(spark: SparkSession, path: str, target: str | int = "last", out: str | None = None, hidden: int = 1000, ridge: float = 0.01, test_size: float = 0.2, seed: int = 42) -> dict[str, float]:
    """The same on a file; metrics also as CSV lines without a header if ``out`` is given.

    A row is known by its place in the file's partitions."""
    df, features, label = delimited.load_dataset(spark, path, target)
    rows = df.withColumn("row id", F.monotonically_increasing_id())
    found = held_out(rows, "row id", features, label, RandomFeatureClassifier(hidden, ridge=ridge, seed=seed), test_size, seed)
    if out:
        spark.createDataFrame(sorted(found.items()), "metric string, value double").coalesce(1).write.mode("overwrite").option("header", False).csv(out)
    return found
