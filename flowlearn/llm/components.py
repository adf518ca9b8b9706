"""Connected components of a graph of any size, by alternating star contractions.

Each round links, for every node, its larger neighbours and then its smaller ones to its
smallest neighbour (large star and small star); a star forest remains. Nodes may have any
number of neighbours: their edges are dealt out by node *and* a salt of the neighbour, so a
hub's edges are spread, and only one row for each node and salt meets in a node's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

SALTS = 64


def salted(df: DataFrame, by: Column, salts: int = SALTS) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def least_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, its least ``value`` as ``least`` and the ``salts`` that it has in ``df``."""
    parts = df.groupBy(key, "salt").agg(F.min(value).alias("least"))
    return parts.groupBy(key).agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts"))


def brought_back(df: DataFrame, key: str, per_key: DataFrame) -> DataFrame:
    """The salted ``df`` beside the columns of ``per_key``, which has ``salts`` for each key."""
    rest = [c for c in per_key.columns if c not in (key, "salts")]
    return df.join(per_key.select(key, *rest, F.explode("salts").alias("salt")), [key, "salt"]).drop("salt")


def _star(directed: DataFrame) -> DataFrame:
    """``u``, ``v`` and ``least``, the least of u's neighbours, for each row (u, v)."""
    s = salted(directed, F.col("v"))
    return brought_back(s, "u", least_of(s, "u", "v"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of each node that has an edge
    to another and isn't a root itself. ``edges`` has two columns of one ordered type; rows with
    nulls and loops are left out, repeated edges count once."""
    a, b = (F.col(c) for c in edges.columns)
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((a != b) & a.isNotNull() & b.isNotNull()).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        s = _star(large)
        small = s.select("u", F.col("least").alias("v")).unionByName(s.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
