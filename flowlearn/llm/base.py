"""What the training-data operators share: table access, sessions, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Rows of an Arrow batch sent to a Python worker. With the byte bound below it keeps a
#: worker's memory flat even where single texts are megabytes long.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20

#: Entries of a per-worker memo, and the longest key that it stores, so that a worker's memory
#: is bounded in bytes: longer keys, such as texts without white space, are computed each time.
MEMO_ENTRIES, MEMO_KEY = 400_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``, read by Spark (any file system it knows)."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; survives lost executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


class Memo(dict):
    """A dict that computes absent values and holds at most about ``entries``, whose keys (text,
    bytes or tuples) have at most ``MEMO_KEY`` parts.

    Entries are in two generations: when the young one is full it becomes the old one, and
    what is asked for again moves back into the young one, so common keys stay."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.half, self.old = make, entries // 2, {}

    def __missing__(self, key):
        if len(key) > MEMO_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def list_array(parts: list[bytes], dtype: str, kind: pa.DataType) -> pa.ListArray:
    """A list array of fixed-width values from the raw bytes of each row's values."""
    width = np.dtype(dtype).itemsize
    ends = np.cumsum([0, *(len(p) // width for p in parts)], dtype=np.int64)
    values = pa.array(np.frombuffer(b"".join(parts), dtype=dtype), type=kind)
    return pa.LargeListArray.from_arrays(pa.array(ends), values).cast(pa.list_(kind))


def map_text(df: DataFrame, keep: list[str], text: str, work: Callable[[list[str]], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Columns ``keep`` of ``df`` beside the columns that ``work`` makes of each batch of texts.

    ``work`` runs once for each Arrow batch on the executors; ``schema`` is the DDL of its
    columns. Other columns of ``df`` are dropped before they reach Python, so names that
    clash with the new ones do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = work(texts(b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made.values()], names=[*keep, *made])

    kept = [df.schema[k] for k in keep]  # names with dots or clashes are given back behind Python
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema])
    return df.select(*[F.col(f"`{k}`").alias(f"kept {i}") for i, k in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text to map")).mapInArrow(run, ddl)


def sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
