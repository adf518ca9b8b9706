"""Files and tables that driver and executors share, on any file system that Hadoop knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent and all of Spark runs on this machine, as in tests, a temporary
    folder is made and becomes the session's checkpoint folder; a cluster must name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowlearn-")
        sc.setCheckpointDir(found)
    return found


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def parked(df: DataFrame, where: str) -> DataFrame:
    """``df`` written to ``where`` and read again: it is computed once, and its lineage is cut."""
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(found)


def removed(spark: SparkSession, path: str) -> None:
    system, found = _path(spark, path)
    system.delete(found, True)


def write_file(path: str, content: bytes) -> str:
    """Write a small file; it appears whole or not at all, in place of an older one."""
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    system, found = _path(spark, path)
    new = found.suffix(f".{uuid.uuid4().hex}.tmp")
    out = system.create(new, True)
    out.write(bytearray(content))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(found.toUri(), conf).rename(new, found, over)
    return path


def read_file(path: str) -> bytes | None:
    """The content of a small file; None if there is none."""
    spark = SparkSession.active()
    system, found = _path(spark, path)
    if not system.exists(found):
        return None
    source = system.open(found)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths that fit a glob pattern in a folder, sorted."""
    system, found = _path(spark, f"{folder}/{pattern}")
    return sorted(str(f.getPath()) for f in system.globStatus(found) or [])


def renamed(spark: SparkSession, path: str, to: str) -> None:
    system, found = _path(spark, path)
    if not system.rename(found, _path(spark, to)[1]):
        raise OSError(f"can't rename {path} to {to}")
