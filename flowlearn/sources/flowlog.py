"""Flow logs: scan, parse and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flow
from .shared import listed, removed, renamed


def list_scenarios(spark: SparkSession, folder: str, pattern: str = "dataset*.csv", expected: int | None = None) -> list[str]:
    """Paths of the scenario files of a folder in the order of their numbers, through Hadoop's
    file systems. Files that aren't named dataset<n>.csv are left out."""
    names = spark.createDataFrame([(path,) for path in listed(spark, folder, pattern)], "path string")
    number = F.regexp_extract("path", r"dataset(\d+)\.csv$", 1)
    out = [r.path for r in names.where(number != "").orderBy(number.cast("long"), "path").collect()]
    if expected is not None and len(out) != expected:
        raise ValueError(f"expected {expected} scenario files in {folder}, found {len(out)}")
    return out


def scenario_order(name: Column) -> Column:
    """Sort key: a scenario's number; names without one come last."""
    n = F.regexp_extract(name, r"dataset(\d+)\.csv$", 1)
    return F.when(n != "", n.cast("long")).otherwise(F.lit((1 << 63) - 1))


def scan(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``scenario`` (file name), ``row_seq`` (1 for the first line after the header) and
    ``value`` of each line; ``size_bytes`` of the file. A file must begin with the header.

    Lines are numbered without a shuffle or a join: each input split counts its own, the splits'
    sums, a row for each, are added in a scalar subquery, and a line looks up its split there by
    the number of its task.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    at = raw.select(
        F.regexp_replace("value", "\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("scenario"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    )
    splits = at.groupBy("path", "block").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    task = lambda c: F.shiftright(c, 33).cast("int")  # noqa: E731  # the number of the task that gave a row its id
    shifts = splits.select("first", before.alias("before")).select(task("first").alias("task"), F.struct("first", (F.col("before") - F.col("first")).alias("shift")).alias("s"))
    by_task = shifts.groupBy("task").agg(F.array_sort(F.collect_list("s")).alias("s"))
    every = shifts.agg(F.max("task").alias("last")).select(F.explode(F.sequence(F.lit(0), "last")).alias("task"))
    table = every.join(by_task, "task", "left").agg(F.array_sort(F.collect_list(F.struct("task", "s"))).alias("t"))
    at = at.withColumn("splits", F.get(table.select(F.transform("t", lambda x: x["s"])).scalar(), task("mid")))
    own = F.element_at(F.filter("splits", lambda s: s["first"] <= F.col("mid")), -1)
    rows = at.withColumn("row_seq", F.col("mid") + own["shift"])
    wrong = (F.col("row_seq") == 0) & (F.col("value") != flow.HEADER)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("unexpected header in "), "scenario"))).otherwise(F.col("value"))
    return rows.select("scenario", "row_seq", checked.alias("value"), "size_bytes").where("row_seq > 0 or value is null")


def check_headers(spark: SparkSession, paths: list[str]) -> None:
    """Raise ValueError unless each file is there, not empty, and begins with the header."""
    for p in paths:
        try:
            first = spark.read.option("lineSep", "\n").text(p).first()
        except Exception as e:
            raise ValueError(f"scenario does not exist: {p}") from e
        if first is None:
            raise ValueError(f"empty file: {p}")
        if first.value.removesuffix("\r") != flow.HEADER:
            raise ValueError(f"unexpected header in {p}")


def parts(lines: DataFrame) -> DataFrame:
    """``lines`` with ``parts``: the fields between commas. Quotes mean nothing here."""
    return lines.withColumn("parts", F.split(F.regexp_replace("value", "\r$", ""), ",", -1))


def parse(lines: DataFrame, strict: bool = True, need_label: bool = True) -> DataFrame:
    """Typed records of ``lines`` (scenario, row_seq, value).

    Strict: a line without exactly 21 fields, or without a binary label if one is needed,
    raises. Otherwise such lines stay, with ``malformed`` set and nulls for what can't be read.
    """
    whole = F.size("parts") == len(flow.FIELDS)
    field = lambda name: F.when(whole, F.get("parts", flow.FIELDS.index(name)))
    p = parts(lines).withColumn("label parts", flow.label_parts(field(flow.FIELDS[-1])))
    p = p.withColumn("label", flow.binary_of(F.col("label parts")))
    label = F.col("label")
    malformed = ~whole | label.isNull() if need_label else ~whole
    if strict:
        bad = F.when(~whole, F.raise_error(F.concat(F.lit("invalid row structure in "), "scenario")).cast("boolean"))
        if need_label:
            bad = bad.when(label.isNull(), F.raise_error(F.concat(F.lit("invalid binary label in "), "scenario")).cast("boolean"))
        malformed = F.coalesce(bad, F.lit(False))
    return p.select(
        "scenario",
        "row_seq",
        # Without a readable time the line's number stands in.
        F.coalesce(flow.number(field("ts")), F.col("row_seq").cast("double")).alias("ts"),
        field("id.orig_h").alias("orig_h"),
        field("id.resp_h").alias("resp_h"),
        field("id.resp_p").alias("resp_p"),
        *[field(n).alias(n) for n in [*flow.BASE_NUMERICS, "missed_bytes", "history"]],
        *[flow.stripped(field(n)).alias(n) for n in flow.CATEGORIES],
        flow.port_bucket(field("id.resp_p")).alias("id.resp_p"),
        label.alias("label"),
        F.get("label parts", 2).alias("detailed_label"),
        malformed.alias("malformed"),
    )


def rejects(lines: DataFrame) -> DataFrame:
    """``scenario``, ``row_seq``, ``value`` and ``reason`` of the lines that strict parsing refuses."""
    whole = F.size("parts") == len(flow.FIELDS)
    label = flow.binary_label(F.when(whole, F.element_at("parts", -1)))
    reason = F.when(~whole, "invalid row structure").when(label.isNull(), "invalid binary label")
    return parts(lines).select("scenario", "row_seq", "value", reason.alias("reason")).where("reason is not null")


def write_scenarios(lines: DataFrame, folder: str) -> list[str]:
    """Write ``lines`` (scenario, row_seq, value) of 21 fields as one file for each scenario, the
    header first, lines by row_seq; their paths. A scenario's lines go through one task."""
    spark = lines.sparkSession
    fields = [F.get("parts", i).alias(n) for i, n in enumerate(flow.FIELDS)]
    dealt = parts(lines).repartition("scenario").sortWithinPartitions("scenario", "row_seq")
    plain = {"header": True, "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quote": "\u0000"}
    dealt.select(F.col("scenario").alias("of file"), *fields).write.partitionBy("of file").options(**plain).csv(f"{folder}/written")
    for path in listed(spark, f"{folder}/written", "of file=*/*.csv"):
        renamed(spark, path, f"{folder}/{path.split('of file=')[1].split('/')[0]}")
    removed(spark, f"{folder}/written")
    return list_scenarios(spark, folder)


def from_events(events: DataFrame) -> DataFrame:
    """Flow-log lines made of the ``events`` test table: scenario, row_seq, value."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    e = F.col("event_id")
    duration = F.when(e % 7 == 0, "-").when(e % 11 == 0, "?").when(e % 13 == 0, "").otherwise(F.col("value").cast("string"))
    label = F.concat(F.lit("-   "), F.when(F.col("event_type") == "error", "Malicious").otherwise("benign"), F.lit("   "), F.when(F.col("event_type") == "error", F.concat(F.lit("Attack"), (e % 3).cast("string"))).otherwise("-"))
    fields = [
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))") / 1e6).cast("decimal(20,6)").cast("string"), F.concat(F.lit("C"), e.cast("string")), F.col("user_id").cast("string"), F.lit("1"), (k.cast("int") % 10).cast("string"), k,
        F.col("event_type"), F.when(e % 5 == 0, "-").otherwise(F.concat(F.lit("svc"), (k.cast("int") % 4).cast("string"))), duration, (e % 1000).cast("string"), F.when(e % 9 == 0, "-").otherwise((e % 77).cast("string")),
        F.when(e % 2 == 0, "SF").otherwise("S0"), F.lit("-"), F.lit("-"), (e % 3).cast("string"), F.substring(F.lit("ShADadFfRrHC"), F.lit(1), (e % 12 + 1).cast("int")),
        (e % 10).cast("string"), (e % 100).cast("string"), (e % 8).cast("string"), (e % 50).cast("string"), label,
    ]
    scenario = F.concat(F.lit("dataset"), F.least(F.dayofmonth("ts"), F.lit(23)).cast("string"), F.lit(".csv"))
    seq = F.row_number().over(Window.partitionBy("scenario").orderBy("event_id")).cast("long")
    return events.select(scenario.alias("scenario"), "event_id", F.concat_ws(",", *fields).alias("value")).select("scenario", seq.alias("row_seq"), "value", "event_id")
