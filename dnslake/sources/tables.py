"""Versioned tables, merging writes, append-only log, exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def merge_latest(base: DataFrame, delta: DataFrame, keys: list[str],
                 rules: Mapping[str, str]) -> DataFrame:
    """Insert-or-update as one aggregation.

    ``rules`` maps each other column to ``sum``, ``min``, ``max``, ``last`` (the delta wins, even
    with a null), ``keep`` (the base wins) or ``fill`` (the delta wins unless null).  All are
    combinable, so rows of one key meet after map-side aggregation.
    """
    both = (base.select(*keys, *rules).withColumn("_v", F.lit(0))
            .unionByName(delta.select(*keys, *rules).withColumn("_v", F.lit(1))))

    def rule(column: str, how: str) -> Column:
        if how in _AGG:
            return _AGG[how](column)
        boxed = F.struct(F.col(column).alias("x"))
        if how == "last":
            return F.max_by(boxed, "_v")["x"]
        if how == "keep":
            return F.min_by(boxed, "_v")["x"]
        if how == "fill":
            return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_v")))
        raise ValueError(f"unknown merge rule {how!r}")

    return both.groupBy(*keys).agg(*[rule(c, h).alias(c) for c, h in rules.items()])


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under ``root`` (folders ``v=<n>`` with a ``_SUCCESS`` marker)."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(
                spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> int:
    """Write the next version of a table.  Readers never see half a version.

    A failed attempt leaves a folder without marker; the number behind it is used next.
    """
    spark = df.sparkSession
    number = (versions(spark, root) or [0])[-1] + 1
    while path_exists(spark, f"{root}/v={number}"):
        number += 1
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/v={number}")
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    number = number if number is not None else versions(spark, root)[-1]
    return spark.read.parquet(f"{root}/v={number}")


def append_decisions(df: DataFrame, path: str) -> None:
    """The audit log only grows; there is no overwriting form."""
    (df.withColumn("dt", F.to_date("created_at"))
     .write.mode("append").partitionBy("dt").parquet(path))


def upsert_metrics(base: DataFrame, delta: DataFrame, at: str = "at") -> DataFrame:
    """Samples by time; on a repeated time the newer write wins."""
    others = [c for c in base.columns if c != at]
    return merge_latest(base, delta, [at], dict.fromkeys(others, "last"))


def export_manifest(queries: DataFrame, resolutions: DataFrame, from_: str, to: str) -> DataFrame:
    """One row per exported file: rows, bytes and an order-free digest of its lines.

    The digest is the sum of the 60-bit heads of the line hashes: it needs no order and no single
    task, and it changes with any line.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        line = F.to_json(F.struct(*df.columns))
        head = F.conv(F.left(F.sha2(line, 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
        return df.agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum(head), F.lit(0)).cast("string").alias("digest"),
        ).select(F.lit(name).alias("file"), "rows", "bytes", "digest",
                 F.lit(from_).alias("from"), F.lit(to).alias("to"))

    return one(queries, "queries").unionByName(one(resolutions, "resolutions"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of every part file under ``path``, one file per task row."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(F.regexp_extract("path", r"[^/]+/[^/]+$", 0).alias("file"),
                    F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))


def export_case(queries: DataFrame, resolutions: DataFrame, from_: str, to: str,
                out: str, max_days: int = 400, rows_per_file: int = 1_000_000) -> None:
    """Write both parts of a case as NDJSON in time order, with manifest and file hashes.

    Files are bounded by ``rows_per_file``, so that hashing one fits a task.
    """
    spark = queries.sparkSession
    span = spark.range(1).select(F.unix_timestamp(F.lit(to).cast("timestamp"))
                                 - F.unix_timestamp(F.lit(from_).cast("timestamp")))
    if span.first()[0] > max_days * 86400:
        raise ValueError(f"range is longer than {max_days} days")
    notes = ["client addresses are those seen at the mirror", "times are those of receipt"]
    for df, part, order in ((queries, "queries", "at"), (resolutions, "resolutions", "last_seen")):
        (df.orderBy(order).write.mode("errorifexists")
         .option("maxRecordsPerFile", rows_per_file).json(f"{out}/{part}"))
    manifest = export_manifest(spark.read.schema(queries.schema).json(f"{out}/queries"),
                               spark.read.schema(resolutions.schema).json(f"{out}/resolutions"),
                               from_, to)
    (manifest.withColumn("limitations", F.lit(notes)).coalesce(1)
     .write.mode("errorifexists").json(f"{out}/manifest"))
    hashes = file_hashes(spark, f"{out}/queries").unionByName(
        file_hashes(spark, f"{out}/resolutions"))
    hashes.write.mode("errorifexists").json(f"{out}/files")
