"""Event log: readers, type filter, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslake import refdata, schemas


def read_events(spark: SparkSession, path: str, fmt: str = "parquet",
                from_: datetime | None = None, to: datetime | None = None) -> DataFrame:
    """Event log with a fixed schema; ``dt`` folders are pruned by the time range when present."""
    reader = spark.read.schema(schemas.EVENTS)
    df = reader.format(fmt).load(path)
    return between(df, from_, to) if from_ or to else df


def stream_events(spark: SparkSession, directory: str, schema: str = schemas.EVENTS,
                  max_files: int = 1000, glob: str | None = None) -> DataFrame:
    """Event files as a stream; ``max_files`` per micro-batch is the back-pressure."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(directory)


def wanted_types(df: DataFrame, qtype: str = "qtype") -> DataFrame:
    return df.where(F.col(qtype).isin(list(refdata.QTYPES.values())))


def between(df: DataFrame, from_: datetime | str | None, to: datetime | str | None,
            ts: str = "occurred_at") -> DataFrame:
    """Rows whose time lies in ``[from_, to]``; also tests ``dt`` when the table has it."""
    if from_ is not None:
        low = F.lit(from_).cast("timestamp")
        df = df.where(F.col(ts) >= low)
        if "dt" in df.columns:
            df = df.where(F.col("dt") >= F.to_date(low))
    if to is not None:
        high = F.lit(to).cast("timestamp")
        df = df.where(F.col(ts) <= high)
        if "dt" in df.columns:
            df = df.where(F.col("dt") <= F.to_date(high))
    return df


def cutoff(as_of: datetime | str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))


def apply_retention(df: DataFrame, as_of: datetime | str, days: int,
                    ts: str = "occurred_at") -> DataFrame:
    """Rows young enough to keep.  Written back by ``dt``, whole old days simply vanish."""
    keep = df.where(F.col(ts) >= cutoff(as_of, days))
    if "dt" in df.columns:
        keep = keep.where(F.col("dt") >= F.to_date(cutoff(as_of, days)))
    return keep


def write_events(df: DataFrame, path: str, ts: str = "occurred_at") -> None:
    """Append by day, names clustered inside a day so that file statistics prune.

    The range on (day, name, second) splits a hot day or a hot name over many tasks.
    """
    (df.withColumn("dt", F.to_date(ts))
     .repartitionByRange("dt", "name", ts).sortWithinPartitions("dt", "name", ts)
     .write.mode("append").partitionBy("dt").parquet(path))
