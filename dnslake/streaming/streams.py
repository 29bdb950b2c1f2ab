"""Micro-batch jobs.

A batch writes its own part of a table under ``batch_id=<n>`` and overwrites it when Spark runs the
batch again: a replay changes nothing.  Readers merge the parts; :func:`compact` folds them into a
new base version.  Events of any age are accepted, since a part may touch any hour.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from dnslake.operators.investigate import merge_resolutions, resolution_rollup
from dnslake.operators.rollup import (client_hours, domain_totals, hourly_from_clients,
                                      merge_client_hours, merge_domain_totals)
from dnslake.sources.events import wanted_types
from dnslake.sources.tables import path_exists, read_version, versions, write_version


def _write_part(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def merge_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Events of one micro-batch: the log, the hourly client rows and the per-name totals."""
    batch = batch.persist()
    try:
        _write_part(batch, f"{out}/events", batch_id)
        _write_part(client_hours(batch), f"{out}/hourly_parts", batch_id)
        _write_part(domain_totals(batch), f"{out}/domain_parts", batch_id)
    finally:
        batch.unpersist()


def merge_answers(batch: DataFrame, batch_id: int, out: str) -> None:
    _write_part(resolution_rollup(batch), f"{out}/resolution_parts", batch_id)


def _trigger(seconds: float | None) -> dict:
    return {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}


def start_event_stream(events: DataFrame, out: str, checkpoint: str,
                       every: float | None = None) -> StreamingQuery:
    """Start the event job; without an interval it drains what is there and stops."""
    observed = wanted_types(events).observe("events", F.count("*").alias("rows"))
    return (observed.writeStream.foreachBatch(lambda df, n: merge_batch(df, n, out))
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def start_answer_stream(answers: DataFrame, out: str, checkpoint: str,
                        every: float | None = None) -> StreamingQuery:
    """Start the answer job: its own query and checkpoint, so neither stream stalls the other."""
    return (answers.writeStream.foreachBatch(lambda df, n: merge_answers(df, n, out))
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def _parts(spark: SparkSession, root: str, above: int) -> DataFrame | None:
    if not path_exists(spark, root):
        return None
    return spark.read.parquet(root).where(F.col("batch_id") > above).drop("batch_id")


def _base(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """Newest base version and the last batch folded into it."""
    if not versions(spark, root):
        return None, -1
    base = read_version(spark, root)
    return base.drop("_upto"), base.agg(F.max("_upto")).first()[0]


def _read(spark: SparkSession, out: str, name: str, merge) -> DataFrame:
    base, upto = _base(spark, f"{out}/{name}_base")
    parts = _parts(spark, f"{out}/{name}_parts", upto)
    if parts is None:
        if base is None:
            raise FileNotFoundError(f"no {name} written under {out}")
        return base
    return merge(parts if base is None else base.unionByName(parts))


def read_client_hours(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, out, "hourly", merge_client_hours)


def read_hourly(spark: SparkSession, out: str) -> DataFrame:
    """Queries and exact distinct clients per (name, hour) over all batches so far."""
    return hourly_from_clients(read_client_hours(spark, out))


def read_domains(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, out, "domain", lambda df: merge_domain_totals(df, df.limit(0)))


def read_resolutions(spark: SparkSession, out: str, known: DataFrame | None = None) -> DataFrame:
    """Resolutions so far; with ``known (name)`` those of known names only."""
    rows = _read(spark, out, "resolution", lambda df: merge_resolutions(df, df.limit(0)))
    return rows if known is None else rows.join(known.select("name"), "name", "left_semi")


def compact(spark: SparkSession, out: str, name: str) -> int:
    """Fold all parts written so far into a new base version; returns the last batch in it.

    Run it between batches: parts above that number stay and are merged on reading.
    """
    last = spark.read.parquet(f"{out}/{name}_parts").agg(F.max("batch_id")).first()[0]
    reader = {"hourly": read_client_hours, "domain": read_domains,
              "resolution": read_resolutions}[name]
    write_version(reader(spark, out).withColumn("_upto", F.lit(last)), f"{out}/{name}_base")
    return last


def hourly_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Bounded-state variant: one-hour windows with a watermark; later events are lost.

    Distinct clients are approximate here; the exact ones come from the client rows of the batch form.
    """
    return (events.withWatermark("occurred_at", lateness)
            .groupBy(F.window("occurred_at", "1 hour"), "name")
            .agg(F.count("*").alias("query_count"),
                 F.approx_count_distinct("client_id").alias("client_count"))
            .select("name", F.col("window.start").alias("hour"), "query_count", "client_count"))


class Progress(StreamingQueryListener):
    """Rows and newest event time per finished batch; feeds the freshness alarm."""

    def __init__(self) -> None:
        self.rows = 0
        self.batches: list[int] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        self.batches.append(progress["batchId"])
        seen = progress.get("observedMetrics", {}).get("events")
        if seen:
            self.rows += seen["rows"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
