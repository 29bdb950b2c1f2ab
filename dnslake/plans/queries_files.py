"""Queries through written tables: event folders, list replacement, the decision log, thresholds and clipped texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslake.functions import names as N
from dnslake.plans import adapters as A
from dnslake.plans import rules
from dnslake.plans.registry import EV, query, sec
from dnslake.session import work_path
from dnslake.sources import events as event_files
from dnslake.sources import lists, tables


@query(f"""WITH {EV} SELECT name, count(*) AS n, CAST(epoch(min(occurred_at)) AS BIGINT) AS first FROM dns_events
WHERE occurred_at BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-12 06:00:00' GROUP BY 1""")
def event_folders(spark, sf):
    """The log written by day and read back for a range of time."""
    path = work_path(spark, "events")
    event_files.write_events(A.events(spark, sf).select("name", "etld1", "client_id", "qtype", "occurred_at"), path)
    log = event_files.read_events(spark, path, from_="2024-01-05 12:00:00", to="2024-01-12 06:00:00")
    return log.groupBy("name").agg(F.count("*").alias("n"), F.min("occurred_at").alias("first")).select("name", "n", sec("first"))


@query("""SELECT source_id, count(*) AS n, min(domain) AS first, max(domain) AS last FROM (
SELECT DISTINCT CAST(p_size % 8 AS BIGINT) AS source_id, CASE WHEN p_size % 8 % 2 = 1 THEN 'new.' ELSE '' END ||
p_brand || '/' || p_type || '/' || (p_partkey % 40) AS domain FROM part) GROUP BY 1""")
def replaced_lists(spark, sf):
    """Every second source of the stored list table replaced by a new version; the others stay."""
    path = work_path(spark, "lists")
    every = A.list_entries(spark, sf)
    lists.replace_entries(every, path)
    lists.replace_entries(every.where("source_id % 2 = 1").withColumn("domain", F.concat(F.lit("new."), "domain")), path,
                          spark.read.parquet(path))
    now = spark.read.schema("domain string, source_id long").parquet(path)
    return now.groupBy("source_id").agg(F.count("*").alias("n"), F.min("domain").alias("first"), F.max("domain").alias("last"))


@query("""SELECT o_orderpriority AS actor, CAST(epoch(date_trunc('year', o_orderdate)) AS BIGINT) AS day, count(*) AS n
FROM orders GROUP BY 1, 2""")
def decision_log_appended(spark, sf):
    """The audit log grows by two appends, then is read by day (decisions are made once a year here)."""
    path = work_path(spark, "decisions")
    o = A.table(spark, sf, "orders")
    for odd in (0, 1):
        tables.append_decisions(o.where(F.col("o_orderkey") % 2 == odd).select(
            F.col("o_custkey").cast("string").alias("name"), F.lit("block").alias("action"),
            F.col("o_orderpriority").alias("actor"), F.date_trunc("year", "o_orderdate").alias("created_at")), path)
    return spark.read.parquet(path).groupBy("actor", F.unix_seconds(F.col("dt").cast("timestamp")).alias("day")).agg(
        F.count("*").alias("n"))


@query("""SELECT 'limit' || p_partkey AS key, CAST(CASE WHEN p_partkey % 3 = 0 OR p_size % 5 = 0 THEN p_partkey % 100
ELSE p_size END AS BIGINT) AS value FROM part""")
def overridden_thresholds(spark, sf):
    """Thresholds with additions for two thirds of the keys, some of them 0, which means not set."""
    p = A.table(spark, sf, "part")
    key = F.concat(F.lit("limit"), F.col("p_partkey").cast("string")).alias("key")
    custom = p.where("p_partkey % 3 <> 0").select(key, F.when(F.col("p_size") % 5 == 0, 0).otherwise(
        F.col("p_size")).cast("long").alias("value"))
    return rules.override_thresholds(p.select(key, (F.col("p_partkey") % 100).cast("long").alias("value")), custom)


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS shown,
coalesce(length(text) > 120, false) AS cut FROM documents""")
def clipped_texts(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", N.clip("text", 120).alias("shown"),
                    F.coalesce(F.length("text") > 120, F.lit(False)).alias("cut"))
