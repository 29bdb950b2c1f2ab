"""Numbers for reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslake.operators.rollup import client_totals
from dnslake.sources.events import between, cutoff


def hours_with_status(hourly: DataFrame, domains: DataFrame, from_: str, to: str) -> DataFrame:
    """Roll-up rows of the range beside the status and category of their name.

    Rows are summed per (name, hour) already, so a hot name holds one row per hour.
    """
    return (between(hourly, from_, to, "hour")
            .join(domains.select("name", "status", "category"), "name"))


def _blocked(column: str = "query_count"):
    return F.sum(F.when(F.col("status") == "blocked", F.col(column)).otherwise(0))


def overview(hourly: DataFrame, domains: DataFrame, from_: str, to: str) -> DataFrame:
    """Queries, blocked queries and their ratio, names seen."""
    # One row per name first: the distinct count then is a plain count.
    per_name = (between(hourly, from_, to, "hour").groupBy("name")
                .agg(F.sum("query_count").alias("query_count"))
                .join(domains.select("name", "status"), "name"))
    totals = per_name.agg(F.coalesce(F.sum("query_count"), F.lit(0)).alias("total_queries"),
                          F.coalesce(_blocked(), F.lit(0)).alias("blocked_queries"),
                          F.count("*").alias("unique_domains"))
    return totals.withColumn("blocked_ratio", F.coalesce(
        F.try_divide("blocked_queries", "total_queries"), F.lit(0.0)))


def counters(events: DataFrame, domains: DataFrame, requests: DataFrame, from_: str) -> DataFrame:
    """Active clients since ``from_``, names in staging, open requests (one row).

    Active clients are bounded by the start only.
    """
    since = F.lit(from_).cast("timestamp")
    active = client_totals(events).where(F.col("last_seen") >= since).agg(
        F.count("*").alias("active_clients"))
    staging = domains.agg(F.count_if(F.col("status") == "staging"))
    pending = requests.agg(F.count_if(F.col("state") == "pending"))
    return active.select("active_clients", staging.scalar().alias("pending_review"),
                         pending.scalar().alias("unblock_requests"))


def by_category(hourly: DataFrame, domains: DataFrame, from_: str, to: str,
                k: int = 20) -> DataFrame:
    return (hours_with_status(hourly, domains, from_, to).where(F.col("category").isNotNull())
            .groupBy("category").agg(F.sum("query_count").alias("queries"))
            .orderBy(F.desc("queries"), "category").limit(k))


def timeseries(hourly: DataFrame, domains: DataFrame, from_: str, to: str) -> DataFrame:
    return (hours_with_status(hourly, domains, from_, to).groupBy("hour")
            .agg(F.sum("query_count").alias("queries"), _blocked().alias("blocked")))


def top(dimension: str, events: DataFrame, hourly: DataFrame, domains: DataFrame, from_: str,
        to: str, k: int = 20) -> DataFrame:
    """Busiest names, blocked names or clients of a range."""
    if dimension in ("client", "clients"):
        return (between(events, from_, to).groupBy(F.col("client_id").alias("key"))
                .agg(F.count("*").alias("queries")).orderBy(F.desc("queries"), "key").limit(k))
    sums = (between(hourly, from_, to, "hour").groupBy("name")
            .agg(F.sum("query_count").alias("queries")))
    rows = sums.join(domains.select("name", "status", "category"), "name")
    if dimension == "blocked":
        rows = rows.where(F.col("status") == "blocked")
    return (rows.select(F.col("name").alias("key"), "queries", "status", "category")
            .orderBy(F.desc("queries"), "key").limit(k))


def timeline(hourly: DataFrame, name: str, from_: str, to: str) -> DataFrame:
    return (between(hourly, from_, to, "hour").where(F.col("name") == name)
            .select("hour", "query_count", "client_count").orderBy("hour"))


def clients_of(events: DataFrame, name: str, from_: str, to: str, k: int = 50) -> DataFrame:
    return (between(events, from_, to).where(F.col("name") == name).groupBy("client_id")
            .agg(F.count("*").alias("queries")).orderBy(F.desc("queries"), "client_id").limit(k))


def count_by_status(domains: DataFrame) -> DataFrame:
    return domains.groupBy("status").agg(F.count("*").alias("n"))


def event_age(events: DataFrame, as_of: str) -> DataFrame:
    """Seconds since the newest event, -1 for an empty log."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.max("occurred_at"))
    return events.agg(F.coalesce(age, F.lit(-1)).alias("age_seconds"))


def freshness_alarm(events: DataFrame, as_of: str, limit: int = 600) -> DataFrame:
    return event_age(events, as_of).withColumn(
        "stale", (F.col("age_seconds") < 0) | (F.col("age_seconds") > limit))


def bucket_seconds(span: timedelta) -> int:
    """Width of a metric bucket for a span (one minute of tolerance)."""
    for hours, width in ((12, 60), (48, 300), (7 * 24, 900)):
        if span - timedelta(minutes=1) <= timedelta(hours=hours):
            return width
    return 3600


def metric_buckets(metrics: DataFrame, bucket: int, from_: str, to: str, columns: list[str],
                   at: str = "at") -> DataFrame:
    start = F.timestamp_seconds(F.floor(F.unix_seconds(at) / bucket) * bucket)
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "avg"), (F.max, "max"))]
    return between(metrics, from_, to, at).groupBy(start.alias("bucket")).agg(*aggs)


def metric_summary(metrics: DataFrame, from_: str, to: str, columns: list[str],
                   at: str = "at") -> DataFrame:
    aggs = [F.coalesce(f(c), F.lit(0.0)).alias(f"{c}_{n}")
            for c in columns for f, n in ((F.avg, "avg"), (F.max, "max"))]
    return between(metrics, from_, to, at).agg(
        F.count("*").alias("samples"), *aggs, F.min(at).alias("oldest"))


def call_usage(calls: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Model calls of the last days: requests, names, verdicts, failures, characters."""
    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0))

    return calls.where(F.col("created_at") >= cutoff(as_of, days)).agg(
        F.count("*").alias("requests"), total("domain_count").alias("domains"),
        total("parsed_count").alias("verdicts"),
        F.count_if(F.col("error") != "").alias("failed"),
        total("prompt_chars").alias("prompt_chars"), total("reply_chars").alias("reply_chars"),
        F.max("created_at").alias("last_at"))


def list_calls(calls: DataFrame, kind: str | None = None, k: int = 50,
               offset: int = 0) -> DataFrame:
    rows = calls.where(F.col("kind") == kind) if kind else calls
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(k)


def calls_by_kind(calls: DataFrame) -> DataFrame:
    return calls.groupBy("kind").agg(F.count("*").alias("n"))


def categories_report(categories: DataFrame, domains: DataFrame,
                      published: DataFrame) -> DataFrame:
    """Names, blocked names and published entries per category."""
    counts = domains.groupBy("category").agg(
        F.count("*").alias("domain_count"),
        F.count_if(F.col("status") == "blocked").alias("blocked_count"))
    return (categories.withColumnRenamed("key", "category").join(counts, "category", "left")
            .join(published.select(F.col("list_key").alias("category"),
                                   F.col("entry_count").alias("published_count")),
                  "category", "left")
            .fillna(0, ["domain_count", "blocked_count", "published_count"]))
