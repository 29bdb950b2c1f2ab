"""Roll-ups of the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslake.sources.tables import merge_latest


def client_ids(clients: DataFrame, known: DataFrame | None = None, client: str = "client",
               buckets: int = 1024) -> DataFrame:
    """Number clients with unique, nearly dense integers that never change.

    Each hash bucket numbers its own clients, the ids of the buckets interleave.  ``known``
    (client, client_id) keeps its numbers; only new clients are numbered, behind the old ones.
    """
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64(client), F.lit(buckets))
    new = clients.select(client).distinct()
    if known is not None:
        new = new.join(known.select(client), client, "left_anti")
        used = (known.groupBy(F.pmod("client_id", F.lit(buckets)).alias("_b"))
                .agg(F.max("client_id").alias("_top")))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(client)) - 1
    numbered = new.withColumn("_b", bucket).withColumn("_rank", rank)
    if known is None:
        return numbered.select(client, (F.col("_rank") * buckets + F.col("_b")).alias("client_id"))
    start = F.coalesce(F.floor(F.col("_top") / buckets) + 1, F.lit(0))
    fresh = numbered.join(used, "_b", "left").select(
        client, ((start + F.col("_rank")) * buckets + F.col("_b")).alias("client_id"))
    return known.select(client, "client_id").unionByName(fresh)


def client_hours(events: DataFrame, client: str = "client_id", unit: str = "hour") -> DataFrame:
    """Stored roll-up with the client set as rows: queries per (name, hour, client).

    A plain hash aggregation with map-side combine that spreads a hot name over its clients.  For
    sparse cells far smaller than bitmaps, which take 4 KiB each while they are built.
    """
    return events.groupBy("name", F.date_trunc(unit, "occurred_at").alias("hour"),
                          F.col(client).alias("client_id")).agg(F.count("*").alias("query_count"))


def merge_client_hours(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name", "hour", "client_id").agg(
        F.sum("query_count").alias("query_count"))


def hourly_from_clients(rows: DataFrame) -> DataFrame:
    """Queries and exact distinct clients per (name, hour) of merged client rows."""
    return rows.groupBy("name", "hour").agg(F.sum("query_count").alias("query_count"),
                                            F.count("client_id").alias("client_count"))


def hourly_cells(events: DataFrame, client: str = "client_id", unit: str = "hour") -> DataFrame:
    """Stored roll-up for dense cells: per (name, hour, client bucket) the query count and the client bitmap.

    A bucket is 64 clients and its bitmap one number, so that a sparse cell takes no more than its clients and rows
    keep one small size while they are aggregated by hash.  Sparse cells hardly combine, so what a task holds follows
    the events it reads; they are dealt evenly first, however large the row groups of the files are.
    """
    events = events.repartition(F.xxhash64("name", "occurred_at", client))
    number = F.col(client).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    return events.groupBy("name", F.date_trunc(unit, "occurred_at").alias("hour"),
                          F.shiftright(number, 6).alias("bucket")).agg(
        F.count("*").alias("query_count"), _union_of(bit).alias("clients"))


def _union_of(bitmaps: Column) -> Column:
    return F.coalesce(F.bit_or(bitmaps), F.lit(0).cast("long"))


def merge_rollups(*cells: DataFrame) -> DataFrame:
    """Merge stored roll-ups: counts add up, bitmaps are OR-ed.  Order does not matter."""
    both = cells[0]
    for other in cells[1:]:
        both = both.unionByName(other)
    return both.groupBy("name", "hour", "bucket").agg(
        F.sum("query_count").alias("query_count"), _union_of(F.col("clients")).alias("clients"))


def hourly_from_cells(cells: DataFrame) -> DataFrame:
    """Queries and exact distinct clients per (name, hour)."""
    return cells.groupBy("name", "hour").agg(
        F.sum("query_count").alias("query_count"),
        F.sum(F.bit_count("clients")).alias("client_count"))


def hourly_rollup(events: DataFrame, client: str = "client_id", unit: str = "hour") -> DataFrame:
    """The same result straight from events, in two combinable steps."""
    return hourly_from_clients(client_hours(events, client, unit))


def peak_clients(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("name").agg(F.max("client_count").alias("client_count"))


def distinct_clients(cells: DataFrame) -> DataFrame:
    """Exact distinct clients per name over all hours, by OR-ing the bitmaps."""
    return (cells.groupBy("name", "bucket").agg(_union_of(F.col("clients")).alias("clients"))
            .groupBy("name").agg(F.sum(F.bit_count("clients")).alias("clients")))


def domain_totals(events: DataFrame) -> DataFrame:
    """Totals per name.  The root depends on the name, so it is a key: strings among the aggregated
    values would force a sort-based aggregation of the log."""
    return events.groupBy("name", "etld1").agg(
        F.count("*").alias("query_count"),
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))


def new_domains(events: DataFrame, known: DataFrame) -> DataFrame:
    """Names of the log that are not in the dimension yet, with the defaults of a new row."""
    return (domain_totals(events).join(known.select("name"), "name", "left_anti")
            .withColumn("status", F.lit("new")).withColumn("origin", F.lit("discovered"))
            .withColumn("is_manual", F.lit(False)))


def merge_domain_totals(base: DataFrame, delta: DataFrame) -> DataFrame:
    return merge_latest(base, delta, ["name"], {
        "etld1": "keep", "query_count": "sum", "first_seen": "min", "last_seen": "max"})


def client_totals(events: DataFrame, client: str = "client_id") -> DataFrame:
    return events.groupBy(client).agg(
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))


def with_ids(df: DataFrame, dim: DataFrame, key: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the id of their key, and the keys the dimension does not know."""
    known = df.join(dim.select(key, id_col), key)
    unknown = df.select(key).distinct().join(dim.select(key), key, "left_anti")
    return known, unknown


def star(events: DataFrame, domains: DataFrame, clients: DataFrame,
         client: str = "client_id") -> DataFrame:
    """Events with their domain and client columns; AQE broadcasts whatever is small enough."""
    return events.drop("etld1").join(domains, "name").join(clients, client)
