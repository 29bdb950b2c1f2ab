"""How a name shows up in the log: after other names, or at regular intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslake.operators.windows import gaps


def preceded_within(df: DataFrame, key: str, other: str, ts: str, gap: int,
                    cell_seconds: int | None = None) -> DataFrame:
    """Add ``preceded``: did the same ``key`` have a row with another ``other`` value in an
    earlier second, at most ``gap`` seconds before?

    The interval EXISTS needs only the least and greatest ``other`` value of the seconds before,
    a RANGE window.  Time is cut into cells and the last ``gap`` seconds of a cell are copied into
    the next as context, so that one busy key spreads over many tasks.
    """
    cell = cell_seconds or 20 * gap
    own = F.floor(F.col("_s") / cell)
    late = F.pmod(F.col("_s"), F.lit(cell)) >= cell - gap
    rows = (df.withColumn("_s", F.unix_seconds(ts)).withColumn("_own", own)
            .withColumn("_cell", F.explode(
                F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))))
    before = Window.partitionBy(key, "_cell").orderBy("_s").rangeBetween(-gap, -1)
    preceded = F.coalesce((F.col("_lo") != F.col(other)) | (F.col("_hi") != F.col(other)),
                          F.lit(False))
    return (rows.withColumn("_lo", F.min(other).over(before))
            .withColumn("_hi", F.max(other).over(before))
            .where(F.col("_cell") == F.col("_own"))
            .withColumn("preceded", preceded).drop("_s", "_own", "_cell", "_lo", "_hi"))


def per_second(events: DataFrame, client: str = "client_id") -> DataFrame:
    """Queries per (client, name, second): what both measures below start from."""
    return (events.groupBy(client, "name", "etld1",
                           F.date_trunc("second", "occurred_at").alias("occurred_at"))
            .agg(F.count("*").alias("_n")))


def third_party_ratio(events: DataFrame, gap: int = 3, min_total: int = 5,
                      client: str = "client_id") -> DataFrame:
    """Share of a name's queries that follow a query to another registrable name.

    Equal queries of one second are counted first, so repeated names shrink early.
    """
    flagged = preceded_within(per_second(events, client), client, "etld1", "occurred_at", gap)
    return (flagged.groupBy("name").agg(
        F.sum("_n").alias("sample_size"),
        F.sum(F.when(F.col("preceded"), F.col("_n")).otherwise(0)).alias("third_party"))
        .where(F.col("sample_size") >= min_total)
        .withColumn("third_party_ratio", F.col("third_party") / F.col("sample_size")))


def interval_cv(events: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Population deviation over mean of the positive gaps between a name's events.

    0 with fewer than three events or two gaps.  With the client among the keys, regularity is
    judged per client.
    """
    rows = events.select(*keys, F.date_trunc("second", "occurred_at").alias("occurred_at"),
                         F.lit(1).alias("_n"))
    return _regularity(rows, list(keys))


def _regularity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events of one second are equal in time, so they stay one row with a count; gaps run inside
    time cells of a key, and their sums combine before the shuffle."""
    seconds = rows.groupBy(*keys, F.date_trunc("second", "occurred_at").alias("_at")).agg(
        F.sum("_n").alias("_n"))
    stats = gaps(seconds, keys, "_at").groupBy(*keys).agg(
        F.sum("_n").alias("_events"), F.count("gap").alias("_gaps"),
        F.avg("gap").alias("_mean"), F.stddev_pop("gap").alias("_std"))
    enough = (F.col("_events") >= 3) & (F.col("_gaps") >= 2)
    return stats.select(*keys, F.when(enough, F.col("_std") / F.col("_mean"))
                        .otherwise(F.lit(0.0)).alias("interval_cv"))


def behavior(events: DataFrame, gap: int = 3, min_total: int = 5,
             client: str = "client_id") -> DataFrame:
    """Behaviour table: ratio, regularity and sample size per name.

    Both measures read the counted log, whose shuffle Spark reuses: the log is scanned once.
    """
    regular = _regularity(per_second(events, client), ["name"])
    return (third_party_ratio(events, gap, min_total, client).join(regular, "name", "left")
            .select("name", "third_party_ratio",
                    F.coalesce("interval_cv", F.lit(0.0)).alias("interval_cv"), "sample_size"))
