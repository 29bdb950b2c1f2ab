"""Per-key order operators that do not depend on one key fitting one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslake.operators.joins import with_hot
from dnslake.session import cut_lineage


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
            shares: int = 1024) -> DataFrame:
    """First ``n`` rows of every key in the given (total) order, exactly, however hot a key is.

    Every input partition keeps its own first ``n`` of a key (Spark cuts them before the shuffle),
    then every one of ``shares`` groups of partitions, then the key: the last step sees at most
    ``shares * n`` rows of it.
    """
    rows = df.withColumn("_share", F.spark_partition_id())
    for share in (F.col("_share"), F.col("_share") % shares, F.lit(0)):
        window = Window.partitionBy(*keys, "_share").orderBy(*order)
        rows = (rows.withColumn("_share", share).withColumn("_rn", F.row_number().over(window))
                .where(F.col("_rn") <= n))
    return rows.drop("_share", "_rn")


def gaps(df: DataFrame, key: str | list[str], ts: str, cell_seconds: int = 3600,
         rows_per_cell: int = 1_000_000) -> DataFrame:
    """Add ``gap``: seconds since the previous row of the same key (null for its first row).

    ``lag`` runs inside (key, time cell); the first row of a cell takes the last time of the
    previous non-empty cell from a summary that has one row per cell.  Cells with more rows than ``rows_per_cell`` are
    cut into finer ones; their rows learn that under a salt, so no task meets the whole of a busy cell.
    """
    keys = [key] if isinstance(key, str) else key
    sec = F.unix_micros(ts) / F.lit(1_000_000)
    cell = F.floor(F.unix_seconds(ts) / cell_seconds)
    rows = df.withColumn("_s", sec).withColumn("_cell", cell)
    busy = (rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_cell)
            .select(*keys, "_cell", F.ceil(F.col("_n") / rows_per_cell).alias("_parts")))
    part = F.lit(0).cast("long")
    if not busy.isEmpty():
        rows = with_hot(rows, busy, [*keys, "_cell"])
        part = F.floor((F.col("_s") - F.col("_cell") * cell_seconds) * F.coalesce("_parts", F.lit(1)) / cell_seconds)
    rows = rows.withColumn("_part", part).drop("_parts")
    cells = [*keys, "_cell", "_part"]
    inside = F.lag("_s").over(Window.partitionBy(*cells).orderBy("_s"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cell", "_part"))
    summary = rows.groupBy(*cells).agg(F.max("_s").alias("_last")).withColumn("_before", before).drop("_last")
    return (rows.withColumn("_in", inside).join(summary, cells, "left")
            .withColumn("gap", F.col("_s") - F.coalesce("_in", "_before"))
            .drop("_s", "_cell", "_part", "_in", "_before"))


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple per key, as a combinable aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def with_group_count(df: DataFrame, key: str, out: str = "group_count") -> DataFrame:
    """Number of rows sharing the key, next to each row.

    Counted with map-side combine and joined back, so a hot key is never gathered in one task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias(out))
    return df.join(counts, key, "left")


def prune_snapshots(df: DataFrame, keep: int) -> DataFrame:
    """Newest ``keep`` snapshots per list."""
    return first_n(df, ["list_key"], [F.desc("published_at"), F.desc("id")], keep)


def number_batches(df: DataFrame, order: list[Column], size: int = 40,
                   limit: int | None = None) -> DataFrame:
    """Position of every row in the given order, and its batch; of the first ``limit`` rows if set.

    Rows are sorted by range and written; a partition's first position follows from the sizes of
    those before it, so only one number per partition meets in one task.
    """
    rows = df.orderBy(*order)
    if limit is not None:
        rows = rows.limit(limit)
    # The id's upper bits number the partition in sort order, its lower bits the row in it.
    rows = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_part").agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (rows.join(starts, "_part")
            .withColumn("position", F.col("_before") + F.col("_at") + 1)
            .withColumn("batch", F.floor((F.col("position") - 1) / size))
            .drop("_id", "_part", "_at", "_before"))
