"""Published lists: content, guards, snapshots, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.operators.windows import first_n, latest_per


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(refdata.CATEGORY_ROWS),
        "key string, enabled boolean, threshold double, publish_path string, sort_order int")


def lists(domains: DataFrame, categories: DataFrame) -> DataFrame:
    """``(list_key, domain)``: one list per enabled category, ``all`` of them, and ``blocked``.

    ``blocked`` takes every blocked name, whatever its category.
    """
    on = categories.where("enabled").select(F.col("key").alias("category"))
    named = domains.where(F.col("status") == "blocked").select("name", "category")
    rows = named.join(on.withColumn("_on", F.lit(True)), "category", "left")
    keys = F.array_compact(F.array(
        F.when(F.col("_on"), F.col("category")), F.when(F.col("_on"), F.lit("all")),
        F.lit("blocked")))
    return rows.select(F.explode(keys).alias("list_key"), F.col("name").alias("domain"))


def files_of(domains: DataFrame, categories: DataFrame) -> DataFrame:
    """Files in which each blocked name appears."""
    info = categories.select(F.col("key").alias("category"), "enabled", "publish_path")
    rows = domains.where(F.col("status") == "blocked").join(info, "category", "left")
    return rows.select("name", F.array_compact(F.array(
        F.when(F.col("enabled"), F.col("publish_path")), F.when(F.col("enabled"), F.lit("all.txt")),
        F.lit("blocked.txt"))).alias("files"))


def list_fingerprint(entries: DataFrame, sink: str = refdata.SINK_ADDRESS) -> DataFrame:
    """Order-free fingerprint per list: count, and sum and XOR of the hashes of its names.

    The sink address goes into every hash, so another sink is another content.
    """
    h = F.xxhash64(F.lit(sink), F.col("domain"))
    return entries.groupBy("list_key").agg(
        F.count("*").alias("entry_count"),
        F.sum(h.cast("decimal(38,0)")).alias("_sum"), F.bit_xor(h).alias("_xor")
    ).select("list_key", "entry_count", F.concat_ws(
        ":", F.lit("fp"), F.col("entry_count").cast("string"), F.col("_sum").cast("string"),
        F.col("_xor").cast("string")).alias("checksum"))


def list_checksum(entries: DataFrame, sink: str = refdata.SINK_ADDRESS) -> DataFrame:
    """SHA-256 of every list, by the same rule at any size.

    Names are dealt over ``256`` shares by their own hash; a share is hashed in order, then the
    hashes of the shares.  No list is gathered whole, and another sink is another content.
    """
    share = F.substring(F.sha2("domain", 256), 1, 2)
    body = F.array_join(F.array_sort(F.collect_list("domain")), "\0")
    parts = (entries.groupBy("list_key", share.alias("_share"))
             .agg(F.count("*").alias("_n"), F.sha2(body, 256).alias("_sum")))
    whole = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_share", "_sum"))),
        lambda p: F.concat(p["_share"], F.lit(":"), p["_sum"])), ",")
    return parts.groupBy("list_key").agg(
        F.sum("_n").alias("entry_count"),
        F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(sink), F.lit("\0"), whole), 256)).alias("checksum"))


def last_snapshots(snapshots: DataFrame) -> DataFrame:
    return latest_per(snapshots, ["list_key"], ["published_at", "id"])


def publish(entries: DataFrame, snapshots: DataFrame, as_of: str, actor: str = "system",
            min_ratio: float = refdata.MIN_PUBLISH_RATIO, sink: str = refdata.SINK_ADDRESS,
            keys: DataFrame | None = None) -> DataFrame:
    """Plan of a publication: per list ``published``, ``unchanged`` or ``refused``.

    A list that shrinks under the ratio of its last snapshot is refused, the others go on.
    ``keys (list_key)`` names lists that may be empty now.
    """
    now = list_fingerprint(entries, sink)
    if keys is not None:
        empty = F.concat_ws(":", F.lit("fp"), F.lit("0"))
        now = (keys.join(now, "list_key", "left")
               .withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
               .withColumn("checksum", F.coalesce("checksum", empty)))
    last = last_snapshots(snapshots).select(
        "list_key", F.col("entry_count").alias("prev_count"),
        F.col("checksum").alias("prev_checksum"))
    rows = now.join(last, "list_key", "left")
    shrunk = (F.col("prev_count") > 0) & (
        F.try_divide("entry_count", "prev_count") < F.lit(min_ratio))
    status = (F.when(shrunk, "refused")
              .when(F.col("checksum") == F.col("prev_checksum"), "unchanged")
              .otherwise("published"))
    return rows.select("list_key", "entry_count",
                       F.coalesce("prev_count", F.lit(0)).alias("prev_count"), "checksum",
                       status.alias("status"), F.lit(as_of).cast("timestamp").alias("published_at"),
                       F.lit(actor).alias("published_by"))


def new_snapshots(plan: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshot rows of the lists to publish; ids go on behind the greatest one.

    One row per list (a dozen), so numbering them is one small task.
    """
    top = snapshots.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rank = F.row_number().over(Window.orderBy("list_key"))
    return (plan.where(F.col("status") == "published").withColumn("_rank", rank)
            .withColumn("id", (top + F.col("_rank")).cast("long"))
            .select("id", "list_key", "entry_count", "checksum", "published_at", "published_by"))


def snapshot_entries(new: DataFrame, entries: DataFrame) -> DataFrame:
    return (entries.join(new.select("list_key", "id"), "list_key")
            .select(F.col("id").alias("snapshot_id"), "domain").distinct())


def diff_snapshots(entries: DataFrame, a: int, b: int) -> DataFrame:
    """``(domain, change)`` from snapshot ``a`` to ``b``: one aggregation instead of two joins."""
    sides = entries.where(F.col("snapshot_id").isin(a, b)).groupBy("domain").agg(
        F.bool_or(F.col("snapshot_id") == a).alias("_a"),
        F.bool_or(F.col("snapshot_id") == b).alias("_b"))
    return sides.where(F.col("_a") != F.col("_b")).select(
        "domain", F.when(F.col("_b"), "added").otherwise("removed").alias("change"))


def rollback(snapshots: DataFrame, entries: DataFrame, snapshot_id: int, as_of: str,
             actor: str) -> tuple[DataFrame, DataFrame]:
    """A new snapshot with the content of an old one: (snapshot row, its entries)."""
    new_id = snapshots.agg(F.max("id") + 1).scalar()
    row = (snapshots.where(F.col("id") == snapshot_id)
           .select(new_id.alias("id"), "list_key", "entry_count", "checksum",
                   F.lit(as_of).cast("timestamp").alias("published_at"),
                   F.lit(f"{actor} (rollback of #{snapshot_id})").alias("published_by")))
    copied = (entries.where(F.col("snapshot_id") == snapshot_id)
              .select(new_id.alias("snapshot_id"), "domain"))
    return row, copied


def prune(snapshots: DataFrame, entries: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Keep the newest snapshots per list, with their entries."""
    kept = first_n(snapshots, ["list_key"], [F.desc("published_at"), F.desc("id")], keep)
    ids = kept.select(F.col("id").alias("snapshot_id"))
    return kept, entries.join(ids, "snapshot_id", "left_semi")


def hosts_lines(entries: DataFrame, sink: str = refdata.SINK_ADDRESS) -> DataFrame:
    return entries.select("list_key", "domain", F.concat_ws(" ", F.lit(sink), F.col("domain"))
                          .alias("line"))


def publish_lists(entries: DataFrame, out: str, as_of: str, sink: str = refdata.SINK_ADDRESS,
                  rows_per_file: int = 1_000_000) -> None:
    """Write hosts files, one folder per list, header first, names in order.

    The lists are range-partitioned by (list, name): parts of a long list, read in part order, are
    the list.  No task writes more than its range, no file more than ``rows_per_file`` lines.
    """
    counts = entries.groupBy("list_key").agg(F.count("*").alias("n"))
    header = counts.select("list_key", F.lit("").alias("domain"), F.concat(
        F.lit("# "), F.col("list_key"), F.lit("\n# "), F.col("n").cast("string"),
        F.lit(f" domain · {as_of}\n# sink: {sink}")).alias("line"))
    (hosts_lines(entries, sink).unionByName(header)
     .repartitionByRange("list_key", "domain").sortWithinPartitions("list_key", "domain")
     .select("list_key", "line").write.mode("errorifexists")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("list_key").text(out))
