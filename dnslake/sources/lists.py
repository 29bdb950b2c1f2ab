"""Public lists: names, ranks, network ranges, threat lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions import names, nets


class EmptyTable(ValueError):
    """A reference table without a single readable row must not replace the old one."""


def _require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyTable(f"{what} has no readable row")
    return df


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blocklist_name(line: Column | str, fmt: str) -> Column:
    """Name on one line of a list in ``hosts``, ``adblock`` or ``plain`` form; null if none."""
    if fmt not in refdata.LIST_FORMATS:
        raise ValueError(f"unknown list format {fmt!r}")
    line = _stripped(F.col(line) if isinstance(line, str) else line)
    if fmt == "adblock":
        field = F.when(line.startswith("||"), F.regexp_extract(line, r"^\|\|([^^$/]*)", 1))
    elif fmt == "plain":
        field = F.regexp_extract(line, r"^[^ \t#]*", 0)
    else:
        fields = F.split(_stripped(F.regexp_extract(line, r"^[^#]*", 0)), r"\s+")
        field = F.when(F.size(fields) >= 2, F.get(fields, F.lit(1))).otherwise(F.get(fields, F.lit(0)))
    name = F.regexp_replace(F.lower(_stripped(field)), r"\.$", "")
    usable = ((line != "") & ~line.startswith("#") & ~line.startswith("!")
              & names.valid_domain(name) & ~name.isin(refdata.LOOPBACK_NAMES))
    return F.when(usable, name)


def parse_blocklist(lines: DataFrame, fmt: str, source_id: int) -> DataFrame:
    """Distinct ``(source_id, domain)`` of a frame with a text column ``value``."""
    return (lines.select(blocklist_name("value", fmt).alias("domain"))
            .where(F.col("domain").isNotNull()).distinct()
            .select(F.lit(source_id).alias("source_id"), "domain"))


def read_blocklist(spark: SparkSession, path: str, fmt: str, source_id: int) -> DataFrame:
    return parse_blocklist(spark.read.text(path), fmt, source_id)


def replace_entries(new: DataFrame, path: str, prev: DataFrame | None = None) -> DataFrame:
    """Overwrite the partitions of the sources in ``new``; return previous and new counts."""
    (new.repartitionByRange("source_id", "domain")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source_id").parquet(path))
    counts = new.groupBy("source_id").agg(F.count("*").alias("new_count"))
    if prev is None:
        return counts.withColumn("prev_count", F.lit(0).cast("long"))
    old = prev.groupBy("source_id").agg(F.count("*").alias("prev_count"))
    return counts.join(old, "source_id", "left").fillna(0, ["prev_count"])


def guard_drop(new: DataFrame, previous: DataFrame,
               min_ratio: float = refdata.MIN_SYNC_RATIO) -> DataFrame:
    """Status per source: ``suspicious_drop`` when new / previous is under the ratio, else ``ok``."""
    a = new.groupBy("source_id").agg(F.count("*").alias("new_count"))
    b = previous.groupBy("source_id").agg(F.count("*").alias("prev_count"))
    joined = b.join(a, "source_id", "full").fillna(0, ["new_count", "prev_count"])
    ratio = F.try_divide("new_count", "prev_count")
    return joined.withColumn(
        "status",
        F.when((F.col("prev_count") > 0) & (ratio < min_ratio), "suspicious_drop").otherwise("ok"))


def sync_entries(new: DataFrame, previous: DataFrame,
                 min_ratio: float = refdata.MIN_SYNC_RATIO) -> DataFrame:
    """Entries after a guarded sync: sources with a suspicious drop keep their old entries."""
    held = (guard_drop(new, previous, min_ratio).where(F.col("status") != "ok")
            .select("source_id"))
    seen = new.select("source_id").distinct()
    fresh = new.join(held, "source_id", "left_anti")
    kept = previous.join(held, "source_id", "left_semi")
    untouched = (previous.join(seen, "source_id", "left_anti")
                 .join(held, "source_id", "left_anti"))
    return fresh.unionByName(kept).unionByName(untouched)


def parse_ip_ranges(lines: DataFrame, allow_v6: bool = True) -> DataFrame:
    """Tab-separated ``start end asn country org`` lines to key ranges."""
    f = F.split("value", "\t")
    parsed = lines.where(F.size(f) >= 5).select(
        nets.ip_key(F.get(f, F.lit(0)), allow_v6).alias("start_key"),
        nets.ip_key(F.get(f, F.lit(1)), allow_v6).alias("end_key"),
        F.get(f, F.lit(2)).try_cast("long").alias("asn"),
        F.get(f, F.lit(3)).alias("country"), F.get(f, F.lit(4)).alias("org"))
    return parsed.where(
        F.col("start_key").isNotNull() & F.col("end_key").isNotNull() & (F.col("asn") != 0))


def read_ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    return _require_rows(parse_ip_ranges(spark.read.text(path)), "range table")


def parse_rank(lines: DataFrame, cutoff: int | None = None) -> DataFrame:
    """``rank,domain`` lines, best rank per name; all ranks, or those up to the cutoff."""
    f = F.split("value", ",")
    rows = lines.select(
        _stripped(F.get(f, F.lit(0))).try_cast("long").alias("rank"),
        F.lower(F.regexp_replace(_stripped(F.get(f, F.lit(1))), r'^"|"$', "")).alias("domain"))
    kept = rows.where((F.col("rank") >= 1) & F.col("domain").isNotNull())
    if cutoff is not None:
        kept = kept.where(F.col("rank") <= cutoff)
    return kept.groupBy("domain").agg(F.min("rank").alias("rank"))


def check_rank(ranks: DataFrame) -> DataFrame:
    """The ranks, if any of the well-known names is among them."""
    if ranks.where(F.col("domain").isin(list(refdata.RANK_SENTINELS))).isEmpty():
        raise EmptyTable("rank list holds none of the well-known names")
    return ranks


def read_rank(spark: SparkSession, path: str, cutoff: int | None = None) -> DataFrame:
    return check_rank(parse_rank(spark.read.text(path), cutoff))


def _wide_enough(p: Column) -> Column:
    v4 = nets.is_v4(p["key"]) & (p["bits"] >= 96)
    return F.when(v4, p["bits"] >= 104).otherwise(p["bits"] >= 19)


def _prefixes(fields: DataFrame, source: str, priority: int, allow_v6: bool) -> DataFrame:
    usable = F.filter(F.array(nets.parse_prefix("field", allow_v6)),
                      lambda p: p.isNotNull() & _wide_enough(p))
    return (fields.select(F.explode(usable).alias("_p"))
            .select(F.col("_p.key").alias("net_key"), F.col("_p.bits").alias("bits")).distinct()
            .withColumn("source", F.lit(source)).withColumn("priority", F.lit(priority)))


def parse_cidr_list(lines: DataFrame, source: str, priority: int = 0,
                    allow_v6: bool = True) -> DataFrame:
    """One address or network per line, ``#`` and ``;`` comments; too wide networks rejected."""
    body = _stripped(F.regexp_extract("value", r"^[^#;]*", 0))
    return _prefixes(lines.select(F.substring_index(body, " ", 1).alias("field")),
                     source, priority, allow_v6)


def strip_port(value: Column) -> Column:
    bracketed = F.regexp_extract(value, r"^\[([^\]]*)", 1)
    one_colon = F.length(value) - F.length(F.replace(value, F.lit(":"))) == 1
    return (F.when(value.startswith("["), bracketed)
            .when(one_colon, F.substring_index(value, ":", 1)).otherwise(value))


def parse_ioc_csv(lines: DataFrame, source: str, priority: int = 0,
                  allow_v6: bool = True) -> DataFrame:
    """Third comma-separated field holds ``ip:port``; later fields may hold commas."""
    line = _stripped(F.col("value"))
    f = F.split(line, ",")
    value = F.regexp_replace(_stripped(F.get(f, F.lit(2))), r'^"+|"+$', "")
    rows = (lines.where((line != "") & ~line.startswith("#") & (F.size(f) >= 3))
            .select(strip_port(value).alias("field")))
    return _prefixes(rows, source, priority, allow_v6)


def read_cidr_list(spark: SparkSession, path: str, source: str, priority: int = 0) -> DataFrame:
    return _require_rows(parse_cidr_list(spark.read.text(path), source, priority), source)


def read_ioc_csv(spark: SparkSession, path: str, source: str, priority: int = 0) -> DataFrame:
    return _require_rows(parse_ioc_csv(spark.read.text(path), source, priority), source)


def sources_due(sources: DataFrame, as_of: str) -> DataFrame:
    """Enabled sources never synced, or whose last sync is at least one interval old."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_sync_at")
    return sources.where(F.col("enabled") & (
        F.col("last_sync_at").isNull() | (age >= F.col("interval_sec"))))
