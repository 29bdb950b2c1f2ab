"""Names and addresses: resolutions, threats, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions import nets
from dnslake.operators.joins import interval_join, priority_prefix_join, range_join
from dnslake.sources.tables import merge_latest


def resolution_rollup(answers: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """One row per (name, address); answers for unknown names are ignored."""
    rows = answers.select("name", F.explode("ips").alias("ip"), "ttl", "occurred_at")
    sums = rows.groupBy("name", "ip").agg(
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
        F.count("*").alias("hits"), F.min("ttl").alias("ttl"))
    # The semi join runs on one row per pair, after the map-side combine.
    return sums if domains is None else sums.join(domains.select("name"), "name", "left_semi")


def merge_resolutions(base: DataFrame, delta: DataFrame) -> DataFrame:
    return merge_latest(base, delta, ["name", "ip"], {
        "first_seen": "min", "last_seen": "max", "hits": "sum", "ttl": "min"})


def domains_by_ip(domain_ips: DataFrame, domains: DataFrame, ip: str, k: int = 200) -> DataFrame:
    return (domain_ips.where(F.col("ip") == ip).join(domains.select("name", "status"), "name")
            .select("name", "status", "first_seen", "last_seen", "hits")
            .orderBy(F.desc("last_seen"), "name").limit(k))


def ips_by_domain(domain_ips: DataFrame, name: str, k: int = 200) -> DataFrame:
    return (domain_ips.where(F.col("name") == name)
            .orderBy(F.desc("last_seen"), "ip").limit(k))


def access_rows(domain_ips: DataFrame, events: DataFrame, ip: str | None = None) -> DataFrame:
    """Queries made while the name was seen to point at the address."""
    spans = domain_ips.select("name", "ip", "first_seen", "last_seen")
    if ip is not None:
        spans = spans.where(F.col("ip") == ip)
    return interval_join(events, spans, ["name"], "occurred_at", "first_seen", "last_seen",
                         cell_seconds=86400)


def accesses_by_ip(domain_ips: DataFrame, events: DataFrame, ip: str, k: int = 200,
                   client: str = "client_id") -> DataFrame:
    return (access_rows(domain_ips, events, ip).select(client, "name", "occurred_at")
            .orderBy(F.desc("occurred_at"), "name", client).limit(k))


def ip_threat_state(domain_ips: DataFrame) -> DataFrame:
    """Threat and its source per address, both from the same row; empty strings when clear."""
    return domain_ips.groupBy("ip").agg(
        F.coalesce(F.max("threat"), F.lit("")).alias("threat"),
        F.coalesce(F.max_by("threat_source", "threat"), F.lit("")).alias("source"))


def pending_geo(domain_ips: DataFrame, k: int | None = None) -> DataFrame:
    """Addresses that were never looked up, most recent first; ``k`` keeps the first so many."""
    queue = (domain_ips.where(F.col("country").isNull()).groupBy("ip")
             .agg(F.max("last_seen").alias("last_seen")).orderBy(F.desc("last_seen"), "ip"))
    return queue if k is None else queue.limit(k)


def locate(df: DataFrame, ranges: DataFrame, ip: str = "ip", allow_v6: bool = True) -> DataFrame:
    """Distinct addresses with their network; unknown ones get empty values."""
    found = range_join(nets.ips_of(df, ip, allow_v6), ranges, "left").drop("ip_key")
    return (df.select(ip).distinct().join(found, ip, "left")
            .select(ip, F.coalesce("asn", F.lit(0)).alias("asn"),
                    F.coalesce("country", F.lit("")).alias("country"),
                    F.coalesce("org", F.lit("")).alias("org")))


def fill_geo(domain_ips: DataFrame, ranges: DataFrame, allow_v6: bool = True) -> DataFrame:
    """Fill asn, country and org of the addresses that have none yet.

    An address without a range gets empty values, so that it counts as looked up.
    """
    pending = domain_ips.where(F.col("country").isNull())
    geo = locate(pending, ranges, "ip", allow_v6).select(
        "ip", F.col("asn").alias("_asn"), F.col("country").alias("_country"),
        F.col("org").alias("_org"))
    return (domain_ips.join(geo, "ip", "left")
            .withColumn("asn", F.coalesce("_asn", "asn"))
            .withColumn("country", F.coalesce("_country", "country"))
            .withColumn("org", F.coalesce("_org", "org"))
            .select(*domain_ips.columns))


def asn_facts(dns: DataFrame, ranges: DataFrame, allow_v6: bool = True) -> DataFrame:
    """Network of the first address of ``(name, a)``."""
    first = dns.where(F.size("a") > 0).select("name", F.element_at("a", 1).alias("ip"))
    return (first.join(locate(first, ranges, "ip", allow_v6), "ip").where(F.col("asn") != 0)
            .select("name", "asn", "org", "country"))


def scan_threats(domain_ips: DataFrame, lists: DataFrame,
                 allow_v6: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Match every address again: (state now, changed rows, alerts).

    An address is set, moved to another list or cleared; an alert needs a new prefix.
    """
    was = ip_threat_state(domain_ips)
    hit = priority_prefix_join(nets.ips_of(domain_ips, "ip", allow_v6), lists)
    now = hit.select("ip", nets.prefix_text("net_key", "bits", allow_v6).alias("now_threat"),
                     F.col("source").alias("now_source"))
    state = (was.join(now, "ip", "left")
             .withColumn("now_threat", F.coalesce("now_threat", F.lit("")))
             .withColumn("now_source", F.coalesce("now_source", F.lit(""))))
    changes = state.where((F.col("threat") != F.col("now_threat"))
                          | (F.col("source") != F.col("now_source")))
    alerts = changes.where((F.col("now_threat") != "") & (F.col("now_threat") != F.col("threat")))
    return (state.select("ip", F.col("now_threat").alias("threat"),
                         F.col("now_source").alias("source")),
            changes.select("ip", F.col("now_threat").alias("threat"),
                           F.col("now_source").alias("source")),
            alerts.select("ip", F.col("now_threat").alias("threat"),
                          F.col("now_source").alias("source")))


def set_threats(domain_ips: DataFrame, changes: DataFrame) -> DataFrame:
    """Write changes back: threat and source are set together or both null."""
    both = (F.col("_t") != "") & (F.col("_s") != "")
    new = changes.select("ip", F.col("threat").alias("_t"), F.col("source").alias("_s"),
                         F.lit(True).alias("_hit"))
    return (domain_ips.join(new, "ip", "left")
            .withColumn("threat", F.when(F.col("_hit"), F.when(both, F.col("_t")))
                        .otherwise(F.col("threat")))
            .withColumn("threat_source", F.when(F.col("_hit"), F.when(both, F.col("_s")))
                        .otherwise(F.col("threat_source")))
            .select(*domain_ips.columns))


def threat_rows(domain_ips: DataFrame, domains: DataFrame, behavior: DataFrame,
                max_cv: float = refdata.BEACON_MAX_CV) -> DataFrame:
    cv = F.coalesce("interval_cv", F.lit(0.0))
    return (domain_ips.where(F.col("threat").isNotNull())
            .join(domains.select("name", "status"), "name")
            .join(behavior.select("name", "interval_cv"), "name", "left")
            .select("name", "status", "ip", "threat",
                    F.coalesce("threat_source", F.lit("")).alias("threat_source"),
                    "last_seen", "hits", ((cv > 0) & (cv < max_cv)).alias("beacon")))


def threat_matches(domain_ips: DataFrame, domains: DataFrame, behavior: DataFrame,
                   k: int = 200) -> DataFrame:
    """Names on flagged addresses, newest first; regular ones carry the beacon flag."""
    return (threat_rows(domain_ips, domains, behavior)
            .orderBy(F.desc("last_seen"), "name", "ip").limit(k))


def export_queries(events: DataFrame, from_: str, to: str, client: str = "client_id") -> DataFrame:
    span = F.col("occurred_at").between(F.lit(from_).cast("timestamp"),
                                        F.lit(to).cast("timestamp"))
    return events.where(span).select(F.col(client).alias("client"), F.col("name").alias("domain"),
                                     "qtype", F.col("occurred_at").alias("at"))


def overlapping(domain_ips: DataFrame, from_: str, to: str) -> DataFrame:
    """Resolutions whose life overlaps the range."""
    return domain_ips.where((F.col("last_seen") >= F.lit(from_).cast("timestamp"))
                            & (F.col("first_seen") <= F.lit(to).cast("timestamp")))


def export_resolutions(domain_ips: DataFrame, from_: str, to: str) -> DataFrame:
    def text(c: str):
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    return overlapping(domain_ips, from_, to).select(
        F.col("name").alias("domain"), "ip", "first_seen", "last_seen", "hits", "ttl",
        F.coalesce("asn", F.lit(0)).alias("asn"), text("country"), text("org"), text("threat"),
        text("threat_source"))
