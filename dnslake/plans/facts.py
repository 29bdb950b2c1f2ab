"""Stored lookup results: parsing, lifetime, selection of names to look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslake import refdata, schemas
from dnslake.functions.names import protecting_rule
from dnslake.operators.chains import walks
from dnslake.operators.joins import needs_fact
from dnslake.sources.tables import merge_latest


def decode(source: str, data: Column | str = "data") -> Column:
    """JSON of one fact source to its struct."""
    return F.from_json(data, schemas.FACT_JSON[source])


def ttl_seconds(source: Column, outcome: Column) -> Column:
    """Seconds a result stays valid: by source on success, by (source, outcome) on failure."""
    good = F.coalesce(*[F.when(source == s, F.lit(v)) for s, v in refdata.SUCCESS_TTL.items()],
                      F.lit(refdata.DEFAULT_SUCCESS_TTL))
    bad = F.coalesce(*[F.when((source == s) & (outcome == o), F.lit(v))
                       for (s, o), v in refdata.OUTCOME_TTL.items()],
                     F.lit(refdata.DEFAULT_RETRY_TTL))
    return F.when(F.coalesce(outcome, F.lit("")).isin("", "ok"), good).otherwise(bad)


# Words of a recorded error -> outcome, in order of precedence.
OUTCOME_WORDS = {
    "blocked_host": r"private address",
    "dns_fail": r"no such host|no address|server misbehaving|nxdomain",
    "quota": r"quota|too many requests|\b429\b",
    "not_found": r"not found",
    "timeout": r"deadline exceeded|timeout|timed out",
    "refused": r"connection refused|no route to host|host is unreachable|network is unreachable",
    "tls_error": r"tls:|x509:",
}


def outcome_of(error: Column) -> Column:
    """Outcome code of a recorded error text; ``ok`` without error."""
    text = F.lower(error)
    known = F.coalesce(*[F.when(text.rlike(words), F.lit(code))
                         for code, words in OUTCOME_WORDS.items()], F.lit("other"))
    return F.when(error.isNull(), F.lit("ok")).otherwise(known)


def save_facts(base: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Merge ``(name, source, data, error, outcome)``; a failure keeps the old data."""
    now = F.lit(as_of).cast("timestamp")
    ttl = ttl_seconds(F.col("source"), F.col("outcome"))
    delta = results.select(
        "name", "source",
        F.when(F.col("error").isNull(), F.col("data")).alias("data"),
        now.alias("fetched_at"), F.timestamp_seconds(F.unix_seconds(now) + ttl).alias("expires_at"),
        "error")
    merged = merge_latest(base, delta, ["name", "source"], {
        "data": "fill", "fetched_at": "last", "expires_at": "last", "error": "last"})
    return merged.withColumn("data", F.coalesce("data", F.lit("{}")))


def facts_for(facts: DataFrame, name: str | None = None) -> DataFrame:
    """Facts per name and source; a failed one shows its error only."""
    rows = facts if name is None else facts.where(F.col("name") == name)
    shown = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(
        F.col("data"))
    return rows.select("name", "source", shown.alias("data"))


def facts_wide(facts: DataFrame, as_of: str | None = None, fresh_only: bool = True) -> DataFrame:
    """One row per name with a struct per source.  ``fresh_only`` leaves expired facts out."""
    good = facts.where(F.col("error").isNull())
    if fresh_only:
        good = good.where(F.col("expires_at") > F.lit(as_of).cast("timestamp"))
    # Text is picked per source first and decoded once per name after the shuffle.
    picked = good.groupBy("name").agg(*[
        F.max(F.when(F.col("source") == s, F.col("data"))).alias(s) for s in refdata.FACT_SOURCES])
    return picked.select("name", *[decode(s, s).alias(s) for s in refdata.FACT_SOURCES])


def parse_cert_log(df: DataFrame, body: str = "body", most_names: int | None = None) -> DataFrame:
    """Certificate log reply: issuer and end of the first entry, all distinct names.

    ``most_names`` keeps the first so many; ``names_seen`` always counts all.
    """
    entries = F.from_json(body, "array<struct<name_value string, issuer_name string, "
                                "not_after string>>")
    sans = F.transform(
        F.flatten(F.transform("_e", lambda e: F.split(F.coalesce(e["name_value"], F.lit("")), "\n"))),
        lambda s: F.lower(F.trim(s)))
    return (df.withColumn("_e", entries).select(
        "name", F.coalesce(F.get("_e", F.lit(0))["issuer_name"], F.lit("")).alias("issuer"),
        F.coalesce(F.get("_e", F.lit(0))["not_after"], F.lit("")).alias("not_after"),
        F.array_distinct(F.filter(sans, lambda s: s != "")).alias("_all")).select(
        "name", "issuer", "not_after", (F.col("_all") if most_names is None else F.slice("_all", 1, most_names)).alias("sans"),
        F.size("_all").alias("names_seen")))


def parse_registration(df: DataFrame, as_of: str, body: str = "body") -> DataFrame:
    """Registration reply: date of the first registration event and its age in whole days."""
    events = F.from_json(body, "events array<struct<eventAction string, eventDate string>>")
    first = F.get(F.filter(events["events"], lambda e: e["eventAction"] == "registration"),
                  F.lit(0))["eventDate"]
    age = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp"))
                   - F.unix_seconds(F.try_to_timestamp("registered_at"))) / refdata.DAY)
    return (df.withColumn("registered_at", F.coalesce(first, F.lit("")))
            .select("name", "registered_at", F.coalesce(age, F.lit(0)).alias("age_days")))


def parse_scan(df: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """Scanner reply: engine counts; a 404 reply means the name is not known there."""
    stats = "malicious int, suspicious int, harmless int, undetected int"
    doc = F.from_json(body, "data struct<attributes struct<reputation int, "
                            f"last_analysis_stats struct<{stats}>>>")
    counts = doc["data"]["attributes"]["last_analysis_stats"]
    known = F.col(status) == 200
    return df.where(F.col(status).isin(200, 404)).select("name", *[
        F.coalesce(F.when(known, counts[c]), F.lit(0)).alias(c)
        for c in ("malicious", "suspicious", "harmless", "undetected")], known.alias("known"))


def cname_chain(names: DataFrame, records: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(name, cname_chain, looped): the hosts that ``records (name, target)`` lead to from each name.

    A chain ends with a host that has no record, or before the first host seen again (looped).  Chains have any
    length and are followed by pointer doubling; ``max_hops`` keeps that many hosts and adds the mark truncated.
    """
    steps = (records.select(F.lower("name").alias("at"), F.lower("target").alias("to"))
             .where("at is not null and to is not null").groupBy("at").agg(F.min("to").alias("to")))
    found = walks(steps).select(F.col("at").alias("_at"), "path", "looped")
    rows = names.select("name").distinct().withColumn("_at", F.lower("name")).join(found, "_at", "left")
    path = F.coalesce("path", F.array().cast("array<string>"))
    tidy = F.transform(path if max_hops is None else F.slice(path, 1, max_hops),
                       lambda h: F.regexp_replace(h, r"\.$", ""))
    marks = [] if max_hops is None else [(F.size(path) > max_hops).alias("truncated")]
    return rows.select("name", tidy.alias("cname_chain"), F.coalesce("looped", F.lit(False)).alias("looped"), *marks)


def enrich_candidates(domains: DataFrame, facts: DataFrame, source: str, as_of: str,
                      limit: int | None = None) -> DataFrame:
    """Names that need a fact of the source, busiest first; ``limit`` keeps the first so many."""
    usable = domains.where(F.col("status").isin("new", "staging", "blocked"))
    wanted = (needs_fact(usable, facts, source, as_of)
              .select("name", "etld1", "query_count").orderBy(F.desc("query_count"), "name"))
    return wanted if limit is None else wanted.limit(limit)


# Fixed values: (least queries, least score, score a name must exceed) by source.
GATES = {
    "http": (5, None, -4.0),
    "vt": (5, 3.0, -4.0),
    "ai": (3, None, -4.0),
}


def gated_candidates(domains: DataFrame, facts: DataFrame, source: str, as_of: str,
                     soft: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Candidates of a costly source: busy, undecided, not clearly harmless, not protected; busiest first.

    ``limit`` keeps the first so many of the names that are left when protected ones are out.
    """
    min_queries, min_score, floor = GATES[source]
    usable = domains.where(F.col("status").isin("new", "staging")
                           & (F.col("query_count") >= min_queries)
                           & (F.col("score").isNull() | (F.col("score") > floor)))
    if min_score is not None:
        usable = usable.where(F.col("score") >= min_score)
    wanted = (needs_fact(usable, facts, source, as_of).where(protecting_rule("name", soft).isNull())
              .select("name", "etld1", "query_count").orderBy(F.desc("query_count"), "name"))
    return wanted if limit is None else wanted.limit(limit)
