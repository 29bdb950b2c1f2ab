"""The rule set of the scorer: built-in values plus what an operator adds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions.names import normalize_host, protecting_rule, suffix_hit


@dataclass(frozen=True)
class Rules:
    """Values the scoring expressions are built from."""

    adtech: dict[str, str] = field(default_factory=lambda: dict(refdata.ADTECH_SUFFIXES))
    asns: dict[int, tuple[str, str]] = field(default_factory=lambda: dict(refdata.ADTECH_ASNS))
    cdn: tuple[str, ...] = tuple(refdata.SHARED_CDN)
    keywords: dict[str, list[str]] = field(
        default_factory=lambda: {c: list(w) for c, w in refdata.KEYWORDS.items()})
    thresholds: dict[str, int] = field(default_factory=lambda: dict(refdata.THRESHOLDS))


CUSTOM = "kind string, key string, value string, org string"


def builtin_rules(spark: SparkSession) -> DataFrame:
    """Built-in rules as one table ``(kind, key, value, org)``."""
    rows = [("adtech_domains", s, c, None) for s, c in refdata.ADTECH_SUFFIXES.items()]
    rows += [("adtech_asns", str(n), c, o) for n, (o, c) in refdata.ADTECH_ASNS.items()]
    rows += [("shared_cdn", s, None, None) for s in refdata.SHARED_CDN]
    rows += [("keywords", w, c, None) for c, words in refdata.KEYWORDS.items() for w in words]
    rows += [("thresholds", k, str(v), None) for k, v in refdata.THRESHOLDS.items()]
    return spark.createDataFrame(rows, CUSTOM)


def _normalized(custom: DataFrame) -> DataFrame:
    key = (F.when(F.col("kind").isin("adtech_domains", "shared_cdn"), normalize_host("key"))
           .when(F.col("kind") == "keywords", F.lower(F.trim("key"))).otherwise(F.trim("key")))
    return custom.withColumn("key", key)


def merge_rules(custom: DataFrame) -> DataFrame:
    """Built-in rules plus additions: an addition overrides the category of an equal key, nothing
    can be removed, a zero threshold means "not set".

    Keywords are keyed by group and word, so a word may sit in two groups.
    """
    added = _normalized(custom).where(
        (F.col("key") != "") & ~((F.col("kind") == "thresholds") & (F.col("value") == "0")))
    both = (builtin_rules(custom.sparkSession).withColumn("_v", F.lit(0))
            .unionByName(added.withColumn("_v", F.lit(1))))
    group = F.when(F.col("kind") == "keywords", F.col("value"))
    return (both.groupBy("kind", "key", group.alias("_g"))
            .agg(F.max_by(F.struct("value", "org"), "_v").alias("_r"))
            .select("kind", "key", "_r.value", "_r.org"))


#: A rule table is configuration; beyond this many rows the caller has mixed up his tables.
MAX_RULES = 100_000


def load_rules(table: DataFrame) -> Rules:
    """Rule table to expression values.  Keywords keep built-in order, additions follow sorted."""
    rows = table.orderBy("kind", "key").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"rule table has more than {MAX_RULES} rows")
    rules = Rules(adtech={}, asns={}, cdn=(), keywords={}, thresholds=dict(refdata.THRESHOLDS))
    words: dict[str, list[str]] = {c: list(w) for c, w in refdata.KEYWORDS.items()}
    cdn: list[str] = []
    for r in rows:
        if r.kind == "adtech_domains":
            rules.adtech[r.key] = r.value
        elif r.kind == "adtech_asns":
            rules.asns[int(r.key)] = (r.org or "", r.value)
        elif r.kind == "shared_cdn":
            cdn.append(r.key)
        elif r.kind == "keywords" and r.key not in words.setdefault(r.value, []):
            words[r.value].append(r.key)
        elif r.kind == "thresholds":
            rules.thresholds[r.key] = int(r.value)
    return Rules(rules.adtech, rules.asns, tuple(cdn), words, rules.thresholds)


def override_thresholds(base: DataFrame, custom: DataFrame) -> DataFrame:
    """``(key, value)`` thresholds; 0 or a missing row keeps the base value."""
    new = custom.select("key", F.col("value").alias("_v"))
    return base.join(new, "key", "left").select(
        "key", F.when(F.coalesce("_v", F.lit(0)) != 0, F.col("_v"))
        .otherwise(F.col("value")).alias("value"))


def validate_rules(custom: DataFrame) -> DataFrame:
    """Every rejected addition with its reason, ordered by field and value."""
    host = normalize_host("key")
    word = F.lower(F.trim("key"))
    number = F.col("key").try_cast("long")
    setting = F.col("value").try_cast("long")
    bad_category = ~F.coalesce(F.col("value").isin(list(refdata.BLOCKABLE)), F.lit(False))

    def among(name: Column, values: dict) -> Column:
        return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in values.items()])

    neutral = among(number, refdata.NEUTRAL_ASNS)
    clash = suffix_hit("key", refdata.SHARED_CDN)
    adtech = (F.when(host == "", "empty name")
              .when(~host.contains("."), "not a full domain name")
              .when(protecting_rule(host).isNotNull(), "protected name")
              .when(bad_category, F.concat(F.lit("bad category: "), F.coalesce("value", F.lit(""))))
              .when(clash.isNotNull(), F.concat(F.lit("shared CDN: "), clash)))
    asn = (F.when(number.isNull() | (number <= 0), "AS number must be positive")
           .when(neutral.isNotNull(), F.concat(F.lit("neutral network: "), neutral))
           .when(bad_category, F.concat(F.lit("bad category: "), F.coalesce("value", F.lit("")))))
    cdn = F.when((host == "") | ~host.contains("."), "not a full domain name")
    keyword = (F.when(bad_category, F.concat(F.lit("bad category: "),
                                             F.coalesce("value", F.lit(""))))
               .when(word == "", "empty keyword")
               .when(F.octet_length(word) < refdata.MIN_KEYWORD_LENGTH, "shorter than 3 bytes")
               .when(word.rlike(r"[ \t/:]"), "holds a blank, slash or colon"))
    low = among(F.col("key"), {k: b[0] for k, b in refdata.THRESHOLD_BOUNDS.items()})
    high = among(F.col("key"), {k: b[1] for k, b in refdata.THRESHOLD_BOUNDS.items()})
    threshold = F.when((setting != 0) & ((setting < low) | (setting > high)), F.concat(
        F.lit("outside "), low.cast("string"), F.lit("-"), high.cast("string")))
    reason = (F.when(F.col("kind") == "adtech_domains", adtech)
              .when(F.col("kind") == "adtech_asns", asn).when(F.col("kind") == "shared_cdn", cdn)
              .when(F.col("kind") == "keywords", keyword)
              .when(F.col("kind") == "thresholds", threshold))
    # A bad group of keywords is one error, its words are not judged.
    value = (F.when((F.col("kind") == "keywords") & bad_category, F.col("value"))
             .when(F.col("kind") == "thresholds", F.concat_ws("=", "key", "value"))
             .otherwise(F.col("key")))
    rows = custom.select(F.col("kind").alias("field"), value.alias("value"),
                         reason.alias("reason")).where(F.col("reason").isNotNull()).distinct()

    def setting_of(key: str) -> Column:
        mine = (F.col("kind") == "thresholds") & (F.col("key") == key)
        return F.max(F.when(mine, F.col("value").try_cast("long")))

    order = (custom.agg(setting_of("spread_mid_min").alias("mid"),
                        setting_of("spread_high_min").alias("high"))
             .where((F.col("mid") != 0) & (F.col("high") != 0) & (F.col("mid") >= F.col("high")))
             .select(F.lit("thresholds").alias("field"),
                     F.format_string("spread_mid_min=%d spread_high_min=%d", "mid", "high")
                     .alias("value"), F.lit("middle must be under high").alias("reason")))
    return rows.unionByName(order).orderBy("field", "value", "reason")
