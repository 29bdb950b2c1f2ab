"""Allow and block rules for URLs by a sorted sweep over reversed-host keys.

A key is the host with its labels reversed, each followed by a comma, then ``)`` and the path, so what a
rule covers at one level of a host is the interval of all keys that begin with the rule's key.  Rules are
intervals [key, key + 0xFF): no UTF-8 text holds the byte 0xFF.  They nest or are apart.  A URL has one key per level of its
host ("org)/x", "org,example,)/x", ...), which makes a rule of a parent domain an interval of that level.

The sweep puts opening and closing ends of intervals and the keys of URLs in one order.  An opening end
puts its rule on the stack; a closing end takes it off, which brings back the rule it is nested in (found
beforehand as its longest proper prefix among the rules).  So after each end the top of the stack is known,
and a URL's rule at a level is the top left by the last end before its key: one window function over sorted
keys.  Of the levels of a URL the longest rule wins.

The window runs per host level that has rules and share of its URLs: a level with many URLs is dealt over
shares of ``SHARE`` rows, and its ends (rules only) are sent to each.  Levels without rules meet no sweep.
Everything is built-in DataFrame functions.

Defined cases: a null URL, or one without ``://``, has empty host and path and meets no rule; rules with null
host or verdict are ignored, a null path is ``/``; of equal rules the blocking one counts; of two rules of equal length at different
levels the longer host wins; repeated URLs are judged one by one; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

SHARE = 100_000

#: Rules of the production list: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
RULE_SQL = "verdict string, host string, path string"


def production_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SQL)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Then up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def level_key(labels: Column) -> Column:
    """Reversed labels, each with a comma."""
    return F.concat(F.array_join(F.reverse(labels), ","), F.lit(","))


def _rules(rules: DataFrame) -> DataFrame:
    """level (reversed host), key, rule (as shown), verdict, parent (key of the rule it is nested in)."""
    clean = (rules.where("host is not null and verdict is not null")
             .select(F.lower("verdict").alias("verdict"), F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                     F.coalesce("path", F.lit("/")).alias("path"))
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
             .withColumn("level", level_key(F.split("host", r"\.", -1)))
             .withColumn("key", F.concat("level", F.lit(")"), "path"))
             .withColumn("rule", F.concat("host", "path")))
    least = F.length("level") + 1
    shorter = clean.where(F.length("key") > least).select(
        "key", F.explode(F.sequence(least, F.length("key") - 1)).alias("n")).select(
        F.col("key").alias("child"), F.col("key").substr(F.lit(1), F.col("n")).alias("parent"))
    parents = (shorter.join(clean.select(F.col("key").alias("parent")), "parent")
               .groupBy(F.col("child").alias("key")).agg(F.max_by("parent", F.length("parent")).alias("parent")))
    return clean.join(parents, "key", "left")


def _ends(rules: DataFrame) -> DataFrame:
    """level, at (binary place), top (the rule on top of the stack from there on; null: none)."""
    this = F.struct(F.col("rule"), F.col("verdict"), F.length("rule").alias("size"), F.length("level").alias("depth"))
    named = rules.select("level", F.col("key").alias("parent"), this.alias("outer"))
    opening = rules.select("level", F.col("key").cast("binary").alias("at"), this.alias("top"))
    closing = (rules.join(named.drop("level"), "parent", "left")
               .select("level", F.concat(F.col("key").cast("binary"), F.lit(b"\xff")).alias("at"), F.col("outer").alias("top")))
    return opening.unionByName(closing)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """All columns of ``pages``, and host, path, rule (null: none fits) and verdict."""
    added = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in added]
    seen = pages.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    rules = _rules(rules)
    levels = rules.select("level").distinct()

    # Equal hosts and paths are judged once.
    places = seen.where("__host <> ''").select(F.col("__host").alias("host"), F.col("__path").alias("path")).distinct()
    labels = F.split("host", r"\.", -1)
    keys = (places.withColumn("labels", labels)
            .select("host", "path", F.explode(F.transform(
                F.sequence(F.lit(1), F.size("labels")), lambda n: level_key(F.slice("labels", -n, n)))).alias("level"))
            .join(levels, "level"))
    shares = keys.groupBy("level").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    probes = (keys.join(shares, "level")
              .select("level", F.pmod(F.xxhash64("host", "path"), F.col("shares")).cast("int").alias("share"),
                      F.concat(F.col("level"), F.lit(")"), F.col("path")).cast("binary").alias("at"), F.lit(1).alias("probe"),
                      F.lit(None).cast(_TOP).alias("top"), "host", "path"))
    ends = (_ends(rules).join(shares, "level")
            .select("level", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "at", F.lit(0).alias("probe"),
                    F.col("top").cast(_TOP).alias("top"), F.lit("").alias("host"), F.lit("").alias("path")))
    # The top of an empty stack is a value too: it must not be skipped as null.
    order = Window.partitionBy("level", "share").orderBy("at", "probe")
    state = F.when(F.col("probe") == 0, F.struct(F.col("top").alias("top")))
    swept = (ends.unionByName(probes).withColumn("state", F.last(state, ignorenulls=True).over(order))
             .where("probe = 1 and state.top is not null"))
    best = (swept.groupBy("host", "path").agg(F.max(F.struct("state.top.size", "state.top.depth", "state.top.rule",
                                                              "state.top.verdict")).alias("best"))
            .select(F.col("host").alias("__host"), F.col("path").alias("__path"), "best"))
    return seen.join(best, ["__host", "__path"], "left").select(
        *[seen[c] for c in kept], F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


_TOP = "struct<rule:string,verdict:string,size:int,depth:int>"
