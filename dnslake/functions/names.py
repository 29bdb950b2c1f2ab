"""Column functions over domain names and hosts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslake import refdata

_VALID_NAME = r"^([a-z0-9_-]{1,63}\.)+[a-z0-9_-]{1,63}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_domain(name: Column | str) -> Column:
    """At most 253 characters, two labels or more, labels of 1..63 from ``a-z 0-9 _ -``."""
    name = _col(name)
    return F.coalesce((F.length(name) <= 253) & name.rlike(_VALID_NAME), F.lit(False))


def normalize_host(host: Column | str) -> Column:
    """Lower case, blanks trimmed, one ``*.`` prefix and one trailing dot dropped."""
    lowered = F.lower(F.regexp_replace(_col(host), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(lowered, r"^\*\.", ""), r"\.$", "")


def host_of(url: Column | str) -> Column:
    """Host of a URL: no scheme, path, user info, port or trailing dot; lower case."""
    rest = F.regexp_replace(_col(url), r"^(?s).*?://", "")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    no_user = F.regexp_replace(authority, r"^(?s).*@", "")
    no_port = F.regexp_extract(no_user, r"^[^:]*", 0)
    return F.lower(F.regexp_replace(no_port, r"\.$", ""))


def suffixes(host: Column | str) -> Column:
    """Every label-boundary suffix, longest first: ``a.b.c`` gives ``[a.b.c, b.c, c]``."""
    parts = F.split(_col(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def reversed_name(name: Column | str) -> Column:
    return F.reverse(_col(name))


def leftmost_label(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", 1)


def round2(x: Column) -> Column:
    """Round half away from zero to two digits."""
    up = F.floor(F.abs(x) * 100 + F.lit(0.5)).cast("double") / 100
    return F.when(x < 0, -up).otherwise(up)


def entropy(s: Column | str) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    s = _col(s)
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")

    def term(acc: Column, c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return acc - p * F.log2(p)

    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), term)


def keyword_hit(name: Column | str, keywords: Mapping[str, Iterable[str]]) -> Column:
    """First keyword found in the name as ``struct(word, category)``, group order first."""
    name = F.lower(_col(name))
    pairs = [(w, c) for c, words in keywords.items() for w in words]
    if not pairs:
        return F.lit(None).cast("struct<word:string,category:string>")
    # One pass rejects the names without any keyword, the ordered list is walked for the rest only.
    any_word = "|".join(re.escape(w) for w, _ in pairs)
    table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(c).alias("category"))
                      for w, c in pairs])
    first = F.get(F.filter(table, lambda k: name.contains(k["word"])), F.lit(0))
    return F.when(name.rlike(any_word), first)


def suffix_hit(host: Column | str, known: Iterable[str]) -> Column:
    """Longest known suffix the host lies under, at a label boundary; null if none.

    The search runs left to right, so the first hit is the longest suffix.
    """
    words = sorted(set(known))
    if not words:
        return F.lit(None).cast("string")
    pattern = r"(?:^|\.)(" + "|".join(re.escape(w) for w in words) + r")$"
    hit = F.regexp_extract(normalize_host(host), pattern, 1)
    return F.when(hit != "", hit)


def suffix_match(hosts: DataFrame, table: DataFrame, host: str = "host",
                 suffix: str = "suffix") -> DataFrame:
    """Join form of :func:`suffix_hit` for suffix tables of any size.

    Distinct hosts are exploded into their suffixes and joined by equality; the longest match
    wins.  Output: the distinct hosts that match, with the columns of the matching table row.
    """
    rest = [c for c in table.columns if c != suffix]
    # Of several rows on one suffix a whole row counts, the least by its columns in order.
    rows = table.groupBy(suffix).agg(F.min(F.struct(*rest)).alias("_row")).select(
        suffix, "_row.*") if rest else table.select(suffix).distinct()
    tried = hosts.select(host).distinct().withColumn(
        suffix, F.explode(suffixes(normalize_host(host))))
    best = F.max_by(F.struct(suffix, *rest), F.length(suffix))
    return (tried.join(rows, suffix).groupBy(host).agg(best.alias("_m"))
            .select(host, *[F.col("_m")[c].alias(c) for c in [suffix, *rest]]))


def protecting_rule(name: Column | str, soft: Iterable[str] = ()) -> Column:
    """Rule that protects the name (hard list first, then soft list, list order); else null."""
    name = F.regexp_replace(F.lower(_col(name)), r"\.$", "")
    soft_rules = [s.strip().lower() for s in soft if s.strip()]

    def first_of(rules: list[str]) -> Column:
        table = F.array(*[F.lit(r) for r in rules])
        return F.get(F.filter(table, lambda r: (name == r) | name.endswith(
            F.concat(F.lit("."), r))), F.lit(0))

    # The regex screens out almost every name before the ordered list is walked.
    screen = r"(?:^|\.)(" + "|".join(re.escape(r) for r in refdata.HARD_PROTECTED) + r")$"
    hard = F.when(name.rlike(screen), first_of(refdata.HARD_PROTECTED))
    return F.coalesce(hard, first_of(soft_rules)) if soft_rules else hard


def is_protected(df: DataFrame, soft: Iterable[str] = (), name: str = "name") -> DataFrame:
    """Add ``protected_by`` (null when the name is not protected)."""
    return df.withColumn("protected_by", protecting_rule(name, soft))


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Public-suffix rules ``(rule)`` from a file (``//`` comments), or the short default."""
    if path is None:
        return spark.createDataFrame([(r,) for r in refdata.DEFAULT_SUFFIX_RULES], "rule string")
    line = F.regexp_extract(F.trim("value"), r"^\S+", 0)
    return (spark.read.text(path).select(line.alias("rule"))
            .where((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct())


def with_etld1(df: DataFrame, rules: DataFrame, name: str = "name",
               out: str = "etld1") -> DataFrame:
    """Registrable name by public-suffix rules; the name itself when there is none.

    Works on the distinct names: every suffix is tried as a plain rule, as ``*.`` rule and as
    ``!`` exception by one equality join; the result joins back by name.
    """
    host = F.regexp_replace(F.lower(name), r"\.$", "")
    parts = F.split("_h", r"\.")
    names = df.select(F.col(name).alias("_n"), host.alias("_h")).distinct()
    tried = names.select(
        "_n", "_h", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_i"),
        F.size(parts).alias("_k"),
    ).withColumn("_s", F.array_join(F.slice(parts, F.col("_i"), F.col("_k")), "."))
    keyed = rules.select(
        F.regexp_replace("rule", r"^(\*\.|!)", "").alias("_s"),
        F.when(F.col("rule").startswith("!"), "exception")
         .when(F.col("rule").startswith("*."), "wild").otherwise("plain").alias("_kind"),
    ).distinct()
    # Number of labels the public suffix has under each matching rule.
    labels = F.col("_k") - F.col("_i") + 1
    size = (F.when(F.col("_kind") == "exception", labels - 1)
            .when((F.col("_kind") == "wild") & (F.col("_i") > 1), labels + 1)
            .when(F.col("_kind") == "plain", labels))
    found = tried.join(keyed, "_s").groupBy("_n").agg(
        F.max(F.when(F.col("_kind") == "exception", size)).alias("_ex"),
        F.max(F.when(F.col("_kind") != "exception", size)).alias("_rule"),
    )
    suffix_size = F.coalesce("_ex", "_rule", F.lit(1))
    take = suffix_size + 1
    etld1 = F.when(
        (F.size(parts) >= take) & ~F.array_contains(parts, ""),
        F.array_join(F.slice(parts, F.size(parts) - take + 1, take), "."),
    ).otherwise(F.col("_h"))
    resolved = names.join(found, "_n", "left").select("_n", etld1.alias(out))
    return df.drop(out).join(resolved, F.col(name) == F.col("_n"), "left").drop("_n")


def qtype_name(code: Column | str) -> Column:
    code = _col(code)
    chain = F.when(F.lit(False), F.lit(""))
    for name, value in refdata.QTYPES.items():
        chain = chain.when(code == value, name)
    return chain.otherwise(F.concat(F.lit("TYPE"), code.cast("string")))


def qtype_code(name: Column | str) -> Column:
    name = F.upper(_col(name))
    chain = F.when(F.lit(False), F.lit(0))
    for known, value in refdata.QTYPES.items():
        chain = chain.when(name == known, value)
    return chain.otherwise(F.lit(0))


def clip(s: Column | str, n: int) -> Column:
    """Cut to ``n`` characters and mark the cut with an ellipsis."""
    s = _col(s)
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)
