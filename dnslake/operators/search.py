"""Finding and paging through names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORT_FIELDS = ("score", "last_seen", "query_count", "name", "confidence")


def search(df: DataFrame, q: str, name: str = "name") -> DataFrame:
    """``/regex/``, ``*.suffix`` (the suffix itself too) or a literal part of the name.

    With a ``name_rev`` column the suffix form is a prefix test, which file statistics can prune.
    """
    q = q.strip()
    col = F.col(name)
    if not q:
        return df
    if len(q) > 2 and q.startswith("/") and q.endswith("/"):
        # Names are lower case; the pattern keeps its case, since "not a digit" and "a digit" differ by it.
        return df.where(col.rlike(q[1:-1]))
    q = q.lower()
    if q.startswith("*."):
        suffix = q[2:]
        if "name_rev" in df.columns:
            below = F.col("name_rev").startswith(suffix[::-1] + ".")
        else:
            below = col.endswith("." + suffix)
        return df.where(below | (col == suffix))
    return df.where(col.contains(q))


def with_category(domains: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join to the categories (eight rows; Catalyst broadcasts by size)."""
    info = categories.select(F.col("key").alias("category"), "threshold", "enabled",
                             "publish_path", "sort_order")
    return domains.join(info, "category", "left")


def list_domains(domains: DataFrame, statuses: list[str] | None = None,
                 categories: list[str] | None = None, q: str = "",
                 min_score: float | None = None, seen_after: str | None = None) -> DataFrame:
    """Filters: OR inside one list of values, AND across filters."""
    df = search(domains, q)
    if statuses:
        df = df.where(F.col("status").isin(statuses))
    if categories:
        df = df.where(F.col("category").isin(categories))
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    if seen_after is not None:
        df = df.where(F.col("last_seen") >= F.lit(seen_after).cast("timestamp"))
    return df


def _order(field: str, desc: bool, tie: str) -> list[Column]:
    if field not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {field!r}")
    # Nulls come first ascending and last descending.
    return ([F.desc_nulls_last(field), F.desc(tie)] if desc
            else [F.asc_nulls_first(field), F.asc(tie)])


def sort_domains(df: DataFrame, field: str = "score", desc: bool = True,
                 tie: str = "name") -> DataFrame:
    return df.orderBy(*_order(field, desc, tie))


def page(df: DataFrame, field: str = "score", desc: bool = True,
         cursor: tuple[object, object] | None = None, n: int = 50,
         tie: str = "name") -> DataFrame:
    """Rows after the cursor (sort value, tie value), one more than ``n`` if there are more.

    Null sort values have their place in the order on both sides of the cursor, so the pages
    together give every row once.
    """
    if cursor is not None:
        value, last = cursor
        key, tiebreak = F.col(field), F.col(tie)
        if desc and value is None:
            after = key.isNull() & (tiebreak < last)
        elif desc:
            after = (key < value) | key.isNull() | ((key == value) & (tiebreak < last))
        elif value is None:
            after = key.isNotNull() | (tiebreak > last)
        else:
            after = (key > value) | ((key == value) & (tiebreak > last))
        df = df.where(after)
    return df.orderBy(*_order(field, desc, tie)).limit(n + 1)


def lookup(domains: DataFrame, q: str) -> DataFrame:
    return domains.where(F.col("name") == q.strip().lower())


def siblings(domains: DataFrame, name: str, k: int = 50) -> DataFrame:
    """Other names under the same registrable name, busiest first."""
    own = domains.where(F.col("name") == name).select("etld1")
    return (domains.where(F.col("name") != name).join(own, "etld1", "left_semi")
            .orderBy(F.desc("query_count"), "name").limit(k))


def count_subdomains(domains: DataFrame, etld1: str) -> DataFrame:
    return domains.where(F.col("etld1") == etld1).agg(F.count("*").alias("n"))


def signals_of(page_df: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of a page of names as an array, heaviest first (by absolute weight)."""
    wanted = signals.join(page_df.select("name"), "name", "left_semi")
    packed = F.sort_array(F.collect_list(F.struct(
        (-F.abs("weight")).alias("order"), "kind", "weight")))
    lists = wanted.groupBy("name").agg(
        F.transform(packed, lambda s: F.struct(s["kind"].alias("kind"),
                                               s["weight"].alias("weight"))).alias("signals"))
    return page_df.join(lists, "name", "left")


def candidates(domains: DataFrame, limit: int | None = None) -> DataFrame:
    """Names the rules may score: not manual, new or in staging, busiest first if limited."""
    df = domains.where(~F.col("is_manual") & F.col("status").isin("new", "staging"))
    return df if limit is None else df.orderBy(F.desc("query_count"), "name").limit(limit)


def history(decisions: DataFrame, name: str, k: int = 50) -> DataFrame:
    return (decisions.where(F.col("name") == name)
            .orderBy(F.desc("created_at"), F.desc("id")).limit(k))


def snapshot_history(snapshots: DataFrame, list_key: str | None = None, k: int = 30) -> DataFrame:
    df = snapshots.where(F.col("list_key") == list_key) if list_key else snapshots
    return df.orderBy(F.desc("published_at"), F.desc("id")).limit(k)


def verdicts_of(verdicts: DataFrame, name: str, k: int = 20) -> DataFrame:
    return (verdicts.where(F.col("domain") == name.strip().lower())
            .orderBy(F.desc("id")).limit(k))


def pending_requests(requests: DataFrame, k: int = 200) -> DataFrame:
    return (requests.where(F.col("state") == "pending")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(k))
