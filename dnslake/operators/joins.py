"""Interval, band, range and prefix joins as equality joins with a residual test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslake.functions import nets
from dnslake.operators import sweep


def interval_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, start: str,
                  end: str, cell_seconds: int = 30 * 86400) -> DataFrame:
    """Rows of ``left`` whose time lies in the ``[start, end]`` of an equal-key ``right`` row.

    Intervals are filed under every time cell they touch, so a row meets only the intervals alive
    in its cell and a hot key spreads over its cells.  Choose cells of about the usual length of an
    interval.  Size estimates do not see the explosion into cells, hence no broadcast.
    """
    def cell(c: str) -> Column:
        return F.floor(F.unix_seconds(c) / cell_seconds)

    spans = right.where(F.col(start) <= F.col(end)).withColumn(
        "_cell", F.explode(F.sequence(cell(start), cell(end)))).hint("merge")
    return (left.withColumn("_cell", cell(ts)).join(spans, [*on, "_cell"])
            .where(F.col(ts).between(F.col(start), F.col(end))).drop("_cell"))


def _cell_seconds(gap: int) -> int:
    """Longer cells copy fewer rows into the next cell but compare more rows inside one."""
    return 4 * gap


def hot_cells(rows: DataFrame, on: list[str], ts: str, gap: int,
              rows_per_task: int) -> DataFrame:
    """Cells of :func:`band_join` too large for one task, with the number of shares to cut them
    into."""
    return (rows.groupBy(*on, F.floor(F.col(ts) / _cell_seconds(gap)).alias("_cell"))
            .agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows_per_task)
            .select(*on, "_cell", F.ceil(F.col("_rows") / rows_per_task).cast("int")
                    .alias("_shares")))


#: Salts over which the rows of a hot key are dealt while they are told that it is hot.
SALTS = 64


def with_hot(rows: DataFrame, hot: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Left join to the table of hot keys without gathering a hot key: rows carry a salt, and each hot key
    stands once under every salt."""
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))  # equal rows differ, too
    spread = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")


def band_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, gap: int,
              residual: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Pairs with equal ``on`` and ``0 < right.ts - left.ts <= gap`` (whole seconds, columns).

    Both sides carry an integer second column ``ts``; other columns must differ in name.  Time is
    cut into cells: a left row looks into its own and, from the last ``gap`` seconds of a cell, also
    into the next.  The cells of ``hot`` (see :func:`hot_cells`) are split into shares of left rows, their right rows being
    copied to each share: exact, and no task holds a whole hot cell.
    """
    keys = [*on, "_cell"]
    width = _cell_seconds(gap)
    cell = F.floor(F.col(ts) / width)
    late = F.pmod(F.col(ts), F.lit(width)) >= width - gap
    a = left.withColumn("_cell", F.explode(F.when(late, F.array(cell, cell + 1)).otherwise(
        F.array(cell)))).withColumnRenamed(ts, "_ta")
    b = right.withColumn("_cell", cell).withColumnRenamed(ts, "_tb")
    if hot is not None:
        shares = F.coalesce("_shares", F.lit(1))
        row = F.xxhash64(*[c for c in left.columns if c != ts], "_ta")
        a = with_hot(a, hot, keys).withColumn("_share", F.pmod(row, shares)).drop("_shares")
        b = (with_hot(b, hot, keys)
             .withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"),
                                                        (shares - 1).cast("long"))))
             .drop("_shares"))
        keys = [*keys, "_share"]
    pairs = a.join(b, keys).where(
        (F.col("_tb") > F.col("_ta")) & (F.col("_tb") <= F.col("_ta") + gap))
    if residual is not None:
        pairs = pairs.where(residual)
    return pairs.drop("_cell", "_share")


def range_join(ips: DataFrame, ranges: DataFrame, how: str = "inner", slab_rows: int = sweep.SLAB_ROWS) -> DataFrame:
    """Each address (``ip_key``) with every range (``start_key``, ``end_key``) that holds it, v4 or v6.

    Distinct addresses are swept once against the sorted ranges (see :mod:`dnslake.operators.sweep`).
    """
    return ips.join(sweep.containing(ips, ranges, slab_rows), "ip_key", how)


def _as_ranges(cidrs: DataFrame) -> DataFrame:
    """Networks (``net_key``, ``bits``) of any length as ranges of addresses."""
    return cidrs.withColumn("start_key", nets.mask_key("net_key", F.col("bits"))).withColumn(
        "end_key", nets.last_key("net_key", F.col("bits")))


def _first_prefix(ips: DataFrame, cidrs: DataFrame, order: Column, kept: list[str], how: str, slab_rows: int) -> DataFrame:
    """Each address with the least network by ``order`` of those that hold it; networks nest, so a sweep meets each once."""
    found = sweep.containing(ips, _as_ranges(cidrs), slab_rows)
    best = found.groupBy("ip_key").agg(F.min_by(F.struct(*kept), order).alias("_m")).select("ip_key", "_m.*")
    return ips.join(best, "ip_key", how)


def longest_prefix_join(ips: DataFrame, cidrs: DataFrame, how: str = "inner",
                        slab_rows: int = sweep.SLAB_ROWS) -> DataFrame:
    """Each address with the most specific network (``net_key``, ``bits``, 0 to 128) that holds it.

    Of several rows on one network a whole row counts, the least by its columns in order.
    """
    rest = [c for c in cidrs.columns if c not in ("net_key", "bits")]
    order = F.struct((-F.col("bits")).alias("narrow"), *rest)
    return _first_prefix(ips, cidrs, order, ["net_key", "bits", *rest], how, slab_rows)


def priority_prefix_join(ips: DataFrame, lists: DataFrame, how: str = "inner",
                         slab_rows: int = sweep.SLAB_ROWS) -> DataFrame:
    """First list in priority order that holds the address, with its most specific network.

    ``lists`` has ``net_key, bits, source, priority``.
    """
    order = F.struct(F.col("priority"), (-F.col("bits")).alias("narrow"), F.col("source"))
    return _first_prefix(ips, lists, order, ["net_key", "bits", "source", "priority"], how, slab_rows)


def needs_fact(domains: DataFrame, facts: DataFrame, source: str, as_of: str) -> DataFrame:
    """Names without a fact of the source, or with an expired one."""
    fresh = facts.where((F.col("source") == source)
                        & (F.col("expires_at") > F.lit(as_of).cast("timestamp"))).select("name")
    return domains.join(fresh, "name", "left_anti")


def list_flags(df: DataFrame, entries: DataFrame, column: str, out: str) -> DataFrame:
    """Add a boolean: is the value of ``column`` a listed name?"""
    listed = entries.select(F.col("domain").alias(column)).distinct().withColumn(out, F.lit(True))
    return df.join(listed, column, "left").fillna(False, [out])


def membership(names: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """List membership of names with source name and category."""
    return (names.join(entries, names["name"] == entries["domain"])
            .join(sources, "source_id", "left")
            .select("name", "source_id", "source_name", "category"))


def rank_of(df: DataFrame, ranks: DataFrame, key: str = "etld1") -> DataFrame:
    found = ranks.select(F.col("domain").alias(key), "rank")
    return df.join(found, key, "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


__all__ = ["band_join", "interval_join", "list_flags", "longest_prefix_join",
           "membership", "needs_fact", "priority_prefix_join", "range_join", "rank_of", "with_hot"]
