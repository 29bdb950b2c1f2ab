"""Comparing public lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_overlap(entries: DataFrame) -> DataFrame:
    """Shared names and Jaccard index per pair of sources.

    A name holds at most one row per source; its pairs are counted by an equality self join on the
    distinct (source, name) rows.
    """
    rows = entries.select("source_id", "domain").distinct()
    size = rows.groupBy("source_id").agg(F.count("*").alias("n"))
    pairs = (rows.select(F.col("source_id").alias("a"), "domain")
             .join(rows.select(F.col("source_id").alias("b"), "domain"), "domain")
             .where(F.col("a") < F.col("b"))
             .groupBy("a", "b").agg(F.count("*").alias("shared")))
    return (pairs.join(size.select(F.col("source_id").alias("a"), F.col("n").alias("_na")), "a")
            .join(size.select(F.col("source_id").alias("b"), F.col("n").alias("_nb")), "b")
            .select("a", "b", "shared",
                    (F.col("shared") / (F.col("_na") + F.col("_nb") - F.col("shared")))
                    .alias("jaccard")))


def only_in_one_source(entries: DataFrame) -> DataFrame:
    """Entries no other source has; one shuffle."""
    return (entries.groupBy("domain").agg(
        F.min("source_id").alias("source_id"), F.max("source_id").alias("_max"))
        .where(F.col("source_id") == F.col("_max")).select("source_id", "domain"))


def source_unique(entries: DataFrame) -> DataFrame:
    """Per source, how many of its entries no other source has."""
    return (only_in_one_source(entries).groupBy("source_id")
            .agg(F.count("*").alias("unique_entries")))
