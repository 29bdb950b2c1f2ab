"""An index of letter triples for searches inside names.

``build`` writes (gram, name) sorted by gram into shards by a hash of the gram, and the number of names of each gram.  A
search takes the triples that any match must contain, reads the postings of the rarest few of them (shards are folders, so
others are not opened; inside a shard file statistics skip other grams), intersects them by one aggregation and verifies
the names that are left.  Names shorter than three letters are kept in a shard of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslake.operators.search import search

SHARDS = 64
#: Postings that a search intersects at most.
RAREST = 4
_SHORT = ""


def shard_of(gram: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(shards)).cast("int")


def grams_of(name: Column) -> Column:
    """Distinct triples of a name; names without any have the empty gram."""
    count = F.char_length(name) - 2
    triples = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(name, i, F.lit(3)))
    return F.when(count >= 1, F.array_distinct(triples)).otherwise(F.array(F.lit(_SHORT)))


def build(names: DataFrame, path: str, name: str = "name", shards: int = SHARDS) -> None:
    """Writes the index of the distinct lower-case names under ``path``."""
    spark = names.sparkSession
    low = names.select(F.lower(name).alias("name")).where("name is not null").distinct()
    rows = low.select("name", F.explode(grams_of(F.col("name"))).alias("gram")).withColumn("shard", shard_of(F.col("gram"), shards))
    # A frequent gram is sorted over several tasks: range borders take the name in, too.
    rows.repartitionByRange("shard", "gram", "name").sortWithinPartitions("shard", "gram", "name").write.partitionBy(
        "shard").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram", "shard").agg(F.count("*").alias("n")).write.parquet(f"{path}/grams")


def required(q: str) -> list[str]:
    """Literal parts of three or more letters that every match of a search contains; none if that cannot be told.

    For ``/regex/`` only plain patterns count: without alternatives, options and back references, and letters that a
    quantifier may drop are left out.
    """
    q = q.strip()
    if len(q) > 2 and q.startswith("/") and q.endswith("/"):
        pattern, parts, now, i = q[1:-1], [], "", 0
        if re.search(r"[|\\]\w|\(\?|\||\\[1-9]|\\Q", pattern):
            return []
        depth = 0
        while i < len(pattern):
            c = pattern[i]
            literal, width = None, 1
            if c == "\\":
                literal, width = pattern[i + 1: i + 2], 2
            elif c == "[":
                end = i + 1 + (pattern[i + 1: i + 2] == "^")
                end = pattern.find("]", end + (pattern[end: end + 1] == "]"))
                if end < 0 or "[" in pattern[i + 1: end] or "\\" in pattern[i + 1: end]:
                    return []
                single = pattern[i + 1: end]
                literal, width = (single if len(single) == 1 and single != "^" else None), end - i + 1
            elif c in "()":
                depth += 1 if c == "(" else -1
            elif c not in "^$.*+?{}":
                literal = c
            following = pattern[i + width: i + width + 1]
            if c in "()" or depth:
                literal = None  # a group may be optional
            if literal is None or following in ("*", "?", "{"):
                parts, now = [*parts, now], ""
            else:
                now += literal
                if following == "+":
                    parts, now = [*parts, now], ""
            i += width
            if c in "{":
                i = pattern.find("}", i) + 1 or len(pattern)
        parts.append(now)
        # Names are lower case, so a pattern's capital letter matches none of their letters.
        return [p for p in parts if len(p) >= 3]
    q = q.lower()
    part = q[2:] if q.startswith("*.") else q
    return [part] if len(part) >= 3 else []


def find(spark: SparkSession, path: str, q: str, rarest: int = RAREST, shards: int = SHARDS) -> DataFrame:
    """(name) of the indexed names that :func:`dnslake.operators.search.search` finds; all are read only if the
    search has no literal part."""
    postings = spark.read.parquet(f"{path}/postings")
    wanted = sorted({part[i: i + 3] for part in required(q) for i in range(len(part) - 2)})
    if not wanted:
        return search(postings.select("name").distinct(), q)
    known = {r.gram: r for r in spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted)).collect()}
    if len(known) < len(wanted):
        return search(postings.select("name").where(F.lit(False)), q)  # some triple occurs nowhere
    few = sorted(known.values(), key=lambda r: (r.n, r.gram))[:rarest]
    rows = postings.where(F.col("shard").isin(sorted({r.shard for r in few})) & F.col("gram").isin([r.gram for r in few]))
    both = rows.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") == len(few)).select("name")
    return search(both, q)
