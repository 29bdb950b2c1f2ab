"""Addresses in ranges by a sorted sweep over slabs of the address space.

Addresses and range borders are cut into slabs of about equal numbers of keys.  A range is filed under every slab it reaches into, so
what is open at the border of a slab is carried over; for ranges that do not overlap that adds one row per border.
Each slab is one group: its ranges are laid into layers without overlap, and every layer answers all addresses of the slab by one
binary search.  The cuts only say who works where; they are taken from a hash sample of the keys and no result depends on them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dnslake.session import cut_lineage

#: Keys of a slab, most slabs, and sampled keys per slab.
SLAB_ROWS = 250_000
MOST_SLABS = 4096
_SAMPLED = 32


def cut_points(keys: DataFrame, slab_rows: int = SLAB_ROWS) -> list[str]:
    """Keys that cut ``keys`` (one column, key) into slabs: at most ``MOST_SLABS`` strings."""
    slabs = min(MOST_SLABS, math.ceil(keys.count() / slab_rows))
    if slabs < 2:
        return []
    one_in = max(1, slab_rows // _SAMPLED)
    sample = sorted(r.key for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).distinct().collect())
    return sorted({sample[len(sample) * i // slabs] for i in range(1, slabs)}) if sample else []


def slab_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at or below the key: a binary search in expressions."""
    if not cuts:
        return F.lit(0)
    table, steps = F.array(*[F.lit(c) for c in cuts]), [1 << b for b in reversed(range(len(cuts).bit_length()))]

    def step(at: Column, size: Column) -> Column:
        there = at + size
        return F.when((there <= len(cuts)) & (F.get(table, there - 1) <= key), there).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def layers(start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranges (numbers from 0, by ascending start) as layers without overlap."""
    left, found = np.arange(len(start)), []
    while len(left):
        reach = np.maximum.accumulate(end[left])
        if len(left) == 1 or (start[left][1:] > reach[:-1]).all():
            return [*found, left]
        keep, last = np.zeros(len(left), bool), -1
        for i, (s, e) in enumerate(zip(start[left].tolist(), end[left].tolist())):
            if s > last:
                keep[i], last = True, e
        found.append(left[keep])
        left = left[~keep]
    return found


def _ranks(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Keys as their places among all keys of these columns."""
    texts = [c.to_numpy().astype("S32") for c in columns]
    place = np.unique(np.concatenate(texts), return_inverse=True)[1]
    return np.split(place, np.cumsum([len(t) for t in texts])[:-1])


def containing(ips: DataFrame, ranges: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Every distinct address (ip_key) with the other columns of each range that holds it.

    ``ranges`` has start_key and end_key, both included.  Ranges may overlap.
    """
    names = [c for c in ranges.columns if c not in ("start_key", "end_key")]
    ips = cut_lineage(ips.select("ip_key").where("ip_key is not null").distinct())
    usable = ranges.where("start_key <= end_key").select("start_key", "end_key", F.struct(*names, F.lit(0).alias("_")).alias("_row"))
    cuts = cut_points(ips.select(F.col("ip_key").alias("key")).unionAll(usable.select("start_key")), slab_rows)
    slabbed = usable.withColumn("_slab", F.explode(F.sequence(
        slab_of(F.col("start_key"), cuts), slab_of(F.col("end_key"), cuts))))
    probes = ips.select("ip_key", slab_of(F.col("ip_key"), cuts).alias("_slab"))
    schema = StructType([StructField("ip_key", StringType()), usable.schema["_row"]])

    def sweep(key, addresses, spans):
        table = spans.sort_by([("start_key", "ascending"), ("end_key", "descending")])
        start, end, asked = _ranks(table.column("start_key"), table.column("end_key"), addresses.column("ip_key"))
        rows, hits = [], []
        for layer in layers(start, end):
            at = np.searchsorted(start[layer], asked, side="right") - 1
            inside = np.flatnonzero((at >= 0) & (asked <= end[layer][np.maximum(at, 0)]))
            rows.append(inside)
            hits.append(layer[at[inside]])
        none = np.zeros(0, np.int64)
        return pa.table({"ip_key": addresses.column("ip_key").take(pa.array(np.concatenate(rows or [none]))),
                         "_row": table.column("_row").take(pa.array(np.concatenate(hits or [none])))})

    found = probes.groupBy("_slab").cogroup(slabbed.groupBy("_slab")).applyInArrow(sweep, schema)
    return found.select("ip_key", *[F.col("_row")[c].alias(c) for c in names])
