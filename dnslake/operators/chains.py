"""Following pointers of any length by pointer doubling.

Every host points to at most one other.  A walk of length 2k is a walk of length k followed by the walk of length k
from its end, so each round joins the walks with themselves and all walks are complete after a number of
rounds that grows with the logarithm of the longest.  Loops are found first, from the ends of walks alone: hosts on loops are
those that remain as ends when neither the number of open walks nor of their ends shrinks any more.  Each loop is cut
before its least member, which leaves a forest, whose walks are then put together with their hosts; a walk that enters a
loop gets the part behind the cut put on.  Walks that have ended are not joined again, for they have no end to join by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslake.session import cut_lineage

_MOST_ROUNDS = 64

#: Hosts on the walks of one task, about; bounds the memory of sorting them.
_HOSTS_PER_TASK = 2_000_000


def _loop_ends(steps: DataFrame) -> DataFrame | None:
    """The hosts on loops as (at), from the ends of open walks (at, end); None if all walks end."""
    walks, before = steps.select("at", F.col("to").alias("end")), None
    for _ in range(_MOST_ROUNDS):
        ahead = walks.select(F.col("at").alias("end"), F.col("end").alias("_end"))
        walks = cut_lineage(walks.join(ahead, "end").select("at", F.col("_end").alias("end")))
        now = walks.agg(F.count("end"), F.count_distinct("end")).first()
        if now[0] == 0:
            return None
        if now == before:
            return walks.select(F.col("end").alias("at")).distinct()
        before = now
    raise RuntimeError("walks did not settle")


def _dealt(walks: DataFrame, key: str, hosts: int) -> DataFrame:
    """Walks by key over as many tasks as their hosts need, where the session has fewer."""
    tasks = hosts // _HOSTS_PER_TASK
    return walks.repartition(tasks, key) if tasks > int(walks.sparkSession.conf.get("spark.sql.shuffle.partitions")) else walks


def _completed(forest: DataFrame) -> tuple[DataFrame, int]:
    """Whole walks (at, entry, head, path) of a forest of steps (at, end, entry, head, path), and their hosts."""
    walks = cut_lineage(forest)
    ended, hosts_ended = [], 0
    for _ in range(_MOST_ROUNDS):
        is_open = F.col("end").isNotNull()
        count = walks.agg(F.count("end"), F.sum(F.when(is_open, F.size("path"))),
                          F.sum(F.when(~is_open, F.size("path")))).first()
        ended.append(walks.where(~is_open))
        hosts_ended += count[2] or 0
        if count[0] == 0:
            return reduce(DataFrame.unionByName, ended).drop("end"), hosts_ended
        walks = walks.where(is_open)
        hosts = hosts_ended + (count[1] or 0)
        ahead = reduce(DataFrame.unionByName, [walks, *ended]).select(
            F.col("at").alias("end"), *[F.col(c).alias(f"_{c}") for c in ("end", "entry", "head", "path")])
        walks = cut_lineage(_dealt(walks, "end", hosts).join(_dealt(ahead, "end", hosts), "end", "left").select(
            "at", F.col("_end").alias("end"), F.coalesce("entry", "_entry").alias("entry"),
            F.coalesce("head", "_head").alias("head"),
            F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path")))
    raise RuntimeError("walks did not settle")


def _loop_heads(loop: DataFrame) -> DataFrame:
    """(at, head) of the hosts on loops; head is the least member.  ``loop`` has (at, to)."""
    state = loop.select("at", F.col("to").alias("end"), F.least("at", "to").alias("head"))
    for _ in range(_MOST_ROUNDS):
        ahead = state.select(F.col("at").alias("end"), F.col("end").alias("_end"), F.col("head").alias("_head"))
        state = cut_lineage(state.join(ahead, "end").select(
            "at", F.col("_end").alias("end"), F.least("head", "_head").alias("head"),
            (F.col("_head") < F.col("head")).alias("_lower")))
        if state.where("_lower").isEmpty():
            return state.select("at", "head")
        state = state.drop("_lower")
    raise RuntimeError("loops did not settle")


def walks(steps: DataFrame) -> DataFrame:
    """(at, path, looped): the hosts that follow ``at``, up to the last or up to the first seen again.

    ``steps`` has (at, to), one row per host at most; a host that points to itself has no path.
    """
    steps = cut_lineage(steps.where("at <> to").select("at", "to"))
    none = F.lit(None).cast("string")
    ends = _loop_ends(steps)
    if ends is None:
        done, _ = _completed(steps.select("at", F.col("to").alias("end"), none.alias("entry"), none.alias("head"),
                                          F.array("to").alias("path")))
        return done.select("at", "path", F.lit(False).alias("looped"))
    on_loop = cut_lineage(_loop_heads(steps.join(ends, "at", "left_semi")))
    target = on_loop.select(F.col("at").alias("to"), F.col("head").alias("_target"))
    # The step from a loop's last host back to its least member goes; hosts on loops and steps into them are remembered.
    steps = steps.join(on_loop, "at", "left").join(target, "to", "left")
    back = F.coalesce((F.col("to") == F.col("head")) & (F.col("_target") == F.col("head")), F.lit(False))
    forest = steps.select(
        "at", F.when(~back, F.col("to")).alias("end"),
        F.when(F.col("head").isNotNull(), F.col("at")).when(F.col("_target").isNotNull(), F.col("to")).alias("entry"),
        F.coalesce("head", "_target").alias("head"),
        F.when(back, F.array().cast("array<string>")).otherwise(F.array("to")).alias("path"))
    done, hosts = _completed(forest)
    looped = F.col("head").isNotNull()
    cycle = done.where("at = head").select("head", F.concat(F.array("at"), "path").alias("_cycle"))
    rest = F.slice("_cycle", F.lit(1), F.array_position("_cycle", F.col("entry")).cast("int") - 1)
    whole = _dealt(done.where(looped), "head", hosts).join(_dealt(cycle, "head", hosts), "head").select(
        "at", F.concat("path", rest).alias("path"), F.lit(True).alias("looped"))
    return whole.unionByName(done.where(~looped).select("at", "path", F.lit(False).alias("looped")))
