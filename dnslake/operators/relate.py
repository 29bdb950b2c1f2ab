"""The graph of relations between names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions.names import normalize_host
from dnslake.operators.joins import band_join, hot_cells
from dnslake.operators.networks import group_pairs, in_company, memberships, shared_degree, sharing
from dnslake.session import cut_lineage

#: Where an edge of a network is made: the number of the network and the shares of its two ends.
PLACE = ["_group", "_low", "_high"]

#: Spellings accepted for a relation kind.
KIND_ALIASES = {"cname": "cname_to", **{k: k for k in refdata.RELATION_KINDS}}


def kinds_of(kinds: list[str] | None) -> list[str]:
    return [KIND_ALIASES[k] for k in kinds] if kinds else list(refdata.RELATION_KINDS)


def busy_keys(events: DataFrame, key: str = "name", at_least: int = 5) -> DataFrame:
    return (events.groupBy(key).agg(F.count("*").alias("_n"))
            .where(F.col("_n") >= at_least).select(key))


def co_occurrence_counts(events: DataFrame, key: str = "name", gap: int = 3, min_count: int = 3,
                         client: str = "client_id", busy: int = 1, ordered: bool = True,
                         rows_per_task: int = 100_000) -> DataFrame:
    """How often two keys meet: one client, the second key 1..``gap`` seconds after the first.

    ``ordered`` counts a pair only when the lesser key comes first; otherwise both orders count.
    Events collapse to one row per (client, key, second) with a count, so a pair of rows stands for
    many pairs of events.  ``busy`` above 1 leaves out keys with fewer events; by default all count.
    That table is written once; the log is not read again for the two sides of the join.
    """
    recent = events.join(busy_keys(events, key, busy), key, "left_semi") if busy > 1 else events
    cells = (recent.groupBy(client, key, F.unix_seconds("occurred_at").alias("_t"))
             .agg(F.count("*").alias("_n")))
    cells = cut_lineage(cells)
    hot = hot_cells(cells, [client], "_t", gap, rows_per_task)
    left = cells.select(client, F.col(key).alias("a"), F.col("_n").alias("_na"), "_t")
    right = cells.select(client, F.col(key).alias("b"), F.col("_n").alias("_nb"), "_t")
    residual = F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b")
    pairs = band_join(left, right, [client], "_t", gap, residual,
                      None if hot.isEmpty() else hot)
    return (pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.sum(F.col("_na") * F.col("_nb")).alias("n")).where(F.col("n") >= min_count))


def npmi(pairs: DataFrame, totals: DataFrame, key: str = "name") -> DataFrame:
    """Normalised pointwise mutual information of pairs, kept where positive, at most 1.

    ``totals`` holds (key, total); the grand total is a scalar subquery.
    """
    share = pairs.withColumn("_grand", totals.agg(F.sum("total")).scalar())
    for side in ("a", "b"):
        share = share.join(totals.select(F.col(key).alias(side), F.col("total").alias(f"_{side}")),
                           side)
    pa, pb = F.col("_a") / F.col("_grand"), F.col("_b") / F.col("_grand")
    pab = F.col("n") / F.col("_grand")
    bound = -F.log2(pab)
    strength = F.when(bound > 0, F.log2(pab / (pa * pb)) / bound)
    return (share.withColumn("strength", F.least(strength, F.lit(1.0)))
            .where(F.col("strength") > 0).select("a", "b", "n", "strength"))


def co_occurrence_edges(events: DataFrame, gap: int = 3, min_count: int = 3, key: str = "name",
                        **how) -> DataFrame:
    pairs = co_occurrence_counts(events, key, gap, min_count, **how)
    totals = events.groupBy(key).agg(F.count("*").alias("total"))
    scored = npmi(pairs, totals, key)
    return mirrored(scored.select(
        F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("co_occurs").alias("kind"),
        "strength", F.to_json(F.struct(F.col("n").alias("count"))).alias("detail")))


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges with both directions for the undirected kinds; no self loops."""
    there = F.struct("from_id", "to_id")
    back = F.struct(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    ways = F.when(F.col("kind") == "cname_to", F.array(there)).otherwise(F.array(there, back))
    return (edges.where(F.col("from_id") != F.col("to_id")).withColumn("_way", F.explode(ways))
            .select("_way.from_id", "_way.to_id", "kind", "strength", "detail"))


def upsert_edges(base: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-update in one shuffle: a new edge wins over the base, the strongest new one over the others.

    Keys are mostly single, so rows are dealt by key first and sorted once, not on both sides of the shuffle.  Where both
    sides have the columns ``PLACE``, edges with a place are merged in the task that makes them, without a shuffle.  A key
    must have one place, or none, on both sides, so both have to come from one call of :func:`same_asn_edges`.
    """
    if not set(PLACE) <= set(base.columns) & set(new.columns):
        return _merged(base, new)
    placed = F.col("_group").isNotNull()
    return _merged(base.where(placed), new.where(placed), PLACE).unionByName(_merged(base.where(~placed), new.where(~placed)))


def _merged(base: DataFrame, new: DataFrame, place: list[str] | None = None) -> DataFrame:
    keys, place = ["from_id", "to_id", "kind"], place or []
    old = base.select(*keys, *place, "strength", "detail", F.lit(False).alias("_new"))
    ups = new.where(F.col("from_id") != F.col("to_id")).select(
        *keys, *place, "strength", F.when(F.col("strength").isNotNull(), F.col("detail")).alias("detail"),
        F.lit(True).alias("_new"))
    rank = F.struct("_new", F.when(F.col("_new"), F.col("strength").cast("double")))
    rows = old.unionByName(ups)
    return ((rows if place else rows.repartition(*keys)).groupBy(*keys, *place)
            .agg(F.max_by(F.struct("strength", "detail"), rank).alias("_e"))
            .select(*keys, "_e.*"))


def replace_kind(base: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """A full recompute of one kind: its old edges go."""
    return base.where(F.col("kind") != kind).unionByName(new)


def cname_edges(dns: DataFrame) -> DataFrame:
    """One edge per hop of ``(name, cname_chain)``; empty hops and the name itself are skipped."""
    hops = F.filter(
        F.transform("cname_chain", lambda h: F.regexp_replace(F.lower(h), r"\.$", "")),
        lambda h: (h != "") & (h != F.col("name")))
    pairs = (dns.withColumn("_hops", hops).where(F.size("_hops") > 0)
             .withColumn("_p", F.explode(F.arrays_zip(
                 F.concat(F.array("name"), F.slice("_hops", 1, F.size("_hops") - 1)).alias("f"),
                 F.col("_hops").alias("t")))))
    detail = F.to_json(F.struct(F.size("cname_chain").alias("chain_position")))
    return (pairs.select(F.col("_p.f").alias("from_id"), F.col("_p.t").alias("to_id"),
                         F.lit("cname_to").alias("kind"), F.lit(1.0).alias("strength"),
                         detail.alias("detail"))
            .where(F.col("from_id") != F.col("to_id"))
            .dropDuplicates(["from_id", "to_id", "kind"]))


def same_asn_edges(asn: DataFrame, largest: int | None = None, placed: bool = False) -> DataFrame:
    """Names that share a network, both directions; neutral networks are left out.

    Groups of any size are enumerated block by block (see :mod:`dnslake.operators.networks`); ``largest`` leaves out
    networks with more names.  Degrees and neighbours need no edges: they come from the memberships.  With ``placed``
    the columns ``PLACE`` tell where an edge is made, null for names that share several networks.
    """
    members = memberships(asn)
    if largest is not None:
        members = members.join(members.groupBy("asn").agg(F.count("*").alias("_n")).where(F.col("_n") <= largest),
                               "asn", "left_semi")
    detail = F.to_json(F.struct("asn"))
    several = members.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("name")
    if several.isEmpty():
        return _as_edges(group_pairs(members, "asn", "name", both_ways=True, detail=detail, placed=placed), placed)
    # Only two names that are both in several networks can share more than one, so only their pairs are grouped.
    members = members.join(several.withColumn("_several", F.lit(True)), "name", "left").select(
        "name", "asn", F.coalesce("_several", F.lit(False)).alias("_several"))
    once = group_pairs(members, "asn", "name", both_ways=True, detail=detail, apart="_several", placed=placed)
    shared = group_pairs(members.where("_several"), "asn", "name").groupBy("a", "b").agg(F.max("asn").alias("asn"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    shared = shared.select("asn", F.explode(ways).alias("_w"), detail.alias("detail")).select("asn", "_w.a", "_w.b", "detail")
    return _as_edges(once, placed).unionByName(_as_edges(shared), allowMissingColumns=True)


def _as_edges(pairs: DataFrame, placed: bool = False) -> DataFrame:
    place = [F.col(c).alias(p) for c, p in zip(["asn", "_low", "_high"], PLACE, strict=True)] if placed else []
    return pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("same_asn").alias("kind"),
                        F.lit(1.0).alias("strength"), "detail", *place)


def same_cert_edges(cert: DataFrame) -> DataFrame:
    """A name and every other name on its certificate, both directions."""
    san = normalize_host(F.col("_san"))
    pairs = (cert.select("name", F.explode("sans").alias("_san")).withColumn("_san", san)
             .where((F.col("_san") != "") & (F.col("_san") != F.col("name"))
                    & ~F.col("_san").rlike(r"[ \t]"))
             .select(F.col("name").alias("from_id"), F.col("_san").alias("to_id"),
                     F.lit("same_cert").alias("kind"), F.lit(1.0).alias("strength"),
                     F.lit(None).cast("string").alias("detail")))
    return mirrored(pairs).dropDuplicates(["from_id", "to_id", "kind"])


def related_names(edges: DataFrame, domains: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """End points that are no known names yet; they enter with origin ``related``.

    With ``members`` (name, asn) the ends of shared networks come from their memberships.
    """
    ends = edges.select(F.col("to_id").alias("name"))
    if members is not None:
        ends = ends.unionByName(in_company(members))
    return (ends.distinct().join(domains.select("name"), "name", "left_anti")
            .withColumn("origin", F.lit("related")).withColumn("status", F.lit("new")))


def chosen(relations: DataFrame, kinds: list[str] | None, min_strength: float) -> DataFrame:
    return relations.where(F.col("kind").isin(kinds_of(kinds))
                           & (F.col("strength") >= min_strength))


def chosen_members(members: DataFrame | None, kinds: list[str] | None, min_strength: float) -> DataFrame | None:
    """The memberships, where edges of shared networks (strength 1) are wanted."""
    return members if "same_asn" in kinds_of(kinds) and min_strength <= 1.0 else None


def both_directions(relations: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Distinct (id, other, kind) over both directions.

    With ``members`` (name, asn) the pairs of shared networks, which are distinct, join without a shuffle, and
    ``relations`` needs no edge of them.
    """
    ways = F.array(F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("other")),
                   F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    found = (relations.select("kind", F.explode(ways).alias("_way"))
             .select("_way.id", "_way.other", "kind").distinct())
    if members is None:
        return found
    return found.unionByName(same_asn_edges(members).select(
        F.col("from_id").alias("id"), F.col("to_id").alias("other"), "kind"))


def degree(relations: DataFrame, kinds: list[str] | None = None, min_strength: float = 0.0,
           members: DataFrame | None = None) -> DataFrame:
    """Neighbours of each name, counted once per kind.

    With ``members`` (name, asn) shared networks count from their memberships, and ``relations`` needs no edge of them.
    """
    counted = (both_directions(chosen(relations, kinds, min_strength))
               .groupBy("id").agg(F.count("*").alias("degree")))
    return _with_shared(counted, chosen_members(members, kinds, min_strength))


def _with_shared(counted: DataFrame, members: DataFrame | None) -> DataFrame:
    if members is None:
        return counted
    shared = shared_degree(members).select(F.col("name").alias("id"), "degree")
    return counted.unionByName(shared).groupBy("id").agg(F.sum("degree").alias("degree"))


def network_totals(relations: DataFrame, kinds: list[str] | None = None,
                   min_strength: float = 0.0, min_degree: int = 1,
                   outgoing_only: bool = False, members: DataFrame | None = None) -> DataFrame:
    """Nodes with at least the degree, and edges.  ``outgoing_only`` counts degrees one way.

    With ``members`` (name, asn) shared networks count from their memberships: a name has as many edges out as others
    share a network with it.
    """
    edges = chosen(relations, kinds, min_strength)
    members = chosen_members(members, kinds, min_strength)
    deg = (_with_shared(edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("degree")), members)
           if outgoing_only else degree(relations, kinds, min_strength, members))
    nodes = deg.agg(F.count_if(F.col("degree") >= max(min_degree, 1)).alias("total_nodes"))
    total = edges.agg(F.count("*")).scalar()
    if members is not None:
        total = total + shared_degree(members).agg(F.coalesce(F.sum("degree"), F.lit(0))).scalar()
    return nodes.select("total_nodes", total.alias("total_edges"))


def neighbours(relations: DataFrame, domains: DataFrame, name: str,
               kinds: list[str] | None = None, min_strength: float = 0.0,
               k: int = 60, members: DataFrame | None = None) -> DataFrame:
    """Strongest edges of one name, with the status of the other end.

    One row more than ``k`` tells that the answer is truncated.  With ``members`` (name, asn) the names of its shared
    networks come from the memberships, and ``relations`` needs no edge of them.
    """
    edges = (chosen(relations, kinds, min_strength).where(F.col("from_id") == name)
             .select("from_id", "to_id", "kind", "strength"))
    members = chosen_members(members, kinds, min_strength)
    if members is not None:
        edges = edges.unionByName(sharing(members, name).select(
            F.lit(name).alias("from_id"), F.col("name").alias("to_id"), F.lit("same_asn").alias("kind"),
            F.lit(1.0).alias("strength")))
    return (edges.join(domains.select(F.col("name").alias("to_id"), "status", "category"), "to_id")
            .select("from_id", "to_id", "kind", "strength", "status", "category")
            .orderBy(F.desc("strength"), "to_id", "kind").limit(k + 1))


def network(relations: DataFrame, domains: DataFrame, kinds: list[str] | None = None,
            statuses: list[str] | None = None, min_strength: float = 0.0, min_degree: int = 1,
            k: int = 300, most_edges: int | None = None,
            members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best connected names and all edges among them.

    ``most_edges`` keeps the strongest so many and one more, which tells that edges were left out.  With ``members``
    (name, asn) degrees in shared networks come from the memberships, and only the pairs of the best connected
    names are made.
    """
    nodes = domains.join(degree(relations, kinds, min_strength, members),
                         F.col("name") == F.col("id")).drop("id")
    nodes = nodes.where(F.col("degree") >= max(min_degree, 1))
    if statuses:
        nodes = nodes.where(F.col("status").isin(statuses))
    top = (nodes.select("name", "etld1", "status", "category", "degree", "query_count")
           .orderBy(F.desc("degree"), F.desc("query_count"), "name").limit(k))
    names = top.select("name")
    edges = chosen(relations, kinds, min_strength).select("from_id", "to_id", "kind", "strength")
    members = chosen_members(members, kinds, min_strength)
    if members is not None:
        names = cut_lineage(names)
        edges = edges.unionByName(same_asn_edges(members.join(names, "name", "left_semi")).drop("detail"))
    edges = (edges.join(names.withColumnRenamed("name", "from_id"), "from_id", "left_semi")
             .join(names.withColumnRenamed("name", "to_id"), "to_id", "left_semi")
             .select("from_id", "to_id", "kind", "strength")
             .orderBy(F.desc("strength"), "from_id", "to_id", "kind"))
    return top, edges if most_edges is None else edges.limit(most_edges + 1)
