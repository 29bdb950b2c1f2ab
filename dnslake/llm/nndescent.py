"""Near-duplicate vectors by NN-descent, with saturated lists enlarged and recall audited.

A neighbour list of every vector starts from small groups of a forest of random sign projections.  A round of
descent gathers, around each vector, its neighbours and those that have it as neighbour, compares them with
one another, and keeps what improves a list.  A list holds ``k`` neighbours; where all of them are links
(cosine at the threshold or more) it is saturated and may hold twice as many links in the next round, up
to ``k * 2**enlarge``.  Rounds go on until the number of links settles.  The number of trees grows with the rows, so
that a pair at the threshold shares a leaf as often in a large table as in a small one.  Then an audit compares a
bounded sample of vectors with all rows: half of it from small components and single vectors, half from large ones.
Recall is the mean share of its own links that a vector has, the lower one of the two halves, so dense groups do not
hide pairs that are missed elsewhere.  While it is below ``recall``, more trees and rounds follow; if that does
not help, all components are compared block against block, which is exact and takes work with the square of the rows.

Lists are bounded, links are not: every comparison also gives out a spanning forest of the links it sees, and these
edges stay however short the lists are.  They give the components, so a weak bridge between two dense groups counts.
Where a leaf or the surroundings of a hub are dealt over shares, members of different components are compared
across the shares as well, block against block.  As a dense component can have more links per vector than any list
should hold, links are counted inside components, block against block; only counts leave a task.

Equal vectors are one class with a weight, so a vector that stands in a third of all rows is one row here.
Large groups (a leaf, the surroundings of a hub, a component) are dealt over shares of bounded size.

Defined cases: null, empty, zero vectors, vectors with null or non-finite components, and vectors of another
length than the most frequent one link with nothing; rows of equal id are vectors of their own; a null id
counts as a vector but never names a component unless alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dnslake.llm.components import connected_components
from dnslake.llm.frames import grouped
from dnslake.llm.minhash import _tree
from dnslake.session import cut_lineage

THRESHOLD = 0.95
K = 12
LEAF = 48
TREES = 12
ENLARGE = 3
HUB = 128
BLOCK = 512
EXACT_BLOCK = 2048
#: How often a pair at the threshold may be in no leaf together.
MISS = 0.01
AUDIT = 2048
RECALL = 0.98
MAX_ROUNDS = 6
_EDGE = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("sim", pa.float64()), ("tree", pa.bool_())])
_EDGE_SQL = "v long, w long, sim double, tree boolean"


def _matrix(rows, name: str = "vec") -> np.ndarray:
    column = rows.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :])


def usable(vector: str = "embedding"):
    """Vectors that can link: finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(rows: DataFrame) -> DataFrame:
    """node, id (smallest vec_id), n (equal vectors) and vec of every class of equal usable vectors."""
    good = rows.where(usable()).select("vec_id", "embedding")
    common = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return good.select(F.lit(0).cast("long").alias("node"), F.col("vec_id").cast("long").alias("id"),
                           F.lit(1).cast("long").alias("n"), F.col("embedding").alias("vec"))
    return (good.where(F.size("embedding") == common["dim"]).groupBy(F.col("embedding").alias("vec"))
            .agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n"))
            .select(F.xxhash64("vec", "id").alias("node"), "id", "n", "vec"))


def _bits(count: int) -> int:
    return max(1, min(60, math.ceil(math.log2(max(2, count / LEAF)))))


def _trees(count: int, threshold: float) -> int:
    """So many trees that a pair at the threshold shares a leaf with a chance of 1 - MISS; TREES at least."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** _bits(count)
    return TREES if together >= 1 else max(TREES, math.ceil(math.log(MISS) / math.log1p(-max(together, 1e-4))))


def _leaves(vectors: DataFrame, count: int, dim: int, trees: int, seed: int) -> DataFrame:
    """g (leaf share), node, vec: every vector once per tree."""
    bits = _bits(count)
    planes = np.random.default_rng(seed).standard_normal((dim, trees * bits))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch) @ planes > 0
            codes = (x.reshape(len(x), trees, bits) * weight).sum(2)
            offsets = np.arange(0, (len(x) + 1) * trees, trees, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("vec"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))], ["node", "vec", "codes"])

    coded = vectors.select("node", "vec").mapInArrow(code, "node long, vec array<float>, codes array<bigint>")
    spread = coded.select("node", "vec", F.posexplode("codes").alias("tree", "code"))
    return _shares(spread, ["tree", "code"], LEAF * 2)


def _shares(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Gives rows of a key the group id g; keys with more than ``most`` rows are dealt over several groups."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    dealt = rows.join(large, keys, "left")
    share = F.when(F.col("__n").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64("node", *keys), F.ceil(F.col("__n") / most)))
    return dealt.withColumn("g", F.xxhash64(*keys, share.cast("long"))).drop("__n")


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that join all roots (``left`` of rows, ``right`` of columns) that links join."""
    i, j = np.nonzero(near & (left[:, None] != right[None, :]))
    if not len(i):
        return i, j
    names, at = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
    used = _tree(len(names), at[: len(i)], at[len(i):])
    return i[used], j[used]


def _compare(groups: DataFrame, k: int, threshold: float, with_floor: bool) -> DataFrame:
    """Edges between the members of each group: the best ``k`` of each member that are above what the member's list
    ends with, and (``tree``) a spanning forest of all links at the threshold between different roots."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in grouped(batches):
            node, root, x = rows.column("node").to_numpy(), rows.column("root").to_numpy(), _matrix(rows)
            floor = rows.column("floor").to_numpy() if with_floor else None
            found = [[], [], [], []]
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                if b - a < 2:
                    continue
                sim = _cosines(x[a:b], x[a:b])
                np.fill_diagonal(sim, -2)
                m = b - a
                take = np.zeros((m, m), bool)
                top = np.argpartition(-sim, min(k, m - 1) - 1, axis=1)[:, : min(k, m - 1)]
                np.put_along_axis(take, top, True, 1)
                if floor is not None:
                    take &= sim > floor[a:b, None]
                i, j = np.nonzero(take & (node[a:b, None] != node[None, a:b]))
                ti, tj = _forest(np.triu(sim >= threshold), root[a:b], root[a:b])
                found[0].append(node[a:b][np.concatenate([i, ti])])
                found[1].append(node[a:b][np.concatenate([j, tj])])
                found[2].append(np.concatenate([sim[i, j], sim[ti, tj]]))
                found[3].append(np.repeat([False, True], [len(i), len(ti)]))
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], schema=_EDGE)

    chosen = groups.select("g", "node", "root", "vec", *(["floor"] if with_floor else []))
    return chosen.repartition("g").sortWithinPartitions("g").mapInArrow(step, _EDGE_SQL)


def _across(rows: DataFrame, keys: list[str], known: DataFrame, threshold: float, most: int, block: int) -> DataFrame:
    """A spanning forest (as edges) of the links between different roots, in each key with more than ``most`` rows.

    The members of the most frequent root are not compared with one another, only with the rest, and the rest with itself.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys)
    held = rows.select(*keys, "node").join(large, keys, "left_semi").join(known.select("node", "root"), "node")
    shape = (held.groupBy(*keys, "root").agg(F.count("*").alias("n")).groupBy(*keys)
             .agg(F.count("*").alias("roots"), F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("top"))
             .where("roots > 1")
             .select(*keys, F.col("top.root").alias("major"), F.ceil(F.col("top.n") / block).cast("int").alias("majors"),
                     F.ceil((F.col("members") - F.col("top.n")) / block).cast("int").alias("minors")))
    hashed, all_blocks = F.xxhash64("node", F.lit(11)), F.col("majors") + F.col("minors") - 1
    dealt = (held.join(shape, keys)
             .withColumn("mine", F.when(F.col("root") == F.col("major"), F.pmod(hashed, F.col("majors")))
                         .otherwise(F.col("majors") + F.pmod(hashed, F.col("minors"))).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.when(F.col("root") == F.col("major"), F.col("majors")).otherwise(F.lit(0)),
                                                       all_blocks)))
             .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
             .select(F.xxhash64(*keys, "i", "j").alias("g"), (F.col("mine") == F.col("i")).alias("left"), "node")
             .join(known.select("node", "root", "vec"), "node"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in grouped(batches):
            node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
            left = rows.column("left").to_numpy(zero_copy_only=False).astype(bool)
            x = _matrix(rows)
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                first = np.arange(a, b)[left[a:b]]
                second = first if len(first) == b - a else np.arange(a, b)[~left[a:b]]
                sim = _cosines(x[first], x[second])
                i, j = _forest(sim >= threshold, root[first], root[second])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(node[first[i]]), pa.array(node[second[j]]), pa.array(sim[i, j]),
                                                      pa.array(np.ones(len(i), bool))], schema=_EDGE)

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(step, _EDGE_SQL)


def _best(edges: DataFrame, k: int, threshold: float, doublings: int) -> DataFrame:
    """The lists (``listed``): ``k`` per vector, more while they are links; and all edges of forests."""
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "w")
    ranked = edges.groupBy("v", "w").agg(F.max("sim").alias("sim"), F.max("tree").alias("tree")).withColumn(
        "rank", F.row_number().over(order))
    listed = (F.col("rank") <= k) | ((F.col("sim") >= threshold) & (F.col("rank") <= k << doublings))
    return ranked.select("v", "w", "sim", "tree", listed.alias("listed")).where("listed or tree")


def _roots(lists: DataFrame, threshold: float) -> DataFrame:
    """(node, root) by all links found."""
    return cut_lineage(connected_components(
        lists.where(F.col("sim") >= threshold).select(F.col("v").alias("a"), F.col("w").alias("b"))))


def _rooted(vectors: DataFrame, roots: DataFrame) -> DataFrame:
    return vectors.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _around(lists: DataFrame) -> DataFrame:
    """(pivot, node): the neighbours of each vector and those that have it as neighbour."""
    lists = lists.where("listed")
    return lists.select(F.col("v").alias("pivot"), F.col("w").alias("node")).union(
        lists.select(F.col("w").alias("pivot"), F.col("v").alias("node"))).distinct()


def _descend(known: DataFrame, lists: DataFrame, k: int, threshold: float, doublings: int) -> DataFrame:
    """One round: neighbours of neighbours, both directions, join the lists they improve."""
    ends = lists.where("listed").groupBy("v").agg(F.count("*").alias("n"), F.min("sim").alias("last"))
    # A list with room takes anything; a saturated one (all links) may grow.
    floor = ends.select(F.col("v").alias("node"), F.when((F.col("n") < k) | (F.col("last") >= threshold), F.lit(-2.0))
                        .otherwise(F.col("last")).alias("floor"))
    known = known.select("node", "vec", "root").join(floor, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    groups = _shares(_around(lists), ["pivot"], HUB).join(known, "node")
    new = _compare(groups, k, threshold, with_floor=True)
    return _best(lists.select("v", "w", "sim", "tree").union(new), k, threshold, doublings)


def neighbour_lists(vectors: DataFrame, count: int, dim: int, threshold: float, k: int, seed: int,
                    start: DataFrame | None = None) -> DataFrame:
    """Lists and forests of links after descent from a forest drawn with ``seed`` (and from ``start``)."""
    leaves = _leaves(vectors, count, dim, _trees(count, threshold), seed)
    edges = _compare(leaves.withColumn("root", F.col("node")), k, threshold, with_floor=False)
    if start is not None:
        edges = edges.union(start.select("v", "w", "sim", "tree"))
    lists = cut_lineage(_best(edges, k, threshold, 0))
    known = _rooted(vectors, _roots(lists, threshold))
    found = lists.select("v", "w", "sim", "tree").union(_across(leaves, ["tree", "code"], known, threshold, LEAF * 2, BLOCK))
    lists = cut_lineage(_best(found, k, threshold, 0))
    before = -1
    for turn in range(1, MAX_ROUNDS + 1):
        lists = cut_lineage(_descend(known, lists, k, threshold, min(turn, ENLARGE)))
        links = lists.where(F.col("sim") >= threshold).select(
            F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct().count()
        if before >= 0 and links - before <= 0.002 * links:
            break
        before = links
    hubs = _across(_around(lists), ["pivot"], _rooted(vectors, _roots(lists, threshold)), threshold, HUB, BLOCK)
    return cut_lineage(lists.union(hubs.withColumn("listed", F.lit(False))))


def _block_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): links of each vector inside its component, counted block against block."""
    size = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (members.join(size, "root").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
             .select(F.xxhash64("root", "i", "j").alias("g"), (F.col("mine") == F.col("i")).alias("left"),
                     (F.col("i") == F.col("j")).alias("same"), "node", "n", "vec"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in grouped(batches):
            node, n, x = rows.column("node").to_numpy(), rows.column("n").to_numpy(), _matrix(rows)
            left, same = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "same"))
            links = np.zeros(len(node), np.int64)
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                first = np.arange(a, b)[left[a:b]]
                second = first if same[a] else np.arange(a, b)[~left[a:b]]
                near = _cosines(x[first], x[second]) >= threshold
                if same[a]:
                    np.fill_diagonal(near, False)
                    links[first] = near @ n[first]
                else:
                    links[first] = near @ n[second]
                    links[second] = near.T @ n[first]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])

    counted = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(step, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def audit(vectors: DataFrame, roots: DataFrame, counted: DataFrame, threshold: float, k: int = K, sample: int = AUDIT) -> float:
    """Mean share of their links that vectors have, of a sample of at most ``sample`` vectors, each compared with all
    rows; half of them from components of up to ``k`` vectors, half from larger ones, and the lower share of the two."""
    large = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > k).select("root")
    in_large = roots.join(large, "root", "left_semi").select("node")
    chosen = [(kind, r) for kind, how in (("small", "left_anti"), ("large", "left_semi"))
              for r in vectors.select("node", "vec").join(in_large, "node", how)
              .orderBy(F.xxhash64("node", F.lit("audit"))).limit(sample // 2).collect()]
    if not chosen:
        return 1.0
    ids = np.array([r.node for _, r in chosen], np.int64)
    sent = vectors.sparkSession.sparkContext.broadcast(
        (ids, np.array([r.vec for _, r in chosen], np.float64)))  # at most ``sample`` vectors

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, x = sent.value
        links = np.zeros(len(mine), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                near = _cosines(x, _matrix(part)) >= threshold
                near &= mine[:, None] != part.column("node").to_numpy()[None, :]
                links += near @ part.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(links)], ["node", "true"])

    true = vectors.select("node", "vec", "n").mapInArrow(step, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    rows = true.where(F.col("true") > 0).join(counted, "node", "left").select(
        "node", (F.least(F.coalesce("links", F.lit(0)), F.col("true")) / F.col("true")).alias("share")).collect()  # the sample
    kinds, shares = {r.node: kind for kind, r in chosen}, {"small": [], "large": []}
    for r in rows:
        shares[kinds[r.node]].append(r.share)
    return min((sum(x) / len(x) for x in shares.values() if x), default=1.0)


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, k: int = K, recall: float = RECALL,
                 attempts: int = 4) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, and recall (of the audit, never below ``recall``)."""
    rows = rows.select("vec_id", "embedding")
    vectors = cut_lineage(_classes(rows))
    shape = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    spark, lists, reached = rows.sparkSession, None, 1.0
    roots = spark.createDataFrame([], "node long, root long")
    counted = spark.createDataFrame([], "node long, links long")
    for attempt in range(attempts + 1 if shape[0] > 1 else 0):
        if attempt < attempts:
            lists = neighbour_lists(vectors, shape[0], shape[1], threshold, k, 1000 + attempt, lists)
            roots = _roots(lists, threshold)
        else:  # exact: whatever is in different components is compared
            missing = _across(vectors.withColumn("all", F.lit(0)), ["all"], _rooted(vectors, roots), threshold, 1, EXACT_BLOCK)
            roots = cut_lineage(connected_components(roots.toDF("a", "b").union(missing.select("v", "w"))))
        counted = cut_lineage(_block_links(vectors.join(roots, "node"), threshold))
        reached = audit(vectors, roots, counted, threshold, k)
        if reached >= recall:
            break
    if reached < recall:
        raise RuntimeError(f"recall {reached:.4f} is below {recall}")
    named = _rooted(vectors, roots)
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    per_class = (named.join(least, "root").join(counted, "node", "left")
                 .select("vec", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    # Without nulls in the key, equal vectors meet their class; all others stay alone.
    key = F.when(usable(), F.col("embedding"))
    return (rows.withColumn("vec", key).join(per_class, "vec", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
            .withColumn("recall", F.lit(reached)))
