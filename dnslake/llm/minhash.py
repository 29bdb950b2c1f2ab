"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

A shingle's weight is the number of times it stands in the document.  Each shingle is a Poisson process
whose rate is its weight; its arrivals fall on registers, and a register keeps the shingle that arrived
first.  A shingle stops as soon as its next arrival is later than the latest register, which ends most of
them after one arrival.  Two documents agree on a register with the probability Jaccard of their weights:

    J(a, b) = sum over shingles i of both: 1 / sum over j of max(a_j / a_i, b_j / b_i)

which is the plain Jaccard of the shingle sets where weights are equal.  Registers are banded; documents
that share a band are candidates; every candidate link is verified with the exact J of the whole texts.

Work is done on classes of equal word sequences, so copies are one row.  In a band's bucket of up to SMALL
classes the possible pairs are listed and verified by their texts.  The classes of a larger bucket bring their
shingles, are compared share by share where they are, and a task gives out no more links than connect them.
Groups are connected components, found by star contractions in Spark.

Defined cases: words are those of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a text with
one to four words has one shingle, all of them; null and empty texts have none, are like nothing and always
stay; rows with equal words are one class whatever their ids; a group keeps its smallest id; rows without
an id stay only where no row of the group has one; rows that repeat both id and words count as one document
in ``drop_near_duplicates``; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dnslake.llm import textops
from dnslake.llm.components import connected_components
from dnslake.llm.frames import add_columns, grouped, pack, unpack
from dnslake.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6
#: Members of a leader, or of a bucket, that one task compares.
SHARE = 500
#: Members of a bucket whose pairs may leave a task before they are verified.
SMALL = 16
#: Standard deviations below the threshold down to which an estimate from registers is still verified.
MARGIN = 4.5
WORDS = textops.lut_alnum_lower()
_SLICE_ROWS = 4096
_U = np.uint64


def shingles(words: textops.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 52-bit id, weight) of the distinct shingles of each row, sorted by row and id."""
    at, code = words.windows(size)
    row = words.row[at]
    for length in range(1, size):
        short = np.flatnonzero(words.counts == length)
        if len(short):
            first, whole = words.windows(length)
            mine = np.isin(words.row[first], short)
            row, code = np.concatenate([row, words.row[first][mine]]), np.concatenate([code, whole[mine]])
    key, weight = np.unique((row.astype(_U) << _U(52)) | (code >> _U(12)), return_counts=True)
    return (key >> _U(52)).astype(np.int64), key & _U((1 << 52) - 1), weight


def signatures(row: np.ndarray, ident: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Registers (rows x size) of shingle ids; rows without shingles have zeros."""
    time = np.full(rows * size, np.inf)
    held = np.zeros(rows * size, _U)
    latest = np.full(rows, np.inf)
    arrival = np.zeros(len(row))
    # Registers of a shingle are drawn anew for each arrival, from its id alone: all documents agree on them.
    turn = 0
    while len(row):
        turn += 1
        draw = textops.mix(ident * _U(0x9E3779B97F4A7C15) + _U(turn * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
        arrival = arrival - np.log1p(-((draw >> _U(11)) * 2.0 ** -53)) / weight
        alive = arrival < latest[row]
        row, ident, weight, arrival, draw = (x[alive] for x in (row, ident, weight, arrival, draw))
        place = row * size + (textops.mix(draw) % _U(size)).astype(np.int64)
        np.minimum.at(time, place, arrival)
        won = time[place] == arrival
        held[place[won]] = ident[won]
        latest = time.reshape(rows, size).max(1)
    return held.reshape(rows, size)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(registers), bands), _U)
    for r in range(rows):
        out = textops.mix(out + registers[:, r::rows][:, :bands] * _U(0x9E3779B97F4A7C15) + _U(r + 1))
    return out.view(np.int64)


def content_hash(words: textops.Words) -> np.ndarray:
    """64-bit hash of the whole word sequence of each row; 0 without words."""
    return textops.row_hashes(words.hash, words.counts).view(np.int64)


def _bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.slices(batch, column):
            for start in range(0, part.num_rows, _SLICE_ROWS):
                yield part.slice(start, _SLICE_ROWS)


def _words(text: pa.Array) -> textops.Words:
    return textops.Words(*textops.flat(text), WORDS)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_words, node (content hash; 0 without words), size (distinct shingles; negative where a
    shingle is repeated), registers (a byte of each) and bands (array of band hashes)."""
    def step(batches):
        for part in _bounded(batches, "text"):
            words = _words(part.column("text"))
            row, ident, weight = shingles(words)
            size = np.bincount(row, minlength=len(words.counts))
            size[row[weight > 1]] *= -1
            registers = signatures(row, ident, weight, len(words.counts), bands * rows)
            hashes = pa.array(band_hashes(registers, bands, rows).ravel())
            short = textops.mix(registers).astype(np.uint8)
            offsets = pa.array(np.arange(0, (len(registers) + 1) * bands, bands, dtype=np.int32))
            yield part, {"n_words": pa.array(words.counts.astype(np.int64)), "node": pa.array(content_hash(words)),
                         "size": pa.array(size.astype(np.int64)),
                         "registers": pa.array([r.tobytes() for r in short], pa.binary()), "bands": pa.ListArray.from_arrays(offsets, hashes)}

    return (add_columns(docs.select("doc_id", "text"), step, "n_words long, node long, size long, registers binary, bands array<bigint>")
            .select("doc_id", "n_words", "node", "size", "registers", "bands"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted ids, weights)."""
    ids = np.union1d(a[0], b[0])
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, a[0])] = a[1]
    y[np.searchsorted(ids, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    x_above = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    y_below = np.concatenate([[0.0], np.cumsum(y[order])])
    k = np.searchsorted(sorted_ratio, ratio[both])
    # From place k on x_j / y_j >= r: the maximum is x_j; before it, y_j * r.
    return float(np.sum(x[both] / (x_above[k] + y_below[k] * ratio[both])))


def alike(left: pa.Array, right: pa.Array, threshold: float) -> np.ndarray:
    """Which pairs of texts reach the threshold."""
    n = len(left)
    sides = []
    for text in (left, right):
        row, ident, weight = shingles(_words(text))
        sides.append(((row.astype(_U) << _U(52)) | ident, weight, np.searchsorted(row, np.arange(n + 1))))
    (ka, wa, ea), (kb, wb, eb) = sides
    shared = np.bincount((np.intersect1d(ka, kb, assume_unique=True) >> _U(52)).astype(np.int64), minlength=n)
    union = np.diff(ea) + np.diff(eb) - shared
    out = (union > 0) & (shared >= threshold * union - 1e-9)
    heavy = np.zeros(n, bool)
    for key, weight in ((ka, wa), (kb, wb)):
        heavy[(key[weight > 1] >> _U(52)).astype(np.int64)] = True
    for i in np.flatnonzero(heavy & (shared > 0)).tolist():
        a, b = slice(ea[i], ea[i + 1]), slice(eb[i], eb[i + 1])
        out[i] = similarity((ka[a], wa[a]), (kb[b], wb[b])) >= threshold - 1e-9
    return out


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are alike.  The texts of an ``a`` with many partners are sent to
    as many shares as it needs."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    left = (texts.join(shares, texts.node == shares.a)
            .select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("text").alias("text_a")))
    right = (pairs.join(shares, "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
             .select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b", "text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in textops.slices(batch, "text_a"):
                for part in _bounded([half], "text_b"):
                    good = alike(part.column("text_a"), part.column("text_b"), threshold)
                    yield part.select(["a", "b"]).filter(pa.array(good))

    return left.join(right, ["a", "share"]).select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _shared(rows: DataFrame) -> DataFrame:
    """Deals the members of buckets over pairs of shares: g, left, same beside the columns of ``rows``."""
    return (rows.withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int"))
            .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
            .withColumn("g", F.xxhash64("band", "hash", "i", "j")).withColumn("left", F.col("mine") == F.col("i"))
            .withColumn("same", F.col("i") == F.col("j")).drop("shares", "mine", "other", "i", "j", "band", "hash", "n")
            .repartition("g").sortWithinPartitions("g"))


def _possible(rows: pa.Table, borders: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per group, the pairs of rows that can be alike: sizes of sets without repeated shingles fit, and the
    registers agree to within MARGIN standard deviations of the threshold."""
    node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy()
    left, same = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "same"))
    registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint8).reshape(len(node), -1)
    least = (threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / registers.shape[1])) * registers.shape[1]
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        inside = np.arange(a, b)
        first, second = (inside, inside) if same[a] else (inside[left[a:b]], inside[~left[a:b]])
        found: tuple[list, list] = ([], [])
        for x in first.tolist():
            small, large = np.minimum(size[x], size[second]), np.maximum(size[x], size[second])
            can = (small < 0) | (small >= (threshold - 1e-9) * large)
            if same[a]:
                can &= node[second] > node[x]
            y = second[can]
            y = y[(registers[y] == registers[x]).sum(1) >= least]
            if len(y):
                found[0].append(np.full(len(y), x))
                found[1].append(y)
        if found[0]:
            yield np.concatenate(found[0]), np.concatenate(found[1])


def _tree(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links x-y among ``count`` sets a breadth-first forest needs."""
    link = np.full((count, count), -1, np.int64)
    link[x, y] = link[y, x] = np.arange(len(x))
    seen, used = np.zeros(count, bool), []
    for root in range(count):
        if seen[root]:
            continue
        seen[root], front = True, np.array([root])
        while len(front):
            near = link[front]
            new = np.flatnonzero((near >= 0).any(0) & ~seen)
            used.append(near[(near[:, new] >= 0).argmax(0), new])
            seen[new] = True
            front = new
    return np.unique(np.concatenate(used)) if used else np.zeros(0, np.int64)


def _small_pairs(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Possible pairs of buckets of at most SMALL members: no more than SMALL / 2 per member."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in grouped(batches):
            node = rows.column("node").to_numpy()
            for x, y in _possible(rows, borders, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))],
                                                 ["a", "b"])

    small = members.where(F.col("n") <= SMALL).join(classes.select("node", "size", "registers"), "node")
    return _shared(small).mapInArrow(step, "a long, b long").distinct()


def _large_links(members: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links inside larger buckets.  Their members bring their shingles and a bucket is compared share by share.
    Every possible pair is verified; of the links, a forest that connects the same sets leaves the task, so the
    rows it makes grow with its members and not with their pairs."""
    def sets(batches: Iterator[pa.RecordBatch]):
        for part in _bounded(batches, "text"):
            row, ident, weight = shingles(_words(part.column("text")))
            edge = np.searchsorted(row, np.arange(part.num_rows + 1))
            both = [(ident[a:b].tobytes(), weight[a:b].astype(np.uint32).tobytes()) for a, b in zip(edge[:-1], edge[1:])]
            yield part, {"ids": pa.array([x for x, _ in both], pa.binary()), "weights": pa.array([w for _, w in both], pa.binary())}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in grouped(batches):
            node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy()
            ids, weights = rows.column("ids"), rows.column("weights")
            for x, y in _possible(rows, borders, threshold):
                used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                held = [np.frombuffer(ids[i].as_py(), _U) for i in used.tolist()]
                shared = _intersections(held, place[: len(x)], place[len(x):])
                heavy = (size[x] < 0) | (size[y] < 0)
                union = np.abs(size[x]) + np.abs(size[y]) - shared
                good = ~heavy & (shared >= threshold * union - 1e-9)
                for k in np.flatnonzero(heavy & (shared > 0)).tolist():
                    a, b = ((held[place[q]], np.frombuffer(weights[int(used[place[q]])].as_py(), np.uint32)) for q in (k, k + len(x)))
                    good[k] = similarity(a, b) >= threshold - 1e-9
                first, second = place[: len(x)][good], place[len(x):][good]
                tree = _tree(len(used), first, second)
                yield pa.RecordBatch.from_arrays([pa.array(node[used[first[tree]]]), pa.array(node[used[second[tree]]])], ["a", "b"])

    large = members.where(F.col("n") > SMALL)
    chosen = texts.join(large.select("node").distinct(), "node", "left_semi")
    brought = add_columns(chosen, sets, "ids binary, weights binary").select("node", "ids", "weights")
    full = large.join(classes.select("node", "size", "registers"), "node").join(brought, "node")
    return _shared(full).mapInArrow(step, "a long, b long").distinct()


def _intersections(held: list[np.ndarray], x: np.ndarray, y: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Number of ids that sets x[k] and y[k] share, by products of incidence matrices some columns at a time."""
    flat = np.concatenate(held)
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # ids of one set alone are in no intersection
    keep = times[code] > 1
    owner, code = owner[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros(len(x), np.float32)
    left, right = np.unique(x), np.unique(y)
    px, py = np.searchsorted(left, x), np.searchsorted(right, y)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        mine = slice(*np.searchsorted(code, [start, start + columns]))
        matrix = np.zeros((len(held), columns), np.float32)
        matrix[owner[mine], code[mine] - start] = 1
        total += (matrix[left] @ matrix[right].T)[px, py]
    return np.rint(total).astype(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, node, class_id (smallest id with the same words), group_id
    (smallest id reachable by links) and kept."""
    every = cut_lineage(sketch(docs, bands, rows))
    classes = cut_lineage(every.where("node <> 0").groupBy("node").agg(
        F.min("doc_id").alias("class_id"), *[F.first(c).alias(c) for c in ("size", "registers", "bands")]))
    buckets = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    sizes = buckets.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(buckets.join(sizes, ["band", "hash"]).select("band", "hash", "node", "n"))
    texts = cut_lineage(_texts(docs, classes.join(members.select("node").distinct(), "node", "left_semi")))
    pairs = cut_lineage(_small_pairs(members, classes, threshold))
    roots = connected_components(_verified(pairs, texts, threshold).union(_large_links(members, classes, texts, threshold)))
    named = classes.join(roots, "node", "left").select("node", "class_id", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    known = named.join(groups, "root").select("node", "class_id", "group_id")
    return (every.join(known, "node", "left")
            .select("doc_id", "n_words", "node", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("group_id", "doc_id").alias("group_id"))
            .withColumn("kept", (F.col("node") == 0) | F.col("group_id").isNull() | F.col("doc_id").eqNullSafe(F.col("group_id"))))


def with_node(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``__node``, the hash of the word sequence."""
    def step(batches):
        for part in _bounded(batches, "text"):
            yield part, {"__node": pa.array(content_hash(_words(part.column("text"))))}

    return add_columns(docs, step, "__node long")


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text) of one document of each class."""
    one = classes.select(F.col("node").alias("__node"), F.col("class_id").alias("doc_id"))
    found = with_node(docs.select("doc_id", "text"))
    return (found.join(one, (found["__node"] == one["__node"]) & found["doc_id"].eqNullSafe(one["doc_id"]))
            .select(found["__node"].alias("node"), found["text"]))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with the columns it came with."""
    found = near_duplicates(docs, threshold)
    stay = found.where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("node").alias("__of")).agg(
        F.count("*").alias("__times"))
    repeated = bool(stay.where("__times > 1 and __of <> 0").limit(1).count())
    marked = with_node(pack(docs, "doc_id", "text"))
    kept = marked.join(stay, marked["doc_id"].eqNullSafe(stay["__id"]) & (marked["__node"] == stay["__of"]))
    if repeated:
        several = kept.where("__times > 1 and __node <> 0")
        kept = kept.where("__times = 1 or __node = 0").unionByName(several.dropDuplicates(["__id", "__of"]))
    return unpack(kept, docs.columns)
