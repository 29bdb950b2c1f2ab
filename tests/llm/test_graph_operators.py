"""Near-duplicates of texts and vectors, and components, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import CLASHES, docs_of, odd_rows, prose, words

from dnslake.llm import minhash, nndescent
from dnslake.llm.components import connected_components


def groups_of(nodes, edges):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 70)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    edges += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    frame = spark.createDataFrame(edges + [(None, 3), (4, None)] + edges[:9], "a long, b long")
    real = [(a, b) for a, b in edges if a != b]
    want = groups_of({n for e in real for n in e}, real)
    assert {r.node: r.root for r in connected_components(frame).collect()} == want
    assert connected_components(frame.limit(0)).count() == 0


def weights(text):
    w = words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def plain_similarity(a, b):
    a, b, total = Counter(a), Counter(b), 0.0
    for i in set(a) & set(b):
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in set(a) | set(b))
    return total


def near_rows():
    rng = random.Random(11)
    rows = list(odd_rows())
    number = 100
    for base in range(12):
        w = prose(base + 40, rng.choice([3, 6, 30, 60, 200])).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((number, rng.choice([" ", ", "]).join(copy)))
            number += 1
    hub = prose(77, 150).split()
    for k in range(40):  # each is near the hub; few are near each other
        copy = list(hub)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = f"w{k}"
        rows.append((number, " ".join(copy)))
        number += 1
    rows.append((number, " ".join(hub)))
    rows += [(number + 1 + k, "la la la la la la la la la " * 4 + prose(5, 20)) for k in range(3)]
    return rows


def test_exact_similarity_of_weighted_sets():
    rng = random.Random(1)
    for _ in range(60):
        a = {k: rng.randint(1, 4) for k in rng.sample(range(20), rng.randint(1, 15))}
        b = {k: rng.randint(1, 4) for k in rng.sample(range(20), rng.randint(1, 15))}
        sides = [(np.array(sorted(x)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert minhash.similarity(*sides) == pytest.approx(plain_similarity(a, b))


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 1 << 52, 60).astype(np.uint64), rng.integers(1, 1 << 52, 60).astype(np.uint64)
    b[:40] = a[:40]
    wa, wb = rng.integers(1, 5, 60), rng.integers(1, 5, 60)
    row = np.repeat([0, 1], 60)
    got = minhash.signatures(row, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    want = plain_similarity(dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist())))
    assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, weights(t))
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if plain_similarity(sets[a], sets[b]) >= 0.8 - 1e-9]
    want = groups_of(ids, edges)
    assert {(r.doc_id, r.group_id) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.kept == (r.group_id == r.doc_id) for r in got if r.doc_id is not None)
    assert all(r.kept for r in got if r.doc_id is None)


def test_one_document_of_each_group_stays(spark):
    docs = docs_of(spark, near_rows())
    kept = minhash.drop_near_duplicates(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and all([r[c] for c in CLASHES] == CLASHES for r in rows)
    ids = Counter(r.doc_id for r in rows)
    assert ids[1] == 1 and 7 not in ids and ids[2] == 1 and ids[3] == 1 and ids[5] == 1 and 6 not in ids and ids[None] == 2
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_repeated_row_of_a_group_stays_once(spark):
    docs = docs_of(spark, [(3, prose(1, 50)), (3, prose(1, 50)), (4, prose(1, 50)), (5, None), (5, None)])
    assert Counter(r.doc_id for r in minhash.drop_near_duplicates(docs).collect()) == {3: 1, 5: 2}


def vectors(seed, dim=24):
    rng = np.random.default_rng(seed)
    rows, number = [], 1
    for size in (1, 1, 1, 2, 2, 3, 9, 70):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((number, (centre + rng.standard_normal(dim) * 0.11 * np.linalg.norm(centre) / np.sqrt(dim)).tolist()))
            number += 1
    rows += [(number + k, rng.standard_normal(dim).tolist()) for k in range(150)]
    number += 150
    rows += [(number + k, rows[5][1]) for k in range(90)]  # equal vectors
    rows += [(5000, [2 * x for x in rows[5][1]]), (5001, None), (5002, []), (5003, [0.0] * dim), (5004, [float("nan")] * dim),
             (5005, [float("inf")] + [1.0] * (dim - 1)), (5006, [1.0, 2.0]), (5007, [None] + [1.0] * (dim - 1)), (5001, None)]
    rng.shuffle(rows)
    return rows


def plain_near(rows):
    """{vec_id: (n_links, component_id)} of usable vectors."""
    x = np.array([v for _, v in rows], np.float32).astype(float)
    unit = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / unit[:, None] / unit[None, :] >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    groups = groups_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return {i: (int(n), groups[i]) for i, n in zip(ids, near.sum(1))}


def bridged(members, dim=24):
    """Two dense groups, more links inside than a list holds; cosines between them are about 0.952."""
    rng = np.random.default_rng(9)
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    rows = []
    for centre in (a, 0.952 * a + np.sqrt(1 - 0.952 ** 2) * b):
        rows += [(centre + rng.standard_normal(dim) * 0.03 / np.sqrt(dim)).tolist() for _ in range(members)]
    return list(enumerate(rows, 1))


def test_weak_bridges_between_dense_groups(spark):
    rows = bridged(250)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nndescent.near_vectors(frame, attempts=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_near(rows)
    assert {r.component_id for r in got} == {1}


def pairs_beside_a_group(members=120, pairs=12, dim=24):
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(dim)
    rows = [(centre + rng.standard_normal(dim) * 0.01).tolist() for _ in range(members)]
    for _ in range(pairs):
        one = rng.standard_normal(dim)
        rows += [one.tolist(), (one + rng.standard_normal(dim) * 0.01).tolist()]
    return list(enumerate(rows, 1))


def test_missed_pairs_beside_a_dense_group_are_found(spark, monkeypatch):
    rows = pairs_beside_a_group()

    def group_only(vectors, *_):
        first = vectors.where("id = 1").select(nndescent.F.col("node").alias("v"))
        return first.crossJoin(vectors.where("id between 2 and 120").select(nndescent.F.col("node").alias("w"))).selectExpr(
            "v", "w", "1.0d as sim", "true as tree", "true as listed")
    monkeypatch.setattr(nndescent, "neighbour_lists", group_only)  # recall over all links is 0.998
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nndescent.near_vectors(frame, attempts=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_near(rows)
    assert nndescent.near_vectors(frame, attempts=0).where("n_links > 0").count() == len(rows)
    monkeypatch.setattr(nndescent, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError):
        nndescent.near_vectors(frame, attempts=1)


def test_trees_follow_the_rows():
    assert nndescent._trees(1000, 0.95) == nndescent.TREES < nndescent._trees(10 ** 6, 0.95) < nndescent._trees(10 ** 9, 0.95)


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    rows = [(int(i), v) for i, v in vectors(2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as node", "1 as g", "2 as root")
    got = nndescent.near_vectors(frame).collect()
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in good])
    unit = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / unit[:, None] / unit[None, :] >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    want_links = {i: int(n) for i, n in zip(ids, near.sum(1))}
    want = groups_of([i for i, _ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, want_links.get(i, 0), want[i]) for i, _ in rows}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and got[0].recall == 1.0


def test_near_vectors_of_hardly_any(spark):
    schema = "vec_id long, embedding array<float>"
    assert nndescent.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = nndescent.near_vectors(spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [0.0, 1.0])], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 0, 1), (2, 1, 2), (None, 1, 2), (4, 0, 4)}
