"""Whitening against plain double-precision and rational computations."""

import math
from fractions import Fraction

import numpy as np
import pytest

from dnslake.llm import whiten

LONG = np.longdouble


def plain(vectors, scale=256):
    """(n, sums, covariance in exact fractions as long double) of the distinct whole-number vectors."""
    listed = sorted({tuple(math.floor(scale * float(c)) for c in v) for v in vectors})
    n, d = len(listed), len(listed[0])
    sums = [sum(x[i] for x in listed) for i in range(d)]
    cov = np.zeros((d, d), LONG)
    for i in range(d):
        for j in range(d):
            exact = Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in listed), n ** 3)
            cov[i, j] = LONG(exact.numerator // exact.denominator) + LONG(float(exact - exact.numerator // exact.denominator))
    return n, sums, cov


def rows_of(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "a", 1) for i, v in enumerate(vectors)],
                                 f"vec_id long, embedding array<{kind}>, n string, __one int").repartition(5)


def known(values, seed=0):
    """A symmetric matrix with these eigenvalues, and its eigenvectors, in long double."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(LONG)
    q = whiten.orthonormal(whiten.orthonormal(q))
    return (q * np.array(values, LONG)) @ q.T, q


@pytest.mark.parametrize("values", [
    [9, 7, 4, 2, 1, .5], [1, 1 - 1e-5, 1 - 2e-5, .5, .25], [1, 1 - 1e-9, 1 - 3e-9, .3, .3 - 1e-8, .1],
    list(np.linspace(2, 1, 40)), [1e6, 1, 1e-3, 1e-6], [3] + [1 + k * 1e-7 for k in range(20, 0, -1)]])
def test_eigenvectors_of_clusters(values):
    a, q = known(values)
    found, x = whiten.eigen(a)
    order = np.argsort(-np.array(values))
    assert np.allclose((found - np.array(values, LONG)[order]).astype(float), 0, atol=1e-16 * max(values) * len(values))
    gaps = np.abs(np.array(values)[:, None] - np.array(values)[None, :])[order][:, order]
    np.fill_diagonal(gaps, np.inf)
    for i in range(len(values)):
        v, want = x[:, i], q[:, order[i]]
        miss = min(np.abs(v - want).max(), np.abs(v + want).max())
        assert miss <= 40 * len(values) * np.finfo(LONG).eps * max(values) / gaps[i].min() + 1e-17, (i, miss)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17


def test_float32_alone_is_not_enough():
    a, q = known([9, 7, 4, 2, 1, .5])
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert np.abs(np.abs(rough.T @ q.astype(float)) - np.eye(6)).max() > 1e-9


def test_equal_eigenvalues():
    values, x = whiten.eigen(np.diag([2.0, 2.0, 2.0, 1.0]))
    assert np.allclose(values.astype(float), [2, 2, 2, 1], atol=0)
    assert np.abs(x.T @ x - np.eye(4)).max() < 1e-17
    assert whiten.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


@pytest.mark.parametrize("top", [10, 1 << 20, 1 << 29, 1 << 40])
def test_products_are_exact(top):
    y = np.random.default_rng(1).integers(-top, top, (50, 4))
    big = y.astype(object)
    assert (whiten.products(y) == big.T.dot(big)).all()


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8)) * np.array([5, 3, 2, 1, 1, .5, .3, .1])
    vectors = [list(map(float, v)) for v in np.concatenate([base, base[:50], np.repeat(base[:1], 100, 0)])]
    odd = [None, [], [None] * 8, [float("nan")] + [0.0] * 7, [0.0] * 7 + [float("-inf")], [1.0, None]]
    rows = rows_of(spark, vectors + odd, "double")
    used = [v for v in vectors] + [[0.0] * 8]  # the empty vector counts as zeros
    n, sums, cov = plain(used)
    values, q = np.linalg.eigh(cov.astype(float))
    values, q = values[::-1], q[:, ::-1]
    done = whiten.by_component(rows).collect()
    assert len(done) == 4 * len(used)
    signs = {}
    for r in done:
        v = vectors[r.vec_id] if r.vec_id < len(vectors) else [0.0] * 8
        x = [math.floor(256 * c) for c in v]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        k = r.component - 1
        want = sum(float(Fraction(n * a - s, n)) * q[i, k] for i, (a, s) in enumerate(zip(x, sums))) / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if abs(want - r.whitened) <= abs(want + r.whitened) else -1)
        assert abs(sign * want - r.whitened) < 1e-10
        assert abs(r.explained - values[k] / np.trace(cov.astype(float))) < 1e-12 and r.identity_error < 1e-10


def test_short_vectors_single_rows_and_no_rows(spark):
    done = whiten.by_component(rows_of(spark, [[1.0, 2.0, 3.0], [1.0], [0.5, 0.25]])).collect()
    n, sums, _ = plain([[1, 2, 3], [1, 0, 0], [.5, .25, 0]])
    assert {(r.component, r.n) for r in done} == {(k, 3) for k in (1, 2, 3)} and len(done) == 9
    assert {r.deviation for r in done if r.vec_id == 1} == {sum((n * a - s) ** 2 for a, s in zip([256, 0, 0], sums))}
    assert all(r.whitened is None for r in done if r.component == 3)
    one = whiten.by_component(rows_of(spark, [[1.0, 2.0]] * 5)).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, 0.0, 0.0, 0)} and len(one) == 10
    for none in ([], [None], [[]], [[None]]):
        assert whiten.by_component(rows_of(spark, none)).count() == 0
    clash = whiten.by_component(rows_of(spark, [[1.0, 2.0], [3.0, 1.0]]))
    assert clash.columns == ["vec_id", "embedding", "__one", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_and_whole_range(spark):
    big = [[3e12, 1.0], [-3e12, 2.0], [1e12, -5.0]]
    n, sums, _ = plain(big)
    done = whiten.by_component(rows_of(spark, big, "double")).collect()
    for r in done:
        assert int(r.deviation) == sum((n * math.floor(256 * c) - s) ** 2 for c, s in zip(big[r.vec_id], sums))
    with pytest.raises(Exception, match="too large"):
        whiten.by_component(rows_of(spark, [[1e30], [1.0]], "double")).collect()


def test_query(spark):
    from dnslake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rows = QUERIES["op12_refined_whitening"](spark, sf).collect()
    n, sums, cov = plain(vectors.values())
    values, q = np.linalg.eigh(cov.astype(float))
    assert len(rows) == 4 * len(vectors) and {r.n for r in rows} == {n}
    white = np.zeros((len(vectors), 4))
    place = {v: i for i, v in enumerate(sorted(vectors))}
    for r in rows:
        white[place[r.vec_id], r.component - 1] = r.whitened
        assert r.identity_error < 1e-10 and abs(r.explained / (values[-r.component] / values.sum()) - 1) < 1e-10
    x = np.array([[math.floor(256 * float(c)) for c in vectors[v]] for v in sorted(vectors)]) - np.array(sums) / n
    want = x @ q[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    assert np.minimum(np.abs(white - want).max(0), np.abs(white + want).max(0)).max() < 1e-9
