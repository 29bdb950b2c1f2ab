"""Whitening of embeddings: exact distributed covariance, float32 eigenvectors, refinement in higher precision.

``fit`` takes each distinct vector once.  Entries become whole numbers, floor(scale * c), so counts, sums and
products are exact: every task adds up x - m for the rounded means m as whole numbers, partial matrices are added row
by row in the shuffle, and only the finished d x d matrix (d is the dimension, not the number of rows) comes to
the driver.  There the eigenvectors are first taken in float32 and then corrected by the iteration of Ogita and
Aishima, a handful of matrix products in extended precision (numpy's long double), which converges quadratically.
Where eigenvalues lie closer together than the iteration can separate, the vectors of the cluster are kept as a
subspace, and the small matrix that the covariance leaves on it, shifted by the cluster's middle, is
solved and refined in the same way by itself.

``transform`` is one pass over the rows.  ``measure`` takes the covariance of the whitened fit list in
another distributed pass and gives its largest distance from the identity.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; shorter
vectors count as filled up with zeros to the longest one; a direction without variance (one distinct vector, repeated dimensions) has
explained 0 and whitened null and is left out of the measure; an empty table or vectors without entries give no rows; entries
of 2**50 or more after scaling end the job; other columns pass through, columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from dnslake.llm.frames import release
from dnslake.session import cut_lineage

SCALE = 256
COMPONENTS = 4
#: Most tasks that write a partial matrix each.
PARTIALS = 2048
_ROWS = 1 << 12
_LIMB = 40
_X = "__x"
_LONG = np.longdouble


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every entry in double precision, as array of long."""
    def whole(c: Column) -> Column:
        v = c.cast("double") * F.lit(float(scale))
        return F.when(F.abs(v) < 2.0 ** 50, F.floor(v)).otherwise(F.raise_error(F.lit("an entry is too large for a whole number")).cast("long"))
    return F.transform(vector, whole)


def is_usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite, F.lit(False))


def prepared(rows: DataFrame, column: str, scale: int) -> DataFrame:
    """Rows with usable vectors and their whole numbers."""
    return rows.where(is_usable(F.col(f"`{column}`"))).withColumn(_X, whole_numbers(F.col(f"`{column}`"), scale))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of d entries; short ones are filled up with zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and sizes.min() == d == sizes.max():
        return values.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = values
    return out


def _pieces(batches: Iterator[pa.RecordBatch], name: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows by the thousand: memory does not depend on the batch."""
    for batch in batches:
        step = max(1, min(_ROWS, (1 << 22) // max(1, d)))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, _matrix(part.column(part.schema.get_field_index(name)), d)


# -- fitting -----------------------------------------------------------------------------------------------


def products(y: np.ndarray) -> np.ndarray:
    """Exact y'y of whole numbers, as Python integers where 64 bits do not do."""
    top = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)  # every partial sum is a whole number below 2**53
        return (f.T @ f).astype(np.int64).astype(object)
    if top < 1 << 31:  # y = high * 2**16 + low, each product exact by itself
        high, low = y >> 16, y & 0xFFFF
        cross = _exact(high, low)
        return (_exact(high, high) << 32) + ((cross + cross.T) << 16) + _exact(low, low)
    big = y.astype(object)
    return big.T.dot(big)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b for entries below 2**16 and at most 2**12 rows: below 2**53."""
    return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)


def _limbs(total: np.ndarray) -> list[np.ndarray]:
    """Whole numbers in limbs of 40 bits, the last with the sign: sums of many partial results stay exact in 64 bits."""
    low = (1 << _LIMB) - 1
    return [v.astype(np.int64) for v in (total & low, total >> _LIMB & low, total >> 2 * _LIMB)]


def _joined(limbs) -> list[int]:
    return [sum(int(v) << _LIMB * k for k, v in enumerate(row)) for row in zip(*limbs)]


def gram(fit: DataFrame, shift: list[int]) -> np.ndarray:
    """Exact sum of (x - shift)(x - shift)' over the rows, as Python integers."""
    d, m = len(shift), np.array(shift, np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _pieces(batches, _X, d):
            found = products(x - m)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), *map(_lists, _limbs(total))], ["i", *limbs])
        release()

    def add(key, table):
        rows = [_lists(sum_rows(table.column(c), d)[None, :]) for c in limbs]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *rows], ["i", *limbs])

    limbs = ["low", "middle", "high"]
    schema = "i int, low array<long>, middle array<long>, high array<long>"
    parts = fit.select(_X).coalesce(PARTIALS).mapInArrow(partial, schema)
    rows = parts.groupBy("i").applyInArrow(add, schema).collect()  # d rows of d numbers
    out = np.zeros((d, d), object)
    for r in rows:
        out[r.i] = _joined([r.low, r.middle, r.high])
    return out


def sum_rows(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Sum of lists of d numbers."""
    total = np.zeros(d, np.int64)
    for chunk in column.chunks:
        total += chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).sum(0)
    return total


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))


@dataclass
class Whitening:
    """What a fit gives: count and sums of the fit list, directions (columns) by falling eigenvalue, their variances."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: int = SCALE
    usable: np.ndarray = field(default=None)

    def __post_init__(self):
        top = float(self.values.max(initial=0.0))
        self.usable = self.values > top * len(self.sums) * 2.0 ** -52

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if u else 0.0 for v, u in zip(self.values, self.usable)]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S exactly, and x - S / n."""
        top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        s = np.array(self.sums, object)
        big = (top + 1) * self.n >= 1 << 62
        moved = (x.astype(object) if big else x) * self.n - (s if big else s.astype(np.int64))
        return moved, (moved / self.n).astype(np.float64)

    def whiten(self, centre: np.ndarray) -> np.ndarray:
        safe = np.where(self.usable, self.values, 1.0)
        return centre @ (self.vectors / np.sqrt(safe))


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Directions of the most variance of the distinct whole-number vectors."""
    return fit_with_list(rows, column, components, scale)[0]


def fit_with_list(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS,
                  scale: int = SCALE) -> tuple[Whitening, DataFrame | None]:
    """The same, and the fit list (None without entries), which ``measure`` takes."""
    narrow = prepared(rows, column, scale)
    d = narrow.agg(F.max(F.size(_X))).first()[0] or 0
    if d == 0:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale), None
    full = F.concat(_X, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(_X)))
    listed = cut_lineage(narrow.select(full.alias(_X)).distinct())
    n, sums = _count_and_sums(listed, d)
    shift = [(2 * s + n) // (2 * n) for s in sums]  # S / n, rounded
    around = gram(listed, shift)
    rest = [s - n * m for s, m in zip(sums, shift)]
    # n n V = n sum(y y') - (sum y)(sum y)', in whole numbers
    exact = around * n - np.outer(np.array(rest, object), np.array(rest, object))
    covariance = to_long_double(exact) / (_LONG(n) * _LONG(n))
    values, vectors = eigen(covariance)
    k = min(components, d)
    made = Whitening(n, sums, vectors[:, :k].astype(np.float64), values[:k].astype(np.float64),
                     float(np.trace(covariance)), scale)
    return made, listed


def _count_and_sums(listed: DataFrame, d: int) -> tuple[int, list[int]]:
    limbs = ["low", "middle", "high"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for _, x in _pieces(batches, _X, d):
            n += len(x)
            total = total + x.sum(0)  # at most 2**12 entries below 2**50
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()),
                                              *map(pa.array, _limbs(total))], ["i", "n", *limbs])

    parts = listed.mapInArrow(partial, "i int, n long, low long, middle long, high long")
    rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", *limbs)]).orderBy("i").collect()  # d rows
    return rows[0].n, _joined([[r[c] for r in rows] for c in limbs])


def to_long_double(whole: np.ndarray) -> np.ndarray:
    """Whole numbers of any size in long double, rounded once."""
    out = np.zeros(whole.shape, _LONG)
    for at in np.ndindex(whole.shape):
        v = int(whole[at])
        cut = max(0, abs(v).bit_length() - 100)
        high, low = divmod(v >> cut, 1 << 50)
        out[at] = np.ldexp(_LONG(high) * _LONG(1 << 50) + _LONG(low), cut)
    return out


# -- eigenvectors ------------------------------------------------------------------------------------------


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix in long double."""
    a = np.asarray(matrix, _LONG)
    size = np.abs(a).max(initial=0)
    if size == 0:
        return np.zeros(len(a), _LONG), np.eye(len(a), dtype=_LONG)
    a = a / size
    first = np.linalg.eigh(a.astype(np.float32))[1]
    values, vectors = refine(a, first.astype(_LONG))
    order = np.argsort(-values, kind="stable")
    return values[order] * size, vectors[:, order]


def refine(a: np.ndarray, x: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The iteration of Ogita and Aishima from approximate eigenvectors x, with a sub-solve for each cluster."""
    d, eps = len(a), np.finfo(_LONG).eps
    values, before = None, np.inf
    for _ in range(most):
        values, x, change = correct(a, x)
        if change <= 8 * d * eps or change >= before / 2 and change < 2.0 ** -40:
            break
        before = change
    x = orthonormal(x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    ax = a @ x
    values = (x * ax).sum(0)
    wrong = np.sqrt(((ax - x * values) ** 2).sum(0))
    # Neighbours belong together if what is left over is not small against their distance.
    gap = values[:-1] - values[1:]
    together = (wrong[:-1] + wrong[1:]) > np.maximum(gap, 0) * 2.0 ** -53
    start = 0
    while start < d:
        stop = start + 1
        while stop < d and together[stop - 1]:
            stop += 1
        if stop - start > 1:
            sub_solve(a, x, values, slice(start, stop))
        start = stop
    return values, x


def correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: (eigenvalues, better vectors, size of the correction)."""
    r = np.eye(len(a), dtype=_LONG) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    bound = 2 * (np.sqrt((off ** 2).sum()) + np.abs(a).sum(1).max() * np.sqrt((r ** 2).sum()))
    distance = values[None, :] - values[:, None]
    far = np.abs(distance) > bound
    step = np.where(far, (s + values[None, :] * r) / np.where(far, distance, 1), r / 2)
    np.fill_diagonal(step, np.diag(r) / 2)
    return values, x + x @ step, float(np.sqrt((step ** 2).sum()))


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so to the last digit, by Newton's iteration for the polar factor."""
    for _ in range(3):
        x = x + x @ (np.eye(x.shape[1], dtype=_LONG) - x.T @ x) / 2
    return x


def sub_solve(a: np.ndarray, x: np.ndarray, values: np.ndarray, mine: slice) -> None:
    """Turns the vectors of a cluster within their subspace by the eigenvectors of the shifted small matrix."""
    q = x[:, mine]
    middle = values[mine].mean()
    small = q.T @ (a @ q - middle * q)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if size <= np.abs(values).max() * np.finfo(_LONG).eps * len(a):
        return  # one eigenvalue: every basis of the subspace will do
    found, turn = np.linalg.eigh((small / size).astype(np.float64))
    turn = turn[:, ::-1].astype(_LONG)
    for _ in range(4):
        found, turn, change = correct(small / size, turn)
        if change <= 8 * len(small) * np.finfo(_LONG).eps:
            break
    turn = orthonormal(turn)
    found = (turn * (small / size @ turn)).sum(0)
    order = np.argsort(-found, kind="stable")
    x[:, mine], values[mine] = q @ turn[:, order], middle + found[order] * size


# -- use ---------------------------------------------------------------------------------------------------


def measure(model: Whitening, listed: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    d, k = len(model.sums), int(model.usable.sum())
    if k == 0:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for _, x in _pieces(batches, _X, d):
            w = model.whiten(model.centred(x)[1])[:, model.usable]
            total += w.T @ w
            sums += w.sum(0)
        full = np.concatenate([total.reshape(-1), sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(full)), pa.int32()), pa.array(full)], ["i", "v"])

    parts = listed.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    found = np.array([r.v for r in parts]) / model.n
    mean = found[k * k:]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """Rows with usable vectors, their columns, deviation (decimal: exact at any size) and whitened (array of double)."""
    added = [StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))]
    names = {f.name for f in added}
    kept = [f for f in rows.schema if f.name.lower() not in names]
    ready = prepared(rows, column, model.scale).select(*[F.col(f"`{f.name}`") for f in kept], _X)
    d, k = len(model.sums), len(model.values)
    if d == 0:
        return ready.drop(_X).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _pieces(batches, _X, d):
            moved, centre = model.centred(x)
            top = max(int(moved.max(initial=0)), -int(moved.min(initial=0)))
            if top * top * d >= 1 << 63:
                moved = moved.astype(object)
            deviation = (moved * moved).sum(1)
            white = model.whiten(centre)
            mask = np.broadcast_to(~model.usable, white.shape)
            entries = pa.array(white.reshape(-1), mask=np.ascontiguousarray(mask).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in range(len(kept))],
                 _decimals(deviation),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), entries)],
                [*[f.name for f in kept], "deviation", "whitened"])
        release()

    return ready.mapInArrow(run, StructType([*kept, *added]))


def _decimals(values: np.ndarray) -> pa.Array:
    if values.dtype == object:
        return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.array(values).cast(pa.decimal128(38, 0))


def by_component(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable row and component: the row's columns, component, n, deviation, whitened, explained, identity_error."""
    model, listed = fit_with_list(rows, column, components, scale)
    error = measure(model, listed) if model.n else 0.0
    done = transform(rows, model, column)
    new = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in new]
    shares = F.array(*[F.lit(v) for v in model.explained]) if model.n else F.array().cast("array<double>")
    flat = done.select(*kept, "deviation", F.posexplode("whitened").alias("__at", "__white"))
    return flat.select(*kept, (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       F.col("__white").alias("whitened"), F.element_at(shares, F.col("__at") + 1).alias("explained"),
                       F.lit(error).alias("identity_error"))
