"""Whitening of embeddings: a pivoted Cholesky factor of the centred scatter, then one-sided Jacobi on the factor.

Components become integers floor(scale * c), so that sums and the scatter are exact. One pass adds up the vectors; a second
one adds up products of deviations from the rounded mean, which are small, and the remainder of the mean (below one half) is
taken out of the totals as integers: scatter = sum z z' - r r' / n. Tasks hold one matrix of partial sums, which
Spark adds up by entry; only those totals, whose number depends on the dimension and not on the rows, reach the driver.

The scatter is factored as L L' with diagonal pivots, which ends where its rank does. Jacobi rotations of L's columns make them
orthogonal: their squared norms are the scatter's eigenvalues and their directions its eigenvectors, with no product of L with itself.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither in the fit nor in the result; a shorter
vector counts as padded with zeros; rows that share an id, or have none, stay rows of their own; axes without variance (constant or dependent
dimensions, a single vector) are no components, so fewer than k may come back; no vectors give no rows; components of 2^40 / scale or
more raise a ValueError in their task; signs are fixed by making each axis's largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A constant added to every integer component would move the mean and nothing that comes out, so none is.
SCALE, COMPONENTS, SWEEPS = 1024, 8, 60
_EPS = np.finfo(float).eps
_WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Axes:
    """n: fitted vectors; middle: the rounded mean by dimension; rest: n times what rounding left out; axes: a row a component."""

    n: int
    middle: np.ndarray
    rest: list[int]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def _integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, and the finite vectors' components times scale, rounded down."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(F.col(vec_col).isNotNull()).where(fine).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("y"))


def _matrix(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """A row a vector, short ones padded with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(values) and max(-int(values.min()), int(values.max())) >= 1 << 40:
        raise ValueError("components are too large: scale the vectors down")
    dims = int(lengths.max(initial=0)) if dims is None else dims
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _products(z: np.ndarray) -> np.ndarray:
    """z' z without rounding: in doubles while they hold every sum, else in unbounded integers."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 53:
        return (z.T.astype(float) @ z.astype(float)).astype(np.int64).astype(object)
    wide = z.astype(object)
    return wide.T @ wide


def _totals(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], dict[int, int]]) -> dict[int, int]:
    """Exact totals by key of what each task adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(batches)
        yield pa.record_batch({"pos": pa.array(list(found), pa.int64()), "value": pa.array([Decimal(v) for v in found.values()], _WIDE)})

    return {r["pos"]: int(r["value"]) for r in rows.mapInArrow(run, "pos long, value decimal(38,0)").groupBy("pos").agg(F.sum("value").alias("value")).collect()}


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[int, int]:
    """Sums by dimension, and under -1 the number of vectors."""
    n, total = 0, np.zeros(0, object)
    for batch in batches:
        y = _matrix(batch.column("y"))
        part = y.sum(0).astype(object)
        wide = max(total, part, key=len).copy()
        wide[: min(len(total), len(part))] = total[: len(part)] + part[: len(total)]
        n, total = n + len(y), wide
    return {-1: n} | dict(enumerate(total))


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with a[order][:, order] = factor @ factor.T; as many columns as the rank."""
    d = len(a)
    order, factor, left = np.arange(d), np.zeros((d, d)), np.diag(a).astype(float).copy()
    stop = d * _EPS * left.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= stop:
            return factor[:, :k], order
        for x in (order, factor, left):
            x[[k, p]] = x[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs, as in a round-robin tournament."""
    seats = np.arange(n + n % 2)
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        p, q = seats[:half], seats[half:][::-1]
        real = (p < n) & (q < n)
        yield p[real], q[real]
        seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, directions by column), by falling norm, of the factor's columns rotated until they are orthogonal."""
    g = factor.copy()
    enough = 2 * _EPS * max(1, len(g)) ** 0.5
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in _rounds(g.shape[1]) if g.shape[1] > 1 else ():
            u, v = g[:, p], g[:, q]
            a, b, c = (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, float(off.max()))
            turn = off > enough / 4
            zeta = (b - a) / np.where(turn, 2 * c, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = cos * u - cos * t * v, cos * t * u + cos * v
        if worst <= enough:
            break
    else:
        raise RuntimeError(f"columns are not orthogonal after {SWEEPS} sweeps")
    norms = (g * g).sum(0)
    by = np.argsort(-norms, kind="stable")
    return norms[by], g[:, by] / np.sqrt(norms[by])


def axes_of(scatter: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row a component, variances, shares of the whole variance) of a scatter matrix of n vectors."""
    factor, order = pivoted_cholesky(scatter)
    norms, turned = one_sided_jacobi(factor)
    axes = np.empty_like(turned)
    axes[order] = turned
    axes, norms = axes[:, :k].T, norms[:k]
    top = np.abs(axes).argmax(1)
    axes = axes * np.where(axes[np.arange(len(axes)), top] < 0, -1.0, 1.0)[:, None]
    return axes, norms / n, norms / max(float(np.trace(scatter)), np.finfo(float).tiny)


def fit(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> Axes:
    """The first k axes of all vectors that take part."""
    rows = _integers(vectors, id_col, vec_col, scale)
    sums = _totals(rows.select("y"), _sums)
    n = sums.pop(-1, 0)
    dims = len(sums)
    if not n or not dims:
        return Axes(n, np.zeros(dims, np.int64), [0] * dims, np.zeros((0, dims)), np.zeros(0), np.zeros(0))
    middle = [(2 * sums[i] + n) // (2 * n) for i in range(dims)]
    rest = [sums[i] - n * m for i, m in enumerate(middle)]
    centre = np.array(middle, np.int64)
    upper = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, int]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total += _products(_matrix(batch.column("y"), dims) - centre)
        return dict(enumerate(total[upper]))

    found = _totals(rows.select("y"), partial)
    scatter = np.zeros((dims, dims))
    for pos, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        scatter[i, j] = scatter[j, i] = (n * found[pos] - rest[i] * rest[j]) / n  # integers until the one division
    return Axes(n, centre, rest, *axes_of(scatter, n, k))


def project(vectors: DataFrame, axes: Axes, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, ``deviation`` (sum over dimensions of (n x - S)^2, exact) and ``whitened``, an entry a component."""
    rows = _integers(vectors, id_col, vec_col, scale)
    n, dims = axes.n, len(axes.middle)
    rest = np.array(axes.rest, object)
    offset = np.array([r / n for r in axes.rest]) if n else np.zeros(dims)
    to = (axes.axes / np.sqrt(axes.variances)[:, None]).T
    squares = sum(r * r for r in axes.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            z = _matrix(batch.column("y"), dims) - axes.middle
            most, far = int(np.abs(z).max(initial=0)), max((abs(r) for r in axes.rest), default=0)
            kind = np.int64 if max(most, 1) * max(most, far, 1) * max(1, dims) < 1 << 62 else object
            wide = z.astype(kind)
            own, mixed = (wide * wide).sum(1).tolist(), (wide @ rest.astype(kind)).tolist()
            deviation = [Decimal(n * n * a - 2 * n * b + squares) for a, b in zip(own, mixed)]
            w = (z - offset) @ to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.record_batch({"id": batch.column("id"), "deviation": pa.array(deviation, _WIDE), "whitened": lists})

    schema = f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identity_error(projected: DataFrame, n: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                part = np.hstack([w.T @ w, w.sum(0)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch({"pos": pa.array(np.arange(total.size)), "value": pa.array(total.ravel())})

    found = projected.select("whitened").mapInArrow(partial, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
    k = int(len(found) ** 0.5)  # k rows of k + 1 entries
    total = np.array([v for _, v in sorted((r["pos"], r["value"]) for r in found)]).reshape(k, k + 1) if k else np.zeros((0, 1))
    mean = total[:, -1] / max(n, 1)
    return float(np.abs(total[:, :-1] / max(n, 1) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row a vector and component (from 1): id, component, n, deviation, whitened, explained, identity_error."""
    axes = fit(vectors, k, id_col, vec_col, scale)
    projected = project(vectors, axes, id_col, vec_col, scale)
    error = identity_error(projected, axes.n)
    long = projected.select(F.col(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*(F.lit(float(e)) for e in axes.explained)).cast("array<double>"), F.col("at"))
    return long.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(axes.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
