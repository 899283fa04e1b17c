"""Whitening of embeddings (operator 13): streamed covariance, symmetric QR, projection.

Partition iterators update mean and scatter by Welford's rank-one step, vector by vector; what the partitions hold is
merged by the parallel update formula, in tasks first and the last few on the driver: d^2 numbers each, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Steps per unit; components of a result; merged states that the driver takes at most.
STEPS, COMPONENTS, LAST = 256, 4, 32
_STATE = "n long, mean binary, scatter binary, sums array<decimal(38,0)>"


class Moments:
    """Count, mean and scatter (sum of products of deviations from the mean) of vectors, and exact sums of whole ones."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.scatter, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d

    def add(self, rows: np.ndarray) -> None:
        product = np.empty_like(self.scatter)
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply(before[:, None], x - self.mean, out=product)
            self.scatter += product

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.scatter += other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def batch(self) -> pa.RecordBatch:
        from decimal import Decimal

        sums = pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), pa.array([self.mean.tobytes()]), pa.array([self.scatter.tobytes()]), sums], names=["n", "mean", "scatter", "sums"])

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Moments]:
        for n, mean, scatter, sums in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "scatter", "sums")), strict=True):
            out = cls(len(mean) // 8)
            out.n, out.mean, out.sums = n, np.frombuffer(mean).copy(), [int(s) for s in sums]
            out.scatter = np.frombuffer(scatter).reshape(len(out.mean), -1).copy()
            yield out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix: Householder reflections to tridiagonal form,
    then implicit QR steps with Wilkinson's shift, whose rotations are applied to the vectors."""
    a = np.array(a, float)
    d = len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    diag, off = np.diag(a).copy(), np.append(np.diag(a, -1), 0.0)
    vectors = np.ascontiguousarray(q.T)
    hi = d - 1
    while hi > 0:
        small = np.abs(off[:hi]) <= np.finfo(float).eps * (np.abs(diag[:hi]) + np.abs(diag[1 : hi + 1]))
        off[:hi][small] = 0.0
        if off[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and off[lo - 1] != 0:
            lo -= 1
        delta = (diag[hi - 1] - diag[hi]) / 2
        b = off[hi - 1]
        shift = diag[hi] - b * b / (delta + np.copysign(np.hypot(delta, b), delta))
        x, z = diag[lo] - shift, off[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            p, e, w = diag[k], off[k], diag[k + 1]
            diag[k] = c * c * p + 2 * c * s * e + s * s * w
            diag[k + 1] = s * s * p - 2 * c * s * e + c * c * w
            off[k] = c * s * (w - p) + (c * c - s * s) * e
            if k < hi - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            one, two = vectors[k].copy(), vectors[k + 1]
            vectors[k] = c * one + s * two
            vectors[k + 1] = c * two - s * one
    order = np.argsort(-diag, kind="stable")
    return diag[order], vectors[order].T


@dataclass
class Whitening:
    """The fit: rows, exact sums, eigenvalues, components (columns) and how far whitened vectors are from unit covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    total: float
    components: np.ndarray
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        # n x - S is exact where whole numbers below 2^53 are; centring comes before the products.
        centred = x - np.array([s / self.n for s in self.sums])
        out = centred @ self.components
        return np.divide(out, np.sqrt(np.maximum(self.values, 0)), out=np.zeros_like(out), where=self.values > 0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S)^2; None where a long cannot hold it."""
        if not len(x):
            return []
        apart = float(np.abs(x).max()) * self.n + float(max(map(abs, self.sums), default=0))
        if apart < 2**52 and apart * apart * max(1, x.shape[1]) < 2.0**62:
            gap = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [e if e < 2**63 else None for e in exact]


def steps(vector: Column) -> Column:
    """Entries as whole steps; beyond a long they stop at its ends, as a cast does."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * STEPS).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry is finite."""
    v = vector.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            state = state or Moments(x.shape[1])
            state.add(x.astype(float))
            if np.abs(x.astype(float)).max() * len(x) < 2**62:
                more = x.sum(axis=0).tolist()
            else:
                more = [sum(c) for c in zip(*x.tolist(), strict=True)]
            state.sums = [a + b for a, b in zip(state.sums, more, strict=True)]
    if state is not None:
        yield state.batch()


def _projected_moments(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    state = Moments(len(model.values))
    for batch in batches:
        if batch.num_rows:
            state.add(model.project(_matrix(batch.column("x")).astype(float)))
    if state.n:
        yield state.batch()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        for other in Moments.read(batch):
            if state is None:
                state = other
            else:
                state.merge(other)
    if state is not None:
        yield state.batch()


def _gathered(states: DataFrame) -> Moments | None:
    """One state of all partitions': merged in ``LAST`` tasks, which leave at most so many rows to the driver."""
    last = states.repartition(LAST).mapInArrow(_merged, _STATE).toArrow()
    out = None
    for batch in last.to_batches():
        for state in Moments.read(batch):
            if out is None:
                out = state
            else:
                out.merge(state)
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct stepped vectors; None where no vector can be used.

    Vectors of another length than the commonest (the longer of equals) have no part. Components without variance give 0.
    """
    x = vectors.where(usable(F.col(column))).select(steps(F.col(column)).alias("x"))
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    scratch = Scratch(vectors.sparkSession)
    distinct = scratch.write(x.where(F.size("x") == sizes.d).distinct())
    whole = _gathered(distinct.mapInArrow(_moments, _STATE))
    values, vectors_ = symmetric_qr(whole.scatter / whole.n)
    total = float(np.trace(whole.scatter)) / whole.n
    values = np.where(values > total * np.finfo(float).eps * sizes.d, values, 0.0)
    k = min(components, sizes.d)
    model = Whitening(whole.n, whole.sums, values[:k], total, np.ascontiguousarray(vectors_[:, :k]))
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    white = _gathered(distinct.mapInArrow(lambda it: _projected_moments(it, sent.value), _STATE))
    own = model.values > 0
    gap = np.abs(white.scatter / white.n - np.eye(k))[np.ix_(own, own)]
    model.error = float(gap.max()) if gap.size else 0.0
    scratch.drop(distinct)
    return model


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    explained = np.divide(model.values, model.total, out=np.zeros(k), where=model.total > 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("x"))
        n = len(x)
        at = pa.array(np.repeat(np.arange(n), k))
        deviation = pa.array(model.deviation(x), pa.int64())
        columns = [
            batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, np.int64)), deviation.take(at),
            pa.array(model.project(x.astype(float)).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, model.error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whitened(vectors: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null or empty, or hold null or non-finite entries, give none, nor do those of another length than the
    fit's; repeated rows give repeated results, a null vec_id stays; a table without usable vectors gives an empty result.
    ``deviation`` is null where a long cannot hold it. Other columns are ignored.
    """
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    x = vectors.where(usable(F.col(column)) & (F.size(column) == len(model.sums))).select(F.col("vec_id").cast("long").alias("vec_id"), steps(F.col(column)).alias("x"))
    return x.mapInArrow(lambda it: _rows(it, sent.value), out)
