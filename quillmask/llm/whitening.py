"""Whitening of vectors: components found by a randomised range finder, over exact whole-number sums.

Numbers become whole ones (x = floor(scale * c) + shift), so that sums over all rows are exact and rows can be centred without loss: x - S / n is the whole
x - S div n less the fraction (S mod n) / n. A random basis of a few more directions than components goes through passes over all
centred rows; each gives V times the basis, from which Rayleigh-Ritz takes components, and their residuals tell whether these are
eigenvectors to double precision. Where they are not after a few passes (a spectrum without a steep fall), the basis is filled up to
all dimensions and one more pass settles it. Every pass adds up one small matrix for each task, then one for each group of
tasks, then one; none of the work depends on the number of rows but those matrices and the passes themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stream import small_batches, tidy

COMPONENTS, OVERSAMPLE, PASSES = 32, 16, 4
SCALE, SHIFT = 64, 1_000_000
#: Largest residual of a component, as a share of the largest eigenvalue, that is an eigenvector to double precision.
SETTLED = 1e-13
#: Eigenvalues up to this share of the largest are no directions of the vectors but rounding; they can't be scaled to one.
NOTHING = 1e-12


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only (zeros and no numbers at all are fine)."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False)))


def whole(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    """Vectors of one length as whole numbers, a row each; they must fit 53 bits, which keeps them exact."""
    c = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(scale * c) + shift
    if len(x) and np.abs(x).max() >= 2.0**53:
        raise ValueError("a vector's number is too large to be scaled exactly")
    return x.astype(np.int64).reshape(len(column), -1)


class Centre:
    """Exact mean of the rows: S / n for each dimension."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total
        self.floor = np.array([s // n for s in total], np.int64)
        self.rest = [s % n for s in total]
        self.fraction = np.array([r / n for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.fraction

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n * x - S)^2 for each row, exact; there is an error where it does not fit 64 bits."""
        near = ((self.n * self(x)) ** 2).sum(axis=1)
        if len(near) and near.max() >= 2.0**62:
            return np.array([sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x], np.int64)
        d = self.n * (x - self.floor) - np.array(self.rest, np.int64)
        return (d * d).sum(axis=1)


def _added(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], np.ndarray] | None, size: int) -> Iterator[pa.RecordBatch]:
    """The sum of what make gives for each batch (or of matrices in it) as one row."""
    total = np.zeros(size)
    for batch in batches:
        if make:
            total += make(batch).ravel()
        else:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


def summed(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of rows of a matrix of size numbers: one for each task, for each group of tasks, and for all."""
    parts = rows.mapInArrow(tidy(_added, make=make, size=size), "m binary")
    groups = max(1, int(np.sqrt(parts.rdd.getNumPartitions())))
    for n in {groups, 1} if groups == 1 else (groups, 1):
        parts = parts.repartition(n).mapInArrow(tidy(_added, make=None, size=size), "m binary")
    found = parts.collect()
    return np.frombuffer(found[0].m).copy() if found else np.zeros(size)


def _sums(batches: Iterator[pa.RecordBatch], at: int, scale: int, shift: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        x = whole(batch.column(at), scale, shift)
        n += len(x)
        total = (0 if total is None else total) + x.astype(object).sum(axis=0) if len(x) else total
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in total]], pa.list_(pa.string()))], ["n", "s"])


def centre_of(rows: DataFrame, vec_col: str, scale: int, shift: int) -> Centre | None:
    """Exact count and sums of the rows' whole numbers."""
    each = rows.select(vec_col).mapInArrow(tidy(_sums, at=0, scale=scale, shift=shift), "n long, s array<string>")
    found = each.select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return Centre(int(found[0].n), [int(r.s) for r in found]) if found else None


def _times(batch: pa.RecordBatch, centre: Centre, basis: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """Centred rows, transposed, times their places on a basis; the sum of their squares besides."""
    y = centre(whole(batch.column(0), scale, shift))
    return np.append((y.T @ (y @ basis)).ravel(), (y * y).sum())


def _spread(batch: pa.RecordBatch, centre: Centre, basis: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """Sums and products of whitened rows."""
    w = centre(whole(batch.column(0), scale, shift)) @ basis
    return np.append(w.sum(axis=0), (w.T @ w).ravel())


def components(rows: DataFrame, centre: Centre, vec_col: str, k: int, oversample: int, passes: int, scale: int, shift: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of the covariance, their unit eigenvectors (columns) and its trace."""
    dim = len(centre.total)
    width = min(dim, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    q, left = basis[:, :width], passes
    while True:
        got = summed(rows.select(vec_col), partial(_times, centre=centre, basis=q, scale=scale, shift=shift), dim * q.shape[1] + 1) / centre.n
        z, trace = got[:-1].reshape(dim, -1), got[-1]
        inner = q.T @ z
        value, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-value, kind="stable")[:k]
        value, turn = np.maximum(value[order], 0), turn[:, order]
        found = q @ turn
        residual = np.sqrt(((z @ turn - found * value) ** 2).sum(axis=0))
        if q.shape[1] == dim or residual.max(initial=0) <= SETTLED * value.max(initial=0):
            break
        left -= 1
        # the range so far, and after the last pass all other directions behind it
        q = np.linalg.qr(z if left else np.concatenate([z, basis], axis=1))[0]
    return value, found, trace


def _whiten(batches: Iterator[pa.RecordBatch], centre: Centre, basis: np.ndarray, explained: np.ndarray, error: float, at: int, scale: int, shift: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    k = basis.shape[1]
    for batch in batches:
        x = whole(batch.column(at), scale, shift)
        w = centre(x) @ basis
        who = pa.array(np.repeat(np.arange(len(x)), k))
        rest = [c.take(who) for i, c in enumerate(batch.columns) if i != at]
        size = len(x) * k
        made = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(size, centre.n), np.repeat(centre.deviation(x), k), w.ravel(), np.tile(explained, len(x)), np.full(size, error)]
        yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, made)], names)


def whiten(vectors: DataFrame, vec_col: str = "embedding", k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES,
           scale: int = SCALE, shift: int = SHIFT, seed: int = 23) -> DataFrame:
    """A row for each usable row of vectors and component: its columns without the vector, then component (from 1, by falling
    eigenvalue), n (rows that were fitted: all usable ones), deviation (sum over dimensions of (n x - S)^2, exact), whitened (x - S / n on the
    component, over the root of its eigenvalue), explained (the eigenvalue's share of the covariance's trace) and identity_error (largest
    absolute entry of the whitened rows' covariance less the identity, over all rows).

    Vectors that are null or hold null or non-finite numbers are left out. Vectors of several lengths are several lists, each fitted
    on its own (n tells them apart), one after another; their number is meant to be small. Components whose eigenvalue is 0 but for rounding are
    left out, so one row alone, equal rows and vectors of no numbers have none. Repeated rows count as often as they stand.
    Other columns are never looked at. Numbers must be exact in 53 bits when scaled, and deviations fit 64 bits; else there is an error. A
    column that has the name of a result is refused with a ValueError. Nothing larger than dimensions x dimensions numbers
    reaches the driver or is sent to a task."""
    small_batches(vectors.sparkSession)
    added = [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    clash = {f.name for f in added} & set(vectors.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    schema = T.StructType([f for f in vectors.schema.fields if f.name != vec_col] + added)
    fine = usable(vectors, vec_col)
    sizes = [r[0] for r in fine.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).agg(F.lit(1)).orderBy("d").collect()]
    out = vectors.sparkSession.createDataFrame([], schema)
    for i, dim in enumerate(sizes):
        rows = fine.where(F.size(vec_col) == dim)
        centre = centre_of(rows, vec_col, scale, shift)
        value, found, trace = components(rows, centre, vec_col, min(k, dim), oversample, passes, scale, shift, seed)
        some = value > NOTHING * value.max(initial=0)
        value, basis = value[some], found[:, some] / np.sqrt(value[some])
        if not len(value):
            continue
        got = summed(rows.select(vec_col), partial(_spread, centre=centre, basis=basis, scale=scale, shift=shift), len(value) * (len(value) + 1)) / centre.n
        mean, square = got[: len(value)], got[len(value) :].reshape(len(value), -1)
        error = float(np.abs(square - np.outer(mean, mean) - np.eye(len(value))).max())
        run = tidy(_whiten, centre=centre, basis=basis, explained=value / trace, error=error, at=vectors.columns.index(vec_col), scale=scale, shift=shift, names=schema.names)
        made = rows.mapInArrow(run, schema)
        out = made if i == 0 else out.unionByName(made)
    return out
