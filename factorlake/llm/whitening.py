"""Whitening of embeddings: float32 eigenvectors refined by matrix products in extended precision."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable

EXACT = 2 ** 53  # float64 holds every integer up to here


# ---- eigenvectors of a small symmetric matrix ------------------------------------------------------


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Index groups of sorted ``values`` whose neighbours lie within ``width``."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > width) + 1
    return np.split(order, cuts)


def refined_eigenvectors(matrix: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Starts from the float32 eigenvectors and corrects them by Ogita-Aishima steps: with R = I - X'X and
    S = X'AX the step is X + XE, E_ij = (S_ij + l_j R_ij) / (l_j - l_i), all in extended precision, so the
    error squares from round to round. Where two eigenvalues lie closer than the error bound of the round
    the quotient says nothing: there E_ij = R_ij / 2 keeps the columns orthonormal, and the cluster is
    turned by a sub-solve of its own projected, shifted matrix, whose scale is the spread of the cluster
    and not the size of the matrix. Equal eigenvalues have no directions of their own: any orthonormal basis is right.
    """
    a = np.array(matrix, dtype=np.longdouble)
    a = (a + a.T) / 2
    d = len(a)
    scale = float(np.abs(a).max()) if d else 0.0
    if scale == 0.0:
        return np.zeros(d), np.eye(d)
    a = a / np.longdouble(scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(d, dtype=np.longdouble)
    norm = np.linalg.norm(a.astype(np.float64), 2)
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ a @ x
        s = (s + s.T) / 2  # E + E' = R only if S is symmetric to the last digit
        lam = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(lam)
        bound = 2 * (np.linalg.norm(off.astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        gap = lam[None, :] - lam[:, None]
        far = np.abs(gap) > bound
        e = np.where(far, (s + lam[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        for members in _clusters(lam.astype(np.float64), bound):
            if len(members) > 1:
                basis = x[:, members]
                basis = basis + basis @ (np.eye(len(members), dtype=np.longdouble) - basis.T @ basis) / 2
                middle = lam[members].mean()
                inner = basis.T @ ((a - middle * eye) @ basis)
                inner = (inner + inner.T) / 2
                spread = np.abs(inner).max()
                if spread > 0:
                    basis = basis @ np.linalg.eigh((inner / spread).astype(np.float64))[1].astype(np.longdouble)
                x[:, members] = basis
        if np.abs(e).max() < 1e-17 and np.abs(r).max() < 1e-17:
            break
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0) * np.longdouble(scale)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


# ---- vectors ---------------------------------------------------------------------------------------


def grid(vector: Column, steps: int = 64, offset: int = 1_000_000) -> Column:
    """Every entry as a whole number of 1/``steps`` (rounded down), plus ``offset``; null if any entry is
    null, not finite or beyond 2^53 steps, and for a null vector."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * steps < float(EXACT)))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * steps).cast("long") + offset))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _total(rows: DataFrame, work, columns: str) -> list:
    """Sums of the per-task figures ``(place, v)`` that ``work`` yields, added up by Spark with map-side combine."""
    return rows.mapInArrow(work, columns).groupBy("place").agg(F.sum("v").alias("v")).collect()


def _means(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums per dimension; ``dims`` + 1 figures reach the driver."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            total[:dims] += x.sum(axis=0)
            total[dims] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(total)], names=["place", "v"])

    out = np.zeros(dims + 1, np.int64)
    for place, v in _total(fit, add, "place long, v long"):
        out[place] = v
    return int(out[dims]), out[:dims]


def _products(rows: np.ndarray) -> np.ndarray:
    """Sum of outer products in float64, in blocks whose sums stay whole numbers below 2^53 where that can be."""
    top = float(np.abs(rows).max()) if len(rows) else 0.0
    block = max(1, int(EXACT / max(1.0, top * top)))
    return sum((b.T @ b for b in (rows[i:i + block] for i in range(0, len(rows), block))), np.zeros((rows.shape[1],) * 2))


def _second_moments(rows: DataFrame, dims: int, width: int, centred) -> np.ndarray:
    """Sum of outer products of ``centred(x)``, ``width`` wide, over all rows; width^2 figures reach the driver."""
    upper = np.triu_indices(width)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            total += _products(centred(_matrix(b.column(0), dims)))
        yield pa.RecordBatch.from_arrays([pa.array((upper[0] * width + upper[1]).astype(np.int64)), pa.array(total[upper])], names=["place", "v"])

    out = np.zeros(width * width)
    for place, v in _total(rows, add, "place long, v double"):
        out[place] = v
    out = out.reshape(width, width)
    return out + np.triu(out, 1).T


@dataclass
class Whitening:
    """What a fit learned: ``vectors`` are the leading unit eigenvectors (columns), ``values`` their variances."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: the whole part is subtracted as integers, the rest of the mean as a double."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact; null (masked) where it passes a 64-bit number."""
        rough = self.n * (x.astype(np.float64) - self.sums / self.n)
        safe = (rough * rough).sum(axis=1) < 9e18
        far = self.n * np.where(safe[:, None], x, 0) - np.where(safe[:, None], self.sums, 0)
        return np.ma.array((far * far).sum(axis=1), mask=~safe)


def fit(rows: DataFrame, components: int = 16) -> tuple[Whitening, DataFrame] | None:
    """Learns from the distinct vectors of ``rows(x)``, which are returned too; null vectors do not count, None without any.

    Vectors of another length than the most frequent one (the longer at a tie) do not count either.
    Repeats go before anything else, with map-side combine, so one vector in a third of all rows costs one
    row per task. Sums and products are added up by Spark; only dims^2 figures reach the driver.
    Components whose variance is within rounding of zero have no scale and are left out.
    """
    sized = rows.where("x IS NOT NULL AND size(x) > 0").groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sized is None:
        return None
    dims = sized["d"]
    once = stable(rows.where(F.size("x") == dims).select("x").distinct())
    n, sums = _means(once, dims)
    whole = sums // n
    rest = (sums - whole * n) / n
    cov = _second_moments(once, dims, dims, lambda x: (x - whole).astype(np.float64)) / n - np.outer(rest, rest)
    values, vectors = refined_eigenvectors(cov)
    trace = float(np.trace(cov))
    keep = min(components, int((values > max(trace, 0.0) * dims * 1e-15).sum()))
    return Whitening(n, sums, values[:keep], vectors[:, :keep], trace), once


def identity_error(model: Whitening, once: DataFrame) -> float:
    """Largest absolute entry of (covariance of the whitened fit list minus the identity), measured over the stored list."""
    width = len(model.values)
    if not width:
        return 0.0
    return float(np.abs(_second_moments(once, model.dims, width, model.project) / model.n - np.eye(width)).max())


def whiten(rows: DataFrame, model: Whitening | None, key: str) -> DataFrame:
    """(key, component, n, deviation, whitened, explained) for every row of ``rows(key, x)`` whose vector the model fits.

    Repeated rows and null keys stay rows of their own; without a model the result is empty.
    """
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    width = len(model.values)
    explained = model.values / model.trace

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), model.dims)
            away = model.deviations(x)
            take = pa.array(np.repeat(np.arange(len(x)), width))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(take), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * width, model.n, np.int64)),
                pa.array(away.data, mask=np.ma.getmaskarray(away)).take(take), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x)))],
                names=[key, "component", "n", "deviation", "whitened", "explained"])

    return rows.where(F.size("x") == model.dims).select(key, "x").mapInArrow(project, schema)


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Whitens every usable vector of ``table`` on its leading components; adds ``identity_error``, one measured value.

    Usable: not null, no null, NaN or infinite entry, of the most frequent length. Other columns are ignored.
    """
    rows = table.select(F.col(key).alias(key), grid(F.col(vector)).alias("x"))
    learned = fit(rows, components)
    return whiten(rows, learned and learned[0], key).withColumn("identity_error", F.lit(identity_error(*learned) if learned else 0.0))
