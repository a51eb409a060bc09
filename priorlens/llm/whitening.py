"""Whitening of embeddings: exact scatter on Spark, eigenvectors from its Cholesky factor.

Entries become whole numbers, ``x = floor(64 * entry) + 1000000``, so that sums and
centred products are exact however rows are dealt. Tasks send sums per dimension, then,
for entries centred on the rounded mean, products per pair of dimensions; Spark adds
them up. The driver holds that one matrix, whose size is the vectors' length squared:
a Cholesky factorisation with pivots, then one-sided Jacobi rotations of the triangular
factor's columns. The columns' squared norms are the eigenvalues, the normalised columns
the components. One more scan measures the covariance of the whitened vectors.

Rows whose vector is null, or holds a null or an entry that is not finite, are left out.
So are vectors of another length than most have (of lengths equally common, the longest
wins). An entry beyond 2**40 in size counts as 2**40. Components end where the scatter's numerical
rank ends, so equal vectors, or a single one, give no row; nor does an empty table.
Repeated rows and ids, null ids among them, count and return as often as they stand.
Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

COMPONENTS = 32
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**40
ROWS = 4096  # vectors that are held as doubles at once
SWEEPS, ORTHOGONAL = 60, 4e-15
_EXACT = 2**53


@dataclass(frozen=True)
class Whitening:
    """Count and sums of the fitted vectors, components by falling eigenvalue, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def rest(self) -> list[int]:
        """What the sums are beyond the shift, ``n`` times each mean of the unshifted entries."""
        return [s - self.n * SHIFT for s in self.sums]


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unshifted entries (whole doubles) of the valid vectors, block by block, one length each."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for length in np.unique(sizes[sizes > 0]).tolist():
        of_length = np.flatnonzero(sizes == length)
        for at in range(0, len(of_length), ROWS):
            rows = of_length[at : at + ROWS]
            flat = pc.list_flatten(column.take(pa.array(rows)))
            entries = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
            fine = np.isfinite(entries).all(axis=1)
            yield rows[fine], np.floor(SCALE * np.clip(entries[fine], -LARGEST, LARGEST))


def _sums(y: np.ndarray) -> list[int]:
    """Exact sums of whole doubles by column."""
    if not len(y) or np.abs(y).max() * len(y) < _EXACT:
        return y.sum(axis=0).astype(np.int64).tolist()
    return y.astype(np.int64).astype(object).sum(axis=0).tolist()


def _products(y: np.ndarray) -> np.ndarray:
    """Exact products of whole doubles, summed over rows for each pair of columns."""
    step = int(min(len(y), _EXACT // max(1, int(np.abs(y).max(initial=0)) ** 2)))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if not step and len(y):
        whole = y.astype(np.int64).astype(object)
        return whole.T @ whole
    for at in range(0, len(y), max(step, 1)):
        part = y[at : at + step]
        total = total + (part.T @ part).astype(np.int64)
    return total


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)`` with ``L @ L.T`` equal to the matrix in that order; ``L`` has one column per rank."""
    d = len(matrix)
    order, left, factor = np.arange(d), matrix.diagonal().copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * left.max(initial=0)
    for k in range(d):
        pivot = k + int(np.argmax(left[k:]))
        if left[pivot] <= least:
            return factor[:, :k], order
        for swapped in (order, left, factor):
            swapped[[k, pivot]] = swapped[[pivot, k]]
        factor[k, k] = np.sqrt(left[k])
        below = matrix[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = below / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each pair of columns meets once."""
    seats = np.arange(size + size % 2)
    for _ in range(len(seats) - 1):
        a, b = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
        real = (a < size) & (b < size)
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """The factor's columns rotated in pairs until all are orthogonal, as rows, longest first."""
    rows = np.ascontiguousarray(factor.T)
    for _ in range(SWEEPS):
        turned = False
        for p, q in _rounds(len(rows)):
            u, v = rows[p], rows[q]
            a, b, both = (np.einsum("ij,ij->i", x, y) for x, y in ((u, u), (v, v), (u, v)))
            skew = np.abs(both) > ORTHOGONAL * np.sqrt(a * b)
            if not skew.any():
                continue
            turned = True
            p, q, u, v = p[skew], q[skew], u[skew], v[skew]
            zeta = (b[skew] - a[skew]) / (2 * both[skew])
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cosine = 1 / np.hypot(1, tangent)
            sine = (cosine * tangent)[:, None]
            rows[p], rows[q] = cosine[:, None] * u - sine * v, sine * u + cosine[:, None] * v
        if not turned:
            break
    norms = np.einsum("ij,ij->i", rows, rows)
    return rows[np.argsort(-norms, kind="stable")]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a symmetric positive semi-definite matrix, falling, and unit eigenvectors as rows."""
    factor, order = pivoted_cholesky(matrix)
    rows = jacobi_columns(factor)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    vectors = np.empty_like(rows)
    vectors[:, order] = rows / norms[:, None]
    return norms**2, vectors


def fit(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on every valid vector; none if there is no valid vector."""
    column = vectors.select(F.col(f"`{embedding}`").alias("v"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        rows: Counter[int] = Counter()
        for batch in batches:
            for _, y in _by_length(batch.column(0)):
                length = y.shape[1]
                rows[length] += len(y)
                sums[length] = [a + b for a, b in zip(sums.get(length, [0] * length), _sums(y), strict=True)]
        for length, values in sums.items():
            size = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([rows[length]] * size, pa.int64()), pa.array(map(str, values), pa.string())],
                names=["length", "i", "n", "s"],
            )

    by_place = column.mapInArrow(count, "length int, i int, n long, s string")
    by_place = by_place.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = F.max(F.struct("n", "length"))  # every place of a length has the same count
    best = by_place.agg(most.alias("m")).select("m.length")
    found = by_place.join(best, "length").where("n > 0").collect()
    if not found:
        return None
    found.sort(key=lambda r: r.i)
    n, length, rest = found[0].n, len(found), [int(r.s) for r in found]
    centre = [round(r / n) if abs(r) < _EXACT else (2 * r + n) // (2 * n) for r in rest]
    middle = np.array(centre, np.float64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length), object)
        for batch in batches:
            for _, y in _by_length(batch.column(0)):
                if y.shape[1] == length:
                    total = total + _products(y - middle)
        i, j = np.triu_indices(length)
        values = total[i, j]
        if any(values):
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(str, values), pa.string())], names=["i", "j", "s"])

    pairs = column.mapInArrow(scatter, "i int, j int, s string")
    pairs = pairs.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    off = [r - n * c for r, c in zip(rest, centre, strict=True)]
    matrix = np.zeros((length, length))  # n * n times the covariance, each entry rounded once
    for row in pairs.collect():
        matrix[row.i, row.j] = matrix[row.j, row.i] = float(n * int(row.s) - off[row.i] * off[row.j])
    values, axes = eigen(matrix)
    squared = float(n) ** 2
    return Whitening(n, tuple(r + n * SHIFT for r in rest), axes[:components], values[:components] / squared, float(matrix.trace()) / squared)


def _deviations(y: np.ndarray, model: Whitening) -> pa.Array:
    """Exact sums of squares of ``n * x - S``; null beyond the long range."""
    far = model.n * y - np.array(model.rest, np.float64)
    about = np.einsum("ij,ij->i", far, far)
    rest = np.array(model.rest, object)
    small = (np.abs(far).max(initial=0) < 2.0**52) and (model.n * np.abs(y).max(initial=0) < 2.0**62) and max(map(abs, model.rest), default=0) < 2**62
    out = np.zeros(len(y), np.int64)
    lost = about > 2.0**64
    exact = ~lost
    if small:
        fits = about < 2.0**62
        whole = model.n * y[fits].astype(np.int64) - rest.astype(np.int64)
        out[fits] = np.einsum("ij,ij->i", whole, whole)
        exact &= ~fits
    for row in np.flatnonzero(exact).tolist():
        value = sum((model.n * int(a) - b) ** 2 for a, b in zip(y[row].tolist(), model.rest, strict=True))
        lost[row] = value >= 2**63
        out[row] = 0 if lost[row] else value
    return pa.array(out, pa.int64(), mask=lost)


def _whitened(y: np.ndarray, model: Whitening) -> np.ndarray:
    mean = np.array([r / model.n for r in model.rest])
    return (y - mean) @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def project(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per fitted row: id, ``deviation``, and ``whitened``, one double per component."""
    schema = StructType(
        [StructField("vec_id", vectors.schema[vec_id].dataType), StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    )
    length, size = len(model.sums), len(model.components)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in _by_length(batch.column(1)):
                if y.shape[1] != length or not len(y):
                    continue
                values = pa.array(_whitened(y, model).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * size), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _deviations(y, model), lists], names=schema.names)

    return vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("v")).mapInArrow(rows, schema)


def identity_error(vectors: DataFrame, model: Whitening, embedding: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over all of them."""
    length, size = len(model.sums), len(model.components)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for _, y in _by_length(batch.column(0)):
                if y.shape[1] == length:
                    w = _whitened(y, model)
                    total += w.T @ w
                    sums += w.sum(axis=0)
        i, j = np.indices((size, size + 1)).reshape(2, -1)
        values = np.concatenate([total, sums[:, None]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], names=["i", "j", "s"])

    found = vectors.select(F.col(f"`{embedding}`").alias("v")).mapInArrow(scatter, "i int, j int, s double")
    total = np.zeros((size, size + 1))
    for row in found.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[row.i, row.j] = row.s
    mean = total[:, size] / model.n
    return float(np.abs(total[:, :size] / model.n - np.outer(mean, mean) - np.eye(size)).max(initial=0))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per fitted vector and component, with the fit's shares and its measured error."""
    model = fit(vectors, embedding, components)
    if model is None or not len(model.components):
        empty = StructType([StructField("vec_id", vectors.schema[vec_id].dataType)])
        rest = "cast(0 AS int) component, 0L n, 0L deviation, 0D whitened, 0D explained, 0D identity_error"
        return vectors.sparkSession.createDataFrame([], empty).selectExpr("vec_id", *[f"{x.rsplit(' ', 1)[0]} AS {x.rsplit(' ', 1)[1]}" for x in rest.split(", ")])
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    long = project(vectors, model, vec_id, embedding).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(identity_error(vectors, model, embedding)).alias("identity_error"),
    )
