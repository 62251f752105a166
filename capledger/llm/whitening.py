"""Embedding whitening: exact covariance, QDWH spectral divide-and-conquer, projection by a broadcast matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.session import stage

COMPONENTS = 16
# An entry c becomes floor(STEPS * c) + OFFSET.
STEPS, OFFSET = 64, 1_000_000
# Entries beyond this many steps are unusable; whole numbers below EXACT are exact as doubles.
LARGEST, EXACT = 1 << 52, 1 << 53
EPS = float(np.finfo(np.float64).eps)


# Whole vectors


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("_vector").cast(pa.list_(pa.float64()))
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        entries = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * STEPS)
        owner = np.repeat(np.arange(len(size)), size)
        usable = size > 0
        usable[owner[~(np.abs(entries) <= LARGEST)]] = False  # a NULL entry reads as NaN
        ends = np.concatenate(([0], np.cumsum(size[usable]))).astype(np.int32)
        numbers = pa.array(entries[usable[owner]].astype(np.int64) + OFFSET)
        columns = [batch.column("_id").filter(pa.array(usable)), pa.array(size[usable], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), numbers)], names=["_id", "_size", "_x"])


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``_id, _x``: the usable rows, each entry as floor(64 * c) + 1000000.

    Left out are rows whose vector is NULL or empty, holds NULL, NaN, an infinity or an entry beyond 2^52 / 64, or has
    another length than most usable rows (of equally frequent lengths the larger).
    """
    kind = dict(rows.dtypes)[key]
    read = rows.select(F.col(key).alias("_id"), F.col(vector).alias("_vector"))
    made = stage(read.mapInArrow(_whole, f"_id {kind}, _size int, _x array<long>"), "whole-vectors")
    usual = made.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("_size")).first()
    return made.where(F.col("_size") == F.lit(usual["_size"] if usual else 0)).select("_id", "_x")


def _matrix(batch: pa.RecordBatch, center: list[int]) -> np.ndarray:
    """The vectors of a batch less a whole-numbered centre."""
    flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(center)) - np.array(center, dtype=np.int64)


# Exact moments


def exact_sum(y: np.ndarray) -> np.ndarray:
    """Column sums as Python numbers."""
    wide = int(np.abs(y).max(initial=0)) * len(y) >= 1 << 62
    return (y.astype(object) if wide else y).sum(axis=0).astype(object)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """Sums of products of every two columns as Python numbers. Products run as doubles in blocks of rows whose sums stay
    exact; entries too large for a block of one row multiply as Python numbers."""
    largest = int(np.abs(y).max(initial=1)) ** 2
    if largest >= EXACT:
        return y.astype(object).T @ y.astype(object)
    rows, real, total = (EXACT - 1) // max(largest, 1), y.astype(np.float64), 0
    for low in range(0, len(y), rows):
        part = real[low : low + rows]
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _moments(center: list[int], products: bool):
    """Rows (i, j, sum as text, vectors) of one task: column sums (j NULL), or products of columns i <= j."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch, center)
                n, total = n + len(y), total + (exact_gram(y) if products else exact_sum(y))
        if n:
            i, j = np.triu_indices(len(center)) if products else (np.arange(len(center)), None)
            sums = total[i, j] if products else total
            second = pa.array(j, pa.int32()) if products else pa.nulls(len(i), pa.int32())
            columns = [pa.array(i, pa.int32()), second, pa.array(map(str, sums.tolist()), pa.string()), pa.array([n] * len(i), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "s", "n"])

    return moments


def _exact(fit_list: DataFrame, center: list[int], products: bool) -> tuple[int, dict[tuple[int, int | None], int]]:
    """(vectors, sums by (i, j)): so many numbers as a vector has entries, or pairs of them, whatever the rows."""
    parts = fit_list.mapInArrow(_moments(center, products), "i int, j int, s string, n long")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    return (rows[0]["n"] if rows else 0), {(r["i"], r["j"]): int(r["s"]) for r in rows}


# Spectral divide-and-conquer


def polar(a: np.ndarray) -> np.ndarray | None:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps; None if it is singular.

    Steps with a large weight use a QR factorisation, the rest a Cholesky one.
    """
    n = len(a)
    x, identity = a / np.linalg.norm(a), np.eye(n)
    try:
        low = min(1.0, 1 / np.linalg.norm(np.linalg.inv(x)))
    except np.linalg.LinAlgError:
        return None
    if not low > n * EPS:
        return None
    for _ in range(30):
        low2 = low * low
        d = (4 * max(1 - low2, 0.0) / low2**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low2) / (low2 * root), 0.0)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:
            both, _ = np.linalg.qr(np.vstack((np.sqrt(r) * x, identity)))
            x = (q / r) * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        else:
            factor = np.linalg.cholesky(identity + r * x.T @ x)
            x = (q / r) * x + (p - q / r) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low2) / (1 + r * low2))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < EPS ** (1 / 3):
            break
    return x


def _split(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, int] | None:
    """(basis, k): the first k columns span the eigenvectors above the shift, the others those below."""
    n = len(a)
    factor = polar(a - shift * np.eye(n))
    if factor is None:
        return None
    k = int(round((np.trace(factor) + n) / 2))
    if not 0 < k < n:
        return None
    projector = (factor + np.eye(n)) / 2
    start = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(4):
        basis, _ = np.linalg.qr(projector @ start, mode="complete")
        if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= n * EPS * scale:
            break
        start = basis[:, :k]
    return basis, k


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix.

    The polar factor of the shifted matrix gives the projectors on the invariant subspaces above and below the
    shift; both are split in turn until a subspace has one dimension, or eigenvalues that rounding cannot part.
    """
    scale = float(np.linalg.norm(a))
    done, todo = [], [(a, np.eye(len(a)))]
    while todo:
        part, basis = todo.pop()
        n, mean = len(part), float(np.trace(part)) / len(part)
        spread = float(np.linalg.norm(part - mean * np.eye(n)))
        if n == 1 or spread <= n * EPS * scale:
            done += [(float(part[i, i]), basis[:, i]) for i in range(n)]
            continue
        # The mean lies strictly between the eigenvalues; small steps aside avoid one that it may equal.
        shifts = [float(np.median(np.diag(part))), *(mean + s * spread / n for s in (0.0, 0.01, -0.01, 0.1, -0.1, 0.3, -0.3))]
        found = next((f for s in shifts if (f := _split(part, s, scale))), None)
        if found is None:
            raise ArithmeticError("no shift parts the eigenvalues")
        turn, k = found
        inner = turn.T @ part @ turn
        for side in (slice(0, k), slice(k, n)):
            half = inner[side, side]
            todo.append(((half + half.T) / 2, basis @ turn[:, side]))
    vectors = np.column_stack([v / np.linalg.norm(v) for _, v in done])
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# Fit and projection


@dataclass(frozen=True)
class Whitener:
    """What was fitted: vectors, a whole-numbered centre near the mean, sums around it, variances and components."""

    n: int
    center: list[int]
    around: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened components of vectors less the centre."""
        offset = np.array([s / self.n for s in self.around])
        return (y - offset) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2, exact; NULL where it is no long."""
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if largest * largest * len(self.center) < 1 << 63:
            return ((y * self.n - np.array(self.around, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        wide = (y.astype(object) * self.n - np.array(self.around, dtype=object)) ** 2
        return [v if v < 1 << 63 else None for v in wide.sum(axis=1).tolist()]


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Mean and components of a staged list of whole vectors (``_x``); None for an empty one.

    Sums and products are whole numbers, so neither their order nor a task that runs again changes a bit. Vectors
    are centred on the whole number nearest the mean before they are multiplied, and the rest of the mean is
    taken out exactly. What comes to the driver is one number per pair of dimensions. Components
    without variance (to rounding) cannot be whitened and are left out.
    """
    width = fit_list.select(F.size("_x")).first()
    if width is None:
        return None
    n, sums = _exact(fit_list, [OFFSET] * width[0], False)
    near = [(2 * sums[i, None] + n) // (2 * n) for i in range(width[0])]
    center = [OFFSET + c for c in near]
    around = [sums[i, None] - n * c for i, c in enumerate(near)]
    _, products = _exact(fit_list, center, True)
    covariance = np.zeros((width[0], width[0]))
    for (i, j), s in products.items():
        covariance[i, j] = covariance[j, i] = (n * s - around[i] * around[j]) / (n * n)
    trace = float(np.trace(covariance))
    if not trace:
        return Whitener(n, center, around, 0.0, np.zeros(0), np.zeros((width[0], 0)))
    values, vectors = eigen(covariance)
    some = values[:components] > width[0] * EPS * trace
    return Whitener(n, center, around, trace, values[:components][some], vectors[:, :components][:, some])


def _spreads(whitener: Whitener):
    def spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whitener.values)
        total = np.zeros((k, k))
        for batch in batches:
            z = whitener.project(_matrix(batch, whitener.center))
            total += z.T @ z
        i, j = (a.ravel() for a in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    return spreads


def identity_error(fit_list: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened list less the identity, measured over the whole list."""
    rows = fit_list.mapInArrow(_spreads(whitener), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max((abs(r["s"] / whitener.n - (r["i"] == r["j"])) for r in rows), default=0.0)


def _whiten(whitener: Whitener):
    def whiten_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whitener.values)
        for batch in batches:
            y = _matrix(batch, whitener.center)
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * k)
            lists = pa.ListArray.from_arrays(ends, pa.array(whitener.project(y).ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(whitener.deviation(y), pa.int64()), lists], names=["_id", "deviation", "whitened"]
            )

    return whiten_


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
) -> tuple[DataFrame, Whitener | None, float]:
    """(``key, deviation, whitened`` per usable row, the fit, the identity error).

    The fit list has each distinct whole vector once, so copies weigh nothing; ``whitened`` has one entry per component
    by falling variance. Unusable rows (``whole_vectors``) are dropped; NULL keys stay; repeated rows are
    whitened each. Without usable rows the result is empty and the fit None; where all vectors are equal ``whitened`` is
    empty. Other columns play no part.
    """
    usable = whole_vectors(rows, key, vector)
    fit_list = stage(usable.select("_x").distinct(), "fit-list")
    found = fit(fit_list, components)
    schema = f"_id {dict(usable.dtypes)['_id']}, deviation long, whitened array<double>"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", key), None, 0.0
    return usable.mapInArrow(_whiten(found), schema).withColumnRenamed("_id", key), found, identity_error(fit_list, found)
