"""Whitening of vectors by a QR factorisation of tall, skinny data (TSQR), without a covariance matrix.

1. Sums by dimension are exact, as the entries are whole numbers; so every row is centred to the last bit of a double.
2. Each task factors its centred rows batch by batch, and keeps R, a square of one row a dimension.
3. R factors are stacked and factored again by `FAN`, until one is left.
4. Singular values of the last R give the variances, its right singular vectors the components: they whiten the rows.

A second pass measures what has been reached: the covariance of the whitened rows, combined from parts that are centred
by their own means before they are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .memory import given_back
from .store import written

#: Matrices that are merged in one task.
FAN = 16
#: Entries beyond this after scaling count as this, so that sums of a batch fit 64 bits.
_MOST = float(1 << 49)
#: Variances below this share of the largest are taken for rounding.
_NOTHING = 1e-13


@dataclass
class Whitening:
    """n: rows; sums: exact ones by dimension; variances, falling, and components (a row each); error: largest absolute entry
    of the whitened rows' covariance minus the identity, over the components that have a variance; None without any."""

    width: int
    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    error: float | None = None

    @property
    def explained(self) -> np.ndarray:
        total = self.variances.sum()
        return self.variances / total if total > 0 else np.zeros(self.width)

    @property
    def real(self) -> np.ndarray:
        """Which components have a variance."""
        return self.variances > _NOTHING * self.variances[:1].max(initial=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once where n * x fits 64 bits."""
        return self.shifted(x).astype(np.float64) / self.n

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64 bits where they are enough, else Python's integers."""
        most = max([int(np.abs(x).max(initial=0)), *(abs(s) // self.n for s in self.sums)])
        kind = np.int64 if self.n * (most + 1) < 1 << 61 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S)^2 of each row, exact."""
        shifted = self.shifted(x)
        if shifted.dtype == np.int64 and float(np.abs(shifted).max(initial=0)) ** 2 * max(1, self.width) < 2.0**62:
            return (shifted * shifted).sum(axis=1).tolist()
        return [sum(int(v) ** 2 for v in row) for row in shifted.tolist()]

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """Rows of x on the first components, at unit variance; components without a variance are not numbers."""
        scale = np.where(self.real, np.sqrt(np.maximum(self.variances, 0)), np.nan)[:most]
        return self.centred(x) @ self.components[:most].T / scale


def entries(column: pa.Array, width: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows hold `width` finite entries, floor(scale * entry) + shift of those rows as whole numbers)."""
    kept = np.flatnonzero((pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width) & (width > 0))
    if not len(kept):
        return kept, np.zeros((0, width), np.int64)
    values = pc.list_flatten(column.take(pa.array(kept))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(values).all(axis=1)  # a null entry has become NaN
    return kept[finite], np.clip(np.floor(values[finite] * scale), -_MOST, _MOST).astype(np.int64) + shift


def _column(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.select(F.col(vector).cast("array<double>").alias("v"))


def _batches(batches: Iterator[pa.RecordBatch], width: int, scale: float, shift: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 13):
            x = entries(batch.column(0).slice(at, 1 << 13), width, scale, shift)[1]
            if len(x):
                yield x


def _sums(vectors: DataFrame, vector: str, width: int, scale: float, shift: int) -> tuple[int, list[int]]:
    """Rows that count, and the sums of their entries; a row for each task and dimension is added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for x in _batches(batches, width, scale, shift):
            n += len(x)
            total = total + x.sum(axis=0, dtype=np.int64).astype(object)  # 2^13 entries of at most 2^49 and a shift
        if n:
            columns = [pa.array(range(width), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "total", "n"])

    parts = _column(vectors, vector).mapInArrow(add, "dim int, total decimal(38,0), n bigint")
    rows = sorted(parts.groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [0] * width)


def _merged(parts: DataFrame, merge, schema: str) -> list[np.ndarray]:
    """Matrices (part, matrix as array<double>) merged by FAN until one is left, and its values; an empty list of none.
    merge: two flat matrices to one. Each round is written, so a lost executor repeats a part of one round."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            for p, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = m.values.to_numpy()
                if p == part:
                    held = merge(held, m)
                    continue
                if held is not None:
                    yield one(part, held)
                part, held = p, m
        if held is not None:
            yield one(part, held)

    def one(part: int, matrix: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([matrix.tolist()], pa.list_(pa.float64()))], ["part", "matrix"])

    parts = written(parts, "matrices")
    largest = parts.agg(F.max("part")).first()[0]
    if largest is None:
        return []
    while True:
        largest //= FAN
        fewer = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("bigint"))
        parts = written(fewer.repartition("part").sortWithinPartitions("part").mapInArrow(join, schema), "matrices")
        if not largest:
            return [np.array(r["matrix"]) for r in parts.collect()]


_MATRIX = "part bigint, matrix array<double>"


def _one_row(matrix: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([matrix.ravel().tolist()], pa.list_(pa.float64()))], ["part", "matrix"])


def _stacked(one: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
    """R of two R factors on top of each other."""
    return np.linalg.qr(np.concatenate([one.reshape(-1, width), other.reshape(-1, width)]), mode="r").ravel()


def _r_factor(vectors: DataFrame, vector: str, fit: Whitening, scale: float, shift: int) -> np.ndarray:
    width = fit.width

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in _batches(batches, width, scale, shift):
            rows = fit.centred(x)
            r = np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")
        if r is not None:
            yield _one_row(r)

    parts = _column(vectors, vector).mapInArrow(lambda b: given_back(factor(b)), _MATRIX)
    return _merged(parts, lambda a, b: _stacked(a, b, width), _MATRIX)[0].reshape(-1, width)


def _combined(one: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """(n, mean, sums of products about the mean) of two parts together."""
    (n, a, p), (m, b, q) = ((v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)) for v in (one, other))
    step = b - a
    return np.concatenate([[n + m], a + step * (m / (n + m)), (p + q + np.outer(step, step) * (n * m / (n + m))).ravel()])


def _identity_error(vectors: DataFrame, vector: str, fit: Whitening, most: int, scale: float, shift: int) -> float | None:
    width, good = fit.width, fit.real[:most]
    k = int(good.sum())
    if not k:
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in _batches(batches, width, scale, shift):
            w = fit.whitened(x, most)[:, good]
            mean = w.mean(axis=0)
            part = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
            held = part if held is None else _combined(held, part, k)
        if held is not None:
            yield _one_row(held)

    parts = _column(vectors, vector).mapInArrow(measure, _MATRIX)
    found = _merged(parts, lambda a, b: _combined(a, b, k), _MATRIX)[0]
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def fitted(vectors: DataFrame, vector: str = "embedding", most: int = 8, scale: float = 1.0, shift: int = 0) -> Whitening:
    """The whitening of the whole numbers x = floor(scale * entry) + shift of all vectors that count; components beyond `most`
    play no part in its error. To the driver come sums by dimension and one triangular matrix."""
    ship(vectors.sparkSession)
    width = _column(vectors, vector).agg(F.max(F.size("v"))).first()[0]
    width = max(0, width or 0)
    n, sums = _sums(vectors, vector, width, scale, shift) if width else (0, [])
    fit = Whitening(width, n, sums, np.zeros(width), np.eye(width))
    if not n:
        return fit
    _, s, rows = np.linalg.svd(_r_factor(vectors, vector, fit, scale, shift))
    fit.variances, fit.components = np.concatenate([s, np.zeros(width - len(s))]) ** 2 / n, rows
    fit.error = _identity_error(vectors, vector, fit, most, scale, shift)
    return fit


def whitened(vectors: DataFrame, fit: Whitening, key: str = "vec_id", vector: str = "embedding", most: int = 8, scale: float = 1.0, shift: int = 0) -> DataFrame:
    """For every row of vectors that counts and each of the first `most` components (all, if fewer): key, component (from 1),
    n, deviation (sum over dimensions of (n * x - S)^2, exact; null beyond 38 digits), whitened, explained (share of the
    variance) and identity_error.

    A row counts if its vector is as wide as the widest and holds finite numbers only: null vectors do not count, nor those
    with null, NaN or infinite entries, nor shorter ones, which lack entries. Entries beyond 2^49 after scaling count as that.
    Keys play no part: null and repeated ones are rows like others. A component without variance has whitened null; where
    there is none at all, explained is 0 and identity_error null. Other columns are not read. An empty table, or one of null
    and empty vectors, gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    width, k = fit.width, min(most, fit.width)

    def map_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(at, 1 << 12)
                own, x = entries(part.column(1), width, scale, shift)
                if not len(own):
                    continue
                count = len(own)
                deviation = pa.array([None if d >= 10**38 else Decimal(d) for d in fit.deviation(x)], pa.decimal128(38, 0))
                again = np.repeat(np.arange(count), k)
                columns = [
                    part.column(0).take(pa.array(own[again])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, fit.n)),
                    deviation.take(pa.array(again)),
                    pa.array(fit.whitened(x, k).ravel(), from_pandas=True),
                    pa.array(np.tile(fit.explained[:k], count)),
                    pa.array([fit.error] * (count * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.mapInArrow(lambda b: given_back(map_(b)), schema)
