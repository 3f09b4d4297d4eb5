"""Whitening of embeddings from polarised covariances.

Components become integers, so every sum below is exact. With m the rounded mean of a dimension and y = x - m, a
first pass gives n and the sums, a second one the squares of y for every dimension and of y_i + y_j for every pair of
dimensions. Variances follow from each, and cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. What y is off the true mean
(less than one) is taken out in whole numbers, so no digit is lost before the one division. The matrix, one number
a pair of dimensions, goes to ``eigh``; rows never leave their tasks.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.frames import without

SCALE, SHIFT = 1024, 100_000
# Rows worked on at once inside a task.
SLICE = 4096
# Sums of 64-bit products stay exact below this; larger ones are made of Python's whole numbers.
SAFE = 1 << 62
# Sums of any size travel as digits to this base, which Spark adds up place by place.
BASE = 1 << 60
TOTALS = "at int, place int, value decimal(38,0)"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null and without null or non-finite components."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def whole_numbers(components: np.ndarray) -> np.ndarray:
    """``floor(1024 * c) + 100000`` of each component; whole numbers of any size where 64 bits don't hold them."""
    floors = np.floor(SCALE * components)
    if not len(floors) or np.abs(floors).max(initial=0) < SAFE:
        return floors.astype(np.int64) + SHIFT
    return np.array([int(v) + SHIFT for v in floors.ravel()], object).reshape(floors.shape)


def exact(values: np.ndarray, times: int) -> np.ndarray:
    """``values`` as they are when ``times`` bounds all that is made of them, else as Python's whole numbers."""
    return values if values.dtype == object or times < SAFE else values.astype(object)


def _most(values: np.ndarray) -> int:
    return int(max(abs(int(values.max())), abs(int(values.min())))) if values.size else 0


def _matrices(batches, size: int, place: int):
    """(slice of the batch, its vectors as whole numbers) in slices of bounded size."""
    for batch in batches:
        column = batch.column(place)
        for a in range(0, len(column), SLICE):
            part = column.slice(a, SLICE)
            values = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield batch.slice(a, SLICE), whole_numbers(values.reshape(len(part), size))


def _add_up(total: list[int], values: np.ndarray) -> None:
    for i, v in enumerate(values.tolist()):
        total[i] += v


def _digits(value: int):
    """(place, digit) of a whole number to ``BASE``, all of its sign."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        value, digit = divmod(value, BASE)
        yield place, sign * digit
        place += 1


def _totals(vectors: DataFrame, size: int, width: int, parts) -> list[int]:
    """Sums over all rows of the ``width`` numbers that ``parts(x)`` gives for a slice of vectors."""

    def run(batches):
        total = [0] * width
        for _, x in _matrices(batches, size, 0):
            _add_up(total, parts(x))
        rows = [(i, place, digit) for i, v in enumerate(total) for place, digit in _digits(v)]
        at, place, digit = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(digit, pa.decimal128(38, 0))],
            names=["at", "place", "value"],
        )

    sums = vectors.mapInArrow(run, TOTALS).groupBy("at", "place").agg(F.sum("value").alias("value"))
    found = [0] * width
    for r in sums.collect():  # a few numbers a sum, whatever the rows
        found[r["at"]] += int(r["value"]) * BASE ** r["place"]
    return found


def _sums(x: np.ndarray) -> np.ndarray:
    x = exact(x, _most(x) * SLICE)
    return np.append(np.array([len(x)], x.dtype), x.sum(axis=0))


def pair_squares(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """Sums of (y_i + y_j)^2 for i < j and of y_i^2 for i = j, in the order of ``np.triu_indices``."""
    y = x - np.array(middle, object if _most(np.array(middle, object)) >= SAFE else np.int64)
    y = exact(y, 4 * _most(y) ** 2 * SLICE)
    parts = []
    for i in range(y.shape[1]):
        both = y[:, i:] + np.where(np.arange(i, y.shape[1]) == i, 0, 1) * y[:, i : i + 1]
        parts.append((both * both).sum(axis=0) if y.dtype == object else np.einsum("ij,ij->j", both, both))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def covariances(n: int, middle: list[int], sums: list[int], squares: list[int]) -> np.ndarray:
    """Covariance matrix, each entry rounded once from exact whole numbers."""
    size = len(sums)
    rest = [s - n * m for s, m in zip(sums, middle)]
    at = {(int(i), int(j)): v for i, j, v in zip(*np.triu_indices(size), squares)}
    variance = [n * at[i, i] - rest[i] ** 2 for i in range(size)]
    out = np.empty((size, size))
    for (i, j), v in at.items():
        if i == j:
            out[i, i] = variance[i] / n**2
        else:
            of_sum = n * v - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (of_sum - variance[i] - variance[j]) / (2 * n**2)
    return out


@dataclasses.dataclass
class Whitening:
    """What the fit leaves: rows, sums, eigenvalues (falling), eigenvectors (columns) and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of whole-number vectors; NaN for components without variance."""
        middle = [s // self.n for s in self.sums]
        rest = np.array([s - self.n * m for s, m in zip(self.sums, middle)], np.float64) / self.n
        kept = np.array(middle, x.dtype if x.dtype == object else np.int64)
        centred = (x - kept).astype(np.float64) - rest
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2 over the dimensions of each vector."""
        big = max(map(abs, self.sums), default=0) + self.n * _most(x)
        if big < SAFE and big**2 * self.size < SAFE:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        middle = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, middle)]
        y = x - np.array(middle, object if _most(np.array(middle, object)) >= SAFE else np.int64)
        if self.size * (self.n * (_most(y) + 1)) ** 2 < SAFE and y.dtype != object:
            off = self.n * y - np.array(rest, np.int64)
        else:
            off = self.n * y.astype(object) - np.array(rest, object)
        return (off * off).sum(axis=1).tolist()


def fit(vectors: DataFrame, size: int, components: int) -> Whitening | None:
    """Fit over all rows of ``vectors`` (one array column of ``size`` usable components); None without rows."""
    n, *sums = _totals(vectors, size, size + 1, _sums)
    if not n:
        return None
    middle = [s // n for s in sums]
    squares = _totals(vectors, size, size * (size + 1) // 2, lambda x: pair_squares(x, middle))
    matrix = covariances(n, middle, sums, squares)
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    # one sign for all rows and reruns: the largest entry of each axis is positive
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    # an eigenvalue within rounding of zero is no variance
    noise = max(matrix.diagonal().max(initial=0), 0) * size * np.finfo(float).eps
    values = np.where(values[order] > noise, values[order], 0.0)
    return Whitening(n, sums, values, axes, float(math.fsum(matrix.diagonal())))


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened rows, as they come out, minus the identity."""
    k, size = len(model.values), model.size

    def run(batches):
        total = np.zeros((k + 1, k))
        for _, x in _matrices(batches, size, 0):
            w = model.whiten(x)
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["t"])

    parts = vectors.mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("at", "v"))
    sums = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) * k)
    for r in sums:
        total[r["at"]] = r["v"]
    total = total.reshape(k + 1, k) / model.n
    live = model.values > 0
    off = np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k))[np.ix_(live, live)]
    return float(off.max()) if off.size else None


def dimensions(vectors: DataFrame) -> int:
    """The commonest length of a vector, the larger of equals; 0 without rows."""
    lengths = vectors.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.agg(F.max(F.struct("n", "size")).alias("t")).first()["t"]
    return top["size"] if top else 0


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8
) -> DataFrame:
    """Whitened components of every usable vector, one row a vector and component.

    Columns: ``key``, ``component`` (from 1, by falling eigenvalue), ``n`` (rows fitted), ``deviation`` (decimal, the
    exact sum over dimensions of (n x - S)^2), ``whitened``, ``explained`` (share of the trace) and ``identity_error``
    (of the whitened rows as a whole). Rows whose vector is null or holds null or non-finite components take no part,
    nor do vectors of another than the commonest length (of equally common ones the longest). Keys may be null or
    repeat: each row counts and has its own result rows. Of components without variance (constant
    dimensions, copies of one vector, one row alone) ``whitened`` is null; ``explained`` is null when nothing varies at all.
    Components may be up to 2^400 in size; a ``deviation`` beyond 38 digits is null.
    An empty table gives an empty result. Other columns of ``rows`` are left out.
    """
    fits = rows.select(F.col(key).alias(key), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    size = dimensions(fits.select("vector"))
    kind = rows.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    fits = fits.filter(F.size("vector") == size)
    vectors = fits.select("vector")
    model = fit(vectors, size, components)
    error = identity_error(vectors, model)
    k = len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches):
        for batch, x in _matrices(batches, size, 1):
            m = len(x)
            w = model.whiten(x).ravel()
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array([d if d < 10**38 else None for d in model.deviations(x)], pa.decimal128(38, 0)).take(again),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=schema.names,
            )

    return fits.mapInArrow(run, schema)
