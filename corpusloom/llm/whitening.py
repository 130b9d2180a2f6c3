"""Embedding whitening from an exact covariance.

Components become whole numbers. A first pass has their sums, a second the products of the numbers
less the whole part of their mean: each block is cut into digits so small that float64 products of
digit matrices are exact, and the digits' products are put together as big integers, added up by
task and then over all tasks. So the covariance is exact until it is divided once. Its eigenvectors
are taken on the driver, where only matrices of the vectors' length arrive. A third pass measures
how far the whitened vectors' covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._vectors import blocks, no_rows, usable, whole

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block and bits of a digit: a sum of ROWS products of two digits stays within 53 bits.
ROWS, DIGIT = 8192, 20
#: Whole numbers below this size are exact as doubles.
MOST = 1 << 52
WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """Rows, sums by dimension, eigenvectors as columns by falling eigenvalue, eigenvalues, trace, and the measured error."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the whole part of the mean leaves of the sums."""
        return np.array([s % self.n for s in self.sums], object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components over the roots of their eigenvalues; 0 where there is no variance."""
        centred = (x - self.middle) - (self.rest / self.n).astype(np.float64)
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0)
        return (centred @ self.vectors) * scale

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact sums over the dimensions of (n * x - sum) ** 2."""
        z = x - self.middle
        most = self.n * (int(np.abs(z).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 62:
            return pa.array(((self.n * z - self.rest.astype(np.int64)) ** 2).sum(1)).cast(WIDE)
        wide = ((self.n * z.astype(object) - self.rest) ** 2).sum(1)
        return pa.array([Decimal(v) for v in wide], WIDE)


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Digit matrices as float64, lowest first, each with its number's sign: x is their sum shifted by DIGIT bits a step."""
    sign, size, out = np.sign(x), np.abs(x), []
    while not out or size.any():
        out.append((sign * (size & ((1 << DIGIT) - 1))).astype(np.float64))
        size = size >> DIGIT
    return out


def products(x: np.ndarray) -> np.ndarray:
    """The exact matrix of sums of products of columns, as Python integers; for ROWS rows at most."""
    cut, total = digits(x), np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(cut):
        for j, b in enumerate(cut[: i + 1]):
            part = (a.T @ b).astype(np.int64).astype(object) * (1 << DIGIT * (i + j))
            total += part if i == j else part + part.T
    return total


def _numbers(block: pa.RecordBatch, length: int) -> np.ndarray:
    return whole(block.column(block.schema.get_field_index("vector")), length, SCALE, MOST) + SHIFT


def _totals(vectors: DataFrame, length: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(length, object)
        for block in blocks(batches, ROWS):
            n += block.num_rows
            high, low = np.divmod(_numbers(block, length), 1 << 32)
            sums += high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array([Decimal(s) for s in sums], WIDE)], ["i", "n", "total"])

    found = vectors.select("vector").mapInArrow(run, "i int, n long, total decimal(38,0)")
    rows = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
    return rows[0].n, [int(r.total) for r in rows]


def _products(vectors: DataFrame, length: int, middle: np.ndarray) -> np.ndarray:
    """Sums over all rows of products of the centred numbers."""
    upper = np.triu_indices(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks(batches, ROWS):
            part = products(_numbers(block, length) - middle)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array([Decimal(v) for v in total[upper]], WIDE)], ["i", "j", "total"])

    found = vectors.select("vector").mapInArrow(run, "i int, j int, total decimal(38,0)")
    out = np.zeros((length, length), object)
    for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r.i, r.j] = out[r.j, r.i] = int(r.total)
    return out


def _error(vectors: DataFrame, length: int, fitted: Whitening) -> float:
    """The largest entry of the whitened covariance less the identity, over the components with variance; their exact mean is 0."""
    some = np.flatnonzero(fitted.values > 0)
    if not len(some):
        return 0.0
    pairs = [(int(i), int(j)) for i in some for j in some if i <= j]
    first, second = ([p[k] for p in pairs] for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fitted.values),) * 2)
        for block in blocks(batches, ROWS):
            w = fitted.whitened(_numbers(block, length))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(total[first, second])], ["i", "j", "total"])

    found = vectors.select("vector").mapInArrow(run, "i int, j int, total double")
    sums = found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    return max(abs(r.total / fitted.n - (r.i == r.j)) for r in sums)


def fit(vectors: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of a table with a column ``vector`` of the given length."""
    n, sums = _totals(vectors, length)
    fitted = Whitening(n, sums, np.empty(0), np.empty(0), 0.0)
    rest = fitted.rest
    spread = n * _products(vectors, length, fitted.middle) - np.outer(rest, rest)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in spread])
    values, found = np.linalg.eigh(covariance)
    trace = sum(int(spread[i, i]) for i in range(length)) / (n * n)
    top = slice(None, -components - 1, -1)
    least = length * np.finfo(np.float64).eps * max(values[-1], 0.0)
    fitted = Whitening(n, sums, found[:, top], np.where(values[top] > least, values[top], 0.0), trace)
    return Whitening(n, sums, fitted.vectors, fitted.values, trace, _error(vectors, length, fitted))


RESULT = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}


def whiten(rows: DataFrame, vector: str = "embedding", carry: Iterable[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """``row`` (the carried columns) and the whitened value of each vector for each component.

    Components of vectors become floor(1024 * c) + 100000; one whose 1024-fold is 2**52 or more raises
    ValueError. ``usable`` says which rows are dropped; repeated rows all count, and an empty table
    gives no rows. Vectors shorter than ``components`` have as many components as numbers. A component
    without variance (all rows equal, or fewer rows than components) has whitened 0 and explained 0.
    ``deviation`` is exact, as a decimal. The order of equal eigenvalues' components is any.
    """
    vectors, length = usable(rows, vector, list(rows.columns if carry is None else carry))
    if not length:
        return no_rows(vectors, **RESULT)
    fitted = fit(vectors, length, components)
    k = len(fitted.values)
    explained = fitted.values / fitted.trace if fitted.trace else fitted.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ROWS):
            x = _numbers(block, length)
            again, n = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
            columns = [
                block.column(0).take(again),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(n, fitted.n, np.int64)),
                fitted.deviation(x).take(again),
                pa.array(fitted.whitened(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(n, fitted.error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", *RESULT])

    kinds = ", ".join(f"{name} {kind}" for name, kind in RESULT.items())
    return vectors.mapInArrow(run, T.StructType([vectors.schema["row"], *T._parse_datatype_string(kinds)]))
