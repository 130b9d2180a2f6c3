"""Vector columns as numpy blocks of whole numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str, carry: Iterable[str]) -> tuple[DataFrame, int]:
    """``row`` (struct of the carried columns) and ``vector`` (doubles) of the rows that have a whole vector, and its length.

    Null and empty vectors and those that hold null, NaN or infinity are dropped. Where lengths differ,
    the commonest is taken, the longer of equally common ones, and rows of other lengths are dropped.
    Both columns are made here, so no column name of ``rows`` can clash. Without a row the length is 0.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    found = rows.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    found = found.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))
    lengths = found.groupBy(F.size("vector").alias("length")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return (found.filter(F.size("vector") == top.length), top.length) if top else (found, 0)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches put together and cut so that all but the last hold ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= rows:
            yield _joined([*held, batch.slice(0, rows - n)])
            batch, held, n = batch.slice(rows - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def whole(column: pa.Array, length: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of a list column as an int64 matrix; raises if a number's size is ``most`` or more."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, length)
    with np.errstate(over="ignore"):
        values = np.floor(values * scale)
    if values.size and np.abs(values).max() >= most:
        raise ValueError(f"a component's {scale}-fold is {most} or more, beyond exact whole numbers")
    return values.astype(np.int64)


def no_rows(rows: DataFrame, **columns: str | Column) -> DataFrame:
    """An empty table of ``row`` and the named types."""
    return rows.filter("false").select("row", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()])
