"""Apply a function on batches of texts to the rows of a table, carrying the rows along."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import pieces
from ._store import small_batches


def map_texts(docs: DataFrame, fn: Callable[[pa.Array], list[pa.Array]], result: str, text: str = "text", carry: Iterable[str] | None = None) -> DataFrame:
    """A table ``row`` (struct of the carried columns, all by default) and ``result`` (struct of what ``fn`` returns).

    ``fn`` gets an Arrow array of texts of about a megabyte and returns one array for each field of
    ``result``, a DDL string. Both sides are structs, so no column name of ``docs`` can clash.
    """
    carry = list(docs.columns if carry is None else carry)
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = T._parse_datatype_string(result)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.StructArray.from_arrays(fn(piece.column(1)), names)], ["row", "result"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("result", fields)]))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Parts that a group is dealt into by ``with_group``.
SALTS = 1024


def with_group(rows: DataFrame, keys: list[str], of: Column, figures: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """Rows with aggregates of their group, however large a group is.

    ``figures`` names each aggregate and how partial ones are put together. A group is dealt into
    ``SALTS`` parts by a hash of ``of``; parts are aggregated, then groups over their parts, and each
    part gets its group's figures back, so no task sees more than a part of a group. Null keys are dropped.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*[first.alias(name) for name, (first, _) in figures.items()])
    groups = parts.groupBy(*keys).agg(*[merge(name).alias(name) for name, (_, merge) in figures.items()])
    back = parts.select(*keys, "_salt").join(groups, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")
