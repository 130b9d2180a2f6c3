"""Token ids of documents in an entropy-coded binary format.

A folder with three Parquet tables: ``table``, the frequencies that all blocks share; ``blocks``,
one row for each block of whole documents in ascending order of doc_id or of a given column; and ``starts``, where in the
corpus each block begins. A block has its documents' ids and lengths, the rANS words, checkpoints,
and checksums of the words and of the ids, so blocks and parts of blocks are decoded independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rans
from ._rows import map_batches, map_texts
from ._store import written

#: A block takes whole documents until it has so many ids; a longer document is a block by itself.
BLOCK = 1 << 18
_BLOCKS = "block bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, width int, words binary, states binary, marks array<bigint>, crc_words bigint, crc_ids bigint"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, order: str = "doc_id") -> DataFrame:
    """``place, doc_id, ids`` in ascending order of a column, then of a digest of the text: place grows along the corpus, ids are packed and end with ``end_id``."""
    from .bpe import encoder

    def run(column: pa.Array) -> list[pa.Array]:
        from .bpe import encoder as of_worker

        return [pa.array([np.append(x, x.dtype.type(end_id)).tobytes() for x in of_worker(tokenizer).encode(column)], pa.binary())]

    if end_id > np.iinfo(encoder(tokenizer).kind).max:
        raise ValueError("the end id does not fit the vocabulary's width")
    rows = docs.select("doc_id", "text", F.col(order).alias("at"), F.xxhash64("text").alias("digest"))
    # With the digest, a null or repeated id that many rows have isn't one range.
    ordered = rows.repartitionByRange("at", "digest").sortWithinPartitions("at", "digest", "doc_id", "text")
    ids = map_texts(ordered, run, "ids binary", carry=["doc_id"])
    return written(ids.select(F.monotonically_increasing_id().alias("place"), "row.doc_id", "result.ids"), "ids")


def frequencies(ids: DataFrame, kind: np.dtype) -> DataFrame:
    """How often each id occurs: summed in each task, then over all; as many rows as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts = np.bincount(np.frombuffer(packed, kind))
                if len(counts) > len(total):
                    counts, total = total, counts
                total[: len(counts)] += counts
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return map_batches(ids.select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, order: str = "doc_id") -> None:
    """Tokenize whole texts (null: empty) and write the folder at ``path``, in ascending order of the column ``order``.

    Every row of ``docs`` is written, ties in the order of a digest of their texts, nulls first; equal
    rows are as many documents. An empty table gives tables without rows. A text longer than a block
    is a block by itself. Columns other than doc_id, text and ``order`` aren't read.
    """
    from .bpe import encoder

    spark, kind = docs.sparkSession, encoder(tokenizer).kind
    ids = tokenized(docs, tokenizer, end_id, order)
    counted = {r["id"]: r["n"] for r in frequencies(ids, kind).collect()}
    counts = np.zeros(max(counted, default=0) + 1, np.int64)
    counts[list(counted)] = list(counted.values())
    frequency = rans.scaled(counts)
    spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(frequency) if f], "id bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(frequency)

    def block(rows: list[tuple[int, int | None, bytes]]) -> tuple:
        flat = np.frombuffer(b"".join(r[2] for r in rows), kind)
        words, states, marks = rans.encode(flat, rans.Table.of(shared.value))
        packed = words.astype("<u4").tobytes()
        return rows[0][0], len(flat), [r[1] for r in rows], [len(r[2]) // kind.itemsize for r in rows], kind.itemsize, packed, states.astype("<u8").tobytes(), marks.tolist(), zlib.crc32(packed), zlib.crc32(flat.astype("<u4").tobytes())

    fields = T._parse_datatype_string(_BLOCKS)
    arrow = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("marks", pa.list_(pa.int64())), ("crc_words", pa.int64()), ("crc_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int | None, bytes]] = []
        size = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(block(rows), arrow, strict=True)], schema=arrow)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(row[2]) // kind.itemsize
                if rows and (row[0] != rows[-1][0] + 1 or size + n > BLOCK):
                    yield out()
                    rows, size = [], 0
                rows.append(row)
                size += n
        if rows:
            yield out()

    map_batches(ids.select("place", "doc_id", "ids"), run, fields.simpleString().removeprefix("struct<").removesuffix(">")).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(fields).parquet(f"{path}/blocks")
    # Where each block begins: within the part of the corpus that one task wrote, and before that part.
    sizes = blocks.select("block", "n_tokens", F.shiftright("block", 33).alias("part"))
    before = lambda by, order: F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before([], "part").alias("parts_before"))
    starts = sizes.select("block", "part", before(["part"], "block").alias("within")).join(parts, "part").select("block", (F.col("within") + F.col("parts_before")).alias("start"))
    starts.write.parquet(f"{path}/starts")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of each document, from the files alone.

    The checksums of every block are compared; one that doesn't fit raises ValueError.
    """
    table = spark.read.parquet(f"{path}/table").collect()
    frequency = np.zeros(max((r["id"] for r in table), default=0) + 1, np.int64)
    for r in table:
        frequency[r["id"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = None
        for batch in batches:
            coding = coding or rans.Table.of(shared.value)
            for b in batch.to_pylist():
                if zlib.crc32(b["words"]) != b["crc_words"]:
                    raise ValueError(f"block {b['block']}: the words' checksum doesn't fit")
                n = b["n_tokens"]
                states = np.frombuffer(b["states"], "<u8").reshape(-1, rans.lanes_for(n))
                flat = rans.decode(np.frombuffer(b["words"], "<u4"), states, np.array(b["marks"], np.int64), n, coding).astype("<u4")
                if zlib.crc32(flat.tobytes()) != b["crc_ids"]:
                    raise ValueError(f"block {b['block']}: the ids' checksum doesn't fit")
                ends = np.cumsum(b["lengths"])
                docs = np.split(flat, ends[:-1])
                columns = [pa.array(b["doc_ids"], pa.int64()), pa.array(ends - np.array(b["lengths"])), pa.array(b["lengths"], pa.int64()), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()), pa.array(np.full(len(docs), b["block"]))]
                names = ["doc_id", "within", "n_tokens", "ids_crc32", "block"]
                if ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int64)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    docs = map_batches(blocks, run, "doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint, block bigint" + ", ids array<bigint>" * ids)
    starts = spark.read.parquet(f"{path}/starts")
    return docs.join(starts, "block").select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
