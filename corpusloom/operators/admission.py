"""Requests admitted in order while an allowance lasts, without a key's requests passing through one task.

A request is granted if its amount is no more than what is left; refusals take nothing. A key's requests
are cut into blocks of its order. In each round all blocks of all keys still open are looked at with
what was left for their key: amounts up to half of that are granted as long as their sum stays within
half, and larger ones refused as long as none fits beside that sum. A prefix sum over the blocks' sums
finds the first block where either ends; that block is run through in order. What is left has halved
by then, so rounds are as many as the logarithm of the allowance, however many requests there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .relational import numbered

#: Requests of a block, and more than any amount.
BLOCK, NEVER = 8192, 1 << 62


def in_order(amounts: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Which amounts are taken in order from what is left, refusals taking nothing, and what is left then.

    What is left only shrinks, so an amount above it is refused for good; the others are taken up to
    the first that doesn't fit.
    """
    out = np.zeros(len(amounts), bool)
    rest = np.arange(len(amounts))
    while len(rest):
        rest = rest[amounts[rest] <= left]
        total = np.cumsum(amounts[rest])
        fit = int(np.searchsorted(total, left, side="right"))
        out[rest[:fit]] = True
        left -= int(total[fit - 1]) if fit else 0
        rest = rest[fit:]
    return out, left


def by_rule(amounts: np.ndarray, left: int) -> tuple[np.ndarray, int, int]:
    """Which amounts are at most half of what is left, their sum, and the least that a larger one needs beside those before it."""
    small = amounts <= left // 2
    taken = np.where(small, amounts, 0)
    before = np.cumsum(taken) - taken
    large = ~small & (amounts <= left)
    return small, int(taken.sum()), int((amounts + before)[large].min(initial=NEVER))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [by_rule(np.asarray(a.values), left)[1:] for a, left in zip(batch.column("amounts"), batch.column("left").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("block"), batch.column("left"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["_k", "block", "left", "taken", "least"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [in_order(np.asarray(a.values), n)[1] for a, n in zip(batch.column("amounts"), batch.column("left").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("block"), pa.array(left, pa.int64())], ["_k", "block", "left"])


def _decided(blocks: DataFrame) -> DataFrame:
    """``_k, id, granted`` of the requests of blocks (_k, ids, amounts, left, rule)."""
    schema = T.StructType([blocks.schema["_k"], T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("granted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                amounts, left = np.asarray(batch.column("amounts")[i].values), batch.column("left")[i].as_py()
                ok = by_rule(amounts, left)[0] if batch.column("rule")[i].as_py() else in_order(amounts, left)[0]
                yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(np.full(len(ok), i))), batch.column("ids").slice(i, 1).flatten(), pa.array(ok)], schema.names)

    return blocks.select("_k", "ids", "amounts", "left", "rule").mapInArrow(run, schema)


def admitted(requests: DataFrame, allowance: int, key: str, order: Sequence[str], amount: str, block: int = BLOCK, log: list[int] | None = None) -> DataFrame:
    """``key``, the last order column and ``granted`` of each request; keys are independent, a null key is a key.

    Amounts are 0 or more, and null is 0; a negative one raises. ``log`` gets the number of keys open in each round.
    """
    last = order[-1]
    size = F.coalesce(F.col(amount).cast("bigint"), F.lit(0))
    checked = F.when(size < 0, F.raise_error(F.lit("an amount is below 0"))).otherwise(size)
    rows = requests.select(F.struct(F.col(key).alias("key")).alias("_k"), *order, checked.cast("bigint").alias("_a"))
    many = rows.groupBy("_k").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("_k")
    few = rows.join(many, "_k", "left_anti").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(*order, "_a"))).alias("r"))
    lists = [F.col(f"r.{last}").alias("ids"), F.col("r._a").alias("amounts")]
    out = _decided(few.select("_k", *lists, F.lit(allowance).cast("bigint").alias("left"), F.lit(False).alias("rule")))
    many = written(many, "large-keys")
    if not many.isEmpty():
        placed = numbered(rows.join(many, "_k", "left_semi"), ["_k"], order, "_nth").withColumn("block", F.floor((F.col("_nth") - 1) / block))
        blocks = written(placed.groupBy("_k", "block").agg(F.array_sort(F.collect_list(F.struct("_nth", last, "_a"))).alias("r")).select("_k", "block", *lists), "blocks")
        out = out.unionByName(_decided(blocks.join(_spans(blocks, many, allowance, log), "_k").filter("block >= first and block < until")))
    return out.select(F.col("_k.key").alias(key), F.col("id").alias(last), "granted")


def _spans(blocks: DataFrame, keys: DataFrame, allowance: int, log: list[int] | None) -> DataFrame:
    """``_k, first, until, left, rule``: how the blocks of each key are decided, and with what left."""
    state = keys.select("_k", F.lit(0).cast("bigint").alias("first"), F.lit(allowance).cast("bigint").alias("left"))
    spans = []
    while True:
        kind = blocks.schema["_k"].dataType.simpleString()
        live = blocks.join(state, "_k").filter("block >= first").select("_k", "block", "amounts", "left")
        figures = live.mapInArrow(_figures, f"_k {kind}, block bigint, left bigint, taken bigint, least bigint")
        before = F.coalesce(F.sum("taken").over(Window.partitionBy("_k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = figures.withColumn("before", before).filter("2 * (before + taken) > left or least <= left - before")
        event = ends.groupBy("_k").agg(F.min_by(F.struct("block", (F.col("left") - F.col("before")).alias("left")), "block").alias("e"))
        now = written(state.join(event, "_k", "left"), "rounds")
        spans.append(now.select("_k", "first", F.coalesce("e.block", F.lit(NEVER)).alias("until"), "left", F.lit(True).alias("rule")))
        hit = now.filter("e is not null").select("_k", F.col("e.block").alias("block"), F.col("e.left").alias("left"))
        spans.append(hit.select("_k", F.col("block").alias("first"), (F.col("block") + 1).alias("until"), "left", F.lit(False).alias("rule")))
        if log is not None:
            log.append(now.count())
        ran = blocks.join(hit, ["_k", "block"]).select("_k", "block", "amounts", "left").mapInArrow(_left, f"_k {kind}, block bigint, left bigint")
        state = written(ran.select("_k", (F.col("block") + 1).alias("first"), "left"), "balances")
        if state.isEmpty():
            break
    found = spans[0]
    for span in spans[1:]:
        found = found.unionByName(span)
    return found
