"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import with_group
from ._store import checkpoint


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a and b); the root is the least node of the component.

    Alternating star contraction: large stars link each larger neighbour to the least one, small
    stars link the smaller ones, until nothing changes. A hub's neighbours are dealt into parts, each
    of which gets the hub's least neighbour (``with_group``), so they are never in one task. Self links
    and repeated links do no harm; nodes without links do not appear.
    """
    least = {"m": (F.min("v"), F.min)}
    now = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_group(both, ["u"], F.col("v"), least).filter("v > u").select(F.col("v").alias("u"), F.least(F.col("u"), F.col("m")).alias("v")).distinct()
        small = with_group(large, ["u"], F.col("v"), least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = checkpoint(small.filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
