"""One-to-one pairs by greedy best score, in rounds that settle whole groups of ties at once.

The greedy rule takes pairs by falling score, then by left, then by right, and leaves out those of
which a side is taken. A left's best pairs are those of its highest score. Lefts with the same score
and the same rights there are a group; were they alone, the first left would take the first right, the
second the second, and so on. A round lets them, up to where that might be wrong: at a right that has a
better pair elsewhere, or that a left outside of the group, before the one that would take it, is as
good for. So a tie of all with all takes one round, and what isn't tied is taken where both sides
are each other's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .relational import top_per_key


def _round(rest: DataFrame) -> DataFrame:
    """``l, r, score`` that the greedy rule is sure to take of the pairs (l, r, score)."""
    best = lambda side, name: rest.groupBy(side).agg(F.max("score").alias(name))
    tagged = rest.join(best("l", "ls"), "l").join(best("r", "rs"), "r")
    of_left = tagged.filter("score = ls")
    mark = lambda seed: F.bit_xor(F.xxhash64("r", F.lit(seed)))
    groups = of_left.groupBy("l").agg(F.struct(F.max("score").alias("s"), F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b")).alias("g"))
    groups = checkpointed(groups)
    nth = lambda side: F.row_number().over(Window.partitionBy("g").orderBy(side))
    lefts = groups.withColumn("nth", nth("l"))
    rights = of_left.join(groups, "l").groupBy("g", "r").agg(F.first("rs").alias("rs")).withColumn("nth", nth("r"))
    # The first left of each group that a right is best for; of these the two first groups tell each which other is first.
    touching = tagged.filter("score = rs").join(groups, "l").groupBy("r", "g").agg(F.min("l").alias("m"))
    placed = touching.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("m"))).filter("k <= 2")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    others = placed.groupBy("r").agg(at(1, "g").alias("g1"), at(1, "m").alias("m1"), at(2, "m").alias("m2"))
    outside = F.when(F.col("g1") == F.col("g"), F.col("m2")).otherwise(F.col("m1"))
    asked = lefts.join(rights, ["g", "nth"]).join(others, "r", "left").withColumn("outside", outside)
    so_far = Window.partitionBy("g").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("outside").over(so_far)
    wrong = (F.col("rs") != F.col("g.s")) | F.coalesce(least < F.col("l"), F.lit(False))
    sure = F.max(wrong.cast("int")).over(so_far) == 0
    return asked.withColumn("sure", sure).filter("sure").select("l", "r", F.col("g.s").alias("score"))


def _able(rest: DataFrame) -> DataFrame:
    """The pairs that can be taken at all.

    When a right's turn comes at its n-th pair, the lefts of the pairs before went to other rights. So with n rights
    in all each takes one of its first n pairs or none, and likewise a left one of as many as there are lefts.
    """
    for side, other in (("r", "l"), ("l", "r")):
        many = rest.select(side).distinct().count()
        rest = top_per_key(rest, [side], [F.desc("score"), F.col(other)], many, "_n").drop("_n") if many else rest
    return rest


#: Pairs that are few enough for the plain loop in one task.
FEW = 50_000


def _plain(rest: DataFrame) -> DataFrame:
    """The greedy rule's pairs of a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights = set(), set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("l").field(0).to_pylist(), batch.column("r").field(0).to_pylist(), strict=True):
                keep.append(a not in lefts and b not in rights)
                if keep[-1]:
                    lefts.add(a)
                    rights.add(b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rest.select("l", "r", "score").repartition(1).sortWithinPartitions(F.desc("score"), "l", "r").mapInArrow(run, rest.select("l", "r", "score").schema)


def greedy_matching(pairs: DataFrame, log: list[int] | None = None, few: int = FEW) -> DataFrame:
    """One-to-one pairs (left, right, score) by greedy best score, ties by left, then right.

    Of pairs that repeat the best counts; a null id is an id, a null score no pair. ``log`` gets the
    number of pairs left before each round; each round takes one at least. The last ``few`` are taken in a plain loop.
    """
    rest = checkpointed(pairs.filter("score is not null").groupBy(F.struct("left").alias("l"), F.struct("right").alias("r")).agg(F.max("score").alias("score")))
    rest = checkpointed(_able(rest))
    taken = []
    while n := rest.count():
        if log is not None:
            log.append(n)
        if n <= few:
            taken.append(checkpointed(_plain(rest)))
            break
        taken.append(checkpointed(_round(rest)))
        for side in ("l", "r"):
            rest = rest.join(taken[-1].select(side), side, "left_anti")
        rest = checkpointed(rest)
    found = rest if not taken else taken[0]
    for more in taken[1:]:
        found = found.unionByName(more)
    return found.select("l.left", "r.right", "score")
