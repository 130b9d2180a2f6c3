"""Ordered folds of a key's rows without ever holding them: by parts that combine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Beyond any score.
FAR = 1 << 60


#: Ranges by quantiles, and rows that a part of a range aims at.
RANGES, PART_ROWS = 64, 100_000


def in_parts(rows: DataFrame, at: str, ranges: int = RANGES, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows with ``_part``, a number that grows with the order column.

    Quantiles over all rows give ranges of about as many rows each, and ranges have as many parts of equal
    width as leave about ``part_rows`` rows in one. So parts grow in number with the table, and however
    many rows a key has, no more than a part's are together.
    """
    order = F.unix_micros(F.col(at).cast("timestamp"))
    found = rows.agg(F.count("*").alias("n"), F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(ranges + 1)]), 10_000).alias("cuts")).first()
    cuts = sorted(set(found["cuts"] or []))
    if len(cuts) < 2:
        return rows.withColumn("_part", F.lit(0).cast("bigint"))
    inner = F.array(*[F.lit(c).cast("bigint") for c in cuts[1:-1]]) if len(cuts) > 2 else F.array().cast("array<bigint>")
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    each = max(1, -(-found["n"] // (part_rows * (len(cuts) - 1))))
    k = F.size(F.filter(inner, lambda c: c <= order))
    low, high = F.get(bounds, k), F.get(bounds, k + 1)
    within = F.least(F.greatest(F.floor((order - low) * each / (high - low + 1)), F.lit(0)), F.lit(each - 1))
    return rows.withColumn("_part", (k * F.lit(each) + within).cast("bigint"))


def clamped_sums(rows: DataFrame, key: Sequence[str], order: Sequence[str], sums: Mapping[str, tuple[str, int, int, int]], ranges: int = RANGES, part_rows: int = PART_ROWS) -> DataFrame:
    """Key, each named sum and ``n``: deltas added in order, clamped at each step.

    ``sums`` names the delta column, the start, and the bounds of each. Adding and clamping is a map
    x -> min(max(x + s, l), h), and one after another is again such a map; so ranges of the order of keys
    with more than ``part_rows`` rows are folded to (s, l, h) by themselves, and a key's few maps are
    put together in order. Other keys are folded as they are.
    """
    named = rows.withColumn("_k", F.struct(*[F.col(c) for c in key]))
    large = written(named.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > part_rows).select("_k"), "large-keys")
    if large.isEmpty():
        return _folded_whole(rows, key, order, sums)
    whole = _folded_whole(named.join(large, "_k", "left_anti").drop("_k"), key, order, sums)
    return whole.unionByName(_folded_in_parts(named.join(large, "_k", "left_semi").drop("_k"), key, order, sums, ranges, part_rows))


def _clamp(x: Column, low: int | Column, high: int | Column) -> Column:
    as_long = lambda v: F.lit(v).cast("bigint") if isinstance(v, int) else v
    return F.least(F.greatest(x, as_long(low)), as_long(high))


def _ordered(order: Sequence[str], sums: Mapping[str, tuple[str, int, int, int]]) -> Column:
    one = F.struct(*[F.col(c) for c in order], *[F.col(d).cast("bigint").alias(f"_{name}") for name, (d, _, _, _) in sums.items()])
    return F.array_sort(F.collect_list(one)).alias("_rows")


def _folded_whole(rows: DataFrame, key: Sequence[str], order: Sequence[str], sums: Mapping[str, tuple[str, int, int, int]]) -> DataFrame:
    held = rows.groupBy(*key).agg(_ordered(order, sums))
    folded = lambda name, begin, low, high: F.aggregate("_rows", F.lit(begin).cast("bigint"), lambda x, r: _clamp(x + r[f"_{name}"], low, high))
    return held.select(*key, *[folded(name, begin, low, high).alias(name) for name, (_, begin, low, high) in sums.items()], F.size("_rows").cast("bigint").alias("n"))


def _folded_in_parts(rows: DataFrame, key: Sequence[str], order: Sequence[str], sums: Mapping[str, tuple[str, int, int, int]], ranges: int, part_rows: int) -> DataFrame:
    held = in_parts(rows, order[0], ranges, part_rows).groupBy(*key, "_part").agg(_ordered(order, sums))

    def then(a: Column, b: tuple[Column, Column, Column]) -> Column:
        s, low, high = b
        return F.struct((a["s"] + s).alias("s"), _clamp(a["l"] + s, low, high).alias("l"), _clamp(a["h"] + s, low, high).alias("h"))

    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(-FAR).cast("bigint").alias("l"), F.lit(FAR).cast("bigint").alias("h"))

    def folded(name: str, low: int, high: int) -> Column:
        # Far bounds stay far: they are clamped by the first step's own.
        return F.aggregate("_rows", start, lambda m, r: then(m, (r[f"_{name}"], F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))))

    maps = held.select(*key, "_part", F.size("_rows").alias("_n"), *[folded(name, low, high).alias(name) for name, (_, _, low, high) in sums.items()])
    joined = maps.groupBy(*key).agg(F.sum("_n").alias("n"), *[F.array_sort(F.collect_list(F.struct("_part", F.col(name).alias("m")))).alias(name) for name in sums])
    value = lambda name, begin: F.aggregate(name, F.lit(begin).cast("bigint"), lambda x, r: _clamp(x + r["m"]["s"], r["m"]["l"], r["m"]["h"]))
    return joined.select(*key, *[value(name, begin).alias(name) for name, (_, begin, _, _) in sums.items()], "n")
