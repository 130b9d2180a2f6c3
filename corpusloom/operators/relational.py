"""Keyed picks, interval joins, unique and ordered matching, ranked fills."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """One row for each key, the first by ``order``, by an aggregate that combines before the shuffle.

    ``order`` must be ascending expressions without nulls that end in a unique one.
    """
    columns = [c for c in (keep or df.columns) if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*key, "_row.*")


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; Spark cuts groups to ``n`` before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def summed_before(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over the rows of their key that stand before them by ``order``, without any key in one task.

    Rows are sorted by ranges over all keys and written. What stands before a row are the rows before
    it in its range, and its key's rows in the ranges before, of which there is one sum for each range.
    """
    ordered = df.withColumn("_v", value).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    rows = written(ordered.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    so_far = lambda c, by, at: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy(*key, "_range").agg(F.sum("_v").alias("_sum"))
    offsets = ranges.withColumn("_before", so_far("_sum", key, "_range")).drop("_sum")
    within = rows.withColumn("_within", so_far("_v", [*key, "_range"], "_at"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*key, "_range")]
    joined = within.alias("r").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_before") + F.col("_within")).alias(name))


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with their place within their key by ``order``, from 1, without any key in one task."""
    return summed_before(df, key, order, F.lit(1).cast("bigint"), "_n").withColumn(name, F.col("_n") + 1).drop("_n")


def insert_if_absent(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table and those rows whose key it hasn't; of new rows with one key any one."""
    return table.unionByName(rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], version: Column) -> DataFrame:
    """The table with each key's row of the highest version; new rows win ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    columns = [c for c in table.columns if c not in key]
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(version.alias("v"), F.col("_new"))).alias("_row"))
    return picked.select(*key, "_row.*").select(*table.columns)


def unique_match(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Left rows with the right side's value where the key has one distinct value there, and null where none or several."""
    single = right.groupBy(*key).agg(F.min(value).alias(value), F.max(value).alias("_max")).filter(F.col(value) == F.col("_max")).drop("_max")
    return left.join(single, list(key), "left")


def first_existing(df: DataFrame, candidates: str, known: DataFrame, path: str, id_columns: Sequence[str]) -> DataFrame:
    """For each row the first of an array of candidates that ``known`` has, by an equi join on the exploded array."""
    each = df.select(*id_columns, F.posexplode(candidates).alias("_pos", path))
    found = each.join(known.select(path).distinct(), path, "left_semi")
    return df.select(*id_columns).distinct().join(found.groupBy(*id_columns).agg(F.min_by(path, "_pos").alias("resolved")), list(id_columns), "left")


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the longest root that is one of its directories, by an equi join on the path's prefixes."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.select(path, F.explode(prefixes).alias(root)).join(roots.select(root).distinct(), root)
    best = each.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.join(best, path, "left")


def as_of(events: DataFrame, versions: DataFrame, key: Sequence[str], at: str, since: str, values: Sequence[str]) -> DataFrame:
    """Each event with the latest version effective at its time, by one sort of both sides together.

    No event meets more than one version, so the join never multiplies rows.
    """
    cols = [c for c in events.columns if c not in key]
    e = events.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*cols).alias("_event"), F.lit(None).cast(versions.select(F.struct(*values)).schema[0].dataType).alias("_version"))
    v = versions.select(*key, F.col(since).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(e.schema["_event"].dataType).alias("_event"), F.struct(*values).alias("_version"))
    w = Window.partitionBy(*key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(v).withColumn("_version", F.last("_version", ignorenulls=True).over(w))
    return both.filter("_kind = 1").select(*key, "_event.*", "_version.*")


def _shifted(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x.cast("bigint"), k.cast("int"))


def cover(start: Column, end: Column) -> Column:
    """The fewest dyadic ranges that make up whole numbers from start to end: an array of (level, node), twice the logarithm of the length at most.

    A node of level k has the numbers from node * 2**k on, 2**k of them. A range that ends before it starts has none.
    """
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2((end - start + 1).cast("double"))), F.lit(0)).cast("int") + 1)

    def of_level(k: Column) -> Column:
        first, past = -_shifted(-start, k), _shifted(end + 1, k)
        node = lambda x: F.struct(k.cast("int").alias("level"), x.cast("bigint").alias("node"))
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        return F.array_compact(F.array(F.when((first < past) & odd(first), node(first)), F.when((first < past) & odd(past), node(past - 1))))

    return F.when(end >= start, F.flatten(F.transform(levels, of_level))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))


def _containing(points: DataFrame, point: str, spans: DataFrame, start: str, end: str, key: Sequence[str]) -> DataFrame:
    """Points with each span of their key that holds the column ``point``, by an equi join on the nodes of the spans' covers."""
    covered = spans.withColumn("_n", F.explode(cover(F.col(start), F.col(end)))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    levels = sorted(r[0] for r in covered.select("_level").distinct().collect())  # 64 at most
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(point).cast("bigint"), k).alias("node")) for k in levels]) if levels else F.array().cast("array<struct<level:int,node:bigint>>")
    placed = points.withColumn("_n", F.explode(nodes)).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    return placed.join(covered, [*key, "_level", "_node"]).drop("_level", "_node")


def enclosing(points: DataFrame, spans: DataFrame, key: Sequence[str], keep: Sequence[str] = ("span_id",)) -> DataFrame:
    """The shortest span around each (start, end), ties by start then id.

    A span is listed by the dyadic ranges that make it up, and a point is looked up in its range of each
    level, so the join is on equal keys and a span costs the logarithm of its length.
    """
    named = spans.select(*key, F.col("start").alias("_s"), F.col("end").alias("_e"), *keep)
    hit = _containing(points, "start", named, "_s", "_e", key).filter(F.col("_e") >= F.col("end"))
    cols = [c for c in points.columns]
    return hit.groupBy(*cols).agg(F.min_by(F.struct(*keep), F.struct(F.col("_e") - F.col("_s"), "_s", *keep)).alias("_k")).select(*cols, "_k.*")


def overlapping(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs of overlapping (start, end) and (r_start, r_end) with equal keys, each pair once.

    Of two ranges that overlap one has the other's start in it: the right start in the left range, or
    the left start in the right range behind its start.
    """
    columns = [*left.columns, *[c for c in right.columns if c not in key]]
    whole = lambda df, s, e: df.filter(F.col(s) <= F.col(e))
    left, right = whole(left, "start", "end"), whole(right, "r_start", "r_end")
    ahead = _containing(right, "r_start", left, "start", "end", key)
    behind = _containing(left, "start", right, "r_start", "r_end", key).filter("start > r_start")
    return ahead.select(*columns).unionByName(behind.select(*columns))


def ranked_fill(df: DataFrame, group: str, order: Sequence[Column], per_group: int, target: int) -> DataFrame:
    """The first rows of each group, then the best of the rest up to ``target`` in all."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    wave = ranked.withColumn("_rest", (F.col("_n") > per_group).cast("int"))
    return wave.orderBy("_rest", *order).limit(target).drop("_n", "_rest")


def priority_order(column: str, ranks: Sequence[str]) -> Column:
    """Place of a value in a fixed order, the last for others."""
    mapping: Mapping[str, int] = {v: i for i, v in enumerate(ranks)}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(column)], F.lit(len(ranks)))


def distinct_first(df: DataFrame, distinct_by: str, order: Sequence[Column], limit: int) -> DataFrame:
    """In rank order at most one row for each value of ``distinct_by``."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(distinct_by).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.orderBy(*order).limit(limit)


def manifest_hash(files: DataFrame, by: str) -> DataFrame:
    """``by, manifest``: the hash of each group's canonical JSON, the list of its files by path.

    An entry has the keys byte_size, content_hash, language and path in order. SHA-256 goes over the text
    from beginning to end, so a group's sorted rows pass through one task, which holds none of them.
    """
    rows = files.select(F.col(by).alias("by"), "path", "content_hash", "language", F.col("byte_size").cast("bigint").alias("byte_size")).repartition("by").sortWithinPartitions("by", "path")
    kind = rows.schema["by"]

    def run(batches):  # noqa: ANN001, ANN202
        now, digest = None, None
        for batch in batches:
            done = []
            for key, path, content, language, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (key,):
                    if digest:
                        digest.update(b"]")
                        done.append((now[0], f"sha256:{digest.hexdigest()}"))
                    now, digest = (key,), hashlib.sha256(b"[")
                else:
                    digest.update(b",")
                digest.update(json.dumps({"byte_size": size, "content_hash": content, "language": language, "path": path}, separators=(",", ":")).encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.schema.field("by").type), pa.array([h for _, h in done], pa.string())], ["by", "manifest"])
        if digest:
            digest.update(b"]")
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], batch.schema.field("by").type), pa.array([f"sha256:{digest.hexdigest()}"])], ["by", "manifest"])

    return rows.mapInArrow(run, T.StructType([T.StructField("by", kind.dataType), T.StructField("manifest", T.StringType())])).withColumnRenamed("by", by)


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    """Rows without those that have expired and were never hit."""
    return rows.filter(~((F.col("expires_at") < now) & (F.col("hit_count") == 0)))


def get_or_create(wanted: DataFrame, existing: DataFrame, key: Sequence[str], value: str, made: Column, carry: Sequence[str] = ()) -> DataFrame:
    """Each wanted key, and what it carries, with the existing value, or the made one; ``created`` tells which."""
    joined = wanted.join(existing.select(*key, value), list(key), "left")
    return joined.select(*key, *carry, F.coalesce(F.col(value), made).alias(value), F.col(value).isNull().alias("created"))
