"""Differences between snapshots, reuse decisions and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .renames import renames


def diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """``path, old_path, change, language, byte_size`` of every path of two manifests.

    A full outer join tells unchanged, modified, added and deleted; then added and deleted files with
    equal content are paired as renames, most alike paths first.
    """
    b = base.select("path", F.col("content_hash").alias("old_hash"), F.col("language").alias("old_language"), F.col("byte_size").alias("old_size"))
    joined = current.join(b, "path", "full")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("content_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("modified")
    rows = joined.select("path", change.alias("change"), F.coalesce("content_hash", "old_hash").alias("hash"), F.coalesce("language", "old_language").alias("language"), F.coalesce("byte_size", "old_size").alias("byte_size"))
    rows = written(rows, "changes")
    moved = renames(rows).join(rows.select("path", "language", "byte_size"), "path")
    gone = moved.select("path").unionByName(moved.select(F.col("old_path").alias("path")))
    still = rows.join(gone, "path", "left_anti").select("path", F.lit(None).cast("string").alias("old_path"), "change", "language", "byte_size")
    return still.unionByName(moved.select("path", "old_path", F.lit("renamed").alias("change"), "language", "byte_size"))


def dirty(changes: DataFrame) -> DataFrame:
    """Paths whose content or place changed: modified, added, deleted and both sides of renames."""
    hit = changes.filter("change <> 'unchanged'")
    return hit.select("path").unionByName(hit.filter("old_path is not null").select(F.col("old_path").alias("path"))).distinct()


def change_ratios(changes: DataFrame) -> DataFrame:
    """Files and bytes changed against all, in one pass, with a guard against empty snapshots."""
    touched = F.col("change") != "unchanged"
    size = F.coalesce("byte_size", F.lit(0))
    n, total = F.count("*"), F.sum(size)
    return changes.agg(F.count_if(touched).alias("files_changed"), n.alias("files"), F.sum(F.when(touched, size).otherwise(0)).alias("bytes_changed"), F.coalesce(total, F.lit(0)).alias("bytes")).select(
        "files_changed", "files", F.round(F.col("files_changed") / F.greatest(F.lit(1), "files"), 6).alias("file_ratio"), F.round(F.coalesce("bytes_changed", F.lit(0)) / F.greatest(F.lit(1), "bytes"), 6).alias("byte_ratio")
    )


def incremental_mode(ratios: DataFrame, impacted: DataFrame, limit: float = 0.30) -> DataFrame:
    """``mode``: full if the impacted share of files or the changed share of bytes is above the limit."""
    hit = impacted.agg(F.count("*").alias("impacted"))
    impact = F.col("impacted") / F.greatest(F.lit(1), "files")
    return ratios.join(F.broadcast(hit)).select("impacted", F.round(impact, 6).alias("impact_ratio"), "byte_ratio", F.when(F.greatest(impact, F.col("byte_ratio")) > limit, "full").otherwise("incremental").alias("mode"))


def lineage(changes: DataFrame) -> DataFrame:
    """What of each current file can be reused: its parse if the content is the same, its place if the path is too."""
    return changes.filter("change <> 'deleted'").select("path", "change", F.col("change").isin("unchanged", "renamed").alias("parse_reused"), (F.col("change") == "unchanged").alias("place_reused"))
