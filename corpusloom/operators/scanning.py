"""Source files of snapshots: what is read, what is left out, and which snapshots are too large."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx

# Names and suffixes of files that hold secrets.
SECRET = r"(^|/)(\.env(\.[^/]*)?|\.npmrc|\.pypirc|id_rsa|id_ed25519|credentials\.json|[^/]*\.(pem|key|p12|pfx))$"


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """``path, raw, byte_size`` of every file below a folder; Spark leaves names out that begin with a dot or an underscore."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return found.select(F.substring(inside, F.lit(len(root.rstrip("/")) + 2), F.length(inside)).alias("path"), F.col("content").alias("raw"), F.col("length").alias("byte_size"))


def language_of(path: Column, languages: Mapping[str, str]) -> Column:
    """The language of a path's suffix, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in languages.items() for x in pair]), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def collected(files: DataFrame, rules: Sequence[str], languages: Mapping[str, str], max_file_bytes: int) -> DataFrame:
    """``snapshot, path, language, content, byte_size`` of files (snapshot, path, raw, byte_size) that are read.

    Ignored and secret files, unknown suffixes, files above the limit, and what holds a zero byte or is no
    UTF-8 is left out; a byte order mark goes.
    """
    kept = files.withColumn("language", language_of(F.col("path"), languages)).filter(F.col("language").isNotNull() & (F.col("byte_size") <= max_file_bytes) & ~fx.ignored(F.col("path"), rules) & ~F.lower("path").rlike(SECRET))
    text = F.col("raw").cast("string")
    kept = kept.filter(F.is_valid_utf8(text) & (F.instr(text, "\0") == 0))
    return kept.select("snapshot", "path", "language", F.regexp_replace(text, "^﻿", "").alias("content"), "byte_size")


def within_limits(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """``snapshot, files, bytes, refused``: a snapshot of too many files or bytes is refused as a whole, not cut."""
    sums = files.groupBy("snapshot").agg(F.count("*").alias("files"), F.sum("byte_size").alias("bytes"))
    return sums.withColumn("refused", F.when(F.col("files") > max_files, "too many files").when(F.col("bytes") > max_bytes, "too many bytes"))
