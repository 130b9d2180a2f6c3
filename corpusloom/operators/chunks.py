"""Cutting files into overlapping windows of lines, symbols and blocks within symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, expand_identifiers, lines, tokens

#: Characters of a chunk's search text that are embedded, and how specific its kinds are.
MAX_CHARS = 24_000
SPECIFICITY = {"file": 1, "block": 2, "symbol": 3}


def _starts(first: Column, last: Column, size: int, overlap: int) -> Column:
    """Where windows of ``size`` begin between two lines; the last one reaches the end."""
    return F.sequence(first, F.greatest(first, last - overlap), F.lit(size - overlap))


def _checked(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def line_windows(files: DataFrame, size: int = 160, overlap: int = 20) -> DataFrame:
    """``start, end`` (1-based, inclusive) of the windows of each file, from its ``line_count``."""
    _checked(size, overlap)
    n = F.col("line_count").cast("int")
    return files.select("*", F.explode(_starts(F.lit(1), n, size, overlap)).alias("start")).withColumn("end", F.least(n, F.col("start") + size - 1))


def chunks(files: DataFrame, size: int = 160, overlap: int = 20, symbols: Column | None = None, block: int = 80, block_overlap: int = 10) -> DataFrame:
    """Chunks: ``file_id, path, language, ordinal, kind, symbol, title, start, end, specificity, text, text_hash, terms``.

    A file has windows of lines, a chunk for each of its symbols, and windows inside of symbols of more
    than ``block`` lines. ``symbols`` is an array of (start, end, name) over the file's columns and
    ``_lines``. Lines are split once for each file and chunks numbered as they leave it, so nothing is
    shuffled. The hash is of the whole text; terms are its words, found once for each line.
    """
    _checked(size, overlap)
    _checked(block, block_overlap)
    cut = files.select("file_id", "path", "language", lines(F.col("content")).alias("_lines")).withColumn("_terms", F.transform("_lines", tokens))
    n = F.size("_lines")
    draft = lambda kind, start, end, name: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), name.cast("string").alias("symbol"))
    spans = symbols if symbols is not None else F.array().cast("array<struct<start:int,end:int,name:string>>")
    of_file = F.transform(_starts(F.lit(1), n, size, overlap), lambda s: draft("file", s, F.least(n, s + size - 1), F.lit(None)))
    of_symbol = F.transform(spans, lambda x: draft("symbol", x["start"], x["end"], x["name"]))
    long = F.filter(spans, lambda x: x["end"] - x["start"] + 1 > block)
    of_block = F.flatten(F.transform(long, lambda x: F.transform(_starts(x["start"].cast("int"), x["end"].cast("int"), block, block_overlap), lambda s: draft("block", s, F.least(x["end"], s + block - 1), x["name"]))))
    drafts = cut.select("file_id", "path", "language", "_lines", "_terms", F.posexplode(F.array_sort(F.concat(of_file, of_symbol, of_block))).alias("_pos", "_c"))
    inside = lambda column: F.slice(column, F.col("_c.start"), F.col("_c.end") - F.col("_c.start") + 1)
    text = F.array_join(inside("_lines"), "\n")
    place = F.concat_ws("-", F.col("_c.start").cast("string"), F.col("_c.end").cast("string"))
    named = F.concat_ws("#", "path", "_c.symbol")
    title = F.when(F.col("_c.kind") == "symbol", named).otherwise(F.concat_ws(" lines ", named, place))
    specificity = F.when(F.col("_c.kind") == "symbol", SPECIFICITY["symbol"]).when(F.col("_c.kind") == "block", SPECIFICITY["block"]).otherwise(SPECIFICITY["file"])
    return drafts.select("file_id", "path", "language", (F.col("_pos") + 1).alias("ordinal"), "_c.kind", "_c.symbol", title.alias("title"), "_c.start", "_c.end", specificity.alias("specificity"), text.alias("text"), content_hash(text).alias("text_hash"), F.flatten(inside("_terms")).alias("terms"))


def embedding_text(limit: int = MAX_CHARS) -> Column:
    """What of a chunk is embedded: header lines, then the source, with identifiers spelled out, to a limit."""
    header = [F.concat(F.lit(f"{name}: "), F.col(column)) for name, column in (("path", "path"), ("language", "language"), ("chunk", "kind"), ("title", "title"), ("symbol", "symbol"))]
    whole = F.concat_ws("\n", *header, F.lit("source:"), F.col("text"))
    return F.substring(F.concat_ws("\n", whole, expand_identifiers(F.col("title"))), 1, limit)


#: Fixed value: segments of a chunk.
SEGMENTS = 80


def line_segments(pieces: DataFrame, most: int = SEGMENTS) -> DataFrame:
    """``chunk_id, segment_id, line, source``: the first lines of each chunk (chunk_id, start, text) that aren't blank, numbered, without the white space around them."""
    each = F.split("text", "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")
    trimmed = F.transform(each, lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("source")))
    rows = pieces.select("chunk_id", "start", F.posexplode(F.slice(F.filter(trimmed, lambda x: x["source"] != ""), 1, most)).alias("n", "x"))
    return rows.select("chunk_id", F.concat(F.lit("seg_"), F.lpad((F.col("n") + 1).cast("string"), 3, "0")).alias("segment_id"), (F.col("start") + F.col("x.at")).alias("line"), F.col("x.source").alias("source"))
