"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A window is a shortest run of lines, from a given line on or up to a given line, that has ``words``
words or more; every run of that many words is a union of such windows. Of each window from a line
on, the line with the least hash (the last of equal ones) is a fingerprint, so a run that occurs
twice has a fingerprint at the same line of both places. Fingerprints that stand in two places or
more are joined with their positions; from there a match is extended back and forth, line digest by
line digest, to the ends of each window around it, and joined with the first place of the same
fingerprint and extension. What later windows cover is deleted. Windows whose fingerprint has no
second place are never extended or digested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._rows import with_group
from ._store import written

#: Words from which on a repeated run of lines goes.
WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, lines``: a digest of id and text, and what newlines part. Equal rows have equal rids."""
    rid = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null")))))
    return docs.select(rid.alias("rid"), "doc_id", F.split("text", "\n").alias("lines"))


def word_lines(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, pos, n_words, hash`` of each line with a word, once for equal rows."""
    n = F.regexp_count("line", F.lit(_WORD)).cast("bigint")
    found = keyed(docs).select("rid", "doc_id", F.posexplode("lines").alias("pos", "line")).select("rid", "doc_id", "pos", n.alias("n_words"), F.xxhash64("line").alias("hash"))
    # Dealt out by document once, for this and for all that looks at a document's lines.
    return found.filter("n_words > 0").repartition("rid").dropDuplicates(["rid", "pos"])


def windows(lines: DataFrame, words: int = WORDS) -> DataFrame:
    """``rid, doc_id, lo, hi, lo_pos, hi_pos, mark, fingerprint`` of every window.

    ``lo``, ``hi`` and ``mark`` count the document's lines with a word from 1; ``mark`` is the
    fingerprint's line. A window up to a line is left out where it is also one from a line on.
    """
    in_doc = Window.partitionBy("rid").orderBy("pos")
    end = F.sum("n_words").over(in_doc.rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumn("end", end).withColumn("at", F.col("end") - F.col("n_words")).withColumn("number", F.row_number().over(in_doc))
    # Lines that begin within so many words of this one's beginning, and those that end within so many of its end.
    ahead = Window.partitionBy("rid").orderBy("at").rangeBetween(0, words - 1)
    back = Window.partitionBy("rid").orderBy("end").rangeBetween(1 - words, 0)
    least = F.min(F.struct("hash", (-F.col("number")).alias("last"))).over(ahead)
    span = lambda size, lo, hi, lo_pos, hi_pos: F.struct(F.col(size).alias("size"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(lo_pos).alias("lo_pos"), F.col(hi_pos).alias("hi_pos"))
    from_here = placed.select("*", least.alias("least"), F.sum("n_words").over(ahead).alias("size"), F.max("number").over(ahead).alias("until"), F.max("pos").over(ahead).alias("until_pos"))
    both = from_here.select(
        "*", F.sum("n_words").over(back).alias("size_back"), F.min("number").over(back).alias("since"), F.min("pos").over(back).alias("since_pos"),
        F.first("until").over(back).alias("same"), F.first("least").over(back).alias("least_back"),
    )
    ahead_of = F.struct(span("size", "number", "until", "pos", "until_pos").alias("span"), F.col("least"))
    back_of = F.when(F.col("same") != F.col("number"), F.struct(span("size_back", "since", "number", "since_pos", "pos").alias("span"), F.col("least_back").alias("least")))
    each = both.select("rid", "doc_id", F.explode(F.array(ahead_of, back_of)).alias("w")).filter(F.col("w.span.size") >= words)
    return each.select("rid", "doc_id", "w.span.lo", "w.span.hi", "w.span.lo_pos", "w.span.hi_pos", (-F.col("w.least.last")).alias("mark"), F.col("w.least.hash").alias("fingerprint"))


def extended(docs: DataFrame, partnered: DataFrame) -> DataFrame:
    """``rid, doc_id, lo_pos, hi_pos, content``: windows with a digest of what stands from their fingerprint back and forth.

    A document's line digests and its windows meet in one row; only ``partnered`` windows are digested.
    """
    digests = F.transform(F.filter("lines", lambda x: F.regexp_like(x, F.lit(_WORD))), lambda x: F.unhex(F.md5(x)))
    wanted = partnered.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("lo", "hi", "mark", "fingerprint", "lo_pos", "hi_pos")).alias("ws"))
    both = keyed(docs).select("rid", digests.alias("digests")).join(wanted, "rid")
    part = lambda a, b: F.array_join(F.transform(F.slice("digests", a, b - a + 1), F.hex), "")
    content = lambda w: F.unhex(F.md5(F.concat_ws("|", w["fingerprint"].cast("string"), part(w["lo"], w["mark"]), part(w["mark"], w["hi"]))))
    made = F.transform("ws", lambda w: F.struct(w["lo_pos"].alias("lo_pos"), w["hi_pos"].alias("hi_pos"), content(w).alias("content")))
    return both.select("rid", "doc_id", F.explode(made).alias("w")).select("rid", "doc_id", "w.*").distinct()


def repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``rid, gone``: positions of the lines in runs of ``words`` words or more that occur earlier, by (doc_id, rid, pos)."""
    all_windows = written(windows(word_lines(docs), words), "windows")
    # A fingerprint that stands in one place only has no copy. Counting places, not windows.
    places = all_windows.select("fingerprint", "rid", "mark").distinct()
    twice = with_group(places, ["fingerprint"], F.col("rid"), {"n": (F.count("*"), F.sum)}).filter("n > 1").select("fingerprint", "rid", "mark")
    partnered = all_windows.join(twice, ["rid", "mark", "fingerprint"], "left_semi")
    matches = written(extended(docs, partnered), "matches")
    place = F.struct("doc_id", "rid", "lo_pos")
    grouped = with_group(matches.withColumn("place", place), ["content"], F.col("rid"), {"first": (F.min("place"), F.min)})
    later = grouped.filter(F.col("place") != F.col("first")).select("rid", "lo_pos", "hi_pos")
    # Covered positions: the part of each window that windows before it have not reached.
    order = Window.partitionBy("rid").orderBy("lo_pos", "hi_pos").rowsBetween(Window.unboundedPreceding, -1)
    fresh = later.withColumn("begin", F.greatest("lo_pos", F.coalesce(F.max("hi_pos").over(order) + 1, F.lit(0)))).filter("begin <= hi_pos")
    return fresh.groupBy("rid").agg(F.flatten(F.collect_list(F.sequence("begin", "hi_pos"))).alias("gone"))


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text, n_lines, n_removed``: each document without later repeated runs of lines.

    Runs are compared over the lines that have a word; blank lines inside a deleted run go with it,
    others stay. The first occurrence by doc_id (null first), then row digest, then line, stays, and
    of a run that overlaps itself what the later one covers goes. Null texts stay null with no lines;
    shorter and empty texts are untouched; equal rows are one document and stay equal; of different
    texts with one id each is a document. A document that is a copy as a whole ends with an empty
    text. An empty table gives no rows. Only doc_id and text are read, whatever other columns are
    called; a very long text is one row here and spread over lines for the comparison.
    """
    joined = keyed(docs).join(repeated_lines(docs, words), "rid", "left")
    n = F.size(F.coalesce("lines", F.array().cast("array<string>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i))), "\n")
    return joined.select("doc_id", text.alias("text"), n.cast("bigint").alias("n_lines"), F.size(F.coalesce("gone", F.array().cast("array<int>"))).cast("bigint").alias("n_removed"))
