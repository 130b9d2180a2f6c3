"""Bindings of imports, calls and requests to what they mean, guided paths, and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .mapping import CODE
from .relational import best_per_key, first_existing, insert_if_absent, top_per_key

#: Suffixes that a specifier may leave out, in the order in which they are tried.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def import_bindings(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``snapshot, path, local, target_path, imported``: the file and name that a local name stands for.

    A specifier means the first of its candidates that the snapshot has; imports of types only, of
    packages, and without a local name bind nothing.
    """
    wanted = imports.filter(~F.col("type_only") & (F.coalesce("local", F.lit("")) != ""))
    at = lambda c: F.concat_ws("\u0000", "snapshot", c)
    keyed = wanted.withColumn("candidates", F.array(*[F.concat(at("specifier"), F.lit(s)) for s in SUFFIXES]))
    found = first_existing(keyed.select("snapshot", "specifier", "candidates").distinct(), "candidates", files.select(at("path").alias("at")), "at", ["snapshot", "specifier"]).filter("resolved is not null")
    target = F.element_at(F.split("resolved", "\u0000"), -1)
    return wanted.join(found, ["snapshot", "specifier"]).select("snapshot", "path", "local", target.alias("target_path"), F.coalesce("imported", "local").alias("imported"))


def tree_summary(files: DataFrame) -> DataFrame:
    """``snapshot, first_file, directories``: the first file of the tree, directories before files without case, and its directories down to two levels."""
    parts = F.split("path", "/")
    n = F.size(parts)
    order = F.transform(parts, lambda p, i: F.concat(F.when(i < n - 1, "0").otherwise("1"), F.lower(p)))
    first = files.groupBy("snapshot").agg(F.min_by("path", order).alias("first_file"))
    level = F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: k < n)).alias("k")
    directories = files.select("snapshot", parts.alias("p"), level).select("snapshot", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("d")).distinct()
    return first.join(directories.groupBy("snapshot").agg(F.array_join(F.array_sort(F.collect_list("d")), ",").alias("directories")), "snapshot")


def lesson_minutes(chunk_type: Column, pace: Column) -> Column:
    """Minutes of a lesson: four for a symbol and three otherwise; careful learners get two more, fast ones one less but two at least."""
    base = F.when(chunk_type == "symbol", 4).otherwise(3)
    return F.when(pace == "careful", base + 2).when(pace == "fast", F.greatest(F.lit(2), base - 1)).otherwise(base)


def _weights(kind: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(kind == name, w).otherwise(out)
    return out


def symbol_score() -> tuple[Column, Column]:
    """How much a candidate (chunk_type, kind, signature, top, degree) says about its file, and its calls; other chunks than symbols come last."""
    signature = F.lower("signature")
    # Weights of kinds and of exports.
    score = _weights(F.col("kind"), {"function": 8, "class": 7, "component": 7, "route": 7, "method": 5}, 3)
    score = score + F.when(F.contains(signature, F.lit("export default")), 6).otherwise(0) + F.when(F.contains(signature, F.lit("export")), 3).otherwise(0) + F.when(F.col("top"), 2).otherwise(0)
    symbol = F.col("chunk_type") == "symbol"
    return F.when(symbol, score).otherwise(-100), F.when(symbol, F.col("degree")).otherwise(0)


def lesson_score() -> Column:
    """How well a candidate (kind, signature) serves as a lesson."""
    # Weights of kinds and of exports.
    kind = _weights(F.col("kind"), {"route": 9, "component": 8, "class": 8, "function": 7, "method": 6}, 3)
    return kind + F.when(F.contains(F.lower("signature"), F.lit("export default")), 4).when(F.contains(F.lower("signature"), F.lit("export")), 2).otherwise(0)


def guided_path(candidates: DataFrame, least: int = 3) -> DataFrame:
    """``snapshot, file_id, slot`` of a guided path: orientation, core, supporting, error and test, each from what the ones before left.

    The entry is the shallowest code file that is no test, and what shares its first directory is near
    it. Where fewer than ``least`` slots are filled, the best of the rest follow in slot 6.
    """
    depth = F.when(F.col("language").isin(*CODE) & ~F.col("is_test"), F.size(F.split("path", "/"))).otherwise(1_000_000)
    entry = candidates.groupBy("snapshot").agg(F.min_by("path", F.struct(depth.alias("d"), "path")).alias("entry_path"))
    score, degree = symbol_score()
    area = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    rows = candidates.join(entry, "snapshot").withColumns({"score": score, "deg": degree, "at_entry": F.col("path") == F.col("entry_path"), "near": area("path") == area("entry_path")})
    rows = written(rows, "candidates")
    symbol = F.col("chunk_type") == "symbol"
    last = lambda c: F.when(c, 0).otherwise(1)
    best = [-F.col("score"), -F.col("deg"), F.col("start"), F.col("file_id")]
    slots = [
        (F.col("near") & (F.col("chunk_type") == "file"), [F.col("start"), F.col("file_id")]),
        (F.col("near") & symbol, best),
        (F.col("near") & symbol, best),
        (F.col("raises"), [last(F.col("at_entry")), last(symbol), F.col("start"), F.col("file_id")]),
        (F.col("is_test") & F.col("chunk_type").isin("symbol", "file"), [last(symbol), F.col("path"), F.col("start"), F.col("file_id")]),
    ]
    taken = None
    for number, (condition, order) in enumerate(slots, 1):
        left = rows if taken is None else rows.join(taken.select("file_id"), "file_id", "left_anti")
        pick = best_per_key(left.filter(condition), ["snapshot"], order, ["file_id"]).withColumn("slot", F.lit(number))
        taken = written(pick if taken is None else taken.unionByName(pick), "slots")
    have = taken.groupBy("snapshot").agg(F.count("*").alias("have"))
    rest = rows.join(taken.select("file_id"), "file_id", "left_anti").join(have, "snapshot", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    more = top_per_key(rest, ["snapshot"], [last(symbol), last(F.col("at_entry")), *best[:2], F.col("path"), F.col("start"), F.col("file_id")], least, "k")
    return taken.unionByName(more.filter(F.col("have") + F.col("k") <= least).select("snapshot", "file_id", F.lit(6).alias("slot")))


def return_stack(steps: DataFrame) -> DataFrame:
    """``session, open, returns_to``: branches not completed yet, and where the last one opened leads back to."""
    still = ~F.col("completed")
    return steps.groupBy("session").agg(F.count_if(still).alias("open"), F.max_by(F.when(still, F.col("return_to")), F.when(still, F.col("order"))).alias("returns_to"))


def merged_questions(have: DataFrame, stacks: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """Questions a learner has, and those of the bank for their stack that they haven't: common ones and the stack's own."""
    wanted = stacks.select(key, F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("stack", F.lit(""))))).alias("need"))
    theirs = wanted.join(bank.select(F.coalesce("needs", F.lit("")).alias("need"), "id"), "need").select(key, "id")
    return insert_if_absent(have.distinct(), theirs, [key, "id"])
