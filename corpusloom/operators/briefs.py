"""What a change of selected lines touches: relations out of them and into their symbol, places to look at, and how risky it is.

A brief lists the first few of what its selection touches, so edges are never paired with selections.
Each distinct selection looks up summaries: of the edges that begin in a dyadic range of lines, of
those that hold one, and of those of a symbol. A summary has the first entries only; summaries of two sets
make up that of both, and an edge in several of them counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .relational import cover, enclosing, top_per_key

# Relations whose effect is direct, those of high and middle risk, the least confidence that counts as verified, and entries of a list.
DIRECT = ("REQUESTS", "HANDLED_BY", "WRITES", "NAVIGATES_TO", "USES_EXTERNAL", "RAISES")
HIGH, MIDDLE = ("WRITES", "USES_EXTERNAL"), ("REQUESTS", "HANDLED_BY", "NAVIGATES_TO", "RAISES")
VERIFIED, LISTED = 0.8, 8

#: The tables of a summary: entries of the lists, places, and what any edge has.
Summary = dict[str, DataFrame]


def _first_edges(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of entries (kind, o, edge_id, but) those that can be among a key's first, whichever symbol's edges (``but``) are left out."""
    some = top_per_key(rows.select(*key, "kind", "o", "edge_id", "but"), [*key, "kind", "but"], [F.col("o")], LISTED, "_n").drop("_n")
    return top_per_key(some, [*key, "kind"], [F.col("o")], 2 * LISTED, "_n").drop("_n")


def _first_places(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of entries (file, line, o, but) those of a key's first places, each with its first two symbols: one place may be the selection, and one symbol's edges may be left out."""
    each = rows.groupBy(*key, "file", "line", "but").agg(F.min("o").alias("o"))
    two = top_per_key(each, [*key, "file", "line"], [F.col("o")], 2, "_n").drop("_n")
    places = two.groupBy(*key, "file", "line").agg(F.array_sort(F.collect_list(F.struct("o", "but"))).alias("best"))
    first = top_per_key(places, key, [F.col("best")[0]["o"]], LISTED + 1, "_n")
    return first.select(*key, "file", "line", F.explode("best").alias("e")).select(*key, "file", "line", "e.*")


def _any(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.max("high").alias("high"), F.max("middle").alias("middle"), F.min("low_file").alias("low_file"), F.max("high_file").alias("high_file"))


KEPT: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"edges": _first_edges, "places": _first_places, "any": _any}


def _summaries(edges: DataFrame, key: list[str], out: bool, into: bool) -> Summary:
    """The summary of each key's edges, as outgoing ones, as incoming ones, or as both."""
    sure = F.col("sure")
    kind = F.when(sure if into else sure & F.col("relation").isin(*DIRECT), "confirmed").otherwise("possible")
    o = F.struct(F.lit(0 if out else 1).alias("side"), F.coalesce("first", F.lit(0)).alias("first"), "relation", "edge_id")
    file, line = (F.col("in_file"), F.col("in_line")) if into else (F.col("out_file"), F.col("out_line"))
    # An edge that comes into the selection's own symbol has another kind and place than one that only goes out.
    own = F.lit(None) if into else F.col("target_symbol")
    own = own.cast(edges.schema["target_symbol"].dataType)
    lists = edges.select(*key, kind.alias("kind"), o.alias("o"), "edge_id", F.when(sure & (kind == "possible"), own).alias("but"))
    places = edges.filter(file.isNotNull()).select(*key, file.alias("file"), line.alias("line"), o.alias("o"), own.alias("but"))
    strong = lambda names: (sure & F.col("relation").isin(*names)).cast("int")
    flags = edges.select(*key, strong(HIGH).alias("high"), strong(MIDDLE).alias("middle"), file.alias("low_file"), file.alias("high_file"))
    return {name: KEPT[name](rows, key) for name, rows in (("edges", lists), ("places", places), ("any", flags))}


def _again(of: Summary, key: list[str], place: Callable[[DataFrame], DataFrame]) -> Summary:
    """Summaries by other keys, that ``place`` adds to the rows of finer ones."""
    return {name: KEPT[name](place(rows), key) for name, rows in of.items()}


def _looked_up(asked: DataFrame, of: Summary, key: list[str]) -> Summary:
    """What each of the asked (shape and key) finds."""
    return {name: asked.join(rows, key).drop(*key) for name, rows in of.items()}


def _nodes(start: Column, end: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("_c", F.explode(cover(start, end))).select("*", F.col("_c.level").alias("level"), F.col("_c.node").alias("node")).drop("_c")


def _at_levels(point: str, levels: list[int]) -> Callable[[DataFrame], DataFrame]:
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(point).cast("bigint"), k).alias("node")) for k in levels]) if levels else F.array().cast("array<struct<level:int,node:bigint>>")
    return lambda df: df.withColumn("_c", F.explode(nodes)).select("*", F.col("_c.level").alias("level"), F.col("_c.node").alias("node")).drop("_c")


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("level").distinct().collect())  # 64 at most


def _overlapping(shapes: DataFrame, edges: DataFrame, key: list[str], out: bool, into: bool) -> list[Summary]:
    """What shapes find of the edges of their key whose lines overlap theirs: those that begin in them, and those that hold their first line."""
    fine = _summaries(edges.filter("first <= last"), [*key, "first", "last"], out, into)
    fine = {name: written(rows.withColumnsRenamed({"first": "_first", "last": "_last"}), f"fine-{name}") for name, rows in fine.items()}
    whole = shapes.filter("start <= end")
    keys = [*key, "level", "node"]
    inside = written(_nodes(F.col("start"), F.col("end"))(whole).select("shape", *keys), "nodes")
    holding = _nodes(F.col("_first"), F.col("_last"))
    held = _at_levels("start", _levels(holding(fine["any"])))(whole).select("shape", *keys)
    begun = _again(fine, keys, _at_levels("_first", _levels(inside)))
    return [_looked_up(inside, begun, keys), _looked_up(held, _again(fine, keys, holding), keys)]


def change_briefs(selections: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``brief, symbol_id, confirmed, possible, to_verify, places, risk`` of each selection.

    ``selections`` has brief, file_id, start, end; ``symbols`` symbol_id, file_id, start, end, one row a symbol;
    ``edges`` edge_id, relation, confidence, source_file, source_symbol, target_symbol, first, last.
    Outgoing edges overlap the selection in its file or start in its innermost symbol; incoming ones end
    in that symbol. ``confirmed`` and ``possible`` list the first edges by side, line, relation and id: verified ones
    that have a direct effect or come in, and the rest; where nothing is confirmed, ``to_verify`` is
    true and stands for the first of the possible ones. ``places`` are files and lines of the other ends,
    the selection's own first, each once. A selection that touches nothing has unknown risk.
    """
    distinct = selections.select("file_id", "start", "end").filter("file_id is not null and start is not null and end is not null").distinct()
    mine = enclosing(distinct, symbols.select("file_id", "start", "end", "symbol_id"), ["file_id"], ["symbol_id"])
    shapes = written(distinct.join(mine, ["file_id", "start", "end"], "left").withColumn("shape", F.struct("file_id", "start", "end")), "shapes")
    chosen = shapes.filter("symbol_id is not null")
    # The other end of each edge: its symbol's place, or the caller's file.
    ends = lambda symbol, file, line: symbols.select(F.col("symbol_id").alias(symbol), F.col("file_id").alias(file), F.col("start").alias(line))
    far = edges.join(ends("target_symbol", "out_file", "out_line"), "target_symbol", "left").join(ends("source_symbol", "in_file", "in_line"), "source_symbol", "left")
    far = far.select("edge_id", "relation", F.coalesce(F.col("confidence") >= VERIFIED, F.lit(False)).alias("sure"), F.col("source_file").alias("file_id"), "source_symbol", "target_symbol", "first", "last", "out_file", F.coalesce("out_line", F.lit(1)).alias("out_line"), F.coalesce("in_file", "source_file").alias("in_file"), F.coalesce("in_line", F.lit(1)).alias("in_line"))
    far = written(far, "edges")
    known = chosen.select("symbol_id").distinct()
    at = lambda side: far.withColumn("symbol_id", F.col(side)).join(known, "symbol_id", "left_semi")
    coming = written(at("target_symbol"), "incoming")
    in_file, alone = ["file_id", "symbol_id"], ["symbol_id"]
    by_symbol = chosen.select("shape", *in_file)
    found = [
        *_overlapping(shapes.select("shape", "file_id", "start", "end"), far, ["file_id"], True, False),
        _looked_up(by_symbol, _summaries(at("source_symbol"), in_file, True, False), in_file),
        _looked_up(by_symbol.drop("file_id"), _summaries(coming, alone, False, True), alone),
        *_overlapping(chosen.select("shape", *in_file, "start", "end"), coming, in_file, True, True),
        _looked_up(by_symbol, _summaries(coming.filter("source_symbol = symbol_id"), in_file, True, True), in_file),
    ]
    both = {name: reduce(DataFrame.unionByName, [f[name] for f in found]) for name in KEPT}
    own = chosen.select("shape", F.col("symbol_id").alias("_own"))
    others = lambda name: both[name].join(own, "shape", "left").filter(F.col("but").isNull() | F.col("_own").isNull() | (F.col("but") != F.col("_own")))
    once = others("edges").groupBy("shape", "kind", "edge_id").agg(F.min("o").alias("o"))
    first = top_per_key(once, ["shape", "kind"], [F.col("o")], LISTED)
    counted = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("rank", "edge_id")))), lambda x: x["edge_id"])
    lists = first.groupBy("shape").agg(counted("confirmed").alias("confirmed"), counted("possible").alias("possible"))
    here = (F.col("file") == F.col("shape.file_id")) & (F.col("line") == F.col("shape.start"))
    places = others("places").filter(~here).groupBy("shape", "file", "line").agg(F.min("o").alias("o"))
    listed = top_per_key(places, ["shape"], [F.col("o")], LISTED - 1).groupBy("shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file", "line"))), lambda x: F.struct(x["file"].alias("file_id"), x["line"].alias("line"))).alias("far"))
    risks = _any(both["any"], ["shape"]).withColumn("files", (F.col("low_file") != F.col("shape.file_id")) | (F.col("high_file") != F.col("shape.file_id")))
    made = shapes.join(lists, "shape", "left").join(listed, "shape", "left").join(risks, "shape", "left")
    rows = selections.join(made.drop("shape"), ["file_id", "start", "end"], "left")
    risk = F.when(F.col("high") == 1, "high").when(F.col("files") | (F.col("middle") == 1), "medium").when(F.col("high").isNotNull(), "low").otherwise("unknown")
    none = lambda c: F.coalesce(c, F.array().cast(lists.schema["confirmed"].dataType))
    unsure = F.size(none(F.col("confirmed"))) == 0
    place = F.struct(F.col("file_id").alias("file_id"), F.col("start").alias("line"))
    return rows.select(
        "brief",
        "symbol_id",
        none(F.col("confirmed")).alias("confirmed"),
        F.when(unsure, F.slice(none(F.col("possible")), 1, LISTED - 1)).otherwise(none(F.col("possible"))).alias("possible"),
        unsure.alias("to_verify"),
        F.when(F.col("far").isNull(), F.array(place)).otherwise(F.concat(F.array(place), F.col("far"))).alias("places"),
        risk.alias("risk"),
    )
