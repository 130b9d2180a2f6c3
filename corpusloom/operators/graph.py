"""Reach, closure, selection and validation on edge tables (source, target, relation, confidence, line)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .relational import best_per_key, ranked_fill, top_per_key


def _roots(single: DataFrame, log: list[str] | None) -> DataFrame:
    """``node, root`` of nodes (node, from) with one way in: where the chain that leads to each begins.

    Each round doubles how far all nodes look back. Nodes on, or behind, a circle that nothing leads
    into have no beginning; they are all that is left when a chain of all nodes would have been done.
    """
    rows = single.withColumnsRenamed({"node": "node", "from": "to"})
    inner = single.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    jumps = written(rows.join(inner, "to", "left").select("node", "to", F.coalesce("open", F.lit(False)).alias("open")), "jumps")
    for _ in range(jumps.count().bit_length() + 1):
        going = jumps.filter("open")
        if going.isEmpty():
            break
        if log is not None:
            log.append("double")
        further = jumps.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("open").alias("more"))
        moved = going.select("node", "to").join(further, "to").select("node", F.col("beyond").alias("to"), F.col("more").alias("open"))
        jumps = written(jumps.filter("not open").unionByName(moved), "jumps")
    return jumps.filter("not open").select("node", F.col("to").alias("root"))


def closure(edges: DataFrame, start: DataFrame, node: str = "node", reverse: bool = True, log: list[str] | None = None) -> DataFrame:
    """Everything that reaches the start set (or is reached from it), the start included.

    A node with one way in is reached if what leads to it is, so chains and trees of such nodes are
    looked through by pointer doubling, in rounds as many as the logarithm of their length. What is
    left are nodes with several ways in, with edges from where their chains begin; they are reached
    level by level, and edges into what is reached leave the table, so no level is read again.
    ``log`` gets a word for each round.
    """
    at, to = ("target", "source") if reverse else ("source", "target")
    begun = written(start.select(F.col(node).alias("node")).distinct(), "start")
    pairs = edges.select(F.col(at).alias("from"), F.col(to).alias("node")).filter(F.col("from") != F.col("node")).distinct().join(begun, "node", "left_anti")
    pairs = written(pairs, "pairs")
    ways = pairs.groupBy("node").agg(F.count("*").alias("ways"), F.min("from").alias("from"))
    ways = written(ways, "ways")
    single = ways.filter("ways = 1").select("node", "from")
    roots = written(_roots(single, log), "roots")
    # Edges into nodes of several ways, from the beginning of what leads to them; without one nothing does.
    inner = single.select(F.col("node").alias("from"), F.lit(True).alias("inner"))
    known = roots.withColumnsRenamed({"node": "from"})
    core = pairs.join(ways.filter("ways > 1").select("node"), "node", "left_semi").join(inner, "from", "left").join(known, "from", "left")
    core = core.filter(F.col("inner").isNull() | F.col("root").isNotNull()).select(F.coalesce("root", "from").alias("from"), "node").distinct()
    core, frontier, levels = written(core, "core"), begun, [begun]
    while True:
        new = written(core.join(frontier.select(F.col("node").alias("from")), "from", "left_semi").select("node").distinct(), "level")
        if new.isEmpty():
            break
        if log is not None:
            log.append("level")
        levels.append(new)
        core, frontier = written(core.join(new, "node", "left_anti"), "core"), new
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    behind = roots.join(reached.select(F.col("node").alias("root")), "root", "left_semi").select("node")
    return reached.unionByName(behind).select(F.col("node").alias(node))


#: Origins of a block of bits, edges and bytes of bits that a task holds at most, and rows of a join for each edge beyond which a level goes by blocks.
ORIGINS, TASK_EDGES, TASK_BYTES, BLOCK_FACTOR = 1024, 4_000_000, 32 << 20, 8
#: Edges of a packed row.
PACKED_EDGES = 32_768


def _bits(frontier: DataFrame, seen: DataFrame, origin: str, per: int) -> DataFrame:
    """``ob, node, now, all``: for each block of origins and node the bits of the block's origins that have reached it in the last level, and at all.

    Both sides have origin and node; origins are numbered by ``_n``.
    """
    both = frontier.select("_n", "node", F.lit(True).alias("now")).unionByName(seen.select("_n", "node", F.lit(False).alias("now")))
    words = [(F.floor(F.col("_n") / 64) % (per // 64)) == w for w in range(per // 64)]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_n") % 64).cast("int"))
    folded = lambda keep: F.array(*[F.coalesce(F.bit_or(F.when(w & keep, bit)), F.lit(0).cast("bigint")) for w in words])
    return both.groupBy(F.floor(F.col("_n") / per).cast("bigint").alias("ob"), "node").agg(folded(F.col("now")).alias("now"), folded(F.lit(True)).alias("all"))


def _level_by_blocks(pairs: DataFrame, frontier: DataFrame, seen: DataFrame, origin: str, depth: int, edges: int) -> DataFrame:
    """The next level of a reach as a product of bit matrices: blocks of origins with blocks of targets.

    A task holds the bits of one block of origins, over the nodes of the graph, and the edges into one
    block of targets. More nodes have smaller blocks of origins, and more edges more blocks of targets,
    so neither is ever larger; what is reached anew leaves the task row by row.
    """
    names = written(seen.select(origin).distinct().sort(origin), "origins")
    order = names.rdd.map(lambda r: r[0]).zipWithIndex()
    numbers = written(names.sparkSession.createDataFrame(order, f"{origin} bigint, _n bigint"), "origin-numbers")
    nodes = max(1, seen.select("node").distinct().count())
    per = ORIGINS
    while per > 64 and nodes * per // 4 > TASK_BYTES:
        per //= 2
    spark = pairs.sparkSession
    blocks = max(1, -(-edges // TASK_EDGES), -(-2 * spark.sparkContext.defaultParallelism * per // max(per, numbers.count())))
    numbered = lambda df: df.join(numbers, origin).select("_n", "node")
    bits = written(_bits(numbered(frontier), numbered(seen), origin, per), "bits")
    of_block = [r[0] for r in bits.select("ob").distinct().collect()]
    # Both sides of a cogroup are dealt by hash, so their keys have one type.
    everywhere = lambda column, values: F.explode(F.array(*[F.lit(v).cast("bigint") for v in values])).alias(column)
    target_block = F.pmod(F.xxhash64("target"), F.lit(blocks))
    left = bits.select("ob", everywhere("tb", range(blocks)), "node", "now", "all")
    pieces = F.pmod(F.xxhash64("target", "source"), F.lit(max(1, edges // blocks // PACKED_EDGES))).alias("piece")
    packed = pairs.filter("source is not null and target is not null").groupBy(target_block.alias("tb"), pieces).agg(F.collect_list(F.struct("source", "target")).alias("e"))
    packed = written(packed.select("tb", F.col("e.source").alias("source"), F.col("e.target").alias("target")), "packed-edges")
    right = packed.select(everywhere("ob", of_block), "tb", "source", "target")
    names_of = numbers.select(F.floor(F.col("_n") / per).alias("ob"), (F.col("_n") % per).alias("_at"), origin)

    schema = pa.schema([("ob", pa.int64()), ("node", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def multiply(key, a, b):  # noqa: ANN001, ANN202
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        flat = lambda table, name: np.concatenate([c.flatten().to_numpy() for c in table.column(name).chunks])
        at = np.asarray(a.column("node"))
        order = np.argsort(at)
        at = at[order]
        now, every = (flat(a, name).reshape(len(at), -1)[order] for name in ("now", "all"))
        source, target = flat(b, "source"), flat(b, "target")
        place = np.searchsorted(at, source)
        known = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == source)
        place, target = place[known], target[known]
        order = np.argsort(target, kind="stable")
        place, target = place[order], target[order]
        starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(target)]
        out = []
        for s, e in zip(starts, ends, strict=True):
            bits = np.bitwise_or.reduce(now[place[s:e]], axis=0)
            own = np.searchsorted(at, target[s])
            if own < len(at) and at[own] == target[s]:
                bits &= ~every[own]
            out.append(bits)
        new = np.array(out, np.int64).reshape(len(out), every.shape[1])
        keep = new.any(axis=1)
        n = int(keep.sum())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * every.shape[1]), pa.array(new[keep].ravel()))
        return pa.table([pa.array(np.full(n, key[0].as_py(), np.int64)), pa.array(target[starts][keep]), rows], schema=schema)

    product = left.groupBy("ob", "tb").cogroup(right.groupBy("ob", "tb")).applyInArrow(multiply, "ob bigint, node bigint, bits array<bigint>")
    words = written(product, "reach-bits")
    set_bits = words.select("ob", "node", F.posexplode("bits").alias("w", "word")).filter("word <> 0")
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("word"), i) % 2 != 0)
    each = set_bits.select("ob", "node", F.explode(at).alias("i"), "w").select("ob", "node", (F.col("w") * 64 + F.col("i")).cast("bigint").alias("_at"))
    found = each.join(F.broadcast(names_of), ["ob", "_at"]).select(origin, "node", F.lit(depth).alias("depth"))
    nowhere = frontier.join(pairs.filter("target is null"), frontier["node"] == pairs["source"]).select(origin, F.col("target").alias("node"), F.lit(depth).alias("depth")).distinct()
    return found.unionByName(nowhere)


def reach(edges: DataFrame, sources: DataFrame, depth: int = 3, origin: str = "origin", block_factor: int = BLOCK_FACTOR) -> DataFrame:
    """``origin, node, depth``: nodes within ``depth`` steps forward of each source, without itself, at their least distance.

    Each level is written once, so the next one doesn't compute it again. A level whose join would have more
    than ``block_factor`` rows for each edge, as where all reach all, goes by blocks of bits, written in that form.
    """
    pairs = written(edges.select("source", "target").distinct(), "pairs")
    degrees = written(pairs.groupBy("source").agg(F.count("*").alias("degree")), "degrees")
    m = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    frontier = sources.select(F.col("source").alias(origin), F.col("source").alias("node"), F.lit(0).alias("depth")).distinct()
    whole = all(dict(df.dtypes)[c] == "bigint" for df, c in ((frontier, "node"), (pairs, "source"), (pairs, "target")))
    seen = frontier
    for d in range(1, depth + 1):
        rows = frontier.join(degrees, frontier["node"] == degrees["source"]).agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0] if whole and d > 1 else 0
        if rows > block_factor * m:
            frontier = _level_by_blocks(pairs, frontier, seen.filter("node is not null"), origin, d, m)
        else:
            step = frontier.join(pairs, frontier["node"] == pairs["source"]).select(origin, F.col("target").alias("node"), F.lit(d).alias("depth")).distinct()
            frontier = written(step.join(seen, [origin, "node"], "left_anti"), "reach")
        seen = seen.unionByName(frontier)
    return seen.filter(F.col("depth") > 0)


def boundary_expansion(dirty: DataFrame, files: DataFrame, boundary: str) -> DataFrame:
    """Dirty paths, and all files below the directory of a dirty boundary file (a pattern on names), at any depth.

    A boundary file at the root makes all files dirty. Files meet their directories by an equi join on
    each prefix of their paths.
    """
    roots = dirty.filter(F.regexp_extract("path", "([^/]+)$", 1).rlike(boundary)).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("root")).distinct()
    if not roots.filter("root = ''").isEmpty():
        return dirty.select("path").unionByName(files.select("path")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    under = files.filter(F.contains("path", F.lit("/"))).select("path", F.explode(above).alias("root")).join(roots, "root", "left_semi").select("path")
    return dirty.select("path").unionByName(under).distinct()


def without_weaker(edges: DataFrame, weak: str) -> DataFrame:
    """Edges but those of the weak relation whose pair has another one."""
    strong = edges.filter(F.col("relation") != weak).select("source", "target").distinct()
    return edges.filter(F.col("relation") != weak).unionByName(edges.filter(F.col("relation") == weak).join(strong, ["source", "target"], "left_anti"))


def labels_in_out(edges: DataFrame) -> DataFrame:
    """``node, ins, outs``: sorted relation names on either side of each node."""
    both = edges.select(F.col("source").alias("node"), F.lit("out").alias("side"), "relation").unionByName(edges.select(F.col("target").alias("node"), F.lit("in").alias("side"), "relation"))
    names = lambda side: F.array_join(F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("relation")))), ",")
    return both.groupBy("node").agg(names("in").alias("ins"), names("out").alias("outs"))


def validation(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Counts of structural faults: duplicate ids, dangling ends, self edges, repeated relations."""
    def fault(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")

    known = nodes.select(F.col(node)).distinct()
    ends = edges.select(F.col("source").alias(node)).unionByName(edges.select(F.col("target").alias(node)))
    out = fault(nodes.groupBy(node).agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_node")
    out = out.unionByName(fault(ends.distinct().join(known, node, "left_anti"), "dangling"))
    out = out.unionByName(fault(edges.filter("source = target"), "self_edge"))
    return out.unionByName(fault(edges.groupBy("source", "target").agg(F.count("*").alias("n")).filter("n > 1"), "parallel_pair"))


def select_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 34, max_edges: int = 48, per_layer: int = 2) -> DataFrame:
    """The edges of a bounded picture: important nodes of each layer, then the best, and the best edges among them.

    ``nodes`` has node, layer and score. Both bounds are the feature: a picture of that size.
    """
    chosen = ranked_fill(nodes, "layer", [F.desc("score"), F.asc("node")], per_layer, max_nodes).select("node")
    kept = edges.filter("source <> target").join(chosen.withColumnRenamed("node", "source"), "source", "left_semi").join(chosen.withColumnRenamed("node", "target"), "target", "left_semi")
    pairs = kept.groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"))
    return pairs.orderBy(F.desc("confidence"), "source", "target", "relation").limit(max_edges)


def diff_graphs(base: DataFrame, current: DataFrame) -> DataFrame:
    """Edge signatures added and removed between two graphs, counted by relation."""
    sign = ["source", "target", "relation"]
    added = current.select(*sign).subtract(base.select(*sign)).withColumn("change", F.lit("added"))
    removed = base.select(*sign).subtract(current.select(*sign)).withColumn("change", F.lit("removed"))
    return added.unionByName(removed).groupBy("change", "relation").agg(F.count("*").alias("n"))


def file_tree(files: DataFrame) -> DataFrame:
    """``path, parent, depth, kind``: every directory and file once."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("parent"), n.alias("depth"), F.when(n == F.size(parts), "file").otherwise("directory").alias("kind")))
    return files.select(F.explode(prefixes).alias("p")).select("p.*").distinct()


def mermaid(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """One text for each layer (node, layer): its edges as flowchart lines, in order."""
    placed = edges.join(layer.select(F.col("node").alias("source"), "layer"), "source")
    line = F.concat(F.lit("  n"), F.col("source").cast("string"), F.lit(" -->|"), F.replace(F.replace("relation", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("| n"), F.col("target").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("source", "target", "relation", line.alias("line"))))
    return placed.groupBy("layer").agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("text"))


def risk(edges: DataFrame, danger: Sequence[str]) -> DataFrame:
    """Risk of changing each source: high with a sure dangerous edge, medium with any sure or many edges, low otherwise."""
    sure = F.col("confidence") >= 80
    bad = F.col("relation").isin(*danger)
    flags = edges.groupBy("source").agg(F.bool_or(sure & bad).alias("high"), F.bool_or(sure).alias("sure"), F.count("*").alias("n"))
    return flags.select("source", F.when(F.col("high"), "high").when(F.col("sure") | (F.col("n") > 10), "medium").otherwise("low").alias("risk"))


def flows(edges: DataFrame, trigger: str, request: str, effect: str, least: int, limit: int = 3) -> DataFrame:
    """``origin, handler, route, effect, reach, lowest, confidence, rank``: at most ``limit`` flows of each origin.

    A flow begins with a trigger edge; its handler's best request and that route's best effect follow
    where they have ``least`` confidence or more. One edge of a node and relation goes on, so flows
    are as many as triggers. ``reach`` is 4 with an effect, 3 with a route, else 1; flows rank by it,
    by their weakest edge, then by handler and line. Confidence is verified with a route and 90 or
    more in trigger and request, inferred from 65 on, else unknown.
    """
    some = edges.filter("source <> target")
    best = lambda relation: best_per_key(some.filter(F.col("relation") == relation), ["source"], [-F.col("confidence"), F.col("line"), F.col("target")], ["target", "confidence"]).filter(F.col("confidence") >= least)
    begun = some.filter(F.col("relation") == trigger).select(F.col("source").alias("origin"), F.col("target").alias("handler"), F.col("confidence").alias("c1"), "line")
    requests = best(request).select(F.col("source").alias("handler"), F.col("target").alias("route"), F.col("confidence").alias("c2"))
    effects = best(effect).select(F.col("source").alias("route"), F.col("target").alias("effect"), F.col("confidence").alias("c3"))
    chain = begun.join(requests, "handler", "left").join(effects, "route", "left")
    gate = F.least("c1", "c2")
    reach = F.when(F.col("effect").isNotNull(), 4).when(F.col("route").isNotNull(), 3).otherwise(1)
    confidence = F.when(F.col("route").isNotNull() & (gate >= 90), "verified").when(gate >= 65, "inferred").otherwise("unknown")
    rated = chain.withColumns({"reach": reach, "lowest": F.least("c1", "c2", "c3"), "flow_confidence": confidence})
    w = Window.partitionBy("origin").orderBy(F.desc("reach"), F.desc("lowest"), "handler", "line")
    return rated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("origin", "handler", "route", "effect", "reach", "lowest", F.col("flow_confidence").alias("confidence"), "rank")


def library_flows(nodes: DataFrame, calls: DataFrame, entries: int = 3, steps: int = 7, depth: int = 2) -> DataFrame:
    """``origin, node, ordinal``: without triggers, flows begin at entry nodes and go through what they reach.

    ``nodes`` has node and preferred; the first ``entries`` by that and by node are entries, each with
    itself and then what is within ``depth`` calls, in order, to ``steps`` in all.
    """
    chosen = written(nodes.orderBy(F.desc("preferred"), "node").limit(entries).select(F.col("node").alias("source")), "entries")
    near = reach(calls, chosen, depth).filter("node <> origin").select("origin", "node").distinct()
    ordinal = F.row_number().over(Window.partitionBy("origin").orderBy("node")) + 1
    own = chosen.select(F.col("source").alias("origin"), F.col("source").alias("node"), F.lit(1).alias("ordinal"))
    return own.unionByName(near.withColumn("ordinal", ordinal)).filter(F.col("ordinal") <= steps)


def failures(near: DataFrame, raises: DataFrame, limit: int = 3) -> DataFrame:
    """``origin, source, target, line, rank``: the first few distinct raising edges in what an origin (origin, node) reaches.

    Of a node's edges only the first few can be among an origin's, so no more are joined.
    """
    first = top_per_key(raises.select("source", "target", "line").distinct(), ["source"], [F.col("line"), F.col("target")], limit, "_n").drop("_n")
    found = near.select("origin", F.col("node").alias("source")).distinct().join(first, "source")
    w = Window.partitionBy("origin").orderBy("line", "source", "target")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("origin", "source", "target", "line", "rank")
