"""Snapshot differences and graph operators over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, relational, snapshot
from ..session import dealt
from ..sources.tables import EDGES_SQL, FILES_SQL, MANIFEST_SQL, Tables
from .registry import Registry

query = Registry()
#: Renames: matching blocks of each pair of paths by recursion (the longest, then the first in the old path, then in the new), then each new path in order takes the most alike old path left.
DIFF_SQL = MANIFEST_SQL + """, j AS (SELECT coalesce(c.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN b.content_hash = c.content_hash THEN 'unchanged' ELSE 'modified' END AS change,
 coalesce(c.content_hash, b.content_hash) AS hash, coalesce(c.language, b.language) AS language, coalesce(c.byte_size, b.byte_size) AS byte_size FROM curr c FULL JOIN base b ON b.path = c.path),
fresh AS (SELECT hash, path, language, byte_size, row_number() OVER (PARTITION BY hash ORDER BY path) AS nth FROM j WHERE change = 'added'),
copies AS (SELECT f.hash, f.path, f.nth, o.path AS old_path FROM fresh f JOIN j o ON o.change = 'deleted' AND o.hash = f.hash),
blocks(old_path, path, a, b, m) AS (SELECT old_path, path, old_path, path, 0::BIGINT FROM copies UNION ALL
 SELECT old_path, path, c.a, c.b, c.m FROM (SELECT old_path, path, unnest([{'a': substr(a, 1, i - 1), 'b': substr(b, 1, spot - 1), 'm': k}, {'a': substr(a, i + k), 'b': substr(b, spot + k), 'm': 0::BIGINT}]) AS c
  FROM (SELECT *, strpos(b, substr(a, i, k)) AS spot FROM (SELECT *, best.k AS k, -best.i AS i FROM (SELECT *, list_max(list_filter(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2), lambda k: {'k': k, 'i': -i}))), lambda x: contains(b, substr(a, -x.i, x.k)))) AS best
   FROM blocks WHERE a <> '' AND b <> '') WHERE best IS NOT NULL)))),
alike AS (SELECT hash, nth, path, old_path, 2.0 * sum(m) / (len(path) + len(old_path)) AS ratio FROM blocks JOIN copies USING (path, old_path) GROUP BY hash, nth, path, old_path),
greedy(hash, nth, taken, path, old_path) AS (SELECT DISTINCT hash, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM alike UNION ALL
 SELECT hash, nth, list_append(taken, pick), path, pick FROM (SELECT g.hash, a.nth, any_value(g.taken) AS taken, any_value(a.path) AS path, arg_min(a.old_path, {'r': -a.ratio, 'o': a.old_path}) AS pick FROM greedy g JOIN alike a ON a.hash = g.hash AND a.nth = g.nth + 1 AND NOT list_contains(g.taken, a.old_path) GROUP BY g.hash, a.nth)),
ren AS (SELECT g.path, g.old_path, f.language, f.byte_size FROM greedy g JOIN fresh f ON f.path = g.path),
changes AS (SELECT path, NULL::VARCHAR AS old_path, change, language, byte_size FROM j WHERE path NOT IN (SELECT path FROM ren UNION ALL SELECT old_path FROM ren) UNION ALL SELECT path, old_path, 'renamed', language, byte_size FROM ren),
dirty AS (SELECT path FROM changes WHERE change <> 'unchanged' UNION SELECT old_path FROM changes WHERE old_path IS NOT NULL)"""


def changes(t: Tables) -> DataFrame:
    return snapshot.diff(*t.manifests())


@query(f"WITH RECURSIVE {DIFF_SQL} SELECT path, old_path, change FROM changes")
def join8_snapshot_diff(t: Tables) -> DataFrame:
    return changes(t).select("path", "old_path", "change")


@query(f"WITH RECURSIVE {DIFF_SQL} SELECT path, old_path FROM changes WHERE change = 'renamed'")
def join21_renames(t: Tables) -> DataFrame:
    return changes(t).filter("change = 'renamed'").select("path", "old_path")


@query(f"WITH RECURSIVE {DIFF_SQL} SELECT path FROM dirty")
def set3_dirty_set(t: Tables) -> DataFrame:
    return snapshot.dirty(changes(t))


@query(f"WITH RECURSIVE {DIFF_SQL} SELECT language, change, count(*) AS n FROM changes WHERE change <> 'unchanged' GROUP BY 1, 2")
def agg11_language_changes(t: Tables) -> DataFrame:
    return changes(t).filter("change <> 'unchanged'").groupBy("language", "change").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {DIFF_SQL} SELECT count(*) FILTER (WHERE change <> 'unchanged') AS files_changed, count(*) AS files, round(count(*) FILTER (WHERE change <> 'unchanged') / greatest(1, count(*)), 6) AS file_ratio, round(coalesce(sum(byte_size) FILTER (WHERE change <> 'unchanged'), 0) / greatest(1, sum(byte_size)), 6) AS byte_ratio FROM changes")
def agg12_change_ratios(t: Tables) -> DataFrame:
    return snapshot.change_ratios(changes(t))


@query(f"WITH RECURSIVE {DIFF_SQL}, r AS (SELECT count(*) AS files, coalesce(sum(byte_size) FILTER (WHERE change <> 'unchanged'), 0) / greatest(1, sum(byte_size)) AS b FROM changes), i AS (SELECT count(*) AS impacted FROM dirty) SELECT impacted, round(impacted / greatest(1, files), 6) AS impact_ratio, round(b, 6) AS byte_ratio, CASE WHEN greatest(impacted / greatest(1, files), round(b, 6)) > 0.3 THEN 'full' ELSE 'incremental' END AS mode FROM r, i")
def gr4_incremental_mode(t: Tables) -> DataFrame:
    c = changes(t)
    return snapshot.incremental_mode(snapshot.change_ratios(c), snapshot.dirty(c))


@query(f"WITH RECURSIVE {DIFF_SQL} SELECT path, change, change IN ('unchanged', 'renamed') AS parse_reused, change = 'unchanged' AS place_reused FROM changes WHERE change <> 'deleted'")
def led7_lineage(t: Tables) -> DataFrame:
    return snapshot.lineage(changes(t))


@query(f"WITH RECURSIVE {EDGES_SQL}, one AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'RF'), c(node) AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < -500 UNION SELECT one.source FROM one JOIN c ON one.target = c.node) SELECT node FROM c")
def gr1_dependency_closure(t: Tables) -> DataFrame:
    start = t.supplier.filter("s_acctbal < -500").select(F.col("s_suppkey").alias("node"))
    return graph.closure(t.edges().filter("relation = 'RF'"), start).select("node")


@query(f"WITH RECURSIVE {DIFF_SQL}, roots AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM dirty WHERE regexp_matches(regexp_extract(path, '([^/]+)$', 1), '^1[0-9]*2\\.')) SELECT path FROM dirty UNION SELECT path FROM files WHERE EXISTS (SELECT 1 FROM roots WHERE root = '' OR starts_with(path, root || '/'))")
def gr2_boundary_expansion(t: Tables) -> DataFrame:
    return graph.boundary_expansion(snapshot.dirty(changes(t)), t.files(), r"^1[0-9]*2\.")


@query(f"WITH {EDGES_SQL}, one AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'RF'), s AS (SELECT s_suppkey AS o FROM supplier WHERE s_acctbal < -800), d1 AS (SELECT DISTINCT o, target AS node FROM s JOIN one ON source = o), d2 AS (SELECT DISTINCT o, one.target AS node FROM d1 JOIN one ON source = node), d3 AS (SELECT DISTINCT o, one.target AS node FROM d2 JOIN one ON source = node) SELECT o AS origin, node, min(d) AS depth FROM (SELECT o, node, 1 AS d FROM d1 UNION ALL SELECT o, node, 2 FROM d2 UNION ALL SELECT o, node, 3 FROM d3) WHERE node <> o GROUP BY 1, 2")
def gr3_bounded_reach(t: Tables) -> DataFrame:
    sources = t.supplier.filter("s_acctbal < -800").select(F.col("s_suppkey").alias("source"))
    return graph.reach(t.edges().filter("relation = 'RF'"), sources, 3)


#: Roles of the relations in a flow: what triggers it, what it requests, what it has for an effect, and what fails.
FLOW_SQL = """picked AS (SELECT source, relation, arg_min(target, k) AS target, arg_min(confidence, k) AS confidence, arg_min(line, k) AS line FROM (SELECT *, struct_pack(a := -confidence, b := line, c := target) AS k FROM edges WHERE source <> target) GROUP BY 1, 2),
trig AS (SELECT source AS origin, target AS handler, confidence AS c1, line FROM edges WHERE relation = 'NF' AND source <> target),
flows AS (SELECT t.origin, t.handler, q.target AS route, e.target AS effect, t.c1, q.confidence AS c2, e.confidence AS c3, t.line FROM trig t LEFT JOIN picked q ON q.source = t.handler AND q.relation = 'RF' AND q.confidence >= 80 LEFT JOIN picked e ON e.source = q.target AND e.relation = 'AF' AND e.confidence >= 80),
rated AS (SELECT origin, handler, route, effect, CASE WHEN effect IS NOT NULL THEN 4 WHEN route IS NOT NULL THEN 3 ELSE 1 END AS reach, least(c1, coalesce(c2, 100), coalesce(c3, 100)) AS lowest, least(c1, coalesce(c2, 100)) AS gate, line FROM flows),
ranked AS (SELECT origin, handler, route, effect, reach, lowest, CASE WHEN route IS NOT NULL AND gate >= 90 THEN 'verified' WHEN gate >= 65 THEN 'inferred' ELSE 'unknown' END AS confidence, row_number() OVER (PARTITION BY origin ORDER BY reach DESC, lowest DESC, handler, line) AS rank FROM rated)"""
RELATIONS = {"trigger": "NF", "request": "RF", "effect": "AF"}


@query(f"WITH {EDGES_SQL}, {FLOW_SQL} SELECT origin, handler, route, effect, lowest, rank FROM ranked WHERE rank <= 3")
def gr5_flow_assembly(t: Tables) -> DataFrame:
    return graph.flows(t.edges(), **RELATIONS, least=80).select("origin", "handler", "route", "effect", "lowest", "rank")


@query(f"WITH {EDGES_SQL}, {FLOW_SQL} SELECT reach, count(*) AS n, min(lowest) AS lowest FROM ranked WHERE rank <= 3 GROUP BY 1")
def gr8_flow_rank(t: Tables) -> DataFrame:
    return graph.flows(t.edges(), **RELATIONS, least=80).groupBy("reach").agg(F.count("*").alias("n"), F.min("lowest").alias("lowest"))


@query(f"WITH {EDGES_SQL}, {FLOW_SQL} SELECT origin, handler, confidence FROM ranked WHERE rank <= 3")
def gr9_flow_confidence(t: Tables) -> DataFrame:
    return graph.flows(t.edges(), **RELATIONS, least=80).select("origin", "handler", "confidence")


@query(f"""WITH {EDGES_SQL}, entry AS (SELECT s_suppkey AS origin FROM supplier ORDER BY CASE WHEN s_nationkey < 5 THEN 0 ELSE 1 END, s_suppkey LIMIT 3), one AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'RF' AND source <> target),
d1 AS (SELECT origin, target AS node FROM entry JOIN one ON source = origin), d2 AS (SELECT origin, one.target AS node FROM d1 JOIN one ON source = node),
near AS (SELECT origin, node, min(d) AS depth FROM (SELECT *, 1 AS d FROM d1 UNION ALL SELECT *, 2 FROM d2) WHERE node <> origin GROUP BY 1, 2),
steps AS (SELECT origin, origin AS node, 1 AS ordinal FROM entry UNION ALL SELECT origin, node, 1 + row_number() OVER (PARTITION BY origin ORDER BY node) FROM near) SELECT origin, node, ordinal FROM steps WHERE ordinal <= 7""")
def gr6_library_flow(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") < 5).alias("preferred"))
    return graph.library_flows(nodes, t.edges().filter("relation = 'RF' and source <> target"))


@query(f"""WITH {EDGES_SQL}, origins AS (SELECT s_suppkey AS origin FROM supplier), one AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'RF' AND source <> target),
inside AS (SELECT origin, origin AS node FROM origins UNION SELECT source, target FROM one),
f AS (SELECT DISTINCT i.origin, e.source, e.target, e.line FROM inside i JOIN edges e ON e.source = i.node AND e.relation = 'AF')
SELECT origin, source, target, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY line, source, target) AS rank FROM f) WHERE rank <= 3""")
def gr7_failure_steps(t: Tables) -> DataFrame:
    calls = t.edges().filter("relation = 'RF' and source <> target")
    origins = t.supplier.select(F.col("s_suppkey").alias("source"))
    near = graph.reach(calls, origins, 1).select("origin", "node").unionByName(origins.select(F.col("source").alias("origin"), F.col("source").alias("node")))
    return graph.failures(near, t.edges().filter("relation = 'AF'"))


BOUNDED_SQL = """n AS (SELECT s_suppkey AS node, s_nationkey AS layer, CAST(round(s_acctbal * 100) AS BIGINT) AS score FROM supplier),
c AS (SELECT node FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, node) AS k FROM n) ORDER BY CASE WHEN k <= 2 THEN 0 ELSE 1 END, score DESC, node LIMIT 34),
bounded AS (SELECT source, target, relation, max(confidence) AS confidence FROM edges WHERE source <> target AND source IN (SELECT node FROM c) AND target IN (SELECT node FROM c) GROUP BY 1, 2, 3 ORDER BY confidence DESC, source, target, relation LIMIT 48)"""


def scored_nodes(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("layer"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("score"))


@query(f"WITH {EDGES_SQL}, {BOUNDED_SQL} SELECT source, target, relation, confidence FROM bounded")
def gr10_bounded_graph(t: Tables) -> DataFrame:
    return graph.select_graph(scored_nodes(t), t.edges())


@query(f"WITH {EDGES_SQL} SELECT relation, count(*) AS n FROM edges e WHERE relation <> 'NO' OR NOT EXISTS (SELECT 1 FROM edges x WHERE x.source = e.source AND x.target = e.target AND x.relation <> 'NO') GROUP BY 1")
def gr11_suppress_weaker(t: Tables) -> DataFrame:
    return graph.without_weaker(t.edges(), "NO").groupBy("relation").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL}, b AS (SELECT source AS node, 'out' AS side, relation FROM edges UNION SELECT target, 'in', relation FROM edges) SELECT node, coalesce(string_agg(relation, ',' ORDER BY relation) FILTER (WHERE side = 'in'), '') AS ins, coalesce(string_agg(relation, ',' ORDER BY relation) FILTER (WHERE side = 'out'), '') AS outs FROM b GROUP BY node")
def gr12_in_out_labels(t: Tables) -> DataFrame:
    return graph.labels_in_out(t.edges())


@query(f"WITH {EDGES_SQL} SELECT e.source, coalesce(s.s_name, 'external:' || e.target) AS target_name, count(*) AS n FROM edges e LEFT JOIN supplier s ON s.s_suppkey = e.target AND s.s_acctbal > 0 GROUP BY 1, 2")
def gr13_import_view(t: Tables) -> DataFrame:
    known = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("target"), "s_name")
    name = F.coalesce("s_name", F.concat(F.lit("external:"), F.col("target").cast("string")))
    pairs = t.edges().groupBy("source", "target").agg(F.count("*").alias("n")).join(known, "target", "left").select("source", name.alias("target_name"), "n")
    return dealt(pairs, t.lineitem.count(), "source", "target_name").groupBy("source", "target_name").agg(F.sum("n").alias("n"))


@query(f"WITH {EDGES_SQL}, s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < -500) SELECT relation, CASE WHEN confidence >= 80 THEN 'confirmed' ELSE 'possible' END AS kind, count(*) AS n FROM edges WHERE source IN (SELECT * FROM s) OR target IN (SELECT * FROM s) GROUP BY 1, 2")
def gr14_impact_brief(t: Tables) -> DataFrame:
    changed = t.supplier.filter("s_acctbal < -500").select(F.col("s_suppkey").alias("node"))
    e = t.edges()
    out = e.join(changed.withColumnRenamed("node", "source"), "source", "left_semi")
    into = e.join(changed.withColumnRenamed("node", "target"), "target", "left_semi").join(changed.withColumnRenamed("node", "source"), "source", "left_anti")
    both = out.unionByName(into.select(*out.columns))
    return both.groupBy("relation", F.when(F.col("confidence") >= 80, "confirmed").otherwise("possible").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT source, CASE WHEN bool_or(confidence >= 80 AND relation IN ('RF')) THEN 'high' WHEN bool_or(confidence >= 80) OR count(*) > 10 THEN 'medium' ELSE 'low' END AS risk FROM edges GROUP BY source")
def gr15_risk(t: Tables) -> DataFrame:
    return graph.risk(t.edges(), ["RF"])


@query(f"WITH {FILES_SQL}, p AS (SELECT path, string_split(path, '/') AS s FROM files), x AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p) SELECT DISTINCT array_to_string(s[1:n], '/') AS path, array_to_string(s[1:n-1], '/') AS parent, CAST(n AS INTEGER) AS depth, CASE WHEN n = len(s) THEN 'file' ELSE 'directory' END AS kind FROM x")
def gr17_file_tree(t: Tables) -> DataFrame:
    return graph.file_tree(t.files())


@query(f"WITH {EDGES_SQL}, b AS (SELECT source, target, relation FROM edges WHERE confidence >= 60), c AS (SELECT source, target, relation FROM edges WHERE confidence <= 90) SELECT 'added' AS change, relation, count(*) AS n FROM (SELECT * FROM c EXCEPT SELECT * FROM b) GROUP BY 2 UNION ALL SELECT 'removed', relation, count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM c) GROUP BY 2")
def gr18_graph_diff(t: Tables) -> DataFrame:
    e = t.edges()
    return graph.diff_graphs(e.filter("confidence >= 60"), e.filter("confidence <= 90"))


@query(f"WITH {EDGES_SQL}, k AS (SELECT DISTINCT s_suppkey AS node FROM supplier WHERE s_acctbal > -500) SELECT 'duplicate_node' AS fault, 0 AS n UNION ALL SELECT 'dangling', count(*) FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges) WHERE node NOT IN (SELECT node FROM k) UNION ALL SELECT 'self_edge', count(*) FROM edges WHERE source = target UNION ALL SELECT 'parallel_pair', count(*) FROM (SELECT 1 FROM edges GROUP BY source, target HAVING count(*) > 1)")
def gr19_validation(t: Tables) -> DataFrame:
    return graph.validation(t.supplier.filter("s_acctbal > -500").select(F.col("s_suppkey").alias("node")), t.edges())


@query(f"WITH {EDGES_SQL}, {BOUNDED_SQL} SELECT s_nationkey AS layer, 'flowchart LR' || chr(10) || string_agg('  n' || source || ' -->|' || relation || '| n' || target, chr(10) ORDER BY source, target, relation) AS text FROM bounded JOIN supplier ON s_suppkey = source GROUP BY 1")
def snk6_mermaid(t: Tables) -> DataFrame:
    layer = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("layer"))
    return graph.mermaid(graph.select_graph(scored_nodes(t), t.edges()), layer)


# -- intervals over documents' lines -----------------------------------------------------------
WINDOW_SQL = FILES_SQL + """, w AS (SELECT file_id, line_count, unnest(range(1, greatest(1, line_count - 5) + 1, 15)) AS s FROM files),
windows AS (SELECT file_id, s AS start, least(line_count, s + 19) AS "end" FROM w),
p AS (SELECT file_id, line_count, unnest(range(1, line_count + 1, 40)) AS s FROM files), parents AS (SELECT file_id, s AS start, least(line_count, s + 39) AS "end" FROM p)"""


def windows(t: Tables, size: int = 20, overlap: int = 5) -> DataFrame:
    from ..operators.chunks import line_windows

    return line_windows(t.files().select("file_id", "line_count"), size, overlap).select("file_id", "start", "end")


def parents(t: Tables) -> DataFrame:
    from ..operators.chunks import line_windows

    spans = line_windows(t.files().select("file_id", "line_count"), 40, 0)
    return spans.select("file_id", "start", "end", F.concat_ws(":", "file_id", "start").alias("span_id"))


@query(f"WITH {WINDOW_SQL} SELECT file_id, start, \"end\" FROM windows")
def fn2_line_windows(t: Tables) -> DataFrame:
    return windows(t)


@query(f"WITH {WINDOW_SQL} SELECT w.file_id, w.start, w.\"end\", arg_min(p.file_id || ':' || p.start, (p.\"end\" - p.start) * 1000000 + p.start) AS span_id FROM windows w JOIN parents p ON p.file_id = w.file_id AND p.start <= w.start AND p.\"end\" >= w.\"end\" GROUP BY 1, 2, 3")
def join9_nearest_enclosing(t: Tables) -> DataFrame:
    return relational.enclosing(windows(t), parents(t), ["file_id"])


@query(f"WITH {WINDOW_SQL} SELECT w.file_id, w.start, w.\"end\", p.start AS r_start, p.\"end\" AS r_end FROM windows w JOIN parents p ON p.file_id = w.file_id AND w.start <= p.\"end\" AND w.\"end\" >= p.start")
def join10_overlap(t: Tables) -> DataFrame:
    right = parents(t).select("file_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return relational.overlapping(windows(t), right, ["file_id"])


@query(f"WITH {WINDOW_SQL} SELECT count(*) AS n FROM windows w JOIN files f USING (file_id) WHERE w.start >= 1 AND w.start <= w.\"end\" AND w.\"end\" <= greatest(1, f.line_count)")
def fil8_valid_ranges(t: Tables) -> DataFrame:
    joined = windows(t).join(t.files().select("file_id", "line_count"), "file_id")
    return joined.filter((F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.greatest(F.lit(1), "line_count"))).agg(F.count("*").alias("n"))
