"""Edges that a parser has found, resolved to the files and symbols of their snapshot.

Each relation has its own rule, and each rule is an equi join against one row for each key, so an edge
stays one edge; a request that a route handles gets a second one, HANDLED_BY. Inputs:

    edges     snapshot, path, edge_id, relation, source (qualified name), target, request_path, method, model
    files     snapshot, path
    symbols   snapshot, path, name, qualified, symbol_id; of equal names the greatest id is the last defined
    routes    snapshot, package_root (* for any), request_path, method, symbol_id, route_file
    roots     snapshot, root: package roots, empty for the snapshot's own
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .relational import first_existing, longest_prefix

#: Endings that a relative specifier, or one below a source root, may leave out, in the order in which they are tried.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
BELOW_SOURCE = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx")

RESULT = ("edge_id", "relation", "target_path", "symbol_id", "resolution")


def _key(column: str) -> Column:
    return F.struct("snapshot", F.col(column).alias("at"))


def clean_path(path: Column) -> Column:
    """A path without empty and dot parts, each double dot having taken the part before it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(empty)
    return F.array_join(F.aggregate(parts, empty, lambda done, p: F.when(p == "..", up(done)).otherwise(F.concat(done, F.array(p)))), "/")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (snapshot, path, target) with the file that each means, else the specifier itself.

    A relative specifier means the first of its endings that the snapshot has; one below ``@/`` the
    only file below a source folder that it fits, and none if there are several.
    """
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    relative = imports.filter(F.startswith("target", F.lit("."))).select("snapshot", "path", "target").distinct()
    based = relative.withColumn("_base", clean_path(F.concat(folder, F.col("target"))))
    tried = based.withColumn("_tried", F.array(*[F.struct("snapshot", F.concat("_base", F.lit(e)).alias("at")) for e in ENDINGS]))
    near = first_existing(tried, "_tried", files.select(_key("path").alias("_at")), "_at", ["snapshot", "path", "target"])
    near = near.filter("resolved is not null").select("snapshot", "path", "target", F.col("resolved.at").alias("_near"))
    # Every tail of a path behind a source folder, without its ending, is what could be written behind @/.
    cuts = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.col("path").substr(i, F.lit(5)) == "/src/")
    tails = files.select("snapshot", "path", F.explode(F.transform(cuts, lambda i: F.col("path").substr(i + 5, F.length("path")))).alias("_tail"))
    fits = F.array_compact(F.array(*[F.when(F.endswith("_tail", F.lit(e)), F.concat(F.lit("@/"), F.expr(f"substr(_tail, 1, length(_tail) - {len(e)})"))) for e in BELOW_SOURCE]))
    below = tails.select("snapshot", "path", F.explode(fits).alias("target")).groupBy("snapshot", "target").agg(F.min("path").alias("_below"), F.max("path").alias("_other")).filter("_below = _other").drop("_other")
    joined = imports.join(near, ["snapshot", "path", "target"], "left").join(below, ["snapshot", "target"], "left")
    return joined.withColumn("resolved", F.coalesce("_near", "_below", "target")).drop("_near", "_below")


def one_symbol(symbols: DataFrame, *key: str) -> DataFrame:
    """``key, symbol_id``: of symbols with equal keys the last defined."""
    return symbols.groupBy(*key).agg(F.max("symbol_id").alias("symbol_id"))


def resolved_calls(calls: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Calls (snapshot, path, target) with the ``symbol_id`` they mean, a row for each call.

    A call means the symbol of its own file that has the last part of its name, else that part, or what
    the first part was imported as, in the file that it was imported from. Of bindings of one local
    name the last by file and name counts.
    """
    named = calls.withColumns({"_short": F.element_at(F.split("target", r"\."), -1), "_root": F.element_at(F.split("target", r"\."), 1)})
    by_name = one_symbol(symbols, "snapshot", "path", "name")
    own = by_name.select("snapshot", "path", F.col("name").alias("_short"), F.col("symbol_id").alias("_own"))
    via = bindings.groupBy("snapshot", "path", F.col("local").alias("_root")).agg(F.max(F.struct("target_path", "imported")).alias("_via"))
    far = by_name.select("snapshot", F.col("path").alias("_file"), F.col("name").alias("_far"), F.col("symbol_id").alias("_other"))
    both = named.join(own, ["snapshot", "path", "_short"], "left").join(via, ["snapshot", "path", "_root"], "left")
    both = both.withColumns({"_file": F.col("_via.target_path"), "_far": F.when(F.contains("target", F.lit(".")), F.col("_short")).otherwise(F.col("_via.imported"))}).join(far, ["snapshot", "_file", "_far"], "left")
    symbol = F.coalesce("_own", "_other")
    return both.select(*calls.columns, symbol.alias("symbol_id"), F.when(symbol.isNull(), "syntactic_target_only").otherwise("resolved_symbol").alias("resolution"))


def resolved_triggers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (snapshot, path, edge_id, source, target) with the symbol of the target's name in the innermost scope around the source, else in the file."""
    inside = F.startswith("source", F.concat("path", F.lit("::")))
    parts = F.when(inside, F.split(F.expr("substr(source, length(path) + 3)"), r"\.")).otherwise(F.array().cast("array<string>"))
    scopes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - n), F.array("target")), "."))
    tried = edges.withColumn("_tried", F.transform(scopes, lambda s: F.struct("snapshot", F.concat("path", F.lit("::"), s).alias("at"))))
    known = one_symbol(symbols, "snapshot", "qualified")
    found = first_existing(tried, "_tried", known.select(_key("qualified").alias("_at")), "_at", ["edge_id"])
    ids = known.select(F.col("snapshot").alias("_s"), F.col("qualified").alias("_q"), "symbol_id")
    at = found.join(ids, (F.col("resolved.snapshot") == F.col("_s")) & (F.col("resolved.at") == F.col("_q"))).select("edge_id", "symbol_id")
    return edges.join(at, "edge_id", "left").withColumn("resolution", F.when(F.col("symbol_id").isNull(), "unresolved_identifier").otherwise("local_symbol"))


def package_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``snapshot, path, package_root`` of files below a package root of their snapshot, the deepest."""
    safe = lambda c: F.replace(F.col(c), F.lit("/"), F.lit("\u0000"))
    at = F.concat_ws("/", safe("snapshot"), "path")
    named = roots.select(F.concat_ws("/", safe("snapshot"), F.when(F.col("root") != "", F.col("root"))).alias("root"))
    found = longest_prefix(files.select(at.alias("path")).distinct(), named).filter("root is not null")
    return files.select("snapshot", "path", at.alias("_at")).distinct().join(found.withColumnRenamed("path", "_at"), "_at").select("snapshot", "path", F.expr("substr(root, length(snapshot) + 2)").alias("package_root"))


def resolved_requests(requests: DataFrame, routes: DataFrame, roots: DataFrame) -> DataFrame:
    """Requests (snapshot, path, request_path, method) with the one route that handles them: of their own package, else of any.

    Routes that share package, path and method handle nothing, as it can't be told which would.
    """
    one = routes.groupBy("snapshot", "package_root", fx.request_path(F.col("request_path")).alias("_path"), F.upper("method").alias("_method")).agg(F.count("*").alias("_n"), F.first("symbol_id").alias("symbol_id"), F.first("route_file").alias("route_file")).filter("_n = 1").drop("_n")
    asked = requests.join(package_roots(requests, roots), ["snapshot", "path"], "left").withColumns({"_path": fx.request_path(F.col("request_path")), "_method": F.upper(F.coalesce("method", F.lit("GET")))})
    of_package = one.filter("package_root <> '*'").withColumnsRenamed({"symbol_id": "_symbol", "route_file": "_file"})
    of_any = one.filter("package_root = '*'").select("snapshot", "_path", "_method", "symbol_id", "route_file")
    both = asked.join(of_package, ["snapshot", "package_root", "_path", "_method"], "left").join(of_any, ["snapshot", "_path", "_method"], "left")
    mine = F.col("_file").isNotNull()
    kind = F.when(mine, "exact_package_route").when(F.col("route_file").isNotNull(), "exact_route").otherwise("literal_only")
    return both.select(*requests.columns, F.when(mine, F.col("_symbol")).otherwise(F.col("symbol_id")).alias("symbol_id"), F.coalesce("_file", "route_file").alias("route_file"), kind.alias("resolution"))


def resolved_models(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (snapshot, model) with the symbol of that name if the snapshot has one only."""
    single = symbols.groupBy("snapshot", F.col("name").alias("model")).agg(F.count("*").alias("_n"), F.min("symbol_id").alias("symbol_id")).filter("_n = 1").drop("_n")
    return edges.join(single, ["snapshot", "model"], "left").withColumn("resolution", F.when(F.col("symbol_id").isNotNull(), "unique_model_symbol"))


def resolved_edges(edges: DataFrame, files: DataFrame, symbols: DataFrame, bindings: DataFrame, routes: DataFrame, roots: DataFrame) -> DataFrame:
    """``edge_id, relation, target_path, symbol_id, resolution`` of all edges, and HANDLED_BY edges of requests.

    Imports resolve to files, calls through bindings, triggers through scopes, requests to routes, reads and
    writes to models; other relations keep their targets.
    """
    of = lambda *names: edges.filter(F.col("relation").isin(*names))
    nothing, no_symbol = F.lit(None).cast("string"), F.lit(None).cast(symbols.schema["symbol_id"].dataType)
    known = files.select("snapshot", F.col("path").alias("resolved"), F.lit(True).alias("_known")).distinct()
    imports = resolved_imports(of("IMPORTS"), files).join(known, ["snapshot", "resolved"], "left")
    imports = imports.select("edge_id", "relation", F.col("resolved").alias("target_path"), no_symbol.alias("symbol_id"), F.when(F.col("_known"), "local_file").otherwise("module_specifier").alias("resolution"))
    plain = lambda rows: rows.select("edge_id", "relation", F.col("target").alias("target_path"), "symbol_id", "resolution")
    requests = resolved_requests(of("REQUESTS"), routes, roots)
    handled = requests.filter("route_file is not null").select("edge_id", F.lit("HANDLED_BY").alias("relation"), F.col("route_file").alias("target_path"), "symbol_id", "resolution")
    rest = edges.filter(~F.col("relation").isin("IMPORTS", "CALLS", "TRIGGERS", "REQUESTS", "READS", "WRITES"))
    parts = [
        plain(resolved_calls(of("CALLS"), symbols, bindings)),
        plain(resolved_triggers(of("TRIGGERS"), symbols)),
        plain(resolved_models(of("READS", "WRITES"), symbols)),
        plain(requests.withColumn("symbol_id", no_symbol)),
        handled,
        plain(rest.withColumns({"symbol_id": no_symbol, "resolution": nothing})),
    ]
    for part in parts:
        imports = imports.unionByName(part)
    return imports
