"""What a repository is for, told by the roles of its files, how they work together, and who uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..session import written
from .relational import priority_order, top_per_key

# Roles in the order in which they are told, relations by how much they say, names that show a role.
ROLES = ("experience", "public_api", "request_gateway", "analysis", "understanding", "learning", "application", "persistence", "external", "runtime", "shared", "core")
RELATIONS = ("TRIGGERS", "REQUESTS", "HANDLED_BY", "CALLS", "READS", "WRITES", "NAVIGATES_TO", "USES_EXTERNAL", "RAISES", "IMPORTS")
LEARNING = ("learning", "assessment", "mastery", "guidance", "deep_task", "deep-task", "chat", "voice", "concept")
UNDERSTANDING = ("/navigation/", "project_map", "feature_flow", "architecture_", "code_focus", "change_brief", "retrieval", "embedding")
GATEWAY = ("/api/repositories", "/queue", "router.py", "main.py", "health.py")
STORES = ("/models", "/schemas", "migration", "database")
ENTRIES = ("index", "main", "lib", "__init__")
ROLE_EVIDENCE, CONNECTION_EVIDENCE, STEPS = 6, 5, 5


def role_of(library: Column) -> Column:
    """The role of a node (path, label, node_type, layer, in_flow) of a library or of an application."""
    path = F.lower("path")
    name = F.concat_ws(" ", path, F.lower("label"), F.lower("node_type"))
    has = lambda words: name.rlike("|".join(rf"\Q{w}\E" for w in words))
    stem = F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(.)\.[^.]*$", "$1")
    layer = F.col("layer")
    of_library = fx.first_match([(F.col("in_flow") | stem.isin(*ENTRIES), "public_api"), (layer == "configuration", "runtime"), (layer.isin("domain", "server"), "core")], "shared")
    analysis = (F.col("node_type") == "worker") | F.contains(path, F.lit("/analysis/")) | has(("repository_analysis", "parser"))
    of_application = fx.first_match(
        [
            (layer == "client", "experience"),
            (has(LEARNING), "learning"),
            (has(UNDERSTANDING), "understanding"),
            (analysis, "analysis"),
            (has(GATEWAY), "request_gateway"),
            ((layer == "data") | has(STORES), "persistence"),
            (layer == "external", "external"),
            (layer == "configuration", "runtime"),
            (layer == "shared", "shared"),
        ],
        "application",
    )
    return F.when(library, of_library).otherwise(of_application)


def with_roles(nodes: DataFrame) -> DataFrame:
    """Nodes with ``library`` (no client or server layer in the snapshot) and ``role``."""
    kinds = nodes.groupBy("snapshot").agg((F.max(F.col("layer").isin("client", "server").cast("int")) == 0).alias("library"))
    return written(nodes.join(kinds, "snapshot").withColumn("role", role_of(F.col("library"))), "story-nodes")


def _verified(column: str = "confidence") -> Column:
    return F.when(F.max((F.col(column) == "verified").cast("int")) == 1, "verified").otherwise("inferred")


def roles(nodes: DataFrame) -> DataFrame:
    """``snapshot, place, role, nodes, confidence, evidence``: the roles of each snapshot in order, with the first paths of each."""
    told = nodes.groupBy("snapshot", "role").agg(F.count("*").alias("nodes"), _verified().alias("confidence"))
    paths = top_per_key(nodes.select("snapshot", "role", "path").distinct(), ["snapshot", "role"], [F.col("path")], ROLE_EVIDENCE)
    first = paths.groupBy("snapshot", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("evidence"))
    placed = top_per_key(told.join(first, ["snapshot", "role"]), ["snapshot"], [priority_order("role", ROLES)], len(ROLES), "place")
    return placed.select("snapshot", "place", "role", "nodes", "confidence", "evidence")


def connections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``snapshot, source_role, target_role, relations, edges, confidence, evidence`` of edges (snapshot, source, target, relation, confidence) between roles.

    Relations are in the order of what they say, so the first is what the connection is called by.
    """
    end = lambda name: nodes.select("snapshot", F.col("path").alias(name), F.col("role").alias(f"{name}_role"))
    between = edges.join(end("source"), ["snapshot", "source"]).join(end("target"), ["snapshot", "target"]).filter("source_role <> target_role")
    key = ["snapshot", "source_role", "target_role"]
    said = F.transform(F.array_sort(F.collect_set(F.struct(priority_order("relation", RELATIONS).alias("p"), "relation"))), lambda x: x["relation"])
    told = between.groupBy(*key).agg(said.alias("relations"), F.count("*").alias("edges"), _verified().alias("confidence"))
    paths = top_per_key(between.select(*key, F.col("source").alias("path")).distinct(), key, [F.col("path")], CONNECTION_EVIDENCE)
    first = paths.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("evidence"))
    return told.join(first, key)


def purpose(told: DataFrame, nodes: DataFrame, summaries: DataFrame, features: DataFrame) -> DataFrame:
    """``snapshot, one_liner, audience, outcome, steps``: what a snapshot is for.

    ``told`` are its roles, ``summaries`` has snapshot and summary, ``features`` snapshot, rank and
    outcome. The audience is developers of a library, people where there is something to see, and
    other systems else; the first feature is the outcome but for people, who get an understanding.
    """
    kinds = nodes.select("snapshot", "library").distinct()
    has = told.groupBy("snapshot").agg((F.max((F.col("role") == "experience").cast("int")) == 1).alias("seen"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= STEPS, F.struct("place", "role")))), lambda x: F.concat_ws(". ", x["place"].cast("string"), x["role"])).alias("steps"))
    first = features.groupBy("snapshot").agg(F.min_by("outcome", "rank").alias("outcome"))
    audience = F.when(F.col("library"), "developers").when(F.col("seen"), "people").otherwise("systems")
    joined = kinds.join(has, "snapshot").join(summaries, "snapshot", "left").join(first, "snapshot", "left")
    line = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.trim("summary")).otherwise(F.col("snapshot"))
    outcome = F.when(audience == "people", "understanding").otherwise(F.coalesce("outcome", F.lit("core result")))
    return joined.select("snapshot", line.alias("one_liner"), audience.alias("audience"), outcome.alias("outcome"), "steps")
