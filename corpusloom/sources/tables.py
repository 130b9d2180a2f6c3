"""The input tables and the views that give them the shape of files, edges, events and prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt


@dataclass(frozen=True)
class Tables:
    """Tables of a folder, ``t.orders`` being ``orders.parquet``; views are methods."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def files(self) -> DataFrame:
        """Documents as source files of one snapshot."""
        text = F.col("text")
        return self.documents.select(
            F.col("doc_id").alias("file_id"),
            F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))).alias("path"),
            F.col("lang").alias("language"),
            text.alias("content"),
            F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("content_hash"),
            F.octet_length(text).cast("bigint").alias("byte_size"),
            F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).cast("bigint").alias("line_count"),
        )

    def tree(self) -> DataFrame:
        """Documents as the files of code repositories, each with files of all kinds: paths and contents follow from the id and the text."""
        d = self.documents.filter("text is not null")
        kind, name = F.col("doc_id") % 12, F.concat(F.lit("d"), F.col("doc_id").cast("string"))
        path, content = F.lit(None).cast("string"), F.col("text")
        for i, (before, after) in enumerate(TREE_PATHS):
            path = F.when(kind == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(path)
        line = lambda n: F.coalesce(F.get(F.split("text", "\n"), F.lit(n)), F.lit(""))
        has = F.array_compact(F.array(*[F.when(F.col("doc_id") % n == r, F.lit(f'"{p}": "1"')) for p, (n, r) in TREE_PACKAGES.items()]))
        manifest = F.concat(F.lit('{"dependencies": {'), F.array_join(has, ", "), F.lit("}}"))
        readme = F.concat_ws("\n", F.lit("# Title"), F.lit("```"), F.lit("- code"), F.lit("```"), line(0), line(1), F.lit(""), F.lit("## Features:"), F.concat(F.lit("- **"), F.substring(line(0), 1, 60), F.lit("**")), F.concat(F.lit("* "), line(2)), F.lit("no bullet"), F.lit("## Other"), F.lit("- no"))
        call = F.concat_ws("\n", F.col("text"), F.concat(F.lit("const x = await fetch('https://api."), F.col("lang"), F.lit(".example.org/v1')")), F.lit("fetch('https://example.com/x'); plain https://other.example.net"))
        content = F.when(kind == 6, manifest).when(kind == 7, readme).when(kind == 8, call).otherwise(content)
        suffix = F.regexp_extract(path, r"\.([a-z]+)$", 1)
        language = F.when(suffix == "ts", "typescript").when(suffix == "js", "javascript").otherwise(suffix)
        return d.select(F.concat(F.lit("repo"), (F.floor(F.col("doc_id") / 12) % 20).cast("string")).alias("snapshot"), F.col("doc_id").alias("file_id"), path.alias("path"), language.alias("language"), content.alias("content"), F.size(F.split(content, "\n")).alias("line_count"))

    def imports(self) -> DataFrame:
        """Imports of packages and files by the tree's library files: a specifier, what it is called here, and what it is called there."""
        files = self.tree().filter("file_id % 12 in (2, 3, 8)")
        target = F.when(F.col("file_id") % 4 == 0, F.lit("stripe/lib")).when(F.col("file_id") % 4 == 1, F.lit("@supabase/supabase-js")).otherwise(F.concat(F.lit("src/lib/d"), (F.col("file_id") - F.col("file_id") % 12 + 3).cast("string")))
        return files.select("snapshot", "path", target.alias("specifier"), F.lit("run").alias("local"), F.concat(F.lit("f"), (F.col("file_id") % 3).cast("string")).alias("imported"), (F.col("file_id") % 5 == 0).alias("type_only"))

    def edges(self) -> DataFrame:
        """Line items as a property graph over suppliers: distinct (source, target, relation) with the best confidence."""
        n = self.supplier.agg(F.count("*").alias("n"))
        rows = self.lineitem.crossJoin(F.broadcast(n)).select(
            F.col("l_suppkey").alias("source"),
            (F.col("l_partkey") % F.col("n") + 1).alias("target"),
            F.concat("l_returnflag", "l_linestatus").alias("relation"),
            (100 - 5 * F.round(F.col("l_discount") * 100).cast("int")).alias("confidence"),
            F.col("l_orderkey").alias("line"),
        )
        return dealt(rows, self.lineitem.count(), "source", "target").groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"), F.min("line").alias("line"))

    def manifests(self) -> tuple[DataFrame, DataFrame]:
        """Two snapshots of the files: some added, deleted, changed and renamed since the first. Copies have one hash, so renames compete."""
        f = self.files().select("file_id", "path", "language", "byte_size", "content_hash")
        own = F.col("content_hash")
        kind = F.col("file_id") % 10
        base = f.filter(kind != 0).select("path", own.alias("content_hash"), "language", "byte_size")
        changed = F.when(kind == 2, F.concat(own, F.lit("+"))).otherwise(own)
        moved = F.when(kind == 3, F.concat(F.lit("new/"), F.col("path"))).otherwise(F.col("path"))
        return base, f.filter(kind != 1).select(moved.alias("path"), changed.alias("content_hash"), "language", (F.col("byte_size") + F.when(kind == 2, 1).otherwise(0)).alias("byte_size"))

    def usage(self) -> DataFrame:
        """Events as usage of organisations: an integer amount of micro-units for each."""
        return self.events.select("event_id", F.col("user_id").alias("org"), F.col("event_type").alias("feature"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("micro"))

    def mastery(self) -> DataFrame:
        """Events as learning events: profile, concept, order and what they add to score and confidence in thousandths."""
        pick = lambda i: F.create_map(*[F.lit(x) for kind, deltas in MASTERY_DELTA.items() for x in (kind, deltas[i])])[F.col("event_type")]
        return self.events.select("event_id", F.col("user_id").alias("profile"), F.col("event_type").alias("concept"), "ts", pick(0).alias("delta"), pick(1).alias("confidence_delta"))


#: Thousandths a learning event adds to a score and to its confidence, by event type.
MASTERY_DELTA = {"signup": (80, 80), "purchase": (120, 150), "view": (80, 80), "click": (-60, 80), "error": (-80, 120)}

#: What stands before and after a file's name in the tree, by its id modulo 12, and when a manifest declares a package.
TREE_PATHS = (("app/", "/page.tsx"), ("app/api/(main)/", "/route.ts"), ("src/components/", ".tsx"), ("src/lib/", ".ts"), ("src/models/", ".js"), ("tests/", ".test.ts"), ("", "/package.json"), ("", "/README.md"), ("src/services/", ".js"), ("", "/tsconfig.json"), ("src/pages/", "/[id].tsx"), ("", "/server.ts"))
TREE_PACKAGES = {"next": (5, 0), "react": (3, 0), "stripe": (7, 0), "zod": (4, 2), "pg": (8, 6)}

#: The views in DuckDB SQL, to stand before a query.
FILES_SQL = """files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS path, lang AS language, text AS content,
  'sha256:' || sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS byte_size,
  CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS BIGINT) AS line_count FROM documents)"""
TREE_SQL = "tree AS (SELECT 'repo' || (doc_id // 12) % 20 AS snapshot, doc_id AS file_id, path, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' ELSE regexp_extract(path, '\\.([a-z]+)$', 1) END AS language, content, len(string_split(content, chr(10))) AS line_count FROM (SELECT *, CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{a}d' || doc_id || '{b}'" for i, (a, b) in enumerate(TREE_PATHS)) + (
    " END AS path, CASE doc_id % 12 WHEN 6 THEN '{\"dependencies\": {' || concat_ws(', ', " + ", ".join(f"CASE WHEN doc_id % {n} = {r} THEN '\"{p}\": \"1\"' END" for p, (n, r) in TREE_PACKAGES.items()) + ") || '}}'"
    " WHEN 7 THEN concat_ws(chr(10), '# Title', '```', '- code', '```', coalesce(ls[1], ''), coalesce(ls[2], ''), '', '## Features:', '- **' || coalesce(ls[1], '')[1:60] || '**', '* ' || coalesce(ls[3], ''), 'no bullet', '## Other', '- no')"
    " WHEN 8 THEN concat_ws(chr(10), text, 'const x = await fetch(''https://api.' || lang || '.example.org/v1'')', 'fetch(''https://example.com/x''); plain https://other.example.net') ELSE text END AS content FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))"
)
IMPORTS_SQL = "imports AS (SELECT snapshot, path, CASE file_id % 4 WHEN 0 THEN 'stripe/lib' WHEN 1 THEN '@supabase/supabase-js' ELSE 'src/lib/d' || (file_id - file_id % 12 + 3) END AS specifier, 'run' AS local, 'f' || (file_id % 3) AS imported, file_id % 5 = 0 AS type_only FROM tree WHERE file_id % 12 IN (2, 3, 8))"
EDGES_SQL = """edges AS (SELECT source, target, relation, max(confidence) AS confidence, min(line) AS line FROM (
  SELECT l_suppkey AS source, l_partkey % (SELECT count(*) FROM supplier) + 1 AS target, l_returnflag || l_linestatus AS relation,
    100 - 5 * CAST(round(l_discount * 100) AS INTEGER) AS confidence, l_orderkey AS line FROM lineitem) GROUP BY 1, 2, 3)"""
MANIFEST_SQL = FILES_SQL + """, own AS (SELECT *, content_hash AS h, file_id % 10 AS kind FROM files),
base AS (SELECT path, h AS content_hash, language, byte_size FROM own WHERE kind <> 0),
curr AS (SELECT CASE WHEN kind = 3 THEN 'new/' || path ELSE path END AS path, CASE WHEN kind = 2 THEN h || '+' ELSE h END AS content_hash,
  language, byte_size + CASE WHEN kind = 2 THEN 1 ELSE 0 END AS byte_size FROM own WHERE kind <> 1)"""
USAGE_SQL = "usage AS (SELECT event_id, user_id AS org, event_type AS feature, ts, CAST(round(value * 100) AS BIGINT) AS micro FROM events)"
_MASTERY_CASE = [" ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in MASTERY_DELTA.items()) for i in (0, 1)]
MASTERY_SQL = f"mastery AS (SELECT event_id, user_id AS profile, event_type AS concept, ts, CASE event_type {_MASTERY_CASE[0]} END AS delta, CASE event_type {_MASTERY_CASE[1]} END AS confidence_delta FROM events)"
