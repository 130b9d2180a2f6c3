"""What a snapshot's files say about it: areas, technologies, services, features, and where to begin reading.

Files have snapshot, file_id, path, language and content; all results are for each snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .relational import best_per_key, top_per_key

# The parts of paths that name an area.
PAGES = ("page.ts", "page.tsx", "page.js", "page.jsx")
SERVERS = ("server.ts", "server.js", "server.mjs")
DATABASES = ("schema.prisma", "db.ts", "db.js", "database.ts", "database.js", "prisma.ts", "prisma.js")
AREAS = ("interface", "api", "data", "core", "tests", "configuration")
CODE = ("typescript", "tsx", "javascript", "jsx")
# Entry files in the order in which they are looked for, and headings of feature lists.
ENTRIES = ("src/app/page.tsx", "app/page.tsx", "src/pages/index.tsx", "src/main.tsx", "src/index.ts", "server.ts", "index.ts", "index.js", "index.d.ts")
FEATURE_HEADINGS = ("feature", "features", "capabilities", "what it does", "key features", "기능", "주요 기능", "핵심 기능")
# Ranks of confidence.
RANKS = ("unknown", "inferred", "verified")


def areas(path: Column) -> dict[str, Column]:
    """Whether a path is of each area, by its directories and its name; page is one more, without files of its own."""
    lower = F.concat(F.lit("/"), F.lower(path))
    name = F.regexp_extract(lower, "[^/]*$", 0)
    under = lambda *folders: lower.rlike("/(" + "|".join(folders) + ")/")
    api = under("api", "routes", "controllers") | name.isin(*SERVERS) | (name.startswith("route.") & under("app"))
    page = name.isin(*PAGES) | (under("pages") & ~api)
    return {
        "page": page,
        "interface": ~api & (page | name.startswith("layout.") | under("components", "views", "ui")),
        "api": api,
        "data": under("prisma", "data", "migrations", "models", "database") | name.isin(*DATABASES),
        "core": ~api & under("lib", "services", "features", "core", "hooks", "state"),
        "tests": under("tests", "test", "__tests__", "e2e") | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec.")),
        "configuration": (name == "package.json") | F.contains(name, F.lit("config.")) | name.startswith("tsconfig") | name.startswith("eslint"),
    }


def system_areas(files: DataFrame, limit: int = 3) -> DataFrame:
    """``snapshot, area, path, rank``: the first few files of each area, by path without case."""
    flags = areas(F.col("path"))
    each = files.select("snapshot", "file_id", "path", F.explode(F.array_compact(F.array(*[F.when(flags[a], F.lit(a)) for a in AREAS]))).alias("area"))
    return top_per_key(each, ["snapshot", "area"], [F.lower("path"), F.col("file_id")], limit).select("snapshot", "area", "path", "rank")


def dependencies(files: DataFrame) -> DataFrame:
    """``snapshot, file_id, path, package`` of what package manifests declare; a manifest that is no JSON declares nothing."""
    read = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>", {"mode": "PERMISSIVE"})
    keys = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(read[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")]))
    return files.filter(F.regexp_extract(F.lower("path"), "[^/]*$", 0) == "package.json").select("snapshot", "file_id", "path", F.explode(keys).alias("package"))


def merged_claims(claims: DataFrame, most: int = 5) -> DataFrame:
    """``snapshot, name, detail, confidence, paths`` of claims (snapshot, name, detail, confidence, place, path): the first detail, the best confidence, a few paths in order.

    Each is an aggregate that combines before the shuffle, or a rank that is cut to a few in each task.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("confidence"))
    of_path = claims.groupBy("snapshot", "name", "path").agg(F.min("place").alias("place"), F.min_by("detail", F.struct("place", "path")).alias("detail"), F.max(rank).alias("r"))
    merged = of_path.groupBy("snapshot", "name").agg(F.min_by("detail", F.struct("place", "path")).alias("detail"), F.max("r").alias("r"))
    few = top_per_key(of_path.select("snapshot", "name", "place", "path"), ["snapshot", "name"], [F.col("place"), F.col("path")], most, "_n")
    paths = few.groupBy("snapshot", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda x: x["path"]), ",").alias("paths"))
    return merged.join(paths, ["snapshot", "name"]).select("snapshot", "name", "detail", F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.col("r").cast("int")).alias("confidence"), "paths")


def _named(mapping: Mapping[str, tuple[str, str]], key: Column, i: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, v[i])])[key]


def tech_stack(files: DataFrame, technologies: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Technologies by the languages of code and by declared packages, merged."""
    language = F.when(F.col("language").isin("typescript", "tsx"), "TypeScript").when(F.col("language").isin("javascript", "jsx"), "JavaScript")
    spoken = files.filter(language.isNotNull() & ~areas(F.col("path"))["configuration"]).select("snapshot", language.alias("name"), F.lit("language").alias("detail"), "path")
    first = spoken.groupBy("snapshot", "name").agg(F.first("detail").alias("detail"), F.min_by("path", F.struct(F.lower("path"), "path")).alias("path")).withColumns({"confidence": F.lit("verified"), "place": F.lit(0)})
    used = dependencies(files).filter(F.col("package").isin(*technologies))
    declared = used.select("snapshot", _named(technologies, F.col("package"), 0).alias("name"), _named(technologies, F.col("package"), 1).alias("detail"), "path", F.lit("verified").alias("confidence"), F.lit(1).alias("place"))
    return merged_claims(first.unionByName(declared))


def external_services(files: DataFrame, imports: DataFrame, packages: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Services by declared packages (inferred), by imports (snapshot, path, package) and by remote hosts in code (verified), merged.

    A host counts where its line has a remote call; local and example hosts don't.
    """
    known = lambda df, confidence, place: df.filter(F.col("package").isin(*packages)).select("snapshot", _named(packages, F.col("package"), 0).alias("name"), _named(packages, F.col("package"), 1).alias("detail"), "path", F.lit(confidence).alias("confidence"), F.lit(place).alias("place"))
    calls = files.filter(F.col("language").isin(*CODE)).select("snapshot", "path", F.explode(fx.lines(F.col("content"))).alias("line")).filter(F.col("line").rlike(r"\b(?:fetch|axios\.(?:get|post|put|patch|delete)|new\s+URL)\b"))
    hosts = calls.select("snapshot", "path", F.explode(F.regexp_extract_all("line", F.lit(r"https?://([A-Za-z0-9.-]+)"), F.lit(1))).alias("host"))
    remote = hosts.select("snapshot", F.regexp_replace(F.lower("host"), r"\.+$", "").alias("name"), F.lit("remote host").alias("detail"), "path", F.lit("verified").alias("confidence"), F.lit(2).alias("place"))
    remote = remote.filter(~F.col("name").isin("localhost", "127.0.0.1", "example.com"))
    return merged_claims(known(dependencies(files), "inferred", 0).unionByName(known(imports, "verified", 1)).unionByName(remote))


def readme_features(files: DataFrame, most: int = 5) -> DataFrame:
    """``snapshot, file_id, line, feature``: the first bullets under a feature heading of each README."""
    headings = F.array(*[F.lit(h) for h in FEATURE_HEADINGS])
    rows = files.filter(F.lower("path").rlike(r"(^|/)readme(\.[a-z]+)?$")).select("snapshot", "file_id", F.posexplode(fx.lines(F.col("content"))).alias("pos", "text"))
    heading = F.regexp_extract("text", r"^\s*#{1,6}\s+(.+?)\s*$", 1)
    listed = F.when(heading != "", F.array_contains(headings, F.regexp_replace(F.lower(fx.clean_markdown(heading)), ":+$", "")))
    w = Window.partitionBy("file_id").orderBy("pos")
    inside = rows.withColumn("_in", F.last(listed, ignorenulls=True).over(w)).filter("_in")
    feature = fx.truncated(fx.clean_markdown(F.regexp_extract("text", r"^\s*[-*+]\s+(.+?)\s*$", 1)), 240)
    found = inside.select("snapshot", "file_id", (F.col("pos") + 1).alias("line"), feature.alias("feature")).filter("feature <> ''")
    return top_per_key(found, ["file_id"], [F.col("line")], most, "_n").drop("_n")


def readme_summary(files: DataFrame, most: int = 240) -> DataFrame:
    """``snapshot, file_id, summary``: the first paragraph of each README outside of code fences, headings, lists, tables and badges."""
    rows = files.filter(F.lower("path").rlike(r"(^|/)readme(\.[a-z]+)?$")).select("snapshot", "file_id", F.posexplode(fx.lines(F.col("content"))).alias("pos", "text"))
    w = Window.partitionBy("file_id").orderBy("pos")
    line = F.trim(F.col("text"))
    fence = line.startswith("```")
    rows = rows.withColumn("_fences", F.sum(fence.cast("int")).over(w))
    noise = line.rlike(r"^(<!--|<img|<picture|\[!\[|!\[)") | F.contains(F.lower(line), F.lit("shields.io"))
    text = ~fence & (F.col("_fences") % 2 == 0) & (line != "") & ~noise & ~line.rlike(r"^(#|- |\* |\+ |\|)")
    # A fence's own line doesn't end a paragraph; any other line that is no text does.
    rows = rows.filter(~fence).withColumn("_text", text)
    run = F.sum((~F.col("_text")).cast("int")).over(w)
    runs = rows.withColumn("_run", run).filter("_text")
    first = runs.groupBy("file_id").agg(F.min("_run").alias("_run"))
    kept = runs.join(first, ["file_id", "_run"], "left_semi").groupBy("snapshot", "file_id").agg(F.array_sort(F.collect_list(F.struct("pos", fx.clean_markdown(line).alias("t")))).alias("p"))
    return kept.select("snapshot", "file_id", fx.truncated(F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != ""), " "), most).alias("summary"))


def capabilities(files: DataFrame, most: int = 5) -> DataFrame:
    """``snapshot, name, kind, rank``: README features first, then what pages and routes are called, each name once."""
    flags = areas(F.col("path"))
    folders = lambda *skipped: F.filter(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda p: ~p.isin(*skipped))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("home"))
    own = readme_features(files).select("snapshot", fx.truncated(F.col("feature"), 80).alias("name"), F.lit("readme").alias("kind"), F.lit(0).alias("place"), F.lpad(F.col("line").cast("string"), 9, "0").alias("at"), "file_id")
    page = files.filter(flags["page"]).select("snapshot", F.concat(last(folders("src", "app", "pages")), F.lit(" page")).alias("name"), F.lit("page").alias("kind"), F.lit(1).alias("place"), F.lower("path").alias("at"), "file_id")
    route = files.filter(flags["api"]).select("snapshot", F.concat(last(folders("src", "app", "api", "routes")), F.lit(" request")).alias("name"), F.lit("api").alias("kind"), F.lit(2).alias("place"), F.lower("path").alias("at"), "file_id")
    once = best_per_key(own.unionByName(page).unionByName(route), ["snapshot", "name"], [F.col("place"), F.col("at"), F.col("file_id")])
    return top_per_key(once, ["snapshot"], [F.col("place"), F.col("at"), F.col("file_id")], most).select("snapshot", "name", "kind", "rank")


def read_first(files: DataFrame, most: int = 5) -> DataFrame:
    """``snapshot, path, reason, rank``: README, root manifest, and the shallowest page, route and data file; each file once."""
    flags = areas(F.col("path"))
    kinds = [("readme", F.lower("path").rlike(r"(^|/)readme(\.[a-z]+)?$")), ("manifest", F.col("path").rlike(r"^([^/]+/)?package\.json$")), ("page", flags["page"]), ("api", flags["api"]), ("data", flags["data"])]
    each = files.select("snapshot", "file_id", "path", F.explode(F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("place"), F.lit(kind).alias("reason"))) for i, (kind, cond) in enumerate(kinds)]))).alias("k")).select("snapshot", "file_id", "path", "k.*")
    best = best_per_key(each.withColumn("depth", F.size(F.split("path", "/"))), ["snapshot", "place"], [F.col("depth"), F.lower("path"), F.col("file_id")], ["reason", "path", "file_id"])
    once = best_per_key(best, ["snapshot", "file_id"], [F.col("place")], ["reason", "path", "place"])
    return top_per_key(once, ["snapshot"], [F.col("place")], most).select("snapshot", "path", "reason", "rank")


def start_here(files: DataFrame, entries: Sequence[str] = ENTRIES, most: int = 5, otherwise: int = 3) -> DataFrame:
    """``snapshot, path, rank``: entry files in their order, or the first few code files of a snapshot without any."""
    place = F.array_position(F.array(*[F.lit(e) for e in entries]), F.regexp_replace("path", "^[^/]+/(?=(src/)?(app/page|pages/index|main|index|server)\\.)", ""))
    listed = top_per_key(files.withColumn("place", place).filter("place > 0"), ["snapshot"], [F.col("place"), F.col("path")], most)
    code = files.filter(F.col("language").isin(*CODE)).join(listed.select("snapshot").distinct(), "snapshot", "left_anti")
    return listed.select("snapshot", "path", "rank").unionByName(top_per_key(code, ["snapshot"], [F.col("path")], otherwise).select("snapshot", "path", "rank"))


def stack_flags(files: DataFrame, packages: Sequence[str]) -> DataFrame:
    """``snapshot`` and whether it has TypeScript, JavaScript and each of some packages."""
    has = lambda *names: F.bool_or(F.col("language").isin(*names))
    spoken = files.groupBy("snapshot").agg(has("typescript", "tsx").alias("typescript"), has("javascript", "jsx").alias("javascript"))
    declared = dependencies(files).groupBy("snapshot").agg(*[F.bool_or(F.col("package") == p).alias(p) for p in packages])
    return spoken.join(declared, "snapshot", "left").select("snapshot", "typescript", "javascript", *[F.coalesce(p, F.lit(False)).alias(p) for p in packages])


def project_map(files: DataFrame, imports: DataFrame, technologies: Mapping[str, tuple[str, str]], packages: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row for each snapshot: summary, and the names of its stack, capabilities, areas, services, and what to read first."""
    names = lambda df, column, order, name: df.groupBy("snapshot").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col(column).alias("x")))), lambda r: r["x"]), ",").alias(name))
    out = files.groupBy("snapshot").agg(F.count("*").alias("files"))
    summary = best_per_key(readme_summary(files), ["snapshot"], [F.col("file_id")], ["summary"])
    parts = [summary, names(tech_stack(files, technologies), "name", F.col("name"), "stack"), names(capabilities(files), "name", F.col("rank"), "capabilities"), names(system_areas(files), "area", F.col("area"), "areas"), names(external_services(files, imports, packages), "name", F.col("name"), "services"), names(read_first(files), "path", F.col("rank"), "read_first")]
    for part in parts:
        out = out.join(part, "snapshot", "left")
    return out
