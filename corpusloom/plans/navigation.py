"""Project maps, routes, import bindings and evaluation over documents as code repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import briefs as bf
from ..operators import edges as eg
from ..operators import evaluation as ev
from ..operators import jobs as jb
from ..operators import learning as lr
from ..operators import mapping as mp
from ..operators import relational as op
from ..operators import resolution as rs
from ..operators import story as st
from ..operators.commits import Versions
from ..session import shared_dir, written
from ..sources.tables import EDGES_SQL, FILES_SQL, IMPORTS_SQL, TREE_SQL, Tables
from .registry import Registry

query = Registry()

# Technologies and services by the packages that show them, as far as the tree has them.
TECHNOLOGIES = {"next": ("Next.js", "framework"), "react": ("React", "user_interface"), "zod": ("Zod", "validation"), "stripe": ("Stripe SDK", "external_sdk")}
SERVICES = {"stripe": ("Stripe", "payments"), "pg": ("PostgreSQL", "database"), "@supabase/supabase-js": ("Supabase", "data and sign-in")}

FLAG_SQL = """named AS (SELECT *, '/' || lower(path) AS p, regexp_extract('/' || lower(path), '[^/]*$') AS nm FROM tree),
api AS (SELECT *, contains(p, '/api/') OR contains(p, '/routes/') OR contains(p, '/controllers/') OR nm IN ('server.ts', 'server.js', 'server.mjs') OR (starts_with(nm, 'route.') AND contains(p, '/app/')) AS is_api FROM named),
paged AS (SELECT *, nm IN ('page.ts', 'page.tsx', 'page.js', 'page.jsx') OR (contains(p, '/pages/') AND NOT is_api) AS is_page FROM api),
flags AS (SELECT *, NOT is_api AND (is_page OR starts_with(nm, 'layout.') OR contains(p, '/components/') OR contains(p, '/views/') OR contains(p, '/ui/')) AS is_interface,
  contains(p, '/prisma/') OR contains(p, '/data/') OR contains(p, '/migrations/') OR contains(p, '/models/') OR contains(p, '/database/') AS is_data,
  NOT is_api AND (contains(p, '/lib/') OR contains(p, '/services/') OR contains(p, '/features/') OR contains(p, '/core/') OR contains(p, '/hooks/') OR contains(p, '/state/')) AS is_core,
  contains(p, '/tests/') OR contains(p, '/test/') OR contains(nm, '.test.') OR contains(nm, '.spec.') AS is_test,
  nm = 'package.json' OR contains(nm, 'config.') OR starts_with(nm, 'tsconfig') OR starts_with(nm, 'eslint') AS is_config FROM paged)"""
AREA_SQL = f"WITH {TREE_SQL}, {FLAG_SQL}, " + "area AS (SELECT snapshot, file_id, path, unnest(list_filter([CASE WHEN is_interface THEN 'interface' END, CASE WHEN is_api THEN 'api' END, CASE WHEN is_data THEN 'data' END, CASE WHEN is_core THEN 'core' END, CASE WHEN is_test THEN 'tests' END, CASE WHEN is_config THEN 'configuration' END], lambda x: x IS NOT NULL)) AS area FROM flags), areas AS (SELECT * FROM (SELECT snapshot, area, path, row_number() OVER (PARTITION BY snapshot, area ORDER BY lower(path), file_id) AS rank FROM area) WHERE rank <= 3)"
DEPENDENCY_SQL = "deps AS (SELECT snapshot, file_id, path, unnest(json_keys(content, '$.dependencies')) AS package FROM tree WHERE path LIKE '%package.json')"
CLAIM_SQL = """place AS (SELECT snapshot, name, path, min(place) AS place, arg_min(detail, place) AS detail, max(CASE confidence WHEN 'verified' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END) AS r FROM claims GROUP BY 1, 2, 3),
nth AS (SELECT *, row_number() OVER (PARTITION BY snapshot, name ORDER BY place, path) AS n FROM place),
merged AS (SELECT snapshot, name, arg_min(detail, n) AS detail, CASE max(r) WHEN 3 THEN 'verified' WHEN 2 THEN 'inferred' ELSE 'unknown' END AS confidence, string_agg(path, ',' ORDER BY n) FILTER (WHERE n <= 5) AS paths FROM nth GROUP BY 1, 2)"""
CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`#>]+', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
CUT = lambda x, n: f"CASE WHEN length({x}) > {n} THEN rtrim(({x})[1:{n - 1}], ' ') || '…' ELSE {x} END"
README_SQL = f"""readme AS (SELECT snapshot, file_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, line_count + 1)) AS pos FROM tree WHERE path LIKE '%README.md'),
heads AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*#{{1,6}}\\s') THEN rtrim(lower({CLEAN("line")}), ':') IN ('features') END AS head FROM readme),
inside AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos) AS listed FROM heads),
bullets AS (SELECT snapshot, file_id, pos AS line, {CLEAN("regexp_extract(line, '^\\s*[-*+]\\s+(.+?)\\s*$', 1)")} AS raw FROM inside WHERE listed AND head IS NULL),
features AS (SELECT snapshot, file_id, line, {CUT("raw", 240)} AS feature FROM bullets WHERE raw <> '')"""


@query(f"WITH {TREE_SQL}, {FLAG_SQL} SELECT file_id, path, is_page AS page, is_interface AS interface, is_api AS api, is_data AS data, is_core AS core, is_test AS tests, is_config AS configuration FROM flags")
def prj5_area_flags(t: Tables) -> DataFrame:
    flags = mp.areas(F.col("path"))
    return t.tree().select("file_id", "path", *[c.alias(name) for name, c in flags.items()])


@query(AREA_SQL + " SELECT snapshot, area, path, rank FROM areas")
def cp3_system_areas(t: Tables) -> DataFrame:
    return mp.system_areas(t.tree())


STACK_SQL = f"""{DEPENDENCY_SQL}, spoken AS (SELECT snapshot, CASE WHEN language IN ('typescript', 'tsx') THEN 'TypeScript' ELSE 'JavaScript' END AS name, arg_min(path, struct_pack(a := lower(path), b := path)) AS path FROM flags WHERE language IN ('typescript', 'tsx', 'javascript', 'jsx') AND NOT is_config GROUP BY 1, 2),
tech(package, name, detail) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in TECHNOLOGIES.items())}),
claims AS (SELECT snapshot, name, 'language' AS detail, path, 'verified' AS confidence, 0 AS place FROM spoken UNION ALL SELECT snapshot, name, detail, path, 'verified', 1 FROM deps JOIN tech USING (package)), {CLAIM_SQL}"""


@query(f"WITH {TREE_SQL}, {FLAG_SQL}, {STACK_SQL} SELECT snapshot, name, detail, confidence, paths FROM merged")
def cp5_tech_stack(t: Tables) -> DataFrame:
    return mp.tech_stack(t.tree(), TECHNOLOGIES)


SERVICE_SQL = f"""{DEPENDENCY_SQL}, {IMPORTS_SQL}, svc(package, name, detail) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in SERVICES.items())}),
hosts AS (SELECT snapshot, path, lower(unnest(regexp_extract_all(line, 'https?://([A-Za-z0-9.-]+)', 1))) AS name FROM (SELECT snapshot, path, unnest(string_split(content, chr(10))) AS line FROM tree WHERE language IN ('typescript', 'tsx', 'javascript', 'jsx')) WHERE contains(line, 'fetch')),
claims AS (SELECT snapshot, name, detail, path, 'inferred' AS confidence, 0 AS place FROM deps JOIN svc USING (package)
  UNION ALL SELECT snapshot, name, detail, path, 'verified', 1 FROM (SELECT snapshot, path, CASE WHEN starts_with(specifier, '@') THEN split_part(specifier, '/', 1) || '/' || split_part(specifier, '/', 2) ELSE split_part(specifier, '/', 1) END AS package FROM imports) JOIN svc USING (package)
  UNION ALL SELECT snapshot, name, 'remote host', path, 'verified', 2 FROM hosts WHERE name NOT IN ('localhost', '127.0.0.1', 'example.com')), {CLAIM_SQL}"""


def packages(t: Tables) -> DataFrame:
    return t.imports().select("snapshot", "path", fx.package_name(F.col("specifier")).alias("package"))


@query(f"WITH {TREE_SQL}, {SERVICE_SQL} SELECT snapshot, name, detail, confidence, paths FROM merged")
def cp4_external_services(t: Tables) -> DataFrame:
    return mp.external_services(t.tree(), packages(t), SERVICES)


@query(f"WITH {TREE_SQL}, {README_SQL} SELECT snapshot, file_id, line, feature FROM features")
def fn20_readme_features(t: Tables) -> DataFrame:
    return mp.readme_features(t.tree())


SUMMARY_SQL = f"""body AS (SELECT doc_id AS file_id, 'repo' || (doc_id // 12) % 20 AS snapshot, trim(coalesce(string_split(text, chr(10))[1], ''), ' ') AS a, trim(coalesce(string_split(text, chr(10))[2], ''), ' ') AS b FROM documents WHERE text IS NOT NULL AND doc_id % 12 = 7),
ok AS (SELECT *, a <> '' AND NOT regexp_matches(a, '^(#|- |\\* |\\+ |\\||```|<!--|<img|<picture|!\\[|\\[!\\[)') AS a_ok, b <> '' AND NOT regexp_matches(b, '^(#|- |\\* |\\+ |\\||```|<!--|<img|<picture|!\\[|\\[!\\[)') AS b_ok FROM body),
joined AS (SELECT snapshot, file_id, CASE WHEN a_ok AND b_ok THEN concat_ws(' ', nullif({CLEAN("a")}, ''), nullif({CLEAN("b")}, '')) WHEN a_ok THEN {CLEAN("a")} WHEN b_ok THEN {CLEAN("b")} ELSE 'no bullet' END AS s FROM ok),
summaries AS (SELECT snapshot, file_id, {CUT("s", 240)} AS summary FROM joined)"""


@query(f"WITH {SUMMARY_SQL} SELECT snapshot, file_id, summary FROM summaries")
def fn20_readme_summary(t: Tables) -> DataFrame:
    return mp.readme_summary(t.tree())


CAPABILITY_SQL = f"""{README_SQL}, cap AS (SELECT snapshot, {CUT("feature", 80)} AS name, 'readme' AS kind, 0 AS place, lpad(line::VARCHAR, 9, '0') AS spot, file_id FROM features
  UNION ALL SELECT snapshot, coalesce(list_filter(string_split(path, '/')[1:-2], lambda x: x NOT IN ('src', 'app', 'pages'))[-1], 'home') || ' page', 'page', 1, lower(path), file_id FROM flags WHERE is_page
  UNION ALL SELECT snapshot, coalesce(list_filter(string_split(path, '/')[1:-2], lambda x: x NOT IN ('src', 'app', 'api', 'routes'))[-1], 'home') || ' request', 'api', 2, lower(path), file_id FROM flags WHERE is_api),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, name ORDER BY place, spot, file_id) AS n FROM cap) WHERE n = 1),
caps AS (SELECT * FROM (SELECT snapshot, name, kind, row_number() OVER (PARTITION BY snapshot ORDER BY place, spot, file_id) AS rank FROM once) WHERE rank <= 5)"""


@query(f"WITH {TREE_SQL}, {FLAG_SQL}, {CAPABILITY_SQL} SELECT snapshot, name, kind, rank FROM caps")
def cp2_capabilities(t: Tables) -> DataFrame:
    return mp.capabilities(t.tree())


READ_SQL = """kinds AS (SELECT snapshot, file_id, path, 0 AS place, 'readme' AS reason FROM flags WHERE nm = 'readme.md' UNION ALL SELECT snapshot, file_id, path, 1, 'manifest' FROM flags WHERE nm = 'package.json' UNION ALL SELECT snapshot, file_id, path, 2, 'page' FROM flags WHERE is_page UNION ALL SELECT snapshot, file_id, path, 3, 'api' FROM flags WHERE is_api UNION ALL SELECT snapshot, file_id, path, 4, 'data' FROM flags WHERE is_data),
shallow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, place ORDER BY len(string_split(path, '/')), lower(path), file_id) AS n FROM kinds) WHERE n = 1),
single AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY snapshot, file_id ORDER BY place) AS n FROM shallow) WHERE n = 1),
reads AS (SELECT snapshot, path, reason, row_number() OVER (PARTITION BY snapshot ORDER BY place) AS rank FROM single)"""


@query(f"WITH {TREE_SQL}, {FLAG_SQL}, {READ_SQL} SELECT snapshot, path, reason, rank FROM reads WHERE rank <= 5")
def cp6_read_first(t: Tables) -> DataFrame:
    return mp.read_first(t.tree())


@query(f"WITH {TREE_SQL}, l AS (SELECT snapshot, path, row_number() OVER (PARTITION BY snapshot ORDER BY path) AS rank FROM tree WHERE path LIKE '%/server.ts'), c AS (SELECT snapshot, path, row_number() OVER (PARTITION BY snapshot ORDER BY path) AS rank FROM tree WHERE language IN ('typescript', 'tsx', 'javascript', 'jsx') AND snapshot NOT IN (SELECT snapshot FROM l)) SELECT * FROM l WHERE rank <= 5 UNION ALL SELECT * FROM c WHERE rank <= 3")
def cp7_start_here(t: Tables) -> DataFrame:
    return mp.start_here(t.tree())


@query(f"WITH {TREE_SQL}, {DEPENDENCY_SQL}, s AS (SELECT snapshot, bool_or(language IN ('typescript', 'tsx')) AS typescript, bool_or(language IN ('javascript', 'jsx')) AS javascript FROM tree GROUP BY 1), d AS (SELECT snapshot, bool_or(package = 'next') AS next, bool_or(package = 'react') AS react FROM deps GROUP BY 1) SELECT snapshot, typescript, javascript, coalesce(next, false) AS next, coalesce(react, false) AS react FROM s LEFT JOIN d USING (snapshot)")
def cp11_stack_detection(t: Tables) -> DataFrame:
    return mp.stack_flags(t.tree(), ["next", "react"])


def _renamed(sql: str, **names: str) -> str:
    """SQL parts that two queries share under other names."""
    import re

    for a, b in names.items():
        sql = re.sub(rf"\b{a}\b", b, sql)
    return sql


@query(f"WITH {TREE_SQL}, {FLAG_SQL}, {STACK_SQL}, {_renamed(SERVICE_SQL.replace(DEPENDENCY_SQL + ', ', ''), claims='claims2', place='place', nth='nth2', merged='merged2').replace('place AS (', 'place2 AS (').replace('FROM place)', 'FROM place2)')}, {SUMMARY_SQL}, {CAPABILITY_SQL}, {READ_SQL}, {AREA_SQL.split(FLAG_SQL + ', ')[1]}, " + """f AS (SELECT snapshot, count(*) AS files FROM tree GROUP BY 1), a AS (SELECT snapshot, arg_min(summary, file_id) AS summary FROM summaries GROUP BY 1), b AS (SELECT snapshot, string_agg(name, ',' ORDER BY name) AS stack FROM merged GROUP BY 1), c AS (SELECT snapshot, string_agg(name, ',' ORDER BY rank) AS capabilities FROM caps GROUP BY 1), d AS (SELECT snapshot, string_agg(DISTINCT area, ',' ORDER BY area) AS areas FROM areas GROUP BY 1), e AS (SELECT snapshot, string_agg(name, ',' ORDER BY name) AS services FROM merged2 GROUP BY 1), g AS (SELECT snapshot, string_agg(path, ',' ORDER BY rank) AS read_first FROM reads WHERE rank <= 5 GROUP BY 1)
SELECT * FROM f LEFT JOIN a USING (snapshot) LEFT JOIN b USING (snapshot) LEFT JOIN c USING (snapshot) LEFT JOIN d USING (snapshot) LEFT JOIN e USING (snapshot) LEFT JOIN g USING (snapshot)""")
def cp1_project_map(t: Tables) -> DataFrame:
    return mp.project_map(t.tree(), packages(t), TECHNOLOGIES, SERVICES)


@query(f"WITH {TREE_SQL} SELECT path, CASE WHEN file_id % 12 = 1 THEN '/api/d' || file_id END AS route FROM tree")
def fn16_route_path(t: Tables) -> DataFrame:
    return t.tree().select("path", fx.route_path(F.col("path")).alias("route"))


# -- imports, calls and requests ---------------------------------------------------------------
BIND_SQL = f"{IMPORTS_SQL}, known AS (SELECT DISTINCT snapshot, path FROM tree), bind AS (SELECT i.snapshot, i.path, i.local, k.path AS target_path, i.imported FROM imports i JOIN known k ON k.snapshot = i.snapshot AND k.path IN (i.specifier || '.ts', i.specifier || '.tsx') WHERE NOT type_only)"
SYMBOL_SQL = "symbols AS (SELECT snapshot, path, 'f' || (file_id % 3) AS name, file_id * 10 AS symbol_id FROM tree WHERE file_id % 12 = 3 UNION ALL SELECT snapshot, path, 'own' AS name, file_id * 10 + 1 FROM tree WHERE file_id % 12 IN (2, 8))"


def symbols(t: Tables) -> DataFrame:
    tree = t.tree()
    kind = F.col("file_id") % 12
    return tree.filter(kind == 3).select("snapshot", "path", F.concat(F.lit("f"), (F.col("file_id") % 3).cast("string")).alias("name"), (F.col("file_id") * 10).alias("symbol_id")).unionByName(tree.filter(kind.isin(2, 8)).select("snapshot", "path", F.lit("own").alias("name"), (F.col("file_id") * 10 + 1).alias("symbol_id")))


@query(f"WITH {TREE_SQL}, {BIND_SQL} SELECT snapshot, path, local, target_path, imported FROM bind")
def join18_import_bindings(t: Tables) -> DataFrame:
    return rs.import_bindings(t.imports(), t.tree()).select("snapshot", "path", "local", "target_path", "imported")


CALLS_SQL = "calls AS (SELECT snapshot, path, file_id, CASE file_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'run' ELSE 'run.f' || (file_id % 2) END AS target FROM tree WHERE file_id % 12 IN (2, 8))"


@query(f"""WITH {TREE_SQL}, {BIND_SQL}, {SYMBOL_SQL}, {CALLS_SQL}, c AS (SELECT *, string_split(target, '.')[-1] AS short, split_part(target, '.', 1) AS root FROM calls),
x AS (SELECT c.*, (SELECT symbol_id FROM symbols s WHERE s.snapshot = c.snapshot AND s.path = c.path AND s.name = c.short) AS own, b.target_path, CASE WHEN contains(target, '.') THEN short ELSE b.imported END AS far FROM c LEFT JOIN bind b ON b.snapshot = c.snapshot AND b.path = c.path AND b.local = c.root),
r AS (SELECT x.file_id, x.target, coalesce(own, s.symbol_id) AS symbol_id FROM x LEFT JOIN symbols s ON s.snapshot = x.snapshot AND s.path = x.target_path AND s.name = x.far) SELECT file_id, target, symbol_id, CASE WHEN symbol_id IS NULL THEN 'syntactic_target_only' ELSE 'resolved_symbol' END AS resolution FROM r""")
def gr21_resolved_calls(t: Tables) -> DataFrame:
    tree = t.tree().filter("file_id % 12 in (2, 8)")
    target = F.when(F.col("file_id") % 3 == 0, "own").when(F.col("file_id") % 3 == 1, "run").otherwise(F.concat(F.lit("run.f"), (F.col("file_id") % 2).cast("string")))
    calls = tree.select("snapshot", "path", "file_id", target.alias("target"))
    return eg.resolved_calls(calls, symbols(t), rs.import_bindings(t.imports(), t.tree())).select("file_id", "target", "symbol_id", "resolution")


@query(f"""WITH {TREE_SQL}, routes AS (SELECT snapshot, file_id * 10 + 2 AS symbol_id, path AS route_file, '/api/d' || file_id AS request_path, 'GET' AS method FROM tree WHERE file_id % 12 = 1),
req AS (SELECT file_id, snapshot, CASE WHEN file_id % 5 = 0 THEN '/api/d' || (file_id - file_id % 12 + 1) || '/' ELSE 'https://x.org/api/d1' END AS target, CASE WHEN file_id % 10 = 0 THEN 'POST' ELSE 'GET' END AS method FROM tree WHERE file_id % 12 IN (2, 8))
SELECT r.file_id, t.symbol_id, t.route_file, CASE WHEN t.route_file IS NULL THEN 'literal_only' ELSE 'exact_route' END AS resolution FROM req r LEFT JOIN routes t ON t.snapshot = r.snapshot AND t.request_path = rtrim(r.target, '/') AND t.method = r.method AND NOT contains(r.target, '://')""")
def gr21_resolved_requests(t: Tables) -> DataFrame:
    tree = t.tree()
    routes = tree.select("snapshot", (F.col("file_id") * 10 + 2).alias("symbol_id"), F.col("path").alias("route_file"), fx.route_path(F.col("path")).alias("request_path"), F.lit("GET").alias("method")).filter("request_path is not null")
    local = F.concat(F.lit("/api/d"), (F.col("file_id") - F.col("file_id") % 12 + 1).cast("string"), F.lit("/"))
    asked = tree.filter("file_id % 12 in (2, 8)").select("snapshot", "path", "file_id", F.when(F.col("file_id") % 5 == 0, local).otherwise("https://x.org/api/d1").alias("request_path"), F.when(F.col("file_id") % 10 == 0, "POST").otherwise("GET").alias("method"))
    no_roots = t.spark.createDataFrame([], "snapshot string, root string")
    return eg.resolved_requests(asked, routes.withColumn("package_root", F.lit("*")), no_roots).select("file_id", "symbol_id", "route_file", "resolution")


#: Parsed edges of the tree's code: each file has one of each kind that its place in the tree has.
PARSED_SQL = """parsed AS (SELECT snapshot, path, file_id * 10 + k AS edge_id, relation, path || '::' || scope AS source, target, request_path, method, model FROM (
  SELECT *, unnest([{'k': 0, 'relation': 'IMPORTS', 'scope': 'x', 'target': CASE file_id % 4 WHEN 0 THEN '../lib/d' || (file_id + 1) WHEN 1 THEN './gone' ELSE '../../src/./lib/../lib/d' || (file_id + 1) END, 'request_path': NULL, 'method': NULL, 'model': NULL},
    {'k': 1, 'relation': 'IMPORTS', 'scope': 'x', 'target': CASE WHEN file_id % 2 = 0 THEN 'react' ELSE '@/lib/d' || file_id END, 'request_path': NULL, 'method': NULL, 'model': NULL},
    {'k': 2, 'relation': 'TRIGGERS', 'scope': CASE WHEN file_id % 3 = 0 THEN 'own.inner.deep' ELSE 'other' END, 'target': CASE WHEN file_id % 5 = 0 THEN 'none' ELSE 'own' END, 'request_path': NULL, 'method': NULL, 'model': NULL},
    {'k': 3, 'relation': 'REQUESTS', 'scope': 'x', 'target': 'fetch', 'request_path': '/api/d' || (file_id - file_id % 12 + 1) || '/', 'method': CASE WHEN file_id % 3 = 0 THEN 'post' END, 'model': NULL},
    {'k': 4, 'relation': 'READS', 'scope': 'x', 'target': 'db', 'request_path': NULL, 'method': NULL, 'model': 'M' || (file_id % 7)},
    {'k': 5, 'relation': 'RAISES', 'scope': 'x', 'target': 'Error', 'request_path': NULL, 'method': NULL, 'model': NULL},
    {'k': 6, 'relation': 'CALLS', 'scope': 'x', 'target': CASE WHEN file_id % 2 = 0 THEN 'own' ELSE 'run.f' || (file_id % 3) END, 'request_path': NULL, 'method': NULL, 'model': NULL}], recursive := true) FROM tree WHERE file_id % 12 IN (2, 8)))"""


def parsed_edges(t: Tables) -> DataFrame:
    n, text = F.col("file_id"), lambda x: x.cast("string")
    edge = lambda k, relation, target, scope=F.lit("x"), path=None, method=None, model=None: F.struct(F.lit(k).alias("k"), F.lit(relation).alias("relation"), scope.alias("scope"), target.alias("target"), *[(F.lit(None).cast("string") if c is None else c).alias(name) for name, c in (("request_path", path), ("method", method), ("model", model))])
    near = F.when(n % 4 == 0, F.concat(F.lit("../lib/d"), text(n + 1))).when(n % 4 == 1, "./gone").otherwise(F.concat(F.lit("../../src/./lib/../lib/d"), text(n + 1)))
    edges = [
        edge(0, "IMPORTS", near),
        edge(1, "IMPORTS", F.when(n % 2 == 0, "react").otherwise(F.concat(F.lit("@/lib/d"), text(n)))),
        edge(2, "TRIGGERS", F.when(n % 5 == 0, "none").otherwise("own"), F.when(n % 3 == 0, "own.inner.deep").otherwise("other")),
        edge(3, "REQUESTS", F.lit("fetch"), path=F.concat(F.lit("/api/d"), text(n - n % 12 + 1), F.lit("/")), method=F.when(n % 3 == 0, "post")),
        edge(4, "READS", F.lit("db"), model=F.concat(F.lit("M"), text(n % 7))),
        edge(5, "RAISES", F.lit("Error")),
        edge(6, "CALLS", F.when(n % 2 == 0, "own").otherwise(F.concat(F.lit("run.f"), text(n % 3)))),
    ]
    rows = t.tree().filter("file_id % 12 in (2, 8)").select("snapshot", "path", "file_id", F.explode(F.array(*edges)).alias("e"))
    return rows.select("snapshot", "path", (n * 10 + F.col("e.k")).alias("edge_id"), "e.relation", F.concat_ws("::", "path", "e.scope").alias("source"), "e.target", "e.request_path", "e.method", "e.model")


@query(f"""WITH {TREE_SQL}, {BIND_SQL}, {SYMBOL_SQL}, {PARSED_SQL}, named AS (SELECT snapshot, path, name, path || '::' || name AS qualified, symbol_id FROM symbols UNION ALL SELECT snapshot, path, 'M' || (file_id % 61), path || '::M' || (file_id % 61), file_id * 10 + 5 FROM tree WHERE file_id % 12 = 4),
routes AS (SELECT snapshot, CASE WHEN file_id % 24 = 1 THEN '' ELSE '*' END AS package_root, '/api/d' || file_id AS request_path, 'GET' AS method, file_id * 10 + 2 AS symbol_id, path AS route_file FROM tree WHERE file_id % 12 = 1),
roots AS (SELECT DISTINCT snapshot FROM tree WHERE file_id % 12 = 6 AND contains(content, '"next"')),
imp AS (SELECT p.*, CASE WHEN starts_with(target, '@/') THEN 'web/src/' || target[3:] || '.ts' WHEN starts_with(target, '../') THEN 'src/lib/' || regexp_extract(target, '[^/]*$') || '.ts' WHEN target = './gone' THEN 'none' ELSE target END AS want FROM parsed p WHERE relation = 'IMPORTS'),
one AS (SELECT snapshot, name, min(symbol_id) AS symbol_id FROM named GROUP BY 1, 2 HAVING count(*) = 1),
hit AS (SELECT p.*, a.symbol_id AS own_id, a.route_file AS own_file, b.symbol_id AS any_id, b.route_file AS any_file FROM parsed p LEFT JOIN roots r ON r.snapshot = p.snapshot LEFT JOIN routes a ON a.package_root = '' AND a.snapshot = r.snapshot AND a.request_path = rtrim(p.request_path, '/') AND a.method = upper(coalesce(p.method, 'GET')) LEFT JOIN routes b ON b.package_root = '*' AND b.snapshot = p.snapshot AND b.request_path = rtrim(p.request_path, '/') AND b.method = upper(coalesce(p.method, 'GET')) WHERE relation = 'REQUESTS')
SELECT edge_id, relation, coalesce(k.path, target) AS target_path, NULL::BIGINT AS symbol_id, CASE WHEN k.path IS NULL THEN 'module_specifier' ELSE 'local_file' END AS resolution FROM imp LEFT JOIN known k ON k.snapshot = imp.snapshot AND k.path = imp.want
UNION ALL SELECT edge_id, relation, target, s.symbol_id, CASE WHEN s.symbol_id IS NULL THEN 'unresolved_identifier' ELSE 'local_symbol' END FROM parsed p LEFT JOIN named s ON s.snapshot = p.snapshot AND s.qualified = p.path || '::' || p.target WHERE relation = 'TRIGGERS'
UNION ALL SELECT edge_id, relation, target, NULL, CASE WHEN own_file IS NOT NULL THEN 'exact_package_route' WHEN any_file IS NOT NULL THEN 'exact_route' ELSE 'literal_only' END FROM hit
UNION ALL SELECT edge_id, 'HANDLED_BY', coalesce(own_file, any_file), CASE WHEN own_file IS NOT NULL THEN own_id ELSE any_id END, CASE WHEN own_file IS NOT NULL THEN 'exact_package_route' ELSE 'exact_route' END FROM hit WHERE coalesce(own_file, any_file) IS NOT NULL
UNION ALL SELECT edge_id, relation, target, o.symbol_id, CASE WHEN o.symbol_id IS NOT NULL THEN 'unique_model_symbol' END FROM parsed p LEFT JOIN one o ON o.snapshot = p.snapshot AND o.name = p.model WHERE relation = 'READS'
UNION ALL SELECT edge_id, relation, target, NULL, NULL FROM parsed WHERE relation = 'RAISES'
UNION ALL SELECT edge_id, relation, target, coalesce(s.symbol_id, f.symbol_id), CASE WHEN coalesce(s.symbol_id, f.symbol_id) IS NULL THEN 'syntactic_target_only' ELSE 'resolved_symbol' END FROM parsed p LEFT JOIN named s ON s.snapshot = p.snapshot AND s.path = p.path AND s.name = string_split(p.target, '.')[-1]
  LEFT JOIN bind b ON b.snapshot = p.snapshot AND b.path = p.path AND b.local = split_part(p.target, '.', 1) LEFT JOIN named f ON f.snapshot = b.snapshot AND f.path = b.target_path AND f.name = CASE WHEN contains(p.target, '.') THEN string_split(p.target, '.')[-1] ELSE b.imported END WHERE relation = 'CALLS'""")
def gr21_resolved_edges(t: Tables) -> DataFrame:
    tree, number = t.tree(), F.col("file_id")
    models = tree.filter("file_id % 12 = 4").select("snapshot", "path", F.concat(F.lit("M"), (number % 61).cast("string")).alias("name"), (number * 10 + 5).alias("symbol_id"))
    named = symbols(t).unionByName(models).withColumn("qualified", F.concat_ws("::", "path", "name"))
    routes = tree.filter("file_id % 12 = 1").select("snapshot", F.when(number % 24 == 1, "").otherwise("*").alias("package_root"), fx.route_path(F.col("path")).alias("request_path"), F.lit("GET").alias("method"), (number * 10 + 2).alias("symbol_id"), F.col("path").alias("route_file"))
    roots = tree.filter((number % 12 == 6) & F.contains("content", F.lit('"next"'))).select("snapshot", F.lit("").alias("root")).distinct()
    return eg.resolved_edges(parsed_edges(t), tree.select("snapshot", "path"), named, rs.import_bindings(t.imports(), tree), routes, roots)


# -- artifacts ---------------------------------------------------------------------------------
@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS verified, count(*) FILTER (WHERE l_returnflag = 'N') AS inferred, count(*) FILTER (WHERE l_returnflag = 'R') AS unknown FROM lineitem GROUP BY 1")
def agg15_confidence_histogram(t: Tables) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "inferred").otherwise("unknown")
    payload = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(name.alias("confidence"), F.lit("x").alias("title"))).alias("steps"))).alias("payload"))
    return payload.select("l_orderkey", *[c.alias(n) for n, c in ev.confidence_counts(F.col("payload")).items()])


@query("SELECT l_orderkey, 'sha256:' || sha256(string_agg(k, chr(10) ORDER BY k)) AS fingerprint FROM (SELECT DISTINCT l_orderkey, l_partkey || '|' || l_suppkey || '|' || l_linenumber AS k FROM lineitem) GROUP BY 1")
def agg20_dependency_fingerprint(t: Tables) -> DataFrame:
    return ev.dependency_fingerprint(t.lineitem, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"])


# -- evaluation --------------------------------------------------------------------------------
@query("SELECT item_id AS query_id, text AS query, 'src' || (item_id % 7) AS expected FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT item_id, text, 'src0' FROM benchmark WHERE text IS NOT NULL")
def src10_gold_reader(t: Tables) -> DataFrame:
    import uuid

    at = f"{shared_dir(t.spark)}/gold-{uuid.uuid4().hex}"
    cases = t.benchmark.filter("text is not null").select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.array(F.struct(F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("path")), F.struct(F.lit("src0").alias("path"))).alias("expected_any"))
    cases.write.json(at)
    return ev.read_gold(t.spark, at)


#: Flows of expected steps by supplier, and of found steps by part, that share some; matched greedily, one pair a step.
GOLD_SQL = """gold AS (SELECT DISTINCT l_suppkey AS gold_id, l_returnflag || l_linenumber || 'p' || l_partkey % 5 || 'q' || l_quantity::INTEGER % 9 AS step FROM lineitem WHERE l_discount < 0.06),
actual AS (SELECT l_partkey % 150 AS actual_id, l_returnflag || l_linenumber || 'p' || l_partkey % 5 || 'q' || l_quantity::INTEGER % 9 AS step, bool_or(l_linestatus = 'F') AS verified FROM lineitem WHERE l_discount > 0.03 GROUP BY 1, 2),
sized AS (SELECT gold_id, count(*) AS size FROM gold GROUP BY 1), shared AS MATERIALIZED (SELECT gold_id, actual_id, count(*) AS overlap, count(*) / any_value(size) AS coverage FROM gold JOIN actual USING (step) JOIN sized USING (gold_id) GROUP BY 1, 2),
link(n, gold_id, actual_id, gs, xs) AS (SELECT 0, NULL::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT n + 1, pick.g, pick.x, list_append(gs, pick.g), list_append(xs, pick.x) FROM (SELECT n, gs, xs, arg_min({'g': p.gold_id, 'x': p.actual_id}, {'a': -coverage, 'b': -overlap, 'g': p.gold_id, 'x': p.actual_id}) AS pick FROM link JOIN shared p ON NOT list_contains(gs, p.gold_id) AND NOT list_contains(xs, p.actual_id) GROUP BY n, gs, xs)),
pairs AS (SELECT gold_id, actual_id FROM link WHERE n > 0)"""


def flows(t: Tables) -> tuple[DataFrame, DataFrame]:
    step = F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.lit("p"), (F.col("l_partkey") % 5).cast("string"), F.lit("q"), (F.col("l_quantity").cast("int") % 9).cast("string")).alias("step")
    gold = t.lineitem.filter("l_discount < 0.06").select(F.col("l_suppkey").alias("gold_id"), step).distinct()
    actual = t.lineitem.filter("l_discount > 0.03").groupBy((F.col("l_partkey") % 150).alias("actual_id"), step).agg(F.bool_or(F.col("l_linestatus") == "F").alias("verified"))
    return gold, actual


@query(f"WITH RECURSIVE {GOLD_SQL}, j AS (SELECT g.gold_id, count(*) AS expected, count(a.step) AS hit FROM gold g LEFT JOIN pairs USING (gold_id) LEFT JOIN actual a ON a.actual_id = pairs.actual_id AND a.step = g.step GROUP BY 1), v AS (SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pairs p JOIN gold g ON g.gold_id = p.gold_id WHERE p.actual_id = a.actual_id AND g.step = a.step)) AS ok FROM actual a WHERE verified) SELECT count(*) AS features, round(count(*) FILTER (WHERE hit >= 0.2 * expected) / count(*), 4) AS feature_recall, round(sum(hit) / sum(expected), 4) AS step_recall, (SELECT round(ok / n, 4) FROM v) AS verified_precision FROM j")
def ev2_flow_quality(t: Tables) -> DataFrame:
    gold, actual = flows(t)
    return ev.flow_quality(gold, actual, ev.matched_flows(gold, actual), 0.2)


@query(f"WITH RECURSIVE {GOLD_SQL} SELECT gold_id, actual_id FROM pairs")
def ev2_flow_matching(t: Tables) -> DataFrame:
    return ev.matched_flows(*flows(t))


@query("""WITH role AS (SELECT p_brand AS id, bool_or(p_size > 48) AS verified, count(*) FILTER (WHERE p_name LIKE '%a%') AS filled, count(*) AS fields, bool_or(p_type LIKE '%STEEL%') AS generic FROM part GROUP BY 1), gold AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_size < 10 UNION SELECT 'Brand#none')
SELECT (SELECT round(count(*) FILTER (WHERE id IN (SELECT id FROM role)) / count(*), 4) FROM gold) AS role_recall, round(count(*) FILTER (WHERE verified AND id IN (SELECT id FROM gold)) / greatest(1, count(*) FILTER (WHERE verified)), 4) AS verified_role_precision, round(sum(filled) / sum(fields), 4) AS narrative_coverage, round(count(*) FILTER (WHERE generic) / count(*), 4) AS generic_ratio, count(*) BETWEEN 3 AND 12 AS count_compliant FROM role""")
def ev4_story_quality(t: Tables) -> DataFrame:
    roles = t.part.groupBy(F.col("p_brand").alias("id")).agg(F.bool_or(F.col("p_size") > 48).alias("verified"), F.count_if(F.col("p_name").contains("a")).alias("filled"), F.count("*").alias("fields"), F.bool_or(F.col("p_type").contains("STEEL")).alias("generic"))
    gold = t.part.filter("p_size < 10").select(F.col("p_brand").alias("id")).distinct().union(t.spark.createDataFrame([("Brand#none",)], "id string"))
    return ev.story_quality(roles, gold)


# -- tables ------------------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS version, source FROM documents WHERE source NOT IN ('src1', 'src2') OR source = 'src1' AND doc_id % 4 = 1")
def snk1_replace_partition(t: Tables) -> DataFrame:
    """All sources are written; then one has new rows and another none."""
    import uuid

    rows = t.documents.select("doc_id", "source").filter("source is not null")
    table = Versions(t.spark, f"{shared_dir(t.spark)}/derived-{uuid.uuid4().hex}", "source")
    table.replace(rows.withColumn("version", F.lit("old")), [r.source for r in rows.select("source").distinct().collect()])
    table.replace(rows.filter("source = 'src1' and doc_id % 4 = 1").withColumn("version", F.lit("new")), ["src1", "src2"])
    return table.read().select("doc_id", "version", "source")


@query("WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_id, ts + CASE event_type WHEN 'view' THEN INTERVAL 1 DAY ELSE INTERVAL 30 DAY END AS expires_at, CAST(floor(value) AS INTEGER) % 3 AS hit_count FROM events) SELECT event_id FROM e, m WHERE NOT (expires_at < now AND hit_count = 0)")
def str3_expiry(t: Tables) -> DataFrame:
    life = F.when(F.col("event_type") == "view", F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 30 DAY"))
    hits = F.floor("value").cast("int") % 3
    rows = t.events.select("event_id", (F.col("ts") + life).alias("expires_at"), hits.alias("hit_count"))
    return op.unexpired(rows.join(F.broadcast(t.events.agg(F.max("ts").alias("now")))), F.col("now")).select("event_id")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def win10_first_seen(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("k", F.lower("text"))
    return op.best_per_key(rows, ["conv_id", "k"], [F.col("turn")], ["turn", "text"]).select("conv_id", "turn", "text")


@query(f"WITH {FILES_SQL}, r AS (SELECT path, CASE WHEN regexp_matches(path, '(^|/)keep[^/]*(/|$)') OR regexp_matches(path, '/[0-9]*7\\.[^/]*(/|$)') THEN 0 WHEN regexp_matches(path, '^src1[^/]*/[^/]*\\.en(/|$)') OR regexp_matches(path, '(^|/)[^/]*\\.es(/|$)') OR regexp_matches(path, '^src2/') THEN 1 ELSE 0 END AS out FROM files) SELECT path FROM r WHERE out = 0")
def src2_ignore_rules(t: Tables) -> DataFrame:
    return t.files().filter(~fx.ignored(F.col("path"), ["# generated", "", "*.es", "/src1*/*.en", "/src2/**", "!keep*", "!*7.??"])).select("path")


# -- text --------------------------------------------------------------------------------------
@query(f"WITH {TREE_SQL}, c AS (SELECT file_id, language, content || CASE file_id % 6 WHEN 0 THEN ' async x' WHEN 1 THEN ' new Promise' WHEN 2 THEN ' class A' WHEN 3 THEN ' try {{ if (x) return 1' WHEN 4 THEN ' <Button a: string' ELSE ' onClick=f fetch (x) setX(1)' END AS s FROM tree) SELECT file_id, concat_ws(',', CASE WHEN regexp_matches(s, '\\b(async|await)\\b') THEN 'async_await' END, CASE WHEN regexp_matches(s, '\\bPromise\\b') THEN 'promise' END, CASE WHEN regexp_matches(s, '\\bclass\\s+[A-Za-z0-9_]+') THEN 'class' END, CASE WHEN regexp_matches(s, '\\b[A-Za-z0-9_]+\\s*<[^>]+>') THEN 'generic_type' END, CASE WHEN regexp_matches(s, '\\b(try|catch|throw)\\b') THEN 'exception_handling' END, CASE WHEN language IN ('tsx', 'jsx') AND regexp_matches(s, '<[A-Z][A-Za-z0-9]*') THEN 'react_component' END) AS concepts, coalesce(nullif(concat_ws(',', CASE WHEN regexp_matches(s, '\\basync\\b|\\bawait\\b') THEN 'async' END, CASE WHEN regexp_matches(s, '\\bfetch\\s*\\(') THEN 'http' END, CASE WHEN regexp_matches(s, '\\bset[A-Z][A-Za-z0-9_]*\\s*\\(') THEN 'state' END, CASE WHEN regexp_matches(s, '\\bon(?:Click|Submit|Change)=') THEN 'events' END, CASE WHEN regexp_matches(s, '\\btry\\s*\\{{') THEN 'errors' END, CASE WHEN regexp_matches(s, '\\bif\\s*\\(') THEN 'conditional' END, CASE WHEN regexp_matches(s, '\\breturn\\b') THEN 'return' END, CASE WHEN language IN ('typescript', 'tsx') AND regexp_matches(s, '[A-Za-z0-9_]\\s*:\\s*[A-Za-z]') THEN 'types' END), ''), 'sequence') AS required FROM c")
def fn5_concept_tags(t: Tables) -> DataFrame:
    tail = F.create_map(*[F.lit(x) for i, s in enumerate((" async x", " new Promise", " class A", " try { if (x) return 1", " <Button a: string", " onClick=f fetch (x) setX(1)")) for x in (i, s)])
    rows = t.tree().select("file_id", "language", F.concat("content", tail[(F.col("file_id") % 6).cast("int")]).alias("s"))
    return rows.select("file_id", F.array_join(fx.concept_candidates(F.col("s"), F.col("language")), ",").alias("concepts"), F.array_join(fx.required_concepts(F.col("s"), F.col("language")), ",").alias("required"))


@query("SELECT o_orderkey, round(least(greatest(o_totalprice / 300000 - 0.2, 0), 1), 3) AS share FROM orders")
def fn13_clamped(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", fx.clamp01(F.col("o_totalprice") / 300000 - 0.2).alias("share"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') || ',' || 'z://' || page_id AS urls FROM pages")
def fn24_nested_urls(t: Tables) -> DataFrame:
    nested = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("url"), F.struct(F.concat(F.lit("z://"), F.col("page_id").cast("string"), F.lit("/#x")).alias("url")).alias("inner"))).alias("items")))
    return t.pages.select("page_id", F.array_join(fx.urls(nested), ",").alias("urls"))


@query("SELECT user_id, event_type, 'sha256:' || sha256('goal=' || event_type || '&pace=' || CASE WHEN user_id % 2 = 0 THEN 'fast' ELSE 'careful' END || '&version=' || 1) AS fingerprint FROM (SELECT DISTINCT user_id, event_type FROM events)")
def fn25_profile_fingerprint(t: Tables) -> DataFrame:
    pace = F.when(F.col("user_id") % 2 == 0, "fast").otherwise("careful")
    return t.events.select("user_id", "event_type").distinct().select("user_id", "event_type", F.concat(F.lit("sha256:"), fx.fingerprint({"version": F.lit(1), "goal": F.col("event_type"), "pace": pace})).alias("fingerprint"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, 0::BIGINT AS embedding_tokens, CASE WHEN event_id % 2 = 0 THEN 7 ELSE 0 END::BIGINT AS cached_input_tokens, event_id % 50 AS output_tokens, 0::BIGINT AS reasoning_tokens FROM events")
def fn26_usage(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    name = F.when(F.col("event_id") % 2 == 0, '{"usage": {"input_tokens": ').otherwise('{"usage": {"prompt_tokens": ')
    cached = F.when(F.col("event_id") % 2 == 0, ', "input_tokens_details": {"cached_tokens": 7}').otherwise("")
    response = F.concat(name, k, cached, F.lit(', "completion_tokens": '), (F.col("event_id") % 50).cast("string"), F.lit("}}"))
    return t.events.select("event_id", *[c.alias(n) for n, c in fx.usage_of(response).items()])


@query(f"WITH {TREE_SQL}, d AS (SELECT DISTINCT snapshot, array_to_string(string_split(path, '/')[1:n], '/') AS directory FROM tree, (SELECT unnest([1, 2]) AS n) WHERE len(string_split(path, '/')) > n), f AS (SELECT snapshot, arg_min(path, k) AS first_file FROM (SELECT snapshot, path, list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i < len(s) THEN '0' ELSE '1' END || lower(s[i])) AS k FROM (SELECT snapshot, path, string_split(path, '/') AS s FROM tree)) GROUP BY 1) SELECT snapshot, first_file, string_agg(directory, ',' ORDER BY directory) AS directories FROM d JOIN f USING (snapshot) GROUP BY 1, 2")
def fn29_tree_helpers(t: Tables) -> DataFrame:
    return rs.tree_summary(t.tree())


@query(f"WITH {TREE_SQL}, c AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 4 ELSE 3 END AS base, CASE file_id % 4 WHEN 0 THEN 'careful' WHEN 1 THEN 'fast' ELSE 'normal' END AS pace FROM tree) SELECT file_id, CASE pace WHEN 'careful' THEN base + 2 WHEN 'fast' THEN greatest(2, base - 1) ELSE base END AS minutes FROM c")
def fn30_lesson_minutes(t: Tables) -> DataFrame:
    kind = F.when(F.col("file_id") % 3 == 0, "symbol").otherwise("file")
    pace = F.when(F.col("file_id") % 4 == 0, "careful").when(F.col("file_id") % 4 == 1, "fast").otherwise("normal")
    return t.tree().select("file_id", rs.lesson_minutes(kind, pace).alias("minutes"))


CANDIDATE_SQL = """cand AS (SELECT snapshot, file_id, path, language, CASE file_id % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'file' ELSE 'block' END AS chunk_type, CASE file_id % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'route' WHEN 3 THEN 'method' ELSE 'other' END AS kind, CASE file_id % 4 WHEN 0 THEN 'export default f' WHEN 1 THEN 'export f' ELSE 'f' END AS signature, file_id % 2 = 0 AS top, file_id % 6 AS degree, file_id % 9 + 1 AS start, file_id % 7 = 0 AS raises, path LIKE 'tests/%' AS is_test FROM tree),
scored AS (SELECT *, CASE WHEN chunk_type <> 'symbol' THEN -100 ELSE CASE kind WHEN 'function' THEN 8 WHEN 'class' THEN 7 WHEN 'component' THEN 7 WHEN 'route' THEN 7 WHEN 'method' THEN 5 ELSE 3 END + CASE WHEN contains(signature, 'export default') THEN 6 ELSE 0 END + CASE WHEN contains(signature, 'export') THEN 3 ELSE 0 END + CASE WHEN top THEN 2 ELSE 0 END END AS score, CASE WHEN chunk_type = 'symbol' THEN degree ELSE 0 END AS deg FROM cand)"""


def candidates(t: Tables) -> DataFrame:
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.least(F.col("file_id") % n, F.lit(len(names) - 1)) + 1).cast("int"))
    return t.tree().select(
        "snapshot", "file_id", "path", "language", pick(3, "symbol", "file", "block").alias("chunk_type"), pick(5, "function", "class", "route", "method", "other").alias("kind"), pick(4, "export default f", "export f", "f").alias("signature"),
        (F.col("file_id") % 2 == 0).alias("top"), (F.col("file_id") % 6).alias("degree"), (F.col("file_id") % 9 + 1).alias("start"), (F.col("file_id") % 7 == 0).alias("raises"), F.col("path").startswith("tests/").alias("is_test"),
    )


@query(f"WITH {TREE_SQL}, {CANDIDATE_SQL} SELECT file_id, score, deg AS degree, CASE kind WHEN 'route' THEN 9 WHEN 'component' THEN 8 WHEN 'class' THEN 8 WHEN 'function' THEN 7 WHEN 'method' THEN 6 ELSE 3 END + CASE WHEN contains(signature, 'export default') THEN 4 WHEN contains(signature, 'export') THEN 2 ELSE 0 END AS lesson_score FROM scored")
def fn31_symbol_scores(t: Tables) -> DataFrame:
    score, degree = rs.symbol_score()
    return candidates(t).select("file_id", score.alias("score"), degree.alias("degree"), rs.lesson_score().alias("lesson_score"))


@query(f"""WITH {TREE_SQL}, {CANDIDATE_SQL}, entry AS (SELECT snapshot, arg_min(path, struct_pack(a := CASE WHEN language IN ('typescript', 'tsx', 'javascript', 'jsx') AND NOT is_test THEN len(string_split(path, '/')) ELSE 1000000 END, b := path)) AS entry_path FROM cand GROUP BY 1),
s0 AS (SELECT *, path = entry_path AS at_entry, split_part(path, '/', 1) = split_part(entry_path, '/', 1) AS near FROM scored JOIN entry USING (snapshot)),
p1 AS (SELECT snapshot, arg_min(file_id, struct_pack(a := start, b := file_id)) AS file_id FROM s0 WHERE near AND chunk_type = 'file' GROUP BY 1),
s1 AS (SELECT * FROM s0 WHERE file_id NOT IN (SELECT file_id FROM p1)),
p2 AS (SELECT snapshot, arg_min(file_id, struct_pack(a := -score, b := -deg, c := start, d := file_id)) AS file_id FROM s1 WHERE near AND chunk_type = 'symbol' GROUP BY 1),
s2 AS (SELECT * FROM s1 WHERE file_id NOT IN (SELECT file_id FROM p2)),
p3 AS (SELECT snapshot, arg_min(file_id, struct_pack(a := -score, b := -deg, c := start, d := file_id)) AS file_id FROM s2 WHERE near AND chunk_type = 'symbol' GROUP BY 1),
s3 AS (SELECT * FROM s2 WHERE file_id NOT IN (SELECT file_id FROM p3)),
p4 AS (SELECT snapshot, arg_min(file_id, struct_pack(a := CASE WHEN at_entry THEN 0 ELSE 1 END, b := CASE WHEN chunk_type = 'symbol' THEN 0 ELSE 1 END, c := start, d := file_id)) AS file_id FROM s3 WHERE raises GROUP BY 1),
s4 AS (SELECT * FROM s3 WHERE file_id NOT IN (SELECT file_id FROM p4)),
p5 AS (SELECT snapshot, arg_min(file_id, struct_pack(a := CASE WHEN chunk_type = 'symbol' THEN 0 ELSE 1 END, b := path, c := start, d := file_id)) AS file_id FROM s4 WHERE is_test AND chunk_type IN ('symbol', 'file') GROUP BY 1),
s5 AS (SELECT * FROM s4 WHERE file_id NOT IN (SELECT file_id FROM p5)),
picked AS (SELECT snapshot, file_id, 1 AS slot FROM p1 UNION ALL SELECT snapshot, file_id, 2 FROM p2 UNION ALL SELECT snapshot, file_id, 3 FROM p3 UNION ALL SELECT snapshot, file_id, 4 FROM p4 UNION ALL SELECT snapshot, file_id, 5 FROM p5),
n AS (SELECT snapshot, count(p.file_id) AS have FROM entry LEFT JOIN picked p USING (snapshot) GROUP BY 1),
fb AS (SELECT snapshot, file_id, have, row_number() OVER (PARTITION BY snapshot ORDER BY CASE WHEN chunk_type = 'symbol' THEN 0 ELSE 1 END, CASE WHEN at_entry THEN 0 ELSE 1 END, -score, -deg, path, start, file_id) AS k FROM s5 JOIN n USING (snapshot))
SELECT snapshot, file_id, slot FROM picked UNION ALL SELECT snapshot, file_id, 6 FROM fb WHERE have + k <= 3""")
def st7_guided_path(t: Tables) -> DataFrame:
    return rs.guided_path(candidates(t))


@query("WITH c AS (SELECT l_suppkey AS branch, l_partkey AS k, l_orderkey AS spot, l_linenumber AS n, l_returnflag = 'R' AS done FROM lineitem) SELECT branch, count(*) FILTER (WHERE NOT done) AS open, arg_max(spot, struct_pack(a := spot, b := n)) FILTER (WHERE NOT done) AS returns_to FROM c GROUP BY 1")
def st13_return_stack(t: Tables) -> DataFrame:
    steps = t.lineitem.select(F.col("l_suppkey").alias("session"), F.struct("l_orderkey", "l_linenumber").alias("order"), F.col("l_orderkey").alias("return_to"), (F.col("l_returnflag") == "R").alias("completed"))
    return rs.return_stack(steps).select(F.col("session").alias("branch"), "open", "returns_to")


@query("WITH q(id, needs) AS (VALUES ('common-1', NULL), ('common-2', NULL), ('react', 'BUILDING'), ('next', 'MACHINERY')), s AS (SELECT c_custkey, c_mktsegment AS stack FROM customer), have AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'common-1' ELSE 'other' END AS id FROM customer) SELECT c_custkey, id FROM have UNION SELECT c_custkey, id FROM s JOIN q ON needs IS NULL OR needs = stack")
def st10_question_bank(t: Tables) -> DataFrame:
    bank = t.spark.createDataFrame([("common-1", None), ("common-2", None), ("react", "BUILDING"), ("next", "MACHINERY")], "id string, needs string")
    have = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "common-1").otherwise("other").alias("id"))
    return rs.merged_questions(have, t.customer.select("c_custkey", F.col("c_mktsegment").alias("stack")), bank, "c_custkey")


@query("WITH seed(id, title) AS (VALUES ('a', 'A'), ('b', 'B'), ('c', 'C')), have AS (SELECT n_name AS id, n_name AS title FROM nation UNION ALL SELECT 'a', 'old') SELECT id, title FROM have WHERE id NOT IN (SELECT id FROM seed) UNION ALL SELECT id, title FROM seed")
def cp12_seed_upsert(t: Tables) -> DataFrame:
    have = t.nation.select(F.col("n_name").alias("id"), F.col("n_name").alias("title")).union(t.spark.createDataFrame([("a", "old")], "id string, title string"))
    seed = t.spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, title string")
    once = op.upsert(have, seed, ["id"], F.lit(1))
    return op.upsert(once, seed, ["id"], F.lit(1))  # a second time changes nothing


@query("WITH want AS (SELECT DISTINCT l_partkey AS chunk, l_linestatus AS depth FROM lineitem), have AS (SELECT l_partkey AS chunk, l_linestatus AS depth, min(l_orderkey) AS artifact FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT chunk, depth, coalesce('art_' || artifact, 'new_' || chunk || '_' || depth) AS artifact, h.artifact IS NULL AS created FROM want LEFT JOIN have h USING (chunk, depth)")
def cp15_get_or_create(t: Tables) -> DataFrame:
    key = [F.col("l_partkey").alias("chunk"), F.col("l_linestatus").alias("depth")]
    have = t.lineitem.filter("l_returnflag = 'R'").groupBy(*key).agg(F.concat(F.lit("art_"), F.min("l_orderkey").cast("string")).alias("artifact"))
    made = F.concat_ws("_", F.lit("new"), F.col("chunk").cast("string"), F.col("depth"))
    return op.get_or_create(t.lineitem.select(*key).distinct(), have, ["chunk", "depth"], "artifact", made)


@query(f"WITH {TREE_SQL}, t AS (SELECT file_id, unnest(list_concat(['function', language], CASE WHEN file_id % 3 = 0 THEN ['loop', 'function'] ELSE ['state_x'] END)) AS concept, unnest(range(4)) AS at_ FROM tree), d AS (SELECT file_id, concept, row_number() OVER (PARTITION BY file_id ORDER BY min(at_)) AS place FROM t WHERE concept IS NOT NULL GROUP BY 1, 2), c AS (SELECT DISTINCT lang AS concept, 'Language ' || lang AS title FROM documents), x AS (SELECT 'function' AS concept, min(p_name) AS code FROM part) SELECT file_id, place, d.concept, coalesce(title, replace(d.concept, '_', ' ')) AS title, 'Where is ' || coalesce(title, replace(d.concept, '_', ' ')) || ' used here, and why?' AS question, coalesce(code, '// Follow a small input through this code.') AS code FROM d LEFT JOIN c ON c.concept = d.concept LEFT JOIN x ON x.concept = d.concept")
def cp17_concept_bridge(t: Tables) -> DataFrame:
    """Concepts of the tree's files; titles and examples come from tables."""
    tail = F.when(F.col("file_id") % 3 == 0, F.array(F.lit("loop"), F.lit("function"))).otherwise(F.array(F.lit("state_x")))
    wanted = t.tree().select("file_id", F.array_compact(F.concat(F.array(F.lit("function"), F.col("language")), tail)).alias("concepts"))
    copy = t.documents.filter("lang is not null").select(F.col("lang").alias("concept"), F.concat(F.lit("Language "), "lang").alias("title"), F.lit(None).cast("string").alias("definition")).distinct()
    examples = t.part.agg(F.min("p_name").alias("code")).select(F.lit("function").alias("concept"), "code")
    return lr.concept_bridge(wanted, copy, examples, "file_id", "concepts").drop("definition")


#: Files as nodes of a story, and imports and requests between them.
NODE_SQL = f"""{FLAG_SQL}, layered AS (SELECT snapshot, path, file_id, regexp_extract(path, '[^/]*$') AS label, CASE WHEN file_id % 12 = 8 THEN 'worker' ELSE 'file' END AS node_type, CASE WHEN is_interface THEN 'client' WHEN is_api THEN 'server' WHEN is_data THEN 'data' WHEN is_core THEN 'domain' WHEN is_config THEN 'configuration' ELSE 'shared' END AS layer, file_id % 24 = 3 AS in_flow, CASE WHEN file_id % 5 = 0 THEN 'verified' ELSE 'inferred' END AS confidence FROM flags),
kept AS (SELECT * FROM layered WHERE snapshot <> 'repo0' OR layer NOT IN ('client', 'server')),
roled AS (SELECT k.*, library, CASE WHEN library THEN CASE WHEN in_flow OR regexp_replace(lower(label), '(.)\\.[^.]*$', '\\1') IN ('index', 'main', 'lib', '__init__') THEN 'public_api' WHEN layer = 'configuration' THEN 'runtime' WHEN layer IN ('domain', 'server') THEN 'core' ELSE 'shared' END
  WHEN layer = 'client' THEN 'experience' WHEN node_type = 'worker' THEN 'analysis' WHEN layer = 'data' OR contains(lower(path), '/models') THEN 'persistence' WHEN layer = 'configuration' THEN 'runtime' WHEN layer = 'shared' THEN 'shared' ELSE 'application' END AS role
  FROM kept k JOIN (SELECT snapshot, NOT bool_or(layer IN ('client', 'server')) AS library FROM kept GROUP BY 1) USING (snapshot)),
told AS (SELECT snapshot, role, count(*) AS nodes, CASE WHEN bool_or(confidence = 'verified') THEN 'verified' ELSE 'inferred' END AS confidence, array_to_string(list_sort(list(path))[1:6], ',') AS evidence, row_number() OVER (PARTITION BY snapshot ORDER BY list_position({list(st.ROLES)}, role)) AS place FROM roled GROUP BY snapshot, role)"""


def story_nodes(t: Tables) -> DataFrame:
    a, n = mp.areas(F.col("path")), F.col("file_id")
    layer = fx.first_match([(a["interface"], "client"), (a["api"], "server"), (a["data"], "data"), (a["core"], "domain"), (a["configuration"], "configuration")], "shared")
    tree = written(t.tree().select("snapshot", "path", "file_id"), "tree")
    nodes = tree.select("snapshot", "path", F.regexp_extract("path", "[^/]*$", 0).alias("label"), F.when(n % 12 == 8, "worker").otherwise("file").alias("node_type"), layer.alias("layer"), (n % 24 == 3).alias("in_flow"), F.when(n % 5 == 0, "verified").otherwise("inferred").alias("confidence"))
    # One snapshot is a library: it has nothing that is seen or served.
    return st.with_roles(nodes.filter("snapshot <> 'repo0' or layer not in ('client', 'server')"))


@query(f"WITH {TREE_SQL}, {NODE_SQL} SELECT snapshot, place, role, nodes, confidence, evidence FROM told")
def gr20_story_roles(t: Tables) -> DataFrame:
    return st.roles(story_nodes(t)).withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {TREE_SQL}, {NODE_SQL}, {BIND_SQL}, e AS (SELECT snapshot, path AS source, target_path AS target, 'IMPORTS' AS relation, CASE WHEN imported = 'f1' THEN 'verified' ELSE 'inferred' END AS confidence FROM bind UNION ALL SELECT a.snapshot, a.path, b.path, CASE WHEN a.file_id % 24 = 2 THEN 'REQUESTS' ELSE 'READS' END, 'inferred' FROM tree a JOIN tree b ON b.snapshot = a.snapshot AND b.file_id = a.file_id - a.file_id % 12 + 1 WHERE a.file_id % 12 IN (2, 8)),\n" + "x AS (SELECT e.*, s.role AS source_role, g.role AS target_role FROM e JOIN roled s ON s.snapshot = e.snapshot AND s.path = e.source JOIN roled g ON g.snapshot = e.snapshot AND g.path = e.target WHERE s.role <> g.role) SELECT snapshot, source_role, target_role, array_to_string(list_transform(list_sort(list_distinct(list({'p': coalesce(list_position(" + str(list(st.RELATIONS)) + ", relation), 99), 'r': relation}))), lambda z: z.r), ',') AS relations, count(*) AS edges, CASE WHEN bool_or(confidence = 'verified') THEN 'verified' ELSE 'inferred' END AS confidence, array_to_string(list_sort(list_distinct(list(source)))[1:5], ',') AS evidence FROM x GROUP BY 1, 2, 3")
def gr20_role_story(t: Tables) -> DataFrame:
    tree = t.tree()
    imports = rs.import_bindings(t.imports(), tree).select("snapshot", F.col("path").alias("source"), F.col("target_path").alias("target"), F.lit("IMPORTS").alias("relation"), F.when(F.col("imported") == "f1", "verified").otherwise("inferred").alias("confidence"))
    n = F.col("file_id")
    asked = tree.filter(n % 12 == 1).select("snapshot", n.alias("api"), F.col("path").alias("target"))
    requests = tree.filter("file_id % 12 in (2, 8)").withColumn("api", n - n % 12 + 1).join(asked, ["snapshot", "api"]).select("snapshot", F.col("path").alias("source"), "target", F.when(n % 24 == 2, "REQUESTS").otherwise("READS").alias("relation"), F.lit("inferred").alias("confidence"))
    told = st.connections(imports.unionByName(requests), story_nodes(t))
    return told.withColumns({"relations": F.array_join("relations", ","), "evidence": F.array_join("evidence", ",")})


@query(f"WITH {TREE_SQL}, {NODE_SQL}, {SUMMARY_SQL}, s AS (SELECT snapshot, arg_min(summary, file_id) AS summary FROM summaries GROUP BY 1), f AS (SELECT snapshot, arg_min('flow of d' || file_id, file_id) AS outcome FROM tree WHERE file_id % 24 = 3 GROUP BY 1), h AS (SELECT snapshot, bool_or(role = 'experience') AS seen, string_agg(place || '. ' || role, ',' ORDER BY place) FILTER (WHERE place <= 5) AS steps FROM told GROUP BY 1), k AS (SELECT DISTINCT snapshot, library FROM roled) SELECT k.snapshot, coalesce(nullif(trim(summary), ''), k.snapshot) AS one_liner, CASE WHEN library THEN 'developers' WHEN seen THEN 'people' ELSE 'systems' END AS audience, CASE WHEN NOT library AND seen THEN 'understanding' ELSE coalesce(outcome, 'core result') END AS outcome, steps FROM k JOIN h USING (snapshot) LEFT JOIN s USING (snapshot) LEFT JOIN f USING (snapshot)")
def gr20_story_purpose(t: Tables) -> DataFrame:
    tree, nodes = t.tree(), story_nodes(t)
    summaries = mp.readme_summary(tree).groupBy("snapshot").agg(F.min_by("summary", "file_id").alias("summary"))
    features = tree.filter("file_id % 24 = 3").select("snapshot", F.col("file_id").alias("rank"), F.concat(F.lit("flow of d"), F.col("file_id").cast("string")).alias("outcome"))
    return st.purpose(st.roles(nodes), nodes, summaries, features).withColumn("steps", F.array_join("steps", ","))


# -- jobs --------------------------------------------------------------------------------------
CHANGES_SQL = "j AS (SELECT user_id AS id, event_type AS status, ts AS at_, event_id AS seq, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), changes AS (SELECT id, status, at_, seq FROM j WHERE coalesce(over, 0) = 0 AND was IS DISTINCT FROM status)"


def job_rows(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query(f"WITH {CHANGES_SQL}, m AS (SELECT max(ts) AS now FROM events) SELECT id, status, seq, greatest(0, epoch_us(coalesce(lead(at_) OVER (PARTITION BY id ORDER BY at_, seq), now)) - epoch_us(at_)) // 15000000 AS beats FROM changes, m")
def str1_status_changes(t: Tables) -> DataFrame:
    changes = jb.status_changes(job_rows(t), ["signup"])
    return jb.heartbeats(changes.join(F.broadcast(t.events.agg(F.max("ts").alias("now")))), F.col("now"), 15)


@query("WITH f AS (SELECT * FROM (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'slow' WHEN 'O' THEN 'fast' ELSE 'none' END AS queue, o_orderdate AS at_, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1) SELECT id, queue, row_number() OVER (PARTITION BY queue ORDER BY at_, seq) AS place FROM f WHERE queue <> 'none'")
def str2_queue_order(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    jobs = t.orders.select(F.col("o_custkey").alias("id"), F.when(status == "F", "slow").when(status == "O", "fast").otherwise("none").alias("queue"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    return jb.queue_order(jobs, ["fast", "slow"])


@query("WITH e AS (SELECT user_id AS id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'purchase', 'signup')) SELECT u.id, coalesce(e.kind, 'queued') AS status FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN e ON e.id = u.id AND e.n = 1")
def str4_guarded_jobs(t: Tables) -> DataFrame:
    return jb.guarded(job_rows(t).withColumnRenamed("status", "kind"), "error", ["purchase", "signup"])


#: Suppliers as symbols in files of nations, the edges between them, and customers' selections of lines.
BRIEF_SQL = f"""{EDGES_SQL}, sym AS (SELECT s_suppkey AS symbol_id, s_nationkey AS file_id, s_suppkey % 40 * 25 + 1 AS start, s_suppkey % 40 * 25 + 20 + s_suppkey % 15 AS "end" FROM supplier),
ed AS (SELECT source || '-' || target || '-' || relation AS edge_id, CASE relation WHEN 'AF' THEN 'WRITES' WHEN 'NF' THEN 'CALLS' WHEN 'NO' THEN 'READS' ELSE 'REQUESTS' END AS relation, confidence / 100 AS confidence, file_id AS source_file, source AS source_symbol, CASE WHEN target % 3 > 0 THEN target END AS target_symbol, line % 1000 + 1 AS first, line % 1000 + 3 AS last FROM edges JOIN sym ON symbol_id = source),
sl AS (SELECT c_custkey AS brief, c_nationkey AS file_id, c_custkey % 1000 + 1 AS start, c_custkey % 1000 + 1 + c_custkey % 12 AS "end" FROM customer),
own AS (SELECT brief, arg_min(symbol_id, struct_pack(a := s."end" - s.start, b := s.start, c := symbol_id)) AS symbol_id FROM sl JOIN sym s ON s.file_id = sl.file_id AND s.start <= sl.start AND s."end" >= sl."end" GROUP BY 1),
hit AS (SELECT brief, edge_id, max(o) = 1 AS outgoing, max(i) = 1 AS incoming FROM (SELECT brief, edge_id, 1 AS o, 0 AS i FROM sl JOIN ed ON source_file = file_id AND first <= "end" AND last >= start UNION ALL SELECT brief, edge_id, 1, 0 FROM own JOIN sl USING (brief) JOIN ed ON source_symbol = symbol_id AND source_file = file_id UNION ALL SELECT brief, edge_id, 0, 1 FROM own JOIN ed ON target_symbol = symbol_id) GROUP BY 1, 2),
full_ AS (SELECT h.brief, h.outgoing, h.incoming, ed.*, struct_pack(a := CASE WHEN outgoing THEN 0 ELSE 1 END, b := first, c := relation, d := ed.edge_id) AS o, CASE WHEN confidence >= 0.8 AND (relation IN ('REQUESTS', 'WRITES') OR incoming) THEN 'confirmed' ELSE 'possible' END AS kind FROM hit h JOIN ed USING (edge_id)),
lists AS (SELECT brief, list(edge_id ORDER BY o) FILTER (WHERE kind = 'confirmed') AS confirmed, list(edge_id ORDER BY o) FILTER (WHERE kind = 'possible') AS possible, bool_or(confidence >= 0.8 AND relation = 'WRITES') AS high, bool_or(confidence >= 0.8 AND relation = 'REQUESTS') AS middle FROM full_ GROUP BY 1),
ends AS (SELECT brief, f.o, coalesce(s.file_id, CASE WHEN incoming THEN source_file END) AS file, coalesce(s.start, 1) AS line FROM full_ f LEFT JOIN sym s ON s.symbol_id = CASE WHEN incoming THEN source_symbol ELSE target_symbol END),
far AS (SELECT brief, file, line, min(o) AS o FROM ends WHERE file IS NOT NULL GROUP BY 1, 2, 3 EXCEPT SELECT e.brief, e.file, e.line, e.o FROM (SELECT brief, file, line, min(o) AS o FROM ends GROUP BY 1, 2, 3) e JOIN sl ON sl.brief = e.brief AND sl.file_id = e.file AND sl.start = e.line),
placed AS (SELECT brief, list(file || ':' || line ORDER BY o) AS far FROM far GROUP BY 1), files AS (SELECT brief, count(DISTINCT file) AS files FROM (SELECT brief, file FROM far UNION ALL SELECT brief, file_id FROM sl) GROUP BY 1)"""


@query(f"""WITH {BRIEF_SQL} SELECT brief, symbol_id, coalesce(array_to_string(confirmed[1:8], ','), '') AS confirmed, coalesce(array_to_string(possible[1:CASE WHEN confirmed IS NULL THEN 7 ELSE 8 END], ','), '') AS possible, confirmed IS NULL AS to_verify,
  array_to_string(list_concat([sl.file_id || ':' || sl.start], coalesce(far[1:7], [])), ',') AS places, CASE WHEN high THEN 'high' WHEN files > 1 OR middle THEN 'medium' WHEN high IS NOT NULL THEN 'low' ELSE 'unknown' END AS risk,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'brief_' || brief ELSE 'made_' || brief END AS artifact, c_mktsegment <> 'BUILDING' AS created FROM sl JOIN customer ON c_custkey = brief LEFT JOIN own USING (brief) LEFT JOIN lists USING (brief) LEFT JOIN placed USING (brief) LEFT JOIN files USING (brief)""")
def cp16_change_brief(t: Tables) -> DataFrame:
    """Briefs of customers' selections, taken from earlier artifacts where there are some."""
    n = F.col("s_suppkey")
    symbols = t.supplier.select(n.alias("symbol_id"), F.col("s_nationkey").alias("file_id"), (n % 40 * 25 + 1).alias("start"), (n % 40 * 25 + 20 + n % 15).alias("end"))
    of_symbol = symbols.select(F.col("symbol_id").alias("source"), F.col("file_id").alias("source_file"))
    names = F.when(F.col("relation") == "AF", "WRITES").when(F.col("relation") == "NF", "CALLS").when(F.col("relation") == "NO", "READS").otherwise("REQUESTS")
    edges = t.edges().join(of_symbol, "source").select(F.concat_ws("-", F.col("source").cast("string"), F.col("target").cast("string"), "relation").alias("edge_id"), names.alias("relation"), (F.col("confidence") / 100).alias("confidence"), "source_file", F.col("source").alias("source_symbol"), F.when(F.col("target") % 3 > 0, F.col("target")).alias("target_symbol"), (F.col("line") % 1000 + 1).alias("first"), (F.col("line") % 1000 + 3).alias("last"))
    c = F.col("c_custkey")
    selections = t.customer.select(c.alias("brief"), F.col("c_nationkey").alias("file_id"), (c % 1000 + 1).alias("start"), (c % 1000 + 1 + c % 12).alias("end"))
    made = bf.change_briefs(selections, symbols, edges)
    flat = made.withColumns({"confirmed": F.array_join("confirmed", ","), "possible": F.array_join("possible", ","), "places": F.array_join(F.transform("places", lambda x: F.concat_ws(":", x["file_id"].cast("string"), x["line"].cast("string"))), ",")})
    text = lambda name: F.concat(F.lit(name), F.col("brief").cast("string"))
    have = t.customer.filter("c_mktsegment = 'BUILDING'").select(c.alias("brief")).select("brief", text("brief_").alias("artifact"))
    return op.get_or_create(flat, have, ["brief"], "artifact", text("made_"), ["symbol_id", "confirmed", "possible", "to_verify", "places", "risk"])
