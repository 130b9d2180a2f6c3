"""Scans, filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import relational as op
from ..operators import scanning as sc
from ..sources.tables import EDGES_SQL, FILES_SQL, USAGE_SQL, Tables
from .registry import Registry

query = Registry()
N = lambda c: F.col(c).cast("bigint")
COUNT = lambda name="n": F.count("*").alias(name)
NOW = "2024-01-01 00:00:00"


# -- scans -------------------------------------------------------------------------------------
SCAN_SQL = f"""{FILES_SQL}, scanned AS (SELECT split_part(path, '/', 1) AS snapshot, path, content, byte_size, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' END AS name FROM files),
kept AS (SELECT * FROM scanned WHERE name IS NOT NULL AND byte_size <= 20000 AND NOT regexp_matches(path, '/[0-9]*3\\.de$') AND position(chr(0) IN content) = 0),
sums AS (SELECT snapshot, count(*) AS files, sum(byte_size) AS bytes FROM kept GROUP BY 1), limits AS (SELECT *, CASE WHEN files > 44 THEN 'too many files' WHEN bytes > 120000 THEN 'too many bytes' END AS refused FROM sums)"""


def scanned(t: Tables) -> DataFrame:
    rows = t.files().select(F.split_part("path", F.lit("/"), F.lit(1)).alias("snapshot"), "path", F.col("content").cast("binary").alias("raw"), "byte_size")
    return sc.collected(rows, ["*3.de"], {".en": "english", ".de": "german", ".fr": "french"}, 20_000)


@query(f"WITH {SCAN_SQL} SELECT path, name AS language, byte_size, length(content) AS n_chars FROM kept WHERE snapshot NOT IN (SELECT snapshot FROM limits WHERE refused IS NOT NULL)")
def src1_source_scan(t: Tables) -> DataFrame:
    rows = scanned(t)
    refused = sc.within_limits(rows, 44, 120_000).filter("refused is not null")
    return rows.join(refused, "snapshot", "left_anti").select("path", "language", "byte_size", F.length("content").cast("bigint").alias("n_chars"))


@query(f"WITH {SCAN_SQL} SELECT snapshot, files, bytes, refused FROM limits")
def src1_limits(t: Tables) -> DataFrame:
    return sc.within_limits(scanned(t), 44, 120_000)


@query(f"WITH {FILES_SQL} SELECT path, regexp_matches(lower(path), '(^|/)(\\.env(\\.[^/]*)?|id_rsa|credentials\\.json|[^/]*\\.(pem|key|p12|fr))$') AS secret FROM files")
def src3_secret_files(t: Tables) -> DataFrame:
    return t.files().select("path", F.lower("path").rlike(r"(^|/)(\.env(\.[^/]*)?|id_rsa|credentials\.json|[^/]*\.(pem|key|p12|fr))$").alias("secret"))


@query(f"WITH {FILES_SQL} SELECT CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'other' END AS name, count(*) AS n, sum(line_count) AS n_lines FROM files GROUP BY 1")
def src4_language_by_suffix(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("en", "english", "de", "german", "fr", "french")])
    suffix = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    return t.files().groupBy(F.coalesce(F.try_element_at(names, suffix), F.lit("other")).alias("name")).agg(COUNT(), F.sum("line_count").alias("n_lines"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS owner FROM pages")
def src7_parse_url(t: Tables) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return t.pages.select("page_id", part("^(https?)://").alias("scheme"), F.lower(part("^https?://([^/?#]+)")).alias("host"), part("^https?://[^/]+/([^/?#]+)").alias("owner"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src0'")
def src8_snapshot_scan(t: Tables) -> DataFrame:
    return t.documents.filter("source = 'src0'").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def src9_point_lookup(t: Tables) -> DataFrame:
    return t.documents.filter("doc_id = 7").select("doc_id", "lang", "source")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src11_tolerant_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


# -- filters and projections -------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F','O') AND o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT'")
def fil1_equality_in(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_custkey").isNotNull() & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE position('steel' IN lower(p_name)) > 0 OR position('brass' IN lower(p_type)) > 0 OR position('brand#2' IN lower(p_brand)) > 0 OR position('steel' IN lower(p_type)) > 0")
def fil2_any_column_contains(t: Tables) -> DataFrame:
    some = F.lit(False)
    for column, term in (("p_name", "steel"), ("p_type", "brass"), ("p_brand", "brand#2"), ("p_type", "steel")):
        some = some | F.lower(column).contains(term)
    return t.part.filter(some).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%e%'")
def fil3_ilike(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%a%e%")).select("p_partkey", "p_name")


@query("WITH p AS (SELECT o_orderkey, o_orderdate AS since, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END AS until FROM orders), m AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS now FROM orders) SELECT o_orderkey FROM p, m WHERE since <= now AND (until IS NULL OR until > now)")
def fil4_validity(t: Tables) -> DataFrame:
    p = t.orders.select("o_orderkey", F.col("o_orderdate").alias("since"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("until"))
    now = t.orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("now"))
    return p.join(F.broadcast(now), (F.col("since") <= F.col("now")) & (F.col("until").isNull() | (F.col("until") > F.col("now")))).select("o_orderkey")


@query("SELECT event_type, count(*) AS n FROM events, (SELECT date_trunc('day', max(ts)) AS e FROM events) m WHERE ts >= e - INTERVAL 1 DAY AND ts < e GROUP BY 1")
def fil5_half_open_period(t: Tables) -> DataFrame:
    end = t.events.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("e"))
    return t.events.join(F.broadcast(end), (F.col("ts") >= F.col("e") - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < F.col("e"))).groupBy("event_type").agg(COUNT())


@query(f"WITH {FILES_SQL} SELECT path, regexp_matches(lower(path), '(^|/)src1[0-9]?/|\\.de$') AS noise FROM files")
def fil9_noise_path(t: Tables) -> DataFrame:
    return t.files().select("path", F.lower("path").rlike(r"(^|/)src1[0-9]?/|\.de$").alias("noise"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def fil10_allowlist(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT page_id FROM pages WHERE url LIKE 'https://%' AND (lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) = 'example.com' OR lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) LIKE '%.example.com')")
def fil11_domain_allowlist(t: Tables) -> DataFrame:
    host = fx.url_host(F.col("url"))
    return t.pages.filter(F.col("url").startswith("https://") & ((host == "example.com") | host.endswith(".example.com"))).select("page_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def fil12_tenant_scope(t: Tables) -> DataFrame:
    members = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.orders.join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT 'ev_' || regexp_replace('chk_' || vec_id, '^chk_', '') AS evidence_id FROM embeddings")
def prj2_evidence_id(t: Tables) -> DataFrame:
    chunk = F.concat(F.lit("chk_"), F.col("vec_id").cast("string"))
    return t.embeddings.select(F.concat(F.lit("ev_"), F.regexp_replace(chunk, "^chk_", "")).alias("evidence_id"))


@query(f"WITH {EDGES_SQL} SELECT CASE WHEN confidence >= 90 THEN 'verified' WHEN confidence >= 65 THEN 'inferred' ELSE 'unknown' END AS flow, CASE WHEN confidence >= 85 THEN 'verified' WHEN confidence >= 50 THEN 'inferred' ELSE 'unknown' END AS graph, count(*) AS n FROM edges GROUP BY 1, 2")
def prj3_confidence_buckets(t: Tables) -> DataFrame:
    c = F.col("confidence") / 100
    return t.edges().groupBy(fx.confidence_bucket(c, 0.9, 0.65).alias("flow"), fx.confidence_bucket(c, 0.85, 0.5).alias("graph")).agg(COUNT())


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'ECONOMY|PROMO') THEN 'client' WHEN regexp_matches(p_type, 'STEEL|BRASS') THEN 'server' WHEN p_size > 25 THEN 'data' ELSE 'shared' END AS layer FROM part")
def prj4_layer_rules(t: Tables) -> DataFrame:
    rules = [(F.col("p_type").rlike("ECONOMY|PROMO"), "client"), (F.col("p_type").rlike("STEEL|BRASS"), "server"), (F.col("p_size") > 25, "data")]
    return t.part.select("p_partkey", fx.first_match(rules, "shared").alias("layer"))


# -- joins -------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def join1_inner_chain(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT d.doc_id, l.toxic, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join2_left_outer(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "toxic", "quality")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join4_parent_chain(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join5_tenant_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, coalesce(a.s_name, b.s_name) AS target FROM lineitem LEFT JOIN supplier a ON a.s_suppkey = CASE WHEN l_returnflag = 'R' THEN l_suppkey END LEFT JOIN supplier b ON b.s_suppkey = l_partkey")
def join7_two_path(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("ka"), F.col("s_name").alias("na"))
    b = t.supplier.select(F.col("s_suppkey").alias("kb"), F.col("s_name").alias("nb"))
    by_id = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
    return t.lineitem.join(a, by_id == F.col("ka"), "left").join(b, F.col("l_partkey") == F.col("kb"), "left").select("l_orderkey", "l_linenumber", F.coalesce("na", "nb").alias("target"))


@query("WITH p AS (SELECT user_id AS org, ts AS since, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events WHERE event_type = 'signup') SELECT e.event_id, p.version FROM events e ASOF LEFT JOIN p ON e.user_id = p.org AND e.ts >= p.since")
def join11_as_of(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prices = t.events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.row_number().over(w).alias("version"))
    return op.as_of(t.events.select("event_id", "user_id", "ts"), prices, ["user_id"], "ts", "since", ["version"]).select("event_id", "version")


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def join12_semi(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.filter("p_size < 5"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(COUNT(), F.sum("l_quantity").alias("quantity"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join13_anti(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT a.c_custkey, a.n_orders, b.n_big FROM (SELECT o_custkey AS c_custkey, o_orderstatus AS s, o_orderpriority AS p, count(*) AS n_orders FROM orders GROUP BY 1,2,3) a JOIN (SELECT o_custkey AS c_custkey, o_orderstatus AS s, o_orderpriority AS p, count(*) AS n_big FROM orders WHERE o_totalprice > 200000 GROUP BY 1,2,3) b USING (c_custkey, s, p)")
def join14_composite_key(t: Tables) -> DataFrame:
    key = [F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")]
    a = t.orders.groupBy(*key).agg(COUNT("n_orders"))
    b = t.orders.filter("o_totalprice > 200000").groupBy(*key).agg(COUNT("n_big"))
    return a.join(b, ["c_custkey", "s", "p"]).select("c_custkey", "n_orders", "n_big")


@query("WITH u AS (SELECT p_brand AS brand, p_size AS size, min(p_partkey) AS partkey FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) = 1) SELECT p.p_partkey, u.partkey FROM part p LEFT JOIN u ON u.brand = p.p_brand AND u.size = p.p_size")
def join15_unique_match(t: Tables) -> DataFrame:
    left = t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    right = t.part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("partkey"))
    return op.unique_match(left, right, ["brand", "size"], "partkey").select("p_partkey", "partkey")


@query("WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages), r AS (SELECT DISTINCT regexp_extract(path, '^[^/]+', 0) AS root FROM u UNION SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+', 0) FROM u WHERE path LIKE '%a%') SELECT path, (SELECT root FROM r WHERE root <> '' AND (path = root OR starts_with(path, root || '/')) ORDER BY length(root) DESC LIMIT 1) AS root FROM (SELECT DISTINCT path FROM u)")
def join16_longest_prefix(t: Tables) -> DataFrame:
    paths = t.pages.select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "").alias("path")).distinct()
    roots = paths.select(F.regexp_extract("path", "^[^/]+", 0).alias("root")).unionByName(paths.filter(F.col("path").contains("a")).select(F.regexp_extract("path", "^[^/]+/[^/]+", 0).alias("root"))).filter("root <> ''")
    return op.longest_prefix(paths, roots)


@query("WITH c AS (SELECT doc_id, unnest(['src' || (doc_id % 40), 'src' || (doc_id % 7), 'src0']) AS source, unnest([0, 1, 2]) AS pos FROM documents), k AS (SELECT DISTINCT source FROM documents WHERE lang = 'en') SELECT doc_id, (SELECT c.source FROM c WHERE c.doc_id = d.doc_id AND c.source IN (SELECT source FROM k) ORDER BY pos LIMIT 1) AS resolved FROM documents d")
def join17_first_existing(t: Tables) -> DataFrame:
    name = lambda n: F.concat(F.lit("src"), (F.col("doc_id") % n).cast("string"))
    rows = t.documents.select("doc_id", F.array(name(40), name(7), F.lit("src0")).alias("candidates"))
    return op.first_existing(rows, "candidates", t.documents.filter("lang = 'en'"), "source", ["doc_id"])


# -- aggregates --------------------------------------------------------------------------------
@query(f"WITH {EDGES_SQL} SELECT source, count(*) AS degree, count(DISTINCT target) AS targets FROM edges GROUP BY source")
def agg1_out_degree(t: Tables) -> DataFrame:
    return t.edges().groupBy("source").agg(COUNT("degree"), F.count_distinct("target").alias("targets"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderdate > TIMESTAMP '2999-01-01'), 0) AS late FROM orders")
def agg2_counts_or_zero(t: Tables) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return t.orders.agg(COUNT(), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.coalesce(F.sum(F.when(F.col("o_orderdate") > F.lit("2999-01-01").cast("timestamp_ntz"), cents)), F.lit(0)).alias("late"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY 1")
def agg4_min_max(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))


@query(f"WITH {EDGES_SQL} SELECT source, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS targets FROM (SELECT DISTINCT source, target FROM edges) GROUP BY source")
def agg5_distinct_successors(t: Tables) -> DataFrame:
    return t.edges().groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_set("target")), lambda x: x.cast("string")), ",").alias("targets"))


@query(f"WITH {FILES_SQL} SELECT split_part(path, '/', 1) AS directory, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, directory LIMIT 5")
def agg6_top_directories(t: Tables) -> DataFrame:
    return t.files().groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("directory")).agg(COUNT()).orderBy(F.desc("n"), "directory").limit(5)


@query(f"WITH {EDGES_SQL}, s AS (SELECT source AS node, 2 AS w FROM edges WHERE confidence >= 90 UNION ALL SELECT target, 1 FROM edges WHERE confidence >= 90 UNION ALL SELECT s_suppkey, 3 FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT l_suppkey, 4 FROM lineitem WHERE l_quantity >= 50) SELECT node, sum(w) AS score FROM s GROUP BY node")
def agg7_importance(t: Tables) -> DataFrame:
    strong = t.edges().filter("confidence >= 90")
    signals = [strong.select(F.col("source").alias("node"), F.lit(2).alias("w")), strong.select(F.col("target"), F.lit(1)), t.supplier.filter("s_acctbal > 5000").select("s_suppkey", F.lit(3)), t.lineitem.filter("l_quantity >= 50").select("l_suppkey", F.lit(4))]
    out = signals[0]
    for s in signals[1:]:
        out = out.union(s)
    return out.groupBy("node").agg(F.sum("w").alias("score"))


@query(f"WITH {EDGES_SQL} SELECT source, target, max(confidence) AS confidence, min(line) AS first_line, count(*) AS relations FROM edges WHERE source <> target GROUP BY source, target")
def agg8_edge_pairs(t: Tables) -> DataFrame:
    return t.edges().filter("source <> target").groupBy("source", "target").agg(F.max("confidence").alias("confidence"), F.min("line").alias("first_line"), COUNT("relations"))


@query(f"WITH {USAGE_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, feature, count(*) AS requests, count(DISTINCT org) AS orgs, sum(micro) AS micro FROM usage GROUP BY 1, 2")
def agg9_daily_rollup(t: Tables) -> DataFrame:
    return t.usage().groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "feature").agg(COUNT("requests"), F.count_distinct("org").alias("orgs"), F.sum("micro").alias("micro"))


@query(f"WITH {EDGES_SQL}, r AS (SELECT s_suppkey, s_nationkey AS role FROM supplier) SELECT a.role AS source_role, b.role AS target_role, count(*) AS edges, count(DISTINCT relation) AS relations FROM edges JOIN r a ON a.s_suppkey = source JOIN r b ON b.s_suppkey = target WHERE a.role <> b.role GROUP BY 1, 2")
def agg10_role_pairs(t: Tables) -> DataFrame:
    role = lambda key, name: t.supplier.select(F.col("s_suppkey").alias(key), F.col("s_nationkey").alias(name))
    e = t.edges().join(role("source", "source_role"), "source").join(role("target", "target_role"), "target")
    return e.filter("source_role <> target_role").groupBy("source_role", "target_role").agg(COUNT("edges"), F.count_distinct("relation").alias("relations"))


@query("WITH r AS (SELECT *, CASE WHEN o_totalprice > 250000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS rank FROM orders) SELECT o_custkey, max(rank) AS rank, count(*) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT o_orderpriority AS k FROM r x WHERE x.o_custkey = r.o_custkey ORDER BY 1 LIMIT 3)) AS evidence FROM r GROUP BY o_custkey")
def agg14_claim_merge(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_totalprice") > 250000, 3).when(F.col("o_totalprice") > 100000, 2).otherwise(1)
    return t.orders.groupBy("o_custkey").agg(F.max(rank).alias("rank"), COUNT(), F.array_join(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3), ",").alias("evidence"))


@query("SELECT user_id, event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1, 2")
def agg16_usage_by_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("SELECT count(*) AS total, count(DISTINCT sha256(text)) AS distinct_texts, count(*) - count(DISTINCT sha256(text)) AS reused FROM documents")
def agg17_reuse(t: Tables) -> DataFrame:
    d = F.count_distinct(F.sha2("text", 256))
    return t.documents.agg(COUNT("total"), d.alias("distinct_texts"), (F.count("*") - d).alias("reused"))


@query(f"WITH {FILES_SQL} SELECT language, 'sha256:' || sha256('[' || string_agg('{{\"byte_size\":' || byte_size || ',\"content_hash\":' || coalesce('\"' || content_hash || '\"', 'null') || ',\"language\":' || coalesce('\"' || language || '\"', 'null') || ',\"path\":\"' || path || '\"}}', ',' ORDER BY path) || ']') AS manifest FROM files GROUP BY 1")
def agg19_manifest_hash(t: Tables) -> DataFrame:
    return op.manifest_hash(t.files(), "language")


@query(f"WITH {USAGE_SQL}, m AS (SELECT max(ts) AS now FROM usage) SELECT count(*) FILTER (WHERE feature = 'view') AS pending, count(*) FILTER (WHERE feature = 'view' AND ts < now - INTERVAL 7 DAY) AS stale, coalesce(sum(micro) FILTER (WHERE feature = 'purchase'), 0) AS settled, count(*) FILTER (WHERE feature = 'error') AS invalid FROM usage, m")
def agg21_reconciliation(t: Tables) -> DataFrame:
    u = t.usage()
    u = u.join(F.broadcast(u.agg(F.max("ts").alias("now"))))
    is_ = lambda f: F.col("feature") == f
    return u.agg(F.count_if(is_("view")).alias("pending"), F.count_if(is_("view") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 7 DAYS"))).alias("stale"), F.coalesce(F.sum(F.when(is_("purchase"), F.col("micro"))), F.lit(0)).alias("settled"), F.count_if(is_("error")).alias("invalid"))


# -- windows -----------------------------------------------------------------------------------
@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS canonical, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY CASE WHEN o_totalprice > 150000 THEN 0 ELSE 1 END, o_orderdate, o_orderkey)")
def win1_canonical_duplicate(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderstatus", "o_orderpriority").orderBy(F.when(F.col("o_totalprice") > 150000, 0).otherwise(1), "o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("canonical"), F.row_number().over(w).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def win3_latest_per_key(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(f"WITH {EDGES_SQL} SELECT target, source, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, relation, line, source) AS n FROM edges) WHERE n = 1")
def win4_best_edge(t: Tables) -> DataFrame:
    return op.best_per_key(t.edges(), ["target"], [-F.col("confidence"), F.col("relation"), F.col("line"), F.col("source")]).select("target", "source", "relation", "confidence")


@query("SELECT conv_id, turn, role, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win6_neighbours(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous"), F.lead("role").over(w).alias("next"))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 8")
def win7_distinct_files(t: Tables) -> DataFrame:
    return op.distinct_first(t.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 8)


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) ORDER BY CASE WHEN n <= 2 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey LIMIT 34")
def win11_layer_fill(t: Tables) -> DataFrame:
    return op.ranked_fill(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 34).select("c_custkey", "c_mktsegment")


@query("WITH n AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role FROM conversations) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (ord - 1 + size) % size) AS r FROM n WHERE role = 'user') WHERE r = 1")
def win12_circular_next(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    n = t.conversations.select("conv_id", "turn", "role", F.count("*").over(w).alias("size"), (F.row_number().over(w.orderBy("turn")) - 1).alias("ord"))
    return n.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("turn", (F.col("ord") - 1 + F.col("size")) % F.col("size")).alias("turn"))


# -- top-k and set operations ------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24")
def top2_order_limit(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(24)


@query("SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END ASC NULLS LAST, o_orderkey LIMIT 50")
def top4_nulls_last(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).asc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 30")
def top5_enum_order(t: Tables) -> DataFrame:
    return t.orders.orderBy(op.priority_order("o_orderpriority", ["3-MEDIUM", "1-URGENT"]), F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_orderpriority")


@query("SELECT item_id, choice, n FROM (SELECT b.item_id, s.s_name AS choice, row_number() OVER (PARTITION BY b.item_id ORDER BY sha256(b.item_id || ':' || s.s_name)) AS n FROM benchmark b CROSS JOIN (SELECT DISTINCT n_name AS s_name FROM nation) s) WHERE n <= 4")
def top7_hash_shuffle(t: Tables) -> DataFrame:
    labels = t.nation.select(F.col("n_name").alias("choice")).distinct()
    pairs = t.benchmark.select("item_id").crossJoin(F.broadcast(labels)).withColumn("h", F.sha2(F.concat_ws(":", "item_id", "choice"), 256))
    return op.top_per_key(pairs, ["item_id"], [F.col("h")], 4, "n").select("item_id", "choice", "n")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def top8_recent_per_key(t: Tables) -> DataFrame:
    return op.top_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'left', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'all', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")
def set1_key_algebra(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    sized = lambda df, name: df.agg(COUNT()).select(F.lit(name).alias("part"), "n")
    return sized(a.intersect(b), "both").unionByName(sized(a.subtract(b), "left")).unionByName(sized(a.union(b).distinct(), "all"))


@query("SELECT DISTINCT a.user_id FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1) a WHERE list_has_any(kinds, ['error', 'signup'])")
def set4_array_overlap(t: Tables) -> DataFrame:
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.filter(F.arrays_overlap("kinds", F.array(F.lit("error"), F.lit("signup")))).select("user_id")


@query("WITH a AS (SELECT source, list(DISTINCT lang) AS l FROM documents WHERE n_chars > 5000 GROUP BY 1), b AS (SELECT source, list(DISTINCT lang) AS m FROM documents WHERE n_chars < 500 GROUP BY 1) SELECT source, array_to_string(list_sort(list_intersect(l, m)), ',') AS common FROM a JOIN b USING (source)")
def set5_array_intersection(t: Tables) -> DataFrame:
    side = lambda cond, name: t.documents.filter(cond).groupBy("source").agg(F.collect_set("lang").alias(name))
    return side("n_chars > 5000", "l").join(side("n_chars < 500", "m"), "source").select("source", F.array_join(F.array_sort(F.array_intersect("l", "m")), ",").alias("common"))
