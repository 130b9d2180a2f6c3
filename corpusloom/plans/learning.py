"""Ledger, learning, evaluation and composite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import evaluation as ev
from ..operators import learning as lr
from ..operators import ledger as ld
from ..operators import relational as op
from ..operators import retrieval as rt
from ..session import written
from ..sources.tables import FILES_SQL, MASTERY_SQL, USAGE_SQL, Tables
from .registry import Registry

query = Registry()
COUNT = lambda name="n": F.count("*").alias(name)
#: Micro-units of a unit, by usage type and month of effect.
PRICES = [("view", "2000-01-01", 3), ("view", "2024-01-01", 4), ("click", "2000-01-01", 7), ("purchase", "2000-01-01", 50), ("purchase", "2024-01-01", 45)]
PRICE_SQL = "prices(usage_type, since, micro) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in PRICES) + ")"
#: Prerequisites: source comes before target.
PREREQUISITES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("signup", "purchase")]
PRE_SQL = "pre(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PREREQUISITES) + ")"
REPLAY_SQL = MASTERY_SQL + ", folded AS (SELECT profile, concept, list_reduce(list_prepend(500, list(delta ORDER BY ts, event_id)), lambda a, x: least(greatest(a + x, 0), 1000)) AS score, list_reduce(list_prepend(350, list(confidence_delta ORDER BY ts, event_id)), lambda a, x: least(greatest(a + x, 0), 1000)) AS confidence, count(*) AS n FROM mastery GROUP BY 1, 2)"


# -- ledger ------------------------------------------------------------------------------------
@query("SELECT o_custkey, o_orderkey, least(amount, greatest(0, 30000000 - coalesce(sum(amount) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders)")
def win8_fifo_drawdown(t: Tables) -> DataFrame:
    grants = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"))
    take = t.orders.select("o_custkey").distinct().withColumn("amount", F.lit(30_000_000))
    return ld.drawdown(grants, take, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "used")


@query(f"WITH {PRICE_SQL}, newest AS (SELECT usage_type, arg_max(micro, since) AS micro FROM prices GROUP BY 1) SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) * micro) AS BIGINT) AS cost FROM events JOIN newest ON usage_type = event_type GROUP BY 1")
def led2_settle_cost(t: Tables) -> DataFrame:
    usage = t.events.select("user_id", F.col("event_type").alias("usage_type"), F.get_json_object("props", "$.k").cast("bigint").alias("units"))
    prices = t.spark.createDataFrame(PRICES, "usage_type string, since string, micro_per_unit bigint")
    return ld.priced(usage, prices).groupBy("user_id").agg(F.sum("cost").alias("cost"))


@query(f"WITH {USAGE_SQL}, r AS (SELECT org, list_reduce(list_prepend(0::BIGINT, list(micro ORDER BY ts, event_id)), lambda a, x: CASE WHEN a + x <= 50000 THEN a + x ELSE a END) AS used FROM usage GROUP BY 1) SELECT org, used FROM r")
def led1_reserve(t: Tables) -> DataFrame:
    u = t.usage()
    granted = ld.reserve(u, 50_000).filter("granted").join(u.select("event_id", "micro"), "event_id").groupBy("org").agg(F.sum("micro").alias("used"))
    return u.select("org").distinct().join(granted, "org", "left").select("org", F.coalesce("used", F.lit(0)).alias("used"))


@query(f"""WITH {USAGE_SQL}, keyed AS (SELECT *, event_id // 3 AS again, feature = 'error' AS blocked FROM usage), firsts AS (SELECT org, again, arg_min(event_id, {{'t': ts, 'e': event_id}}) AS event_id FROM keyed GROUP BY 1, 2),
asked AS (SELECT k.* FROM keyed k JOIN firsts USING (org, again, event_id) WHERE NOT blocked),
walk AS (SELECT org, list_reduce(list_prepend({{'left': 50000::BIGINT, 'ids': []::BIGINT[]}}, list({{'left': micro, 'ids': [event_id]}} ORDER BY ts, event_id)), lambda a, x: CASE WHEN x.left <= a.left THEN {{'left': a.left - x.left, 'ids': list_concat(a.ids, x.ids)}} ELSE a END) AS w FROM asked GROUP BY 1),
ok AS (SELECT org, unnest(w.ids) AS event_id FROM walk), outcome AS (SELECT f.*, o.event_id IS NOT NULL AS ok FROM firsts f LEFT JOIN ok o USING (org, event_id))
SELECT k.org, k.event_id, CASE WHEN o.ok THEN 'reserved' ELSE 'shadow_exceeded' END AS status, CASE WHEN o.ok AND k.event_id = o.event_id THEN k.micro ELSE 0 END AS charged FROM keyed k JOIN outcome o USING (org, again)""")
def led1_reserve_shadow(t: Tables) -> DataFrame:
    """Requests that repeat an idempotency key, some beyond their feature's limit, in shadow mode."""
    u = t.usage().withColumns({"idempotency_key": F.floor(F.col("event_id") / 3), "over": F.col("feature") == "error"})
    return ld.reservations(u, 50_000, "shadow", blocked="over")


@query(f"WITH {USAGE_SQL}, m AS (SELECT max(ts) - INTERVAL 2 DAY AS now FROM usage), r AS (SELECT event_id, micro, ts + INTERVAL 7 DAY AS expires_at, CASE WHEN feature IN ('view', 'click') THEN 'pending' ELSE 'settled' END AS status, CASE WHEN feature = 'click' THEN event_id END AS provider_request FROM usage), s AS (SELECT *, status = 'pending' AND expires_at <= now AND provider_request IS NULL AS stale FROM r, m) SELECT event_id, CASE WHEN stale THEN 'released' ELSE status END AS status, CASE WHEN stale THEN 0 ELSE micro END AS reserved FROM s")
def led3_release_stale(t: Tables) -> DataFrame:
    kind = F.col("feature")
    r = t.usage().select("event_id", F.col("micro").alias("reserved"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), F.when(kind.isin("view", "click"), "pending").otherwise("settled").alias("status"), F.when(kind == "click", F.col("event_id")).alias("provider_request"))
    now = t.usage().agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("now"))
    return ld.release_stale(r.join(F.broadcast(now)), F.col("now")).select("event_id", "status", "reserved")


@query(f"WITH {USAGE_SQL} SELECT org, greatest(0, 100000 + coalesce(sum(micro) FILTER (WHERE feature = 'signup'), 0) - coalesce(sum(micro) FILTER (WHERE feature = 'view'), 0) - coalesce(sum(micro) FILTER (WHERE feature = 'purchase'), 0)) AS remaining FROM usage GROUP BY 1")
def led4_remaining(t: Tables) -> DataFrame:
    part = lambda kind, name: F.coalesce(F.sum(F.when(F.col("feature") == kind, F.col("micro"))), F.lit(0)).alias(name)
    book = t.usage().groupBy("org").agg(F.lit(100_000).alias("allowance"), part("signup", "bonus"), part("view", "reserved"), part("purchase", "consumed"))
    return ld.remaining(book).select("org", "remaining")


@query(f"WITH {USAGE_SQL}, m AS (SELECT date_trunc('month', max(ts)) AS s, max(ts) AS now FROM usage) SELECT org, feature, count(*) FILTER (WHERE ts >= s AND ts < s + INTERVAL 1 MONTH) AS n, count(*) FILTER (WHERE ts > now - INTERVAL 1 HOUR) AS active, count(*) FILTER (WHERE ts >= s AND ts < s + INTERVAL 1 MONTH) >= 20 OR count(*) FILTER (WHERE ts > now - INTERVAL 1 HOUR) >= 2 AS blocked FROM usage, m GROUP BY 1, 2")
def led5_feature_limit(t: Tables) -> DataFrame:
    u = t.usage()
    m = F.broadcast(u.agg(F.date_trunc("month", F.max("ts")).cast("timestamp_ntz").alias("s"), F.max("ts").alias("now")))
    return ld.feature_limits(u.join(m), F.col("s"), F.col("s") + F.expr("INTERVAL 1 MONTH"), 20, F.col("ts") > F.col("now") - F.expr("INTERVAL 1 HOUR"), 2)


@query("WITH k AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS exact, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE o_orderstatus = 'O') AS base FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN base IS NOT NULL THEN 'incremental' ELSE 'full' END AS how, coalesce(exact, base) AS snapshot FROM customer LEFT JOIN k ON o_custkey = c_custkey")
def led6_snapshot_reuse(t: Tables) -> DataFrame:
    latest = lambda status, name: F.max(F.when(F.col("o_orderstatus") == status, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"].alias(name)
    k = t.orders.groupBy("o_custkey").agg(latest("F", "exact"), latest("O", "base"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("base").isNotNull(), "incremental").otherwise("full")
    return t.customer.select("c_custkey").join(k, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", how.alias("how"), F.coalesce("exact", "base").alias("snapshot"))


# -- learning ----------------------------------------------------------------------------------
@query(f"WITH {REPLAY_SQL} SELECT profile, concept, score, confidence, n FROM folded")
def win9_clamped_replay(t: Tables) -> DataFrame:
    return lr.replay(t.mastery())


@query(f"WITH {REPLAY_SQL}, s AS (SELECT profile, concept, score, CASE WHEN score >= 750 THEN 'strong' WHEN score >= 450 THEN 'developing' ELSE 'weak' END AS state FROM folded) SELECT concept, state, count(*) AS profiles FROM s GROUP BY 1, 2")
def st5_mastery_states(t: Tables) -> DataFrame:
    return lr.replay(t.mastery()).groupBy("concept", lr.state(F.col("score")).alias("state")).agg(COUNT("profiles"))


@query(f"WITH {REPLAY_SQL}, o AS (SELECT profile, concept, least(1000, 500 + 80 * count(*)) AS score, 430 AS confidence FROM mastery WHERE delta = 80 GROUP BY 1, 2), j AS (SELECT f.profile, f.concept, coalesce(o.score, 500) AS before, f.score, coalesce(o.confidence, 0) AS confidence_before, f.confidence FROM folded f LEFT JOIN o USING (profile, concept)) SELECT * FROM j WHERE before <> score OR confidence_before <> confidence")
def st2_projection(t: Tables) -> DataFrame:
    old = t.mastery().filter("delta = 80").groupBy("profile", "concept").agg(F.least(F.lit(1000), 500 + 80 * F.count("*")).alias("score"), F.lit(430).alias("confidence"))
    return lr.project(old, lr.replay(t.mastery()).drop("n"), ["profile", "concept"])


@query("WITH d(event_type, a, b) AS (VALUES ('signup', 80, 80), ('view', 80, 80), ('click', -60, 80), ('purchase', 120, 150), ('error', -80, 120)) SELECT user_id, sum(a) AS score, sum(b) AS confidence FROM events JOIN d USING (event_type) GROUP BY 1")
def st1_event_deltas(t: Tables) -> DataFrame:
    return t.mastery().groupBy(F.col("profile").alias("user_id")).agg(F.sum("delta").alias("score"), F.sum("confidence_delta").alias("confidence"))


@query("SELECT event_type, count(*) AS n, sum(CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN -6 WHEN 'purchase' THEN 12 ELSE -8 END) AS total FROM events GROUP BY 1")
def st3_delta_constants(t: Tables) -> DataFrame:
    delta = F.when(F.col("event_type") == "view", 8).when(F.col("event_type") == "click", -6).when(F.col("event_type") == "purchase", 12).otherwise(-8)
    return t.events.groupBy("event_type").agg(COUNT(), F.sum(delta).alias("total"))


@query("WITH a AS (SELECT source AS profile, lang AS concept, l.quality = 1 AS objective, CASE WHEN l.doc_id IS NULL THEN least(2, d.n_chars // 2000) END AS self FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), r AS (SELECT *, CASE WHEN objective IS NOT NULL THEN CASE WHEN objective THEN 78 ELSE 20 END WHEN self IS NOT NULL THEN CASE self WHEN 0 THEN 15 WHEN 1 THEN 45 WHEN 2 THEN 78 ELSE 35 END ELSE 0 END AS score, CASE WHEN objective IS NOT NULL THEN 65 WHEN self IS NOT NULL THEN 30 ELSE 15 END AS confidence FROM a) SELECT profile, concept, arg_max(score, confidence * 1000 + score) AS score, max(confidence) AS confidence FROM r GROUP BY 1, 2")
def st4_assessment(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("objective"), F.lit(1).alias("has")), "doc_id", "left")
    own = F.when(F.col("has").isNull(), F.least(F.lit(2), F.floor(F.col("n_chars") / 2000)))
    return lr.assess(d.select(F.col("source").alias("profile"), F.col("lang").alias("concept"), "objective", own.alias("self")))


@query(f"WITH {REPLAY_SQL}, {PRE_SQL}, w AS (SELECT * FROM folded WHERE score < 450), u AS (SELECT w.profile, w.concept AS target, f.concept, f.score FROM w JOIN pre ON pre.target = w.concept JOIN folded f ON f.profile = w.profile AND f.concept = pre.source AND f.score < 450), b AS (SELECT profile, concept, score FROM u UNION SELECT profile, concept, score FROM w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.profile = w.profile AND u.target = w.concept)) SELECT profile, concept, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score, concept) AS rank FROM b) WHERE rank <= 3")
def gr16_concept_gaps(t: Tables) -> DataFrame:
    pre = F.broadcast(t.spark.createDataFrame(PREREQUISITES, "source string, target string"))
    return lr.gaps(pre, lr.replay(t.mastery()), 450)


@query(f"WITH {MASTERY_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts DESC, event_id DESC) AS n FROM mastery) WHERE n <= 200) SELECT profile, concept, count(*) AS n, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS last_event FROM top GROUP BY 1, 2")
def agg13_mastery_overview(t: Tables) -> DataFrame:
    top = op.top_per_key(t.mastery(), ["profile"], [F.desc("ts"), F.desc("event_id")], 200)
    return top.groupBy("profile", "concept").agg(COUNT(), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("WITH c AS (SELECT p_partkey AS item, p_size AS size, p_type AS kind, CAST(round(p_retailprice * 100) AS BIGINT) AS score FROM part), a AS (SELECT * FROM c WHERE kind LIKE '%STEEL%' ORDER BY score DESC, item LIMIT 4), b AS (SELECT * FROM c WHERE size < 10 AND item NOT IN (SELECT item FROM a) ORDER BY score DESC, item LIMIT 7), d AS (SELECT * FROM c WHERE item NOT IN (SELECT item FROM a UNION ALL SELECT item FROM b) ORDER BY score DESC, item LIMIT (SELECT 18 - count(*) FROM (SELECT item FROM a UNION ALL SELECT item FROM b))) SELECT item, 0 AS pool FROM a UNION ALL SELECT item, 1 FROM b UNION ALL SELECT item, 2 FROM d")
def st8_curriculum_plan(t: Tables) -> DataFrame:
    c = t.part.select(F.col("p_partkey").alias("item"), "p_size", "p_type", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("score"))
    return lr.plan(c, [(F.col("p_type").contains("STEEL"), 4), (F.col("p_size") < 10, 7)], [F.desc("score"), F.asc("item")], 18).select("item", "pool")


@query("WITH done AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_quantity = 50), c AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_size, p_partkey) AS k FROM part WHERE p_partkey NOT IN (SELECT item FROM done)), o AS (SELECT count(*) AS n FROM done) SELECT item, n + k AS ordinal FROM c, o")
def st9_replan(t: Tables) -> DataFrame:
    done = t.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("item")).distinct()
    left = t.part.select(F.col("p_partkey").alias("item"), "p_size").join(done, "item", "left_anti")
    # One sort for each size, then offsets of sizes: no window over all rows.
    sizes = left.groupBy("p_size").agg(COUNT()).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    k = F.row_number().over(Window.partitionBy("p_size").orderBy("item"))
    return left.withColumn("k", k).join(sizes, "p_size").join(F.broadcast(done.agg(COUNT()))).select("item", (F.col("n") + F.col("before") + F.col("k")).alias("ordinal"))


@query("SELECT user_id AS profile, title, rank FROM (SELECT user_id, p_name || '#' || p_partkey AS title, row_number() OVER (PARTITION BY user_id ORDER BY k + abs(p_size - 25) * 10, p_size, p_name || '#' || p_partkey) AS rank FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) JOIN part ON p_partkey = k + 1) WHERE rank <= 6")
def st11_recommendation(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("profile"), F.get_json_object("props", "$.k").cast("bigint").alias("score"))
    p = t.part.select((F.col("p_partkey") - 1).alias("score"), F.col("p_size").alias("difficulty"), F.col("p_size").alias("minutes"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("title"), F.lit(25).alias("level"))
    return lr.recommend(e.join(p, "score")).select("profile", "title", "rank")


@query("WITH k AS (SELECT user_id AS profile, ts, event_id, CASE event_type WHEN 'error' THEN 'needs_help' WHEN 'purchase' THEN 'understood' ELSE 'opened' END AS kind FROM events) SELECT profile, count(*) FILTER (WHERE kind = 'opened') AS opened, count(*) FILTER (WHERE kind = 'understood') AS understood, count(*) FILTER (WHERE kind = 'needs_help') AS help, list_reduce(list_prepend(2, list(CASE kind WHEN 'needs_help' THEN -1 WHEN 'understood' THEN 1 ELSE 0 END ORDER BY ts, event_id)), lambda a, x: least(greatest(a + x, 0), 2)) AS style FROM k GROUP BY 1")
def st6_progress_fold(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "needs_help").when(F.col("event_type") == "purchase", "understood").otherwise("opened")
    return lr.reduce_progress(t.events.select(F.col("user_id").alias("profile"), "ts", "event_id", kind.alias("kind")))


@query("SELECT l_orderkey, arg_min(kind, p) AS activity FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'throw' WHEN l_returnflag = 'A' THEN 'return' ELSE 'call' END AS kind, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS p FROM lineitem) GROUP BY 1")
def st12_activity_priority(t: Tables) -> DataFrame:
    kind = fx.first_match([(F.col("l_returnflag") == "R", "throw"), (F.col("l_returnflag") == "A", "return")], "call")
    return t.lineitem.select("l_orderkey", kind.alias("kind")).groupBy("l_orderkey").agg(F.min_by("kind", op.priority_order("kind", ["throw", "return", "call"])).alias("activity"))


@query("SELECT conv_id, sum(CASE WHEN role = 'user' THEN 5 ELSE 12 END * CASE WHEN length(text) > 200 THEN 2 ELSE 1 END)::BIGINT AS minutes FROM conversations GROUP BY 1")
def agg18_minutes(t: Tables) -> DataFrame:
    minutes = F.when(F.col("role") == "user", 5).otherwise(12) * F.when(F.length("text") > 200, 2).otherwise(1)
    return t.conversations.groupBy("conv_id").agg(F.sum(minutes).cast("bigint").alias("minutes"))


# -- evaluation --------------------------------------------------------------------------------
@query("SELECT (SELECT count(*) FROM labels WHERE toxic = 1) AS expected, count(*) AS found, count(*) FILTER (WHERE l.toxic = 1) AS matched, round(count(*) FILTER (WHERE l.toxic = 1) / greatest(1, (SELECT count(*) FROM labels WHERE toxic = 1)), 6) AS recall, round(count(*) FILTER (WHERE l.toxic = 1) / greatest(1, count(*)), 6) AS precision FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE regexp_matches(lower(text), 'idiot|moron|clown|stupid')")
def ev3_recall_precision(t: Tables) -> DataFrame:
    actual = t.documents.filter(F.lower("text").rlike("idiot|moron|clown|stupid")).select("doc_id")
    return ev.set_quality(actual, t.labels.filter("toxic = 1"), ["doc_id"])


@query("WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM labels) SELECT n, round(good / greatest(1, n), 6) AS share, good / greatest(1, n) >= 0.5 AND n <= 1000000000 AS passed FROM r")
def ev5_threshold_gate(t: Tables) -> DataFrame:
    report = t.labels.agg(COUNT(), F.count_if(F.col("quality") == 1).alias("good")).select("n", F.round(F.col("good") / F.greatest(F.lit(1), "n"), 6).alias("share"))
    return ev.gate(report, {"share": 0.5}, {"n": 1e9})


@query("WITH gold AS (SELECT b.item_id AS q, d.doc_id AS i FROM benchmark b JOIN documents d ON position(b.text IN d.text) > 0), w AS (SELECT item_id AS q, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark), p AS (SELECT doc_id AS i, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents), s AS (SELECT q, i, count(*) AS n FROM w JOIN p USING (term) GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, i) AS rank FROM s), f AS (SELECT g.q, min(rank) AS rank FROM gold g LEFT JOIN h ON h.q = g.q AND h.i = g.i AND h.rank <= 8 GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1 / rank, 0.0)), 6) AS mrr FROM f")
def ev1_retrieval_quality(t: Tables) -> DataFrame:
    words = fx.tokens(F.col("text"))
    begins, ends = (F.lower("text").rlike(pattern).cast("int") for pattern in ("^[a-z0-9]", r"[a-z0-9]\z"))
    # A passage may begin and end within a document's words, but has all of its others; one without others is searched for everywhere.
    inner = F.size(F.array_distinct(F.slice(words, begins + 1, F.greatest(F.lit(0), F.size(words) - begins - ends))))
    passages = t.benchmark.filter("text is not null").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), F.array_distinct(words).alias("terms"), F.when(inner > 0, inner).alias("need"))
    documents = t.documents.filter("text is not null").select(F.col("doc_id").alias("item"), F.col("text").alias("content"))
    pairs = written(rt.by_words(documents.select("item", F.array_distinct(fx.tokens(F.col("content"))).alias("terms")), passages, 8), "word-pairs")
    hits = op.top_per_key(pairs, ["query_id"], [F.desc("n"), F.asc_nulls_last("item")], 8)
    full = pairs.filter("enough").select(F.col("query_id").alias("_q"), F.col("item").alias("_i"))
    found = full.join(passages, F.col("_q").eqNullSafe(F.col("query_id"))).join(documents, F.col("_i").eqNullSafe(F.col("item")))
    anywhere = documents.join(F.broadcast(passages.filter("need is null")))
    gold = found.select("query_id", "item", "passage", "content").unionByName(anywhere.select("query_id", "item", "passage", "content"))
    return ev.retrieval_quality(hits, gold.filter(F.col("content").contains(F.col("passage"))).select("query_id", "item"), 8)


@query("WITH RECURSIVE pairs AS MATERIALIZED (SELECT l_suppkey AS l, l_partkey AS r, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2), g(n, pick, ls, rs) AS (SELECT 0, NULL::STRUCT(l BIGINT, r BIGINT, s DOUBLE), []::BIGINT[], []::BIGINT[] UNION ALL SELECT n + 1, best, list_append(ls, best.l), list_append(rs, best.r) FROM (SELECT n, ls, rs, arg_min({'l': p.l::BIGINT, 'r': p.r::BIGINT, 's': p.score::DOUBLE}, {'s': -p.score, 'l': p.l, 'r': p.r}) AS best FROM g JOIN pairs p ON NOT list_contains(ls, p.l) AND NOT list_contains(rs, p.r) GROUP BY n, ls, rs)) SELECT pick.l AS \"left\", pick.r AS \"right\", pick.s AS score FROM g WHERE n > 0")
def join20_greedy_matching(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right")).agg(F.sum("l_quantity").alias("score"))
    return ev.greedy_matching(pairs)


# -- composites --------------------------------------------------------------------------------
@query("WITH s AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id ORDER BY toxic, quality) AS n FROM labels) SELECT d.doc_id, coalesce('label ' || s.quality, 'doc ' || d.source) AS label FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND n = 1")
def cp10_label_overrides(t: Tables) -> DataFrame:
    first = t.labels.groupBy("doc_id").agg(F.min_by("quality", F.struct("toxic", "quality")).alias("quality"))
    return t.documents.select("doc_id", "source").join(first, "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("label "), F.col("quality").cast("string")), F.concat(F.lit("doc "), "source")).alias("label"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey")
def cp13_earliest_membership(t: Tables) -> DataFrame:
    first = t.orders.filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return t.customer.select("c_custkey").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY THEN 'failed' ELSE o_orderstatus END AS status FROM orders")
def cp14_abandoned_jobs(t: Tables) -> DataFrame:
    last = F.broadcast(t.orders.agg(F.max("o_orderdate").alias("now")))
    return t.orders.join(last).select("o_orderkey", F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.col("now") - F.expr("INTERVAL 60 DAYS")), "failed").otherwise(F.col("o_orderstatus")).alias("status"))


# -- sinks as plans ----------------------------------------------------------------------------
@query("SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2")
def snk2_upsert(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    table, new = rows.filter("event_type <> 'view'"), rows
    return op.upsert(table.dropDuplicates(["user_id", "event_type", "event_id"]), new, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "value")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_acctbal <= 0")
def snk3_insert_if_absent(t: Tables) -> DataFrame:
    table = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name")
    return op.insert_if_absent(table, t.customer.select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name")), ["c_custkey"])


@query("SELECT event_id FROM events WHERE NOT (ts < (SELECT max(ts) FROM events) - INTERVAL 90 DAY AND value < 10)")
def snk4_conditional_delete(t: Tables) -> DataFrame:
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    return t.events.join(now).filter(~((F.col("ts") < F.col("now") - F.expr("INTERVAL 90 DAYS")) & (F.col("value") < 10))).select("event_id")
