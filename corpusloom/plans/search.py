"""Retrieval, caching and text functions over documents, benchmark passages, pages and embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import chunks as ch
from ..operators import grounded as gd
from ..operators import relational as op
from ..operators import retrieval as rt
from ..operators.lexical import Lexical
from ..operators.vector_index import VectorIndex
from ..session import shared_dir, written
from ..sources.tables import FILES_SQL, Tables
from .registry import Registry

query = Registry()
#: Paths that count as tests and as entry files here, and words of a query that hint at them.
NOISE, ENTRY = "^src1[0-9]?/", "^src[05]/"
HINTS = {"test": "was|est", "entry_point": "for"}

CHUNK_SQL = FILES_SQL + """, ls AS (SELECT file_id, path, language, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls, line_count AS n FROM files),
spans AS (SELECT * EXCLUDE (s), s AS start, least(n, s + 39) AS "end", lower(regexp_extract(ls[s], '[A-Za-z0-9]+')) AS symbol FROM (SELECT *, unnest(range(1, n + 1, 40)) AS s FROM ls)),
drafts AS (SELECT file_id, path, language, ls, 'file' AS kind, NULL AS symbol, s AS start, least(n, s + 19) AS "end", 1 AS specificity FROM (SELECT *, unnest(range(1, greatest(1, n - 5) + 1, 15)) AS s FROM ls)
  UNION ALL SELECT file_id, path, language, ls, 'symbol', symbol, start, "end", 3 FROM spans
  UNION ALL SELECT file_id, path, language, ls, 'block', symbol, b, least("end", b + 15), 2 FROM (SELECT *, unnest(range(start, greatest(start, "end" - 4) + 1, 12)) AS b FROM spans WHERE "end" - start + 1 > 16)),
chunks AS (SELECT file_id * 1000000 + row_number() OVER (PARTITION BY file_id ORDER BY start, "end", kind) AS chunk_id, row_number() OVER (PARTITION BY file_id ORDER BY start, "end", kind) AS ordinal, file_id, path, language, kind, symbol, start, "end", specificity,
  concat_ws('#', path, symbol) || CASE WHEN kind = 'symbol' THEN '' ELSE ' lines ' || start || '-' || "end" END AS title, array_to_string(ls[start:"end"], chr(10)) AS text FROM drafts)"""
TERM_SQL = """terms AS (SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM (
  SELECT query_id, term, min(pos) AS pos FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS pos FROM benchmark) WHERE length(term) >= 2 GROUP BY 1, 2)) WHERE n <= 10)"""
EXACT_SQL = """words AS (SELECT DISTINCT term FROM terms), names AS (SELECT DISTINCT path, symbol, title FROM chunks),
bands AS (SELECT path, symbol, title, term, greatest(CASE WHEN symbol = term THEN 1.0 WHEN contains(symbol, term) THEN 0.9 ELSE 0 END, CASE WHEN ends_with(lower(path), term) THEN 0.85 WHEN contains(lower(path), term) THEN 0.7 ELSE 0 END, CASE WHEN contains(lower(title), term) THEN 0.65 ELSE 0 END) AS band FROM names, words),
es AS (SELECT query_id, chunk_id, specificity, max(band)::DOUBLE AS score FROM chunks c JOIN bands b ON b.title = c.title AND b.symbol IS NOT DISTINCT FROM c.symbol AND b.band > 0 JOIN terms USING (term) GROUP BY 1, 2, 3),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, specificity DESC, chunk_id) AS rank FROM es) WHERE rank <= 24)"""
LEXICAL_SQL = """lw AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks),
ls2 AS (SELECT query_id, chunk_id, round(count(*) / 10, 6) AS score FROM lw JOIN terms USING (term) GROUP BY 1, 2), lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ls2) WHERE rank <= 24)"""
SELECTION_SQL = """sel AS (SELECT item_id AS query_id, item_id * 7 AS file_id, CASE WHEN item_id % 5 > 0 THEN 5 END AS first, CASE WHEN item_id % 5 > 0 THEN 30 END AS last FROM benchmark),
selection AS (SELECT query_id, chunk_id, rank, round(1.0 / rank, 6) AS score FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY start, "end", chunk_id) AS rank FROM chunks JOIN sel USING (file_id) WHERE coalesce(start <= last AND "end" >= first, true)) WHERE rank <= 24)"""
VECTOR_SQL = """cv AS (SELECT chunk_id, embedding::DOUBLE[] AS v FROM chunks JOIN embeddings ON vec_id = file_id WHERE ordinal = 1), qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id + 10),
vector AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv.v, cv.v), 9) DESC, chunk_id) AS rank FROM qv, cv) WHERE rank <= 24)"""
FUSED_SQL = f"WITH {CHUNK_SQL}, {TERM_SQL}, {EXACT_SQL}, {LEXICAL_SQL}, {SELECTION_SQL}, {VECTOR_SQL}, " + """fu AS (SELECT query_id, chunk_id, rank, 0 AS place, 1.5 / (60 + rank) AS part FROM exact UNION ALL SELECT query_id, chunk_id, rank, 1, 1.0 / (60 + rank) FROM lexical UNION ALL SELECT query_id, chunk_id, rank, 2, 1.25 / (60 + rank) FROM selection UNION ALL SELECT query_id, chunk_id, rank, 3, 1.0 / (60 + rank) FROM vector),
fused AS (SELECT query_id, chunk_id, round(CAST(sum(CAST(part AS DOUBLE)) AS DOUBLE), 10) AS score, min(place) AS first_retriever, arg_min(rank, place) AS first_rank FROM fu GROUP BY 1, 2)"""
ADJUST_SQL = f"""hints AS (SELECT item_id AS query_id, regexp_matches(lower(text), '{HINTS["test"]}') AS test, regexp_matches(lower(text), '{HINTS["entry_point"]}') AS entry_point FROM benchmark),
adj AS (SELECT f.*, specificity, round(f.score + CASE WHEN regexp_matches(path, '{NOISE}') AND NOT test THEN -0.015 ELSE 0 END + CASE WHEN entry_point AND regexp_matches(path, '{ENTRY}') THEN 0.018 ELSE 0 END + CASE WHEN entry_point AND regexp_matches(path, '{NOISE}') THEN -0.012 ELSE 0 END, 10) AS s2 FROM fused f JOIN chunks USING (chunk_id) JOIN hints USING (query_id)),
final AS (SELECT query_id, chunk_id, s2 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, specificity DESC, first_retriever, first_rank, chunk_id) AS rank FROM adj) WHERE rank <= 8)"""
FINAL_SQL = f"{FUSED_SQL}, {ADJUST_SQL}"


def chunked(files: Tables | DataFrame) -> DataFrame:
    """Chunks of the files: windows of 20 lines, spans of 40 as symbols named by their first word, and blocks of 16 lines in them."""
    if isinstance(files, Tables):
        files = files.files()
    n = F.size("_lines")
    name = lambda s: F.lower(F.regexp_extract(F.get("_lines", s - 1), "[A-Za-z0-9]+", 0))
    spans = F.transform(F.sequence(F.lit(1), n, F.lit(40)), lambda s: F.struct(s.alias("start"), F.least(n, s + 39).alias("end"), name(s).alias("name")))
    return ch.chunks(files, 20, 5, spans, 16, 4).withColumn("chunk_id", F.col("file_id") * 1_000_000 + F.col("ordinal"))


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def terms(t: Tables) -> DataFrame:
    return rt.query_terms(asked(t), F.col("text"))


def selections(t: Tables) -> DataFrame:
    inside = F.col("item_id") % 5 > 0
    return t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7).alias("file_id"), F.when(inside, 5).alias("first"), F.when(inside, 30).alias("last"))


def vectors(t: Tables, slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Given vectors: a file's stands for its first chunk; queries have others."""
    of_chunks = slim.filter("ordinal = 1").join(t.embeddings, F.col("file_id") == F.col("vec_id")).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    return of_chunks, t.benchmark.join(t.embeddings, F.col("vec_id") == F.col("item_id") + 10).select(F.col("item_id").alias("id"), F.col("embedding").alias("vector"))


def slim(t: Tables) -> DataFrame:
    """Chunks without their text, cut once and written."""
    return written(chunked(t).select("chunk_id", "file_id", "path", "symbol", "title", "start", "end", "specificity", "ordinal"), "chunks")


def index(t: Tables) -> Lexical:
    """The lexical index of the files, in the shared folder: what another query has built is used again, less the files that have changed."""
    at = hashlib.sha256(t.folder.encode()).hexdigest()[:16]
    return Lexical.at(f"{shared_dir(t.spark)}/lexical-{at}", t.files(), chunked)


def fused(t: Tables, chunks: DataFrame, embedded: bool = True) -> DataFrame:
    q = written(terms(t), "terms")
    of_chunks, of_queries = vectors(t, chunks)
    by_vector, _ = rt.by_vector(of_chunks, of_queries if embedded else None)
    return rt.fuse({"exact": rt.exact(chunks, q), "lexical": rt.lexical(index(t), q), "selection": rt.selected(chunks, selections(t)), "vector": by_vector})


def final(t: Tables, chunks: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    hints = rt.query_hints(asked(t), F.col("text"), HINTS)
    return rt.rerank(fused(t, chunks) if candidates is None else candidates, chunks, hints, NOISE, ENTRY)


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'where|find|wo|donde') THEN 'locate' WHEN regexp_matches(lower(text), 'how|why|the') THEN 'explain' ELSE 'general' END AS intent, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)))::BIGINT AS n_terms FROM conversations")
def ret1_query_analysis(t: Tables) -> DataFrame:
    q = F.lower("text")
    words = F.array_distinct(F.filter(fx.tokens(F.col("text")), lambda w: F.length(w) >= 2))
    return t.conversations.select("conv_id", "turn", fx.first_match([(q.rlike("where|find|wo|donde"), "locate"), (q.rlike("how|why|the"), "explain")], "general").alias("intent"), F.size(words).cast("bigint").alias("n_terms"))


@query(f"WITH {CHUNK_SQL}, {TERM_SQL}, {EXACT_SQL} SELECT query_id, chunk_id, score, rank FROM exact")
def ret2_exact_retriever(t: Tables) -> DataFrame:
    return rt.exact(slim(t), terms(t)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {CHUNK_SQL}, {TERM_SQL}, {LEXICAL_SQL} SELECT query_id, chunk_id, score, rank FROM lexical")
def ret3_lexical_retriever(t: Tables) -> DataFrame:
    return rt.lexical(index(t), terms(t)).select("query_id", "chunk_id", "score", "rank")


@query("SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) DESC, r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0) WHERE rank <= 8")
def ret4_vector_topk(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rt.nearest(v, v.filter("id % 20 = 0"), 8).select("query_id", "id", "rank")


@query()
def ret4_vector_index(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return VectorIndex(v).nearest(v.filter("id % 20 = 0"), 8).select("query_id", "id", "rank")


@query(f"WITH {CHUNK_SQL}, {SELECTION_SQL} SELECT query_id, chunk_id, rank, score FROM selection")
def ret5_selection_retriever(t: Tables) -> DataFrame:
    return rt.selected(chunked(t), selections(t)).select("query_id", "chunk_id", "rank", "score")


@query(FUSED_SQL + " SELECT query_id, chunk_id, score, first_retriever, first_rank FROM fused")
def ret6_rrf_fusion(t: Tables) -> DataFrame:
    return fused(t, slim(t))


@query(FINAL_SQL + " SELECT f.query_id, f.chunk_id, round(a.s2 - f.score, 6) AS adjustment FROM fused f JOIN adj a ON a.query_id = f.query_id AND a.chunk_id = f.chunk_id")
def ret7_structural_rerank(t: Tables) -> DataFrame:
    chunks = slim(t)
    f = written(fused(t, chunks), "fused")
    all_of_them = rt.rerank(f, chunks, rt.query_hints(asked(t), F.col("text"), HINTS), NOISE, ENTRY, hits=1 << 30)
    before = f.select("query_id", "chunk_id", F.col("score").alias("before"))
    return all_of_them.join(before, ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.round(F.col("score") - F.col("before"), 6).alias("adjustment"))


@query(FINAL_SQL + " SELECT query_id, chunk_id, score, rank FROM final")
def ret8_hybrid_retrieval(t: Tables) -> DataFrame:
    return final(t, slim(t))


@query(FINAL_SQL + " SELECT f.query_id, f.chunk_id, x.rank AS final_rank, x.rank IS NOT NULL AS selected FROM fused f LEFT JOIN final x ON x.query_id = f.query_id AND x.chunk_id = f.chunk_id")
def ret9_candidate_trace(t: Tables) -> DataFrame:
    chunks = slim(t)
    f = written(fused(t, chunks), "fused")
    return rt.trace(f, final(t, chunks, f)).select("query_id", "chunk_id", "final_rank", "selected")


@query(FUSED_SQL.replace(" UNION ALL SELECT query_id, chunk_id, rank, 3, 1.0 / (60 + rank) FROM vector", "") + " SELECT query_id, chunk_id, score, 'unavailable' AS vector_status FROM fused")
def ret10_without_vectors(t: Tables) -> DataFrame:
    _, status = rt.by_vector(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), None)
    return fused(t, slim(t), embedded=False).select("query_id", "chunk_id", "score", F.lit(status).alias("vector_status"))


@query(f"WITH {CHUNK_SQL} SELECT chunk_id FROM chunks WHERE file_id IN (SELECT file_id FROM files WHERE language <> 'es')")
def ret11_evidence_verification(t: Tables) -> DataFrame:
    stale = F.when(F.col("language") == "es", F.lit("sha256:old")).otherwise(F.col("content_hash"))
    claims = chunked(t).join(t.files().select("file_id", stale.alias("file_hash")), "file_id")
    return rt.verified(claims, t.files()).select("chunk_id")


@query("WITH p AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS flat FROM documents) SELECT doc_id, CASE WHEN length(flat) > 320 THEN rtrim(flat[1:319], ' ') || '…' ELSE flat END AS preview FROM p")
def ret12_preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fx.preview(F.col("text")).alias("preview"))


@query(FINAL_SQL + ", h AS (SELECT f.*, c.file_id FROM final f JOIN chunks c USING (chunk_id)), l AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY rank) AS n FROM h), d AS (SELECT *, row_number() OVER (PARTITION BY query_id, n = 1 ORDER BY rank) AS k FROM l) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 1 AND k <= 3 THEN 0 ELSE 1 END, rank) AS answer_rank FROM d")
def ret13_answer_selection(t: Tables) -> DataFrame:
    chunks = slim(t)
    hits = final(t, chunks).join(chunks.select("chunk_id", "file_id"), "chunk_id")
    return rt.spread_answers(hits, ["file_id"]).select("query_id", "chunk_id", "answer_rank")


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, 'l' || label || ':' || vec_id AS f, label AS m FROM embeddings WHERE vec_id % 3 > 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS v, 'l' || label || ':' || vec_id AS f, CASE WHEN vec_id % 40 = 0 THEN label + 1 ELSE label END AS m FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT r.vec_id AS id, e.vec_id AS entry FROM r JOIN e USING (f)), n AS (SELECT r.vec_id AS id, e.vec_id AS near, row_number() OVER (PARTITION BY r.vec_id ORDER BY round(list_cosine_similarity(r.v, e.v), 9) DESC, e.vec_id) AS k, round(list_cosine_similarity(r.v, e.v), 9) AS s FROM r, e WHERE r.vec_id NOT IN (SELECT id FROM x)), h AS (SELECT r.vec_id AS id, r.m, x.entry, n.near, coalesce(x.entry, n.near) AS hit FROM r LEFT JOIN x ON x.id = r.vec_id LEFT JOIN n ON n.id = r.vec_id AND n.k = 1 AND n.s >= 0.3), q AS (SELECT h.*, e.m IS DISTINCT FROM h.m AND hit IS NOT NULL AS other FROM h LEFT JOIN e ON e.vec_id = hit) SELECT id, CASE WHEN NOT other THEN hit END AS entry, CASE WHEN other THEN 'quarantined' WHEN entry IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'semantic' ELSE 'miss' END AS how FROM q")
def ret14_semantic_cache(t: Tables) -> DataFrame:
    mark = F.concat(F.lit("l"), F.col("label").cast("string"), F.lit(":"), F.col("vec_id").cast("string"))
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), mark.alias("fingerprint"), F.col("label").alias("manifest"))
    changed = F.when(F.col("id") % 40 == 0, F.col("manifest") + 1).otherwise(F.col("manifest"))
    return rt.cache_lookup(v.filter("id % 20 = 0").withColumn("manifest", changed), v.filter("id % 3 > 0"), 0.3)


@query("WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT user_id, event_type, max(ts) AS ts, max(ts) + INTERVAL 30 DAY AS until FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), live AS (SELECT e.* FROM e, m WHERE until > now), fresh AS (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2) SELECT user_id, event_type, ts FROM live UNION ALL SELECT user_id, event_type, ts FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.user_id = f.user_id AND l.event_type = f.event_type)")
def ret15_cache_store(t: Tables) -> DataFrame:
    latest = lambda *kinds: t.events.filter(F.col("event_type").isin(*kinds)).groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    live = latest("view", "click").join(now).filter(F.col("ts") + F.expr("INTERVAL 30 DAYS") > F.col("now")).drop("now")
    return op.insert_if_absent(live, latest("view", "purchase"), ["user_id", "event_type"])


@query("SELECT doc_id, sha256('lang=' || lang || '&n_chars=' || n_chars || '&source=' || source) AS fingerprint FROM documents")
def ret16_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fx.fingerprint({"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")}).alias("fingerprint"))


@query("SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn) || ' ', '') || text AS rewritten FROM conversations")
def ret17_query_rewriting(t: Tables) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.concat(F.coalesce(F.concat(before, F.lit(" ")), F.lit("")), F.col("text")).alias("rewritten"))


# -- column functions --------------------------------------------------------------------------
@query("SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(p_name || '_' || p_brand || 'Xy', '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_.]+', ' ', 'g'), '[ \\t]+', ' ', 'g'))) AS words FROM part")
def fn1_expand_identifiers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fx.expand_identifiers(F.concat(F.col("p_name"), F.lit("_"), F.col("p_brand"), F.lit("Xy"))).alias("words"))


@query(f"WITH {CHUNK_SQL} SELECT chunk_id, kind, title, specificity, 'sha256:' || sha256(text) AS text_hash, ordinal FROM chunks")
def fn3_chunk_build(t: Tables) -> DataFrame:
    return chunked(t).select("chunk_id", "kind", "title", "specificity", "text_hash", "ordinal")


@query(f"WITH {CHUNK_SQL}, e AS (SELECT chunk_id, concat_ws(chr(10), 'path: ' || path, 'language: ' || language, 'chunk: ' || kind, 'title: ' || title, 'symbol: ' || symbol, 'source:', text, lower(trim(regexp_replace(regexp_replace(regexp_replace(title, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_.]+', ' ', 'g'), '[ \\t]+', ' ', 'g')))) AS whole FROM chunks) SELECT chunk_id, length(whole[1:24000]) AS n_chars, sha256(whole[1:24000]) AS digest FROM e")
def fn4_embedding_text(t: Tables) -> DataFrame:
    made = chunked(t).select("chunk_id", ch.embedding_text().alias("e"))
    return made.select("chunk_id", F.length("e").cast("bigint").alias("n_chars"), F.sha2("e", 256).alias("digest"))


@query()
def fn10_hash_embedding(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rt.hash_embedding(F.col("text")).alias("embedding"))


@query("SELECT item_id, trim(regexp_replace(lower('  ' || text || ' '), '[ \\t\\r\\n]+', ' ', 'g')) AS q FROM benchmark")
def fn7_normalize_query(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", fx.normalize_query(F.concat(F.lit("  "), F.col("text"), F.lit(" "))).alias("q"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, 'node_' || sha256(source || '|' || doc_id)[1:16] AS stable_id FROM documents")
def fn8_hashes_and_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fx.content_hash(F.col("text")).alias("content_hash"), fx.stable_id("node", F.col("source"), F.col("doc_id")).alias("stable_id"))


@query("SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month_start, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end FROM events")
def fn12_month_bounds(t: Tables) -> DataFrame:
    start = F.date_trunc("month", "ts")
    return t.events.select("event_id", F.date_format(start, "yyyy-MM-dd").alias("month_start"), F.date_format(F.add_months(start, 1), "yyyy-MM-dd").alias("month_end"))


@query("SELECT page_id, regexp_replace(regexp_replace(url || '/#top', '#.*$', ''), '/+$', '') AS url FROM pages")
def fn14_normalize_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fx.normalize_url(F.concat(F.col("url"), F.lit("/#top"))).alias("url"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]*(/.*)$', 1) || '/{id}/[x]/', '[?#].*$', ''), '(.)/+$', '\\1'), '\\{[^}]*\\}', '{}', 'g'), '\\[[^\\]]*\\]', '{}', 'g') AS path FROM pages WHERE regexp_extract(url, '^https?://[^/]*(/.*)$', 1) <> ''")
def fn15_request_path(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1)
    return t.pages.filter(path != "").select("page_id", fx.request_path(F.concat(path, F.lit("/{id}/[x]/"))).alias("path"))


@query("SELECT page_id, regexp_replace(regexp_replace(replace(url, '://', '://user:pw@') || '?k=1', '[?#].*$', ''), '://[^/@]*@', '://') AS url FROM pages")
def fn17_redact_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fx.redact_url(F.concat(F.replace("url", F.lit("://"), F.lit("://user:pw@")), F.lit("?k=1"))).alias("url"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?:token|secret|key|password) = '))::BIGINT AS n FROM documents")
def fn18_assignments(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(?:token|secret|key|password) = "), F.lit(0))).cast("bigint").alias("n"))


@query("SELECT host, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, 'https?://([^/\"<> ?#]+)', 1))) AS host FROM pages) GROUP BY 1 UNION ALL SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), count(*) FROM pages GROUP BY 1")
def fn19_hosts(t: Tables) -> DataFrame:
    inside = t.pages.select(F.explode(F.transform(F.regexp_extract_all("html", F.lit('https?://([^/"<> ?#]+)'), F.lit(1)), F.lower)).alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    return inside.unionByName(t.pages.groupBy(fx.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n")))


@query("SELECT doc_id, coalesce((SELECT min(i) FROM (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS l) WHERE position('the' IN l) > 0), 1) AS line FROM documents")
def fn23_first_line_with(t: Tables) -> DataFrame:
    at = F.array_position(F.transform(fx.lines(F.col("text")), lambda x: x.contains("the")), F.lit(True))
    return t.documents.select("doc_id", F.when(at > 0, at).otherwise(F.lit(1)).cast("bigint").alias("line"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`#>]+', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS clean FROM documents")
def fn21_clean_markdown(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fx.clean_markdown(F.col("text")).alias("clean"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '@' || split_part(p, '/', 1) || '/' || split_part(p, '/', 2) ELSE split_part(p, '/', 1) END AS package FROM (SELECT page_id, regexp_replace(url, '^https?://', '') || '/x/y' AS p FROM pages)")
def fn22_package_name(t: Tables) -> DataFrame:
    p = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("/x/y"))
    return t.pages.select("page_id", fx.package_name(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("@"), p)).otherwise(p)).alias("package"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)((?:api[_-]?key|token|secret|password)\\s*[=:]\\s*)(\"[^\"]*\"|''[^'']*''|[^\\s,;]+)', '\\1[redacted]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[redacted]', 'g') AS text FROM documents")
def fn27_redaction(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fx.redact_secrets(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^(no|not) ') THEN 'grounded' WHEN regexp_matches(lower(text), 'impact|change|refactor|tion') THEN 'deep' ELSE 'grounded' END AS route FROM conversations")
def fn28_route_classifier(t: Tables) -> DataFrame:
    q = F.lower("text")
    return t.conversations.select("conv_id", "turn", fx.first_match([(q.rlike("^(no|not) "), "grounded"), (q.rlike("impact|change|refactor|tion"), "deep")], "grounded").alias("route"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings")
def fn11_normalized(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
    return t.embeddings.select("vec_id", F.round(F.get(unit, F.lit(0)), 5).alias("first"))


# -- composites --------------------------------------------------------------------------------
@query(FINAL_SQL + """, rq AS (SELECT item_id AS id, item_id % 5 AS org, sha256(lower(text)) AS f, CASE WHEN item_id % 16 = 0 THEN 9 ELSE item_id % 3 END AS m, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id + 10),
en AS (SELECT item_id AS id, sha256(lower(text)) AS f, item_id % 3 AS m, embedding::DOUBLE[] AS v, 'answer-' || item_id AS answer FROM benchmark JOIN embeddings ON vec_id = item_id + 10 WHERE item_id % 4 = 0),
ex AS (SELECT rq.id, min(en.id) AS entry FROM rq JOIN en USING (f) GROUP BY 1),
nr AS (SELECT rq.id, en.id AS near, row_number() OVER (PARTITION BY rq.id ORDER BY round(list_cosine_similarity(rq.v, en.v), 9) DESC, en.id) AS k, round(list_cosine_similarity(rq.v, en.v), 9) AS s FROM rq, en WHERE rq.id NOT IN (SELECT id FROM ex)),
lk AS (SELECT rq.id, rq.org, rq.m, coalesce(ex.entry, near) AS hit, CASE WHEN ex.entry IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'semantic' ELSE 'miss' END AS how FROM rq LEFT JOIN ex USING (id) LEFT JOIN nr ON nr.id = rq.id AND k = 1 AND s >= 0.2),
tn AS (SELECT lk.id, lk.org, CASE WHEN hit IS NOT NULL AND en.m <> lk.m THEN 'quarantined' ELSE how END AS how, CASE WHEN en.m = lk.m THEN answer END AS answer FROM lk LEFT JOIN en ON en.id = lk.hit),
asking AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY id) AS nth FROM tn WHERE answer IS NULL),
kept AS (SELECT f.query_id, f.chunk_id, c.file_id, row_number() OVER (PARTITION BY f.query_id ORDER BY rank) AS k FROM final f JOIN chunks c USING (chunk_id) WHERE c.file_id % 6 <> 0 AND f.query_id IN (SELECT id FROM asking WHERE nth <= 4)),
spread AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY k) AS n FROM kept), lead AS (SELECT *, row_number() OVER (PARTITION BY query_id, n = 1 ORDER BY k) AS d FROM spread),
placed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 1 AND d <= 3 THEN 0 ELSE 1 END, k) AS a FROM lead),
made AS (SELECT query_id, string_agg('ev_' || chunk_id, ',' ORDER BY a) AS answer, 5 * count(*) AS cost FROM placed WHERE a <= 3 GROUP BY 1)
SELECT id, how, answer, 'free' AS status, 0 AS cost FROM tn WHERE answer IS NOT NULL UNION ALL SELECT id, how, made.answer, CASE WHEN nth > 4 THEN 'refused' WHEN made.answer IS NULL THEN 'insufficient' ELSE 'settled' END, coalesce(cost, 0) FROM asking LEFT JOIN made ON query_id = id""")
def cp9_grounded_turn(t: Tables) -> DataFrame:
    """Passages as requests of five orgs; a quarter of them is cached, of some the files have changed since."""
    n, print_ = F.col("item_id"), F.sha2(F.lower("text"), 256).alias("fingerprint")
    asked = t.benchmark.join(t.embeddings, F.col("vec_id") == n + 10)
    requests = asked.select(n.alias("id"), (n % 5).alias("org"), F.timestamp_seconds(n).alias("ts"), n.cast("string").alias("idempotency_key"), print_, F.col("embedding").alias("vector"), F.when(n % 16 == 0, 9).otherwise(n % 3).alias("manifest"))
    entries = asked.filter(n % 4 == 0).select(n.alias("id"), print_, F.col("embedding").alias("vector"), (n % 3).alias("manifest"), F.concat(F.lit("answer-"), n.cast("string")).alias("answer"))
    chunks = slim(t)

    def retrieve(ids: DataFrame) -> DataFrame:
        hits = written(final(t, chunks).join(ids, "query_id", "left_semi").join(chunks.select("chunk_id", "file_id"), "chunk_id"), "hits")
        files = t.files().join(hits.select("file_id").distinct(), "file_id", "left_semi")  # only files with hits are cut for their text
        made_of = files.select("file_id", F.when(F.col("file_id") % 6 == 0, F.lit("sha256:old")).otherwise(F.col("content_hash")).alias("file_hash"))
        return written(hits.join(chunked(files).select("chunk_id", "start", "end", "text"), "chunk_id").join(made_of, "file_id"), "evidence")

    prices = t.region.agg(F.count("*").cast("bigint").alias("micro_per_unit")).select(F.lit("answer").alias("usage_type"), F.lit("2024-01-01").alias("since"), "micro_per_unit")
    return gd.grounded_turns(requests, entries, retrieve, t.files(), prices, 40, 10, 0.2)


@query(f"WITH {CHUNK_SQL}, l AS (SELECT chunk_id, start, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM chunks), x AS (SELECT chunk_id, start, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l), y AS (SELECT chunk_id, start + pos AS line, regexp_replace(line, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g') AS source FROM x) SELECT chunk_id, 'seg_' || lpad(n::VARCHAR, 3, '0') AS segment_id, line, source FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY line) AS n FROM y WHERE source <> '') WHERE n <= 80")
def udtf3_line_segments(t: Tables) -> DataFrame:
    return ch.line_segments(chunked(t).select("chunk_id", "start", "text"))


@query(f"""WITH {CHUNK_SQL}, {SELECTION_SQL}, s AS (SELECT query_id, file_id, coalesce(first, 1) AS first, coalesce(last, 1) AS last FROM sel),
sym AS (SELECT query_id, arg_min(chunk_id, struct_pack(a := "end" - start, b := start)) AS symbol FROM s JOIN chunks c USING (file_id) WHERE kind = 'symbol' AND start <= first AND "end" >= last GROUP BY 1),
ov AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY start, chunk_id) AS n FROM s JOIN chunks USING (file_id) WHERE kind = 'block' AND start <= last AND "end" >= first)
SELECT s.query_id, symbol, coalesce(related, '') AS related FROM s SEMI JOIN chunks USING (file_id) LEFT JOIN sym USING (query_id) LEFT JOIN (SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY n) AS related FROM ov WHERE n <= 5 GROUP BY 1) USING (query_id)""")
def cp8_selection_explanation(t: Tables) -> DataFrame:
    wanted = selections(t).select("query_id", "file_id", F.coalesce("first", F.lit(1)).alias("start"), F.coalesce("last", F.lit(1)).alias("end"))
    wanted = wanted.join(t.files().select("file_id"), "file_id", "left_semi")
    chunks = chunked(t).select("chunk_id", "file_id", "kind", "start", "end")
    spans = chunks.filter("kind = 'symbol'").select("file_id", "start", "end", F.col("chunk_id").alias("span_id"))
    symbol = op.enclosing(wanted, spans, ["file_id"]).select("query_id", F.col("span_id").alias("symbol"))
    blocks = chunks.filter("kind = 'block'").select("file_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "chunk_id")
    near = op.top_per_key(op.overlapping(wanted, blocks, ["file_id"]), ["query_id"], [F.col("r_start"), F.col("chunk_id")], 5, "n")
    related = near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("related"))
    return wanted.select("query_id").join(symbol, "query_id", "left").join(related, "query_id", "left").select("query_id", "symbol", F.coalesce("related", F.lit("")).alias("related"))
