"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, htmltext, langid, linededup, mixing, neardup, quality, tokens, toxicity, warc, whitening
from ._store import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


#: Where the public vocabulary files are.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str, pieces: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = langid.train(docs, pieces, ~held_out)
    found = langid.predict(docs, model, carry=["doc_id"]).select("row.doc_id", "result.*")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_tokens(spark: SparkSession, sf_dir: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(table(spark, sf_dir, "documents"), path, tokenizer)
    return tokens.read(spark, path, ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.transactions(warc.read(spark, path), payload=False))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    sha = F.sha2(F.array_join("verdict.items", ","), 256)
    return found.select("row.doc_id", "verdict.n_words", "verdict.n_hit", "verdict.n_items", sha.alias("items_sha256"), "verdict.contaminated")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = toxicity.train(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, model, carry=["doc_id"]).select("row.doc_id", "result.score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), repeats=2.0)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).select("row.page_id", "row.url", "result.text", "result.n_chars")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest, carry=["doc_id"]).select("row.doc_id", *(f"result.{c}" for c in (*quality.COUNTS, "base_failed", "kept", "score")))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), carry=["vec_id", "label"])
    found = codes.with_label_errors(coded) if books else coded.withColumn("label_error", F.lit(None).cast("long"))
    return found.select("row.vec_id", "code", "error", "label_error", F.sha2(F.lit(books.text() if books else ""), 256).alias("codebooks_sha256"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table are records of a turn each; the conversation of control strings is one of a list of messages."""
    path, said = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}", "</s>[INST] ok [/INST]"
    whole = json.dumps({"messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    records = rows.unionAll(spark.range(1).select(F.lit(-7).cast("long"), F.lit(whole)))
    chat.write(chat.turns(records), path)
    return chat.digests(chat.read(spark, path)).withColumnRenamed("key", "conv_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return found.select("row.vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_linededup, op2_langid, op3_tokens, op4_warc, op5_decontaminate, op6_neardup, op7_toxicity, op8_mixing, op9_html, op10_quality, op11_codes, op12_chat, op13_whitening)}
#: Without fingerprints: every shortest window of 50 words, from a line on or up to a line, is compared with the first of the same lines.
LINE_DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
counted AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
placed AS (SELECT doc_id, pos, line, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS ended FROM counted WHERE n > 0),
begun AS (SELECT *, ended - n AS began FROM placed),
windows AS (
  SELECT 'ahead' AS kind, doc_id, pos, sum(n) OVER ahead AS size, max(pos) OVER ahead AS until_pos, list(line) OVER ahead AS content
  FROM begun WINDOW ahead AS (PARTITION BY doc_id ORDER BY began RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT 'back', doc_id, min(pos) OVER back, sum(n) OVER back, pos, list(line) OVER back
  FROM begun WINDOW back AS (PARTITION BY doc_id ORDER BY ended RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT doc_id, pos, until_pos, row_number() OVER (PARTITION BY kind, content ORDER BY doc_id, pos) AS nth FROM windows WHERE size >= 50),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.pos AND r.until_pos WHERE r.nth > 1),
marked AS (SELECT l.doc_id, l.line, l.pos, g.pos IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed
FROM marked GROUP BY doc_id
"""
#: What the archives have to say, straight from the pages.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS largest FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM m
"""
#: Lloyd's rounds one after the other, every part compared with every entry.
_CODES_ROUND = """,
near{r} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min({{'e': e, 'd': d, 'y': y}}, (d, e)) AS best FROM (
  SELECT p.*, b.entry AS e, b.y, list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts p JOIN book{r} b ON b.part = p.part) GROUP BY vec_id, label, part, x)"""
_CODES_MOVE = """,
sums{r} AS (SELECT part, best.e AS entry, pos, (sum(c) // count(*) - CASE WHEN sum(c) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS c
  FROM (SELECT part, best, unnest(x) AS c, unnest(range(len(x))) AS pos FROM near{r}) GROUP BY ALL),
book{s} AS MATERIALIZED (SELECT part, entry, coalesce(n.y, o.y) AS y FROM book{r} o
  LEFT JOIN (SELECT part, entry, list(c ORDER BY pos) AS y FROM sums{r} GROUP BY ALL) n USING (part, entry))"""
CODES_SQL = (
    """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
parts AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // 8 + 1 : (part + 1) * len(x) // 8] AS x FROM kept, range(8) t(part)),
book0 AS MATERIALIZED (SELECT part, (dense_rank() OVER (ORDER BY vec_id) - 1)::BIGINT AS entry, x AS y FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY 1 LIMIT 16))"""
    + "".join(_CODES_ROUND.format(r=r) + _CODES_MOVE.format(r=r, s=r + 1) for r in range(6))
    + _CODES_ROUND.format(r=6)
    + """,
coded AS (SELECT vec_id, label, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near6 GROUP BY vec_id, label)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM book6) AS codebooks_sha256 FROM coded
"""
)
#: Figures from the table's turns; the formatted length follows from the template.
CHAT_SQL = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
formed AS (SELECT *, len('{chat.START}') + 1 + len('<|im_end|>') + 1 + len(role)
  + len(regexp_replace(text, '([<\[])(\\*)({chat.TAILS})', '\1\\\2\3', 'g')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM formed GROUP BY conv_id
"""
ORACLE_SQL: dict[str, str] = {"op11_codes": CODES_SQL, "op12_chat": CHAT_SQL, "op1_linededup": LINE_DEDUP_SQL, "op4_warc": WARC_SQL}
