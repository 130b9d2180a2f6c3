"""Grounded turns: a cached answer where there is one, else one from verified evidence, within what is left of the allowance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ledger import priced, reservations
from .retrieval import cache_lookup, spread_answers, verified

#: Pieces of evidence of an answer.
EVIDENCE = 3


def grounded_turns(requests: DataFrame, entries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], files: DataFrame, prices: DataFrame, allowance: int, estimate: int, least: float, evidence: int = EVIDENCE) -> DataFrame:
    """``id, how, answer, status, cost``: what becomes of each request.

    ``requests`` has id, org, ts, idempotency_key, fingerprint, vector, manifest; ``entries`` id,
    fingerprint, vector, manifest, answer. A request is answered by the cache entry of its fingerprint or
    the nearest one of ``least`` similarity that was made of the same files, at no cost. Others reserve
    ``estimate`` of their org's allowance, in order; what is refused is not retrieved. ``retrieve`` has
    the hits of the rest (query_id, chunk_id, file_id, start, end, text, file_hash, rank). Hits that no longer
    are what their file says are dropped; the first ``evidence`` over distinct files are the answer, and
    are priced as usage of type ``answer``. Without any the request is insufficient and costs nothing.
    """
    looked = written(cache_lookup(requests, entries, least), "lookups")
    hits = looked.filter("entry is not null").join(entries.select(F.col("id").alias("entry"), "answer"), "entry").select("id", "how", "answer", F.lit("free").alias("status"), F.lit(0).cast("bigint").alias("cost"))
    asking = requests.join(looked.filter("entry is null").select("id", "how"), "id")
    held = reservations(asking.withColumn("estimate", F.lit(estimate)), allowance, "enforce", "org", ("ts", "id"), "estimate")
    held = written(asking.select("id", "org", "how").join(held.select("id", "status"), "id"), "reservations")
    refused = held.filter("status = 'refused'").select("id", "how", F.lit(None).cast("string").alias("answer"), "status", F.lit(0).cast("bigint").alias("cost"))
    open_ = held.filter("status = 'reserved'").select("id", "how")
    found = verified(retrieve(open_.select(F.col("id").alias("query_id"))), files)
    first = spread_answers(found, ["file_id"], evidence).filter(F.col("answer_rank") <= evidence)
    cited = F.transform(F.array_sort(F.collect_list(F.struct("answer_rank", "chunk_id"))), lambda x: F.concat(F.lit("ev_"), x["chunk_id"].cast("string")))
    made = first.groupBy("query_id").agg(F.array_join(cited, ",").alias("answer"), F.count("*").alias("units"))
    costed = priced(made.withColumn("usage_type", F.lit("answer")), prices).select(F.col("query_id").alias("id"), "answer", "cost")
    answered = open_.join(costed, "id", "left").select("id", "how", "answer", F.when(F.col("answer").isNull(), "insufficient").otherwise("settled").alias("status"), F.coalesce("cost", F.lit(0)).cast("bigint").alias("cost"))
    return hits.unionByName(refused).unionByName(answered)
