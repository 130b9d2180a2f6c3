"""Quality against gold sets."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .matching import greedy_matching


def retrieval_quality(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``queries, recall, mrr`` of hits (query_id, item, rank) against gold (query_id, item): any expected item counts."""
    first = gold.join(hits.filter(F.col("rank") <= k), ["query_id", "item"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    found = F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)
    return first.agg(F.count("*").alias("queries"), F.round(F.avg(found), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def set_quality(actual: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """``expected, found, matched, recall, precision`` of distinct keys; empty sides count as one to divide by."""
    a, g = actual.select(*key).distinct().withColumn("_a", F.lit(1)), gold.select(*key).distinct().withColumn("_g", F.lit(1))
    both = a.join(g, key, "full").agg(F.count("_g").alias("expected"), F.count("_a").alias("found"), F.count_if(F.col("_a").isNotNull() & F.col("_g").isNotNull()).alias("matched"))
    ratio = lambda n: F.round(F.col("matched") / F.greatest(F.lit(1), n), 6)
    return both.withColumns({"recall": ratio("expected"), "precision": ratio("found")})


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query, expected`` of a gold set in JSON lines: each case has id, query and expected_any, a list of paths."""
    cases = spark.read.schema("id bigint, query string, expected_any array<struct<path: string>>").json(path)
    return cases.select(F.col("id").alias("query_id"), "query", F.explode("expected_any").alias("e")).select("query_id", "query", F.col("e.path").alias("expected"))


#: Rows (flow, step) of a block of flows on either side.
FLOW_ROWS = 262_144


def _flow_blocks(flows: DataFrame, name: str) -> DataFrame:
    """Numbered flows (id number, step number) in blocks of about ``FLOW_ROWS``, all of a flow in one."""
    rows = flows.count()
    blocks = max(1, -(-rows // FLOW_ROWS))
    packed = flows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("id", "step")).alias("e"))
    return packed.select(F.col("e.id").alias(f"{name}_ids"), F.col("e.step").alias(f"{name}_steps"))


def _shared_steps(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """``gold_id, actual_id, overlap`` of distinct (gold_id, step) and (actual_id, step): how many steps they share.

    Rows of one step are never paired one by one: a task multiplies a block of gold flows with a block of actual
    ones, and has for each pair of flows one row.
    """
    actual = actual.select(F.struct("actual_id").alias("actual_id"), "step")  # a null id is an id
    steps = _numbered(gold.select("step").join(actual.select("step").distinct(), "step", "left_semi").distinct(), "step")
    golds, actuals = _numbered(gold.select("gold_id").distinct(), "gold_id"), _numbered(actual.select("actual_id").distinct(), "actual_id")

    def side(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        numbered = df.join(_as(steps, "step", "_s"), "step").join(_as(ids, name, "_i"), name)
        return written(numbered.select(F.col("_i").alias("id"), F.col("_s").alias("step")), "flow-steps")

    left, right = _flow_blocks(side(gold, golds, "gold_id"), "g"), _flow_blocks(side(actual, actuals, "actual_id"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g, gs, a, s = (batch.column(c)[row].values.to_numpy() for c in range(4))
                known, step = np.unique(s, return_inverse=True)
                names, at = np.unique(a, return_inverse=True)
                place = np.minimum(np.searchsorted(known, gs), max(0, len(known) - 1))
                keep = known[place] == gs if len(known) else np.zeros(len(gs), bool)
                order = np.argsort(g[keep], kind="stable")
                flow, place = g[keep][order], place[keep][order]
                starts = np.flatnonzero(np.r_[True, flow[1:] != flow[:-1]]) if len(flow) else np.zeros(0, np.int64)
                for b in range(0, len(names), 256):
                    own = (at >= b) & (at < b + 256)
                    has = np.zeros((len(known), min(256, len(names) - b)), np.int32)
                    has[step[own], at[own] - b] = 1
                    for x in range(0, len(starts), 128):
                        first, past = starts[x], starts[x + 128] if x + 128 < len(starts) else len(flow)
                        n = np.add.reduceat(has[place[first:past]], starts[x : x + 128] - first, axis=0)
                        i, j = np.nonzero(n)
                        yield pa.RecordBatch.from_arrays([pa.array(flow[starts[x : x + 128]][i]), pa.array(names[b + j]), pa.array(n[i, j].astype(np.int64))], ["_g", "_a", "overlap"])

    found = left.join(right).select("g_ids", "g_steps", "a_ids", "a_steps").mapInArrow(run, "_g bigint, _a bigint, overlap bigint")
    return found.join(_as(golds, "gold_id", "_g"), "_g").join(_as(actuals, "actual_id", "_a"), "_a").select("gold_id", "actual_id.actual_id", "overlap")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Distinct values with numbers: any, but each its own."""
    return written(df.filter(F.col(name).isNotNull()).withColumn("_number", F.monotonically_increasing_id()), "numbers")


def _as(numbers: DataFrame, name: str, number: str) -> DataFrame:
    return numbers.select(name, F.col("_number").alias(number))


def matched_flows(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """``gold_id, actual_id`` one to one: greedy by coverage of the gold flow's steps, then by how many, then by ids.

    Only flows that share a step can be matched. Gold flows without an id are none.
    """
    size = gold.groupBy("gold_id").agg(F.count_distinct("step").alias("size"))
    shared = _shared_steps(gold.select("gold_id", "step").distinct(), actual.select("actual_id", "step").distinct())
    score = F.struct((F.col("overlap") / F.col("size")).alias("coverage"), "overlap")
    pairs = shared.join(size, "gold_id").select(F.col("gold_id").alias("left"), F.col("actual_id").alias("right"), score.alias("score"))
    return greedy_matching(pairs).select(F.col("left").alias("gold_id"), F.col("right").alias("actual_id"))


def flow_quality(gold: DataFrame, actual: DataFrame, pairs: DataFrame, least: float = 1.0) -> DataFrame:
    """``features, feature_recall, step_recall, verified_precision`` of flows matched by ``pairs``.

    A gold flow is found if its match has ``least`` of its steps; a verified step is right if its
    flow's match expects it.
    """
    seen = actual.select("actual_id", "step").distinct().withColumn("hit", F.lit(1))
    each = gold.join(pairs, "gold_id", "left").join(seen, ["actual_id", "step"], "left").groupBy("gold_id").agg(F.count("*").alias("expected"), F.count("hit").alias("hit"))
    ratio = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 4)
    recall = each.agg(F.count("*").alias("features"), ratio(F.count_if(F.col("hit") >= F.lit(least) * F.col("expected")), F.count("*")).alias("feature_recall"), ratio(F.sum("hit"), F.sum("expected")).alias("step_recall"))
    right = gold.join(pairs, "gold_id").select("actual_id", "step").distinct().withColumn("ok", F.lit(1))
    precision = actual.filter("verified").join(right, ["actual_id", "step"], "left").agg(ratio(F.count("ok"), F.count("*")).alias("verified_precision"))
    return recall.join(F.broadcast(precision))


def story_quality(roles: DataFrame, gold: DataFrame, low: int = 3, high: int = 12) -> DataFrame:
    """Recall and verified precision of roles (id, verified, filled, fields, generic) against gold ids, their narrative, and whether their number is in order."""
    known = gold.select("id").distinct().withColumn("gold", F.lit(True))
    both = roles.withColumn("role", F.lit(True)).join(known, "id", "full")
    ratio = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 4)
    n, role, gold_too = F.count("role"), F.col("role").isNotNull(), F.col("gold").isNotNull()
    return both.agg(
        ratio(F.count_if(role & gold_too), F.count("gold")).alias("role_recall"),
        ratio(F.count_if(F.col("verified") & gold_too), F.count_if(F.col("verified"))).alias("verified_role_precision"),
        ratio(F.sum("filled"), F.sum("fields")).alias("narrative_coverage"),
        ratio(F.count_if(F.col("generic")), n).alias("generic_ratio"),
        ((n >= low) & (n <= high)).alias("count_compliant"),
    )


def confidence_counts(payload: Column) -> dict[str, Column]:
    """How often each confidence stands in a JSON text, at any depth."""
    found = lambda name: F.regexp_count(payload, F.lit(f'"confidence"\\s*:\\s*"{name}"')).cast("bigint")
    return {name: found(name) for name in ("verified", "inferred", "unknown")}


def dependency_fingerprint(evidence: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A hash of each key's distinct pieces of evidence, in order; a key is one artifact, whose evidence fits a row."""
    piece = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    joined = F.array_join(F.array_sort(F.collect_set(piece)), "\n")
    return evidence.groupBy(*key).agg(F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("fingerprint"))


def gate(report: DataFrame, at_least: Mapping[str, float], at_most: Mapping[str, float]) -> DataFrame:
    """Whether every metric of the one-row report is within its threshold."""
    ok = F.lit(True)
    for name, least in at_least.items():
        ok = ok & (F.col(name) >= least)
    for name, most in at_most.items():
        ok = ok & (F.col(name) <= most)
    return report.withColumn("passed", ok)
