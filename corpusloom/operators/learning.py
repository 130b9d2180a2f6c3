"""Event-sourced scores, assessments, planners and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import clamped_sums
from .relational import top_per_key


#: Fixed values, in thousandths: what a concept begins with, and the score and confidence each kind of event adds.
START_SCORE, START_CONFIDENCE = 500, 350
DELTAS = {"understood": (80, 80), "needs_help": (-60, 80), "correct": (120, 150), "wrong": (-80, 120)}


def replay(events: DataFrame, start: int = START_SCORE, confidence: int = START_CONFIDENCE, low: int = 0, high: int = 1000) -> DataFrame:
    """``profile, concept, score, confidence, n`` in thousandths: deltas added in (ts, event_id) order, clamped at each step."""
    sums = {"score": ("delta", start, low, high), "confidence": ("confidence_delta", confidence, low, high)}
    return clamped_sums(events, ["profile", "concept"], ["ts", "event_id"], sums)


def state(score: Column) -> Column:
    """Mastery bucket of a score in thousandths."""
    return F.when(score >= 750, "strong").when(score >= 450, "developing").otherwise("weak")


def project(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``before, score, confidence_before, confidence`` of new absolute values that differ from the old ones.

    A key that has no old values is taken to have had the start score and no confidence.
    """
    known = old.select(*key, F.col("score").alias("before"), F.col("confidence").alias("confidence_before"))
    both = new.join(known, list(key), "left").withColumns({"before": F.coalesce("before", F.lit(START_SCORE)), "confidence_before": F.coalesce("confidence_before", F.lit(0))})
    return both.filter((F.col("score") != F.col("before")) | (F.col("confidence") != F.col("confidence_before"))).select(*key, "before", "score", "confidence_before", "confidence")


def assess(answers: DataFrame) -> DataFrame:
    """Score and confidence of each (profile, concept): objective answers beat self reports.

    ``answers`` has objective (true, false or null) and self (0, 1, 2 or null); values in hundredths.
    """
    score = F.when(F.col("objective").isNotNull(), F.when(F.col("objective"), 78).otherwise(20)).when(F.col("self").isNotNull(), F.when(F.col("self") == 0, 15).when(F.col("self") == 1, 45).when(F.col("self") == 2, 78).otherwise(35)).otherwise(0)
    confidence = F.when(F.col("objective").isNotNull(), 65).when(F.col("self").isNotNull(), 30).otherwise(15)
    rated = answers.withColumns({"score": score, "confidence": confidence})
    return rated.groupBy("profile", "concept").agg(F.max(F.struct("confidence", "score")).alias("m")).select("profile", "concept", F.col("m.score").alias("score"), F.col("m.confidence").alias("confidence"))


def gaps(prerequisites: DataFrame, scores: DataFrame, weak: int, limit: int = 3) -> DataFrame:
    """``profile, concept, score``: for each weak target its weak prerequisites, else the target itself; the weakest few of a profile."""
    s = scores.select("profile", "concept", "score")
    targets = s.filter(F.col("score") < weak)
    needed = targets.join(prerequisites, targets["concept"] == prerequisites["target"]).select("profile", F.col("target"), F.col("source").alias("concept"))
    unmet = needed.join(s, ["profile", "concept"]).filter(F.col("score") < weak)
    alone = targets.join(unmet.select("profile", F.col("target").alias("concept")).distinct(), ["profile", "concept"], "left_anti")
    both = unmet.select("profile", "concept", "score").unionByName(alone.select("profile", "concept", "score")).distinct()
    return top_per_key(both, ["profile"], [F.asc("score"), F.asc("concept")], limit)


def plan(candidates: DataFrame, pools: Sequence[tuple[Column, int]], order: Sequence[Column], total: int) -> DataFrame:
    """Items for a curriculum: a quota from each pool in turn, none twice, then the best of the rest up to ``total``.

    A candidate's pool is the first it qualifies for whose quota it makes: as pools follow one another,
    each takes the best of what earlier ones left. The plan has ``total`` rows at most.
    """
    left, parts = candidates, []
    for number, (condition, quota) in enumerate([*pools, (F.lit(True), total)]):
        taken = left.filter(condition).orderBy(*order).limit(quota).withColumn("pool", F.lit(number))
        parts.append(taken)
        left = left.join(taken.select("item"), "item", "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("pool", *order).limit(total)


def recommend(sources: DataFrame, limit: int = 6) -> DataFrame:
    """The best sources of each profile by score and difficulty penalty, then minutes, then title."""
    return top_per_key(sources, ["profile"], [F.asc(F.col("score") + F.abs(F.col("difficulty") - F.col("level")) * 10), F.asc("minutes"), F.asc("title")], limit)


def reduce_progress(events: DataFrame) -> DataFrame:
    """``profile, opened, understood, help, style``: how often each happened, and the style after all in order.

    A call for help simplifies the style, understanding restores it; it stays within 0 and 2.
    """
    kind = F.col("kind")
    step = F.when(kind == "needs_help", -1).when(kind == "understood", 1).otherwise(0)
    style = clamped_sums(events.withColumn("_step", step), ["profile"], ["ts", "event_id"], {"style": ("_step", 2, 0, 2)}).drop("n")
    times = lambda k, name: F.count_if(kind == k).alias(name)
    return events.groupBy("profile").agg(times("opened", "opened"), times("understood", "understood"), times("needs_help", "help")).join(style, "profile")


def concept_bridge(wanted: DataFrame, copy: DataFrame, examples: DataFrame, key: str, concepts: str) -> DataFrame:
    """``key, place, concept, title, definition, question, code`` of each concept that a row names, each once, in order.

    ``copy`` has concept, title, definition and ``examples`` concept, code; a concept without either gets
    its own name as title, a plain definition, and a hint in place of code.
    """
    each = wanted.select(key, F.posexplode(F.array_distinct(concepts)).alias("at", "concept")).withColumn("place", F.col("at") + 1)
    one = lambda df, *columns: df.groupBy("concept").agg(*[F.min(c).alias(c) for c in columns])
    joined = each.join(one(copy, "title", "definition"), "concept", "left").join(one(examples, "code"), "concept", "left")
    title = F.coalesce("title", F.regexp_replace("concept", "_", " "))
    return joined.select(key, "place", "concept", title.alias("title"), F.coalesce("definition", F.concat(F.lit("What "), title, F.lit(" does in this code."))).alias("definition"), F.concat(F.lit("Where is "), title, F.lit(" used here, and why?")).alias("question"), F.coalesce("code", F.lit("// Follow a small input through this code.")).alias("code"))
