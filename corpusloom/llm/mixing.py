"""Mixing sources to target weights by temperature.

Source s with token share p gets weight proportional to p ** alpha. The exponent is found by
bisection: the largest at which the weights' entropy reaches a target, or else the least, and so the
flattest weights, at which no source is repeated more often than a limit. Weights become budgets of tokens, and each budget is met by
passes over the source's blocks, every pass in a permutation of its own; the last pass stops in
the middle of a block where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import checkpoint, written

#: Documents' tokens that a block aims at.
BLOCK_TOKENS = 1 << 18
#: Blocks of a pass are summed by ranges of their hash's leading bits: 4,096 ranges.
RANGE_BITS = 52
#: Exponents that one aggregate looks at; each such job is worth four halvings.
FAN, JOBS = 16, 10


def token_count(text: str = "text") -> Column:
    """Runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def shares(sizes: DataFrame) -> DataFrame:
    """``source, tokens`` of each source that has any, from columns source and tokens; null is a source."""
    return sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent in [0, 1] for a target entropy, as a share of the largest possible, or a limit of passes.

    With ``entropy``, the largest exponent that reaches it, or the least that ``repeats`` allows where
    that is larger. With ``repeats`` alone, the least exponent at which no source takes more passes
    than that where the least repeated takes one. Every step is an aggregate over the sources, which
    stay where they are.
    """
    total = sources.agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.min("tokens").alias("low"), F.max("tokens").alias("high")).first()
    if not total["k"] or total["k"] == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(total["n"]))

    def entropies(exponents: list[float]) -> list[float]:
        import math

        sums = [x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share) * F.lit(a)))]
        row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
        return [(math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i]) / math.log(total["k"]) for i in range(len(exponents))]

    low, high = 0.0, 1.0
    if entropy is not None and entropies([1.0])[0] < entropy:
        for _ in range(JOBS):
            inner = [low + (high - low) * i / FAN for i in range(1, FAN)]
            good = [a for a, e in zip(inner, entropies(inner), strict=True) if e >= entropy]
            edge = max(good, default=low)
            low, high = edge, edge + (high - low) / FAN
        high = low
    chosen = high
    if repeats is not None and repeats >= 1:
        spread = total["high"] / total["low"]
        low, high = 0.0, 1.0
        if spread > repeats:
            for _ in range(50):
                middle = (low + high) / 2
                if spread ** (1 - middle) <= repeats:
                    high = middle
                else:
                    low = middle
            chosen = max(chosen, high) if entropy is not None else high
        elif entropy is None:
            chosen = 0.0
    return chosen


def weights(sources: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """``source, tokens, weight, target``: normalised weights and whole-token budgets.

    Without a budget the targets are the least that keep every document: the least repeated source
    takes exactly one pass.
    """
    power = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    total, least = sources.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    total = total or 1.0
    target = power * F.lit(float(least or 0)) if budget is None else power / F.lit(total) * F.lit(float(budget))
    return sources.select("source", "tokens", (power / F.lit(total)).alias("weight"), F.round(target).cast("bigint").alias("target"))


def plan(docs: DataFrame, key: list[str], entropy: float | None = None, repeats: float | None = 2.0, budget: int | None = None, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every copy in the mixture: the key columns, ``source, n_tokens, weight, pass, position``.

    ``docs`` has the key columns, source and tokens. Each source is dealt into hash blocks of about
    ``block_tokens``; pass k orders them by a hash of block and k and takes whole blocks while the
    budget lasts, then the documents of the last one, by hash, while they begin within the budget. So
    a source differs from its budget by less than one document. Blocks are small whatever the source
    holds, so no source is ever in one task. ``position`` orders the mixture: uniform over it for every
    source. Documents without tokens are free and stay, in pass 0; equal rows are separate documents.
    """
    sources = checkpoint(shares(docs))
    alpha = exponent(sources, entropy, repeats)
    goal = weights(sources, alpha, budget)
    n_blocks = F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("int")
    goal = checkpoint(goal.withColumn("blocks", F.greatest(n_blocks, F.lit(1))))
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    d = docs.select(*key, "source", F.col("tokens").alias("n_tokens"))
    g = goal.select(F.col("source").alias("s"), "weight", "blocks")
    dealt = d.join(g, d["source"].eqNullSafe(g["s"]), "left").drop("s")
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64(*key, F.lit(seed)), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")
    sized = checkpoint(dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size")))
    passes = F.greatest(F.ceil(F.col("target") / F.col("tokens")), F.lit(1)).cast("int")
    b = sized.join(goal, null_safe(sized, goal)).select(sized["source"], "block", "size", "tokens", "target", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"))
    b = b.withColumn("place", F.xxhash64("source", "block", "pass", F.lit(seed))).withColumn("range", F.shiftright("place", RANGE_BITS))
    # What stands before a block: the ranges of the hash before its own, and the blocks before it in its range.
    running = lambda by, order: F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = b.groupBy("source", "pass", "range").agg(F.sum("size").alias("size"))
    ranges = ranges.select(F.col("source").alias("rs"), F.col("pass").alias("rp"), F.col("range").alias("rr"), running(["source", "pass"], ["range"]).alias("ranges_before"))
    b = b.withColumn("within", running(["source", "pass", "range"], ["place", "block"])).join(ranges, F.col("source").eqNullSafe(F.col("rs")) & (F.col("pass") == F.col("rp")) & (F.col("range") == F.col("rr")))
    before = F.col("ranges_before") + F.col("within")
    b = b.withColumn("left", F.col("target") - F.col("pass") * F.col("tokens") - before).filter("left > 0").select(F.col("source").alias("bs"), F.col("block").alias("bb"), "pass", "left", "size")
    b = checkpoint(b)
    base = dealt.filter("weight is not null and n_tokens > 0")
    # Passes that take a whole block are a list at the block; only a block where a budget ends looks into its documents.
    whole = b.filter("left >= size").groupBy("bs", "bb").agg(F.array_sort(F.collect_list("pass")).alias("passes"))
    partly = b.filter("left < size").select("bs", "bb", "pass", "left")
    full = base.join(whole, base["source"].eqNullSafe(whole["bs"]) & (base["block"] == whole["bb"])).select(*key, "source", "n_tokens", "weight", F.explode("passes").alias("pass"))
    inner = Window.partitionBy("source", "block", "pass").orderBy(F.xxhash64(*key, F.col("pass"), F.lit(seed)), *key)
    cut = base.join(partly, base["source"].eqNullSafe(partly["bs"]) & (base["block"] == partly["bb"])).withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.filter("ahead < left").select(*key, "source", "n_tokens", "weight", "pass")
    free = dealt.filter("n_tokens = 0").select(*key, "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(0).alias("pass"))
    taken = full.unionByName(cut).unionByName(free)
    return taken.withColumn("position", F.xxhash64(*key, "source", "pass", F.lit(seed + 1)))


def _measured(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, source, tokens`` of each row; the digest tells texts apart that share an id."""
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "source", token_count().alias("tokens"))


def mixture(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: int | None = None, seed: int = 1) -> DataFrame:
    """``doc_id, source, n_tokens, weight, pass, position`` of every copy in the mixture.

    Null sources are a source; null and empty texts have no tokens, weigh nothing and stay once. Null
    or repeated ids are told apart by their texts, equal rows are separate documents, and an empty
    table gives no rows. Other columns aren't read.
    """
    return plan(written(_measured(docs), "measured"), ["doc_id", "digest"], entropy, repeats, budget, seed).drop("digest")


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of the document) beside what tells documents apart, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), F.col("source").alias("of"))


def mixed(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: int | None = None, seed: int = 1) -> DataFrame:
    """The documents themselves, each as often as the mixture has it, with their own columns, whatever they are called.

    Rows that are equal in id, source and text share their copies' number. ``ordered`` gives the
    mixture's order back.
    """
    copies = plan(written(_measured(docs), "measured"), ["doc_id", "digest"], entropy, repeats, budget, seed).groupBy("doc_id", "source", "digest").agg(F.count_distinct("pass").cast("int").alias("times"))
    rows, c = _keyed(docs), copies.select(F.col("doc_id").alias("cid"), F.col("source").alias("cs"), F.col("digest").alias("cd"), "times")
    joined = rows.join(c, rows["id"].eqNullSafe(c["cid"]) & rows["of"].eqNullSafe(c["cs"]) & rows["digest"].eqNullSafe(c["cd"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def ordered(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``doc_id, text, position`` of each row of what ``mixed`` returned: the mixture's own positions.

    Copies of a document are counted, so a text crosses the network once however many copies stand
    beside one another, and get the passes from 0 on again; the position is the same hash of id, text,
    source and pass. It follows from the rows alone, and copies stand far apart.
    """
    counted = docs.select("doc_id", "source", F.col("text").cast("string").alias("text")).groupBy("doc_id", "source", "text").agg(F.count("*").cast("int").alias("times"))
    passes = counted.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.col("source").alias("of"), F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
    return passes.select("doc_id", "text", F.xxhash64("doc_id", "digest", "of", "pass", F.lit(seed + 1)).alias("position"))
