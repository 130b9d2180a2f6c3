"""Prices, grants, reservations and limits in whole micro-units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .admission import admitted
from .relational import summed_before


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage (usage_type, units) with the newest price of its type (since, micro_per_unit): ``cost`` in micro-units.

    Spark broadcasts the newest prices where its own size check allows it.
    """
    newest = prices.groupBy("usage_type").agg(F.max_by("micro_per_unit", "since").alias("micro_per_unit"))
    return usage.join(newest, "usage_type").withColumn("cost", (F.col("units") * F.col("micro_per_unit")).cast("bigint"))


def drawdown(grants: DataFrame, amounts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``used`` of each grant when an amount is taken from each key's grants in order; a key's grants are summed in ranges, not in one task."""
    before = summed_before(grants, [key], order, F.coalesce(F.col("amount"), F.lit(0)).cast("bigint"), "_before")
    wanted = before.join(amounts.withColumnRenamed("amount", "_take"), key)
    return wanted.withColumn("used", F.least("amount", F.greatest(F.lit(0), F.col("_take") - F.col("_before")))).drop("_before", "_take")


def reserve(requests: DataFrame, allowance: int, key: str = "org", order: tuple[str, ...] = ("ts", "event_id"), amount: str = "micro") -> DataFrame:
    """``granted`` of each request: taken in order while the allowance lasts, refusals taking nothing; keys are independent."""
    return admitted(requests, allowance, key, order, amount)


#: How limits are enforced: not at all, refusing, or only noting what would have been refused.
MODES = ("off", "enforce", "shadow")


def reservations(requests: DataFrame, allowance: int, mode: str = "enforce", key: str = "org", order: tuple[str, ...] = ("ts", "event_id"), amount: str = "micro", again: str = "idempotency_key", blocked: str | None = None) -> DataFrame:
    """``key``, the last order column, ``status`` and ``charged`` of each request.

    Requests of one key and idempotency key are one request, the first, and have its outcome; a null
    idempotency key is a request of its own. Only the first is charged. A request whose ``blocked`` is
    true is beyond its feature's limit and takes nothing. In enforce mode what isn't reserved is
    refused; in shadow mode it goes on as shadow_exceeded, uncharged; where limits are off there are no
    reservations: status off.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    last = order[-1]
    limited = F.coalesce(F.col(blocked), F.lit(False)) if blocked else F.lit(False)
    rows = requests.select(F.struct(F.col(key).alias("k"), F.coalesce(F.col(again).cast("string"), F.concat(F.lit("\0"), F.col(last).cast("string"))).alias("a")).alias("_same"), F.col(key), *order, F.coalesce(F.col(amount).cast("bigint"), F.lit(0)).alias("_amount"), limited.alias("_blocked"))
    if mode == "off":
        return rows.select(key, last, F.lit("off").alias("status"), F.lit(0).cast("bigint").alias("charged"))
    first = rows.groupBy("_same").agg(F.min(F.struct(*order, "_amount", "_blocked")).alias("_first"))
    asked = first.filter("not _first._blocked").select(F.col("_same.k").alias(key), *[F.col(f"_first.{c}").alias(c) for c in order], F.col("_first._amount").alias("_amount"))
    granted = admitted(asked, allowance, key, order, "_amount").filter("granted").select(F.struct(F.col(key).alias("k"), F.col(last).alias("i")).alias("_at"))
    outcome = first.select("_same", F.col(f"_first.{last}").alias("_last"), F.col("_first._amount").alias("_taken"), F.struct(F.col("_same.k").alias("k"), F.col(f"_first.{last}").alias("i")).alias("_at"))
    outcome = outcome.join(granted.withColumn("_ok", F.lit(True)), "_at", "left").drop("_at")
    ok, mine = F.coalesce("_ok", F.lit(False)), F.col(last).eqNullSafe(F.col("_last"))
    status = F.when(ok, "reserved").otherwise("refused" if mode == "enforce" else "shadow_exceeded")
    return rows.join(outcome, "_same").select(key, last, status.alias("status"), F.when(ok & mine, F.col("_taken")).otherwise(0).cast("bigint").alias("charged"))


def release_stale(reservations: DataFrame, now: Column) -> DataFrame:
    """Reservations with those released that have expired before any provider was asked: status released, ``reserved`` 0.

    ``reservations`` has status, expires_at, provider_request and reserved; others stay as they are.
    """
    stale = (F.col("status") == "pending") & (F.col("expires_at") <= now) & F.col("provider_request").isNull()
    return reservations.withColumns({"status": F.when(stale, "released").otherwise(F.col("status")), "reserved": F.when(stale, 0).otherwise(F.col("reserved"))})


def remaining(ledger: DataFrame) -> DataFrame:
    """Never below nothing: allowance and bonus less reserved and consumed."""
    return ledger.withColumn("remaining", F.greatest(F.lit(0), F.col("allowance") + F.col("bonus") - F.col("reserved") - F.col("consumed")))


def feature_limits(usage: DataFrame, start: Column, end: Column, limit: int, active: Column | None = None, concurrent: int | None = None) -> DataFrame:
    """``org, feature, n, active, blocked``: uses in a half-open period and those still active; at either limit a feature is blocked."""
    inside = (F.col("ts") >= start) & (F.col("ts") < end)
    running = F.count_if(active) if active is not None else F.lit(0).cast("bigint")
    held = usage.groupBy("org", "feature").agg(F.count_if(inside).alias("n"), running.alias("active"))
    full = F.col("n") >= limit
    return held.withColumn("blocked", full if concurrent is None else full | (F.col("active") >= concurrent))
