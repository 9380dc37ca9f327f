"""Per-domain limits, failure signals, retries, versions and refresh decisions on logs and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentspark.session import cut_lineage

CALLS_PER_SECOND = 5
BREAKER_WINDOW = 10
BREAKER_MIN_CALLS = 5
BREAKER_FAILURE_RATE = 0.5
MAX_RETRIES = 2


def _epoch_seconds(ts: Column) -> Column:
    """Seconds since a fixed moment without a zone, so the session's zone plays no part."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def rate_limit(calls: DataFrame, limit: int = CALLS_PER_SECOND) -> DataFrame:
    """``admitted``: whether a call is among the first ``limit`` of its domain's second.

    A busy domain is spread over tasks by its seconds.
    """
    window = Window.partitionBy("domain", _epoch_seconds(F.col("ts"))).orderBy("ts", "call_id")
    return calls.withColumn("admitted", F.row_number().over(window) <= limit)


def in_chunks(calls: DataFrame, chunks: int | None = None) -> DataFrame:
    """Calls with the ``chunk`` they are in: ranges of domain, time and id of about the same size, stored once.

    A burst of one domain within a second is cut like anything else.
    """
    order = ["domain", "ts", "call_id"]
    log = calls.select(*order, "failed")
    ranged = log.repartitionByRange(*order) if chunks is None else log.repartitionByRange(chunks, *order)
    return cut_lineage(ranged.withColumn("chunk", F.spark_partition_id()))


def breaker_trips(
    calls: DataFrame, size: int = BREAKER_WINDOW, min_calls: int = BREAKER_MIN_CALLS,
    failure_rate: float = BREAKER_FAILURE_RATE, chunks: int | None = None,
) -> DataFrame:
    """Per call: ``window_calls``, ``window_failures`` of the domain's last ``size`` calls, and ``tripped``.

    A domain may hold a third of the log, so the log is cut into ranges of equal size that are windowed on their own.
    Each first receives the ``size - 1`` calls of its domain before it, taken from the tails of earlier ranges.
    """
    before = size - 1
    in_order = [F.col("ts").asc(), F.col("call_id").asc()]
    log = in_chunks(calls, chunks)

    newest = Window.partitionBy("domain", "chunk").orderBy(F.col("ts").desc(), F.col("call_id").desc())
    tails = (
        log.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= before)
        .groupBy("domain", "chunk").agg(F.collect_list(F.struct("ts", "call_id", "failed")).alias("tail"))
    )
    # Every stored chunk has at least one call, so `before` chunks hold at least `before` calls.
    earlier = Window.partitionBy("domain").orderBy("chunk").rowsBetween(-before, -1)
    carried = tails.select(
        "domain", "chunk", F.flatten(F.collect_list("tail").over(earlier)).alias("calls"),
    ).select(
        "domain", "chunk",
        F.inline(F.slice(F.reverse(F.array_sort("calls")), 1, before)),
    )
    both = log.withColumn("own", F.lit(True)).unionByName(
        carried.withColumn("own", F.lit(False)))
    last = Window.partitionBy("domain", "chunk").orderBy(*in_order).rowsBetween(-before, 0)
    counted = both.withColumns({
        "window_calls": F.count("*").over(last),
        "window_failures": F.count_if(F.col("failed")).over(last),
    }).where("own")
    tripped = (F.col("window_calls") >= min_calls) & (
        F.col("window_failures") >= F.lit(failure_rate) * F.col("window_calls"))
    return counted.select(
        "domain", "ts", "call_id", "failed", "window_calls", "window_failures", tripped.alias("tripped"))


def retry_decision(failures: Column, max_retries: int = MAX_RETRIES) -> Column:
    """What happens to a record that has failed this often: ``done``, ``retry`` or ``dead_letter``."""
    return F.when(failures == 0, "done").when(failures <= max_retries, "retry").otherwise("dead_letter")


def route_failures(records: DataFrame, failures: str = "failures", max_retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """Records to try again, and records that have used up their retries."""
    decision = retry_decision(F.col(failures), max_retries)
    return records.where(decision == "retry"), records.where(decision == "dead_letter")


def feed_versions(users: DataFrame, invalidations: DataFrame) -> DataFrame:
    """``(user_id, version)``: one plus the number of the user's invalidations."""
    counts = invalidations.groupBy("user_id").agg(F.count("*").alias("n"))
    return users.join(counts, "user_id", "left").select(
        "user_id", (F.lit(1) + F.coalesce("n", F.lit(0))).alias("version"))


def refresh_decision(
    expiry_ms: Column, now_ms: Column, ttl_ms: Column, delta_ms: Column, r: Column, beta: float = 1.0,
) -> Column:
    """``expired``, ``refresh`` (early, with a chance that grows towards expiry) or ``fresh``."""
    left = expiry_ms - now_ms
    early = (left <= ttl_ms - delta_ms) & (F.lit(-beta) * delta_ms * F.log(r) > left)
    return F.when(left <= 0, "expired").when(early, "refresh").otherwise("fresh")
