"""Outbox state as pure functions: old state in, new state out, time passed in.

One writer per outbox table is assumed; two concurrent writers could hand out the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentspark.functions.events import AGGREGATE_TYPE, EVENT_TYPE, encode_event
from contentspark.functions.ids import aggregate_key, random_uuid, shift_millis
from contentspark.operators.ranking import first_n, top_k
from contentspark.plans.sizing import broadcast_if_small

BATCH_SIZE = 50
LEASE_MS = 30_000
RETENTION_MS = 7 * 24 * 3600 * 1000
_ID_BYTES = 64
#: Batches beyond this are chosen range by range instead of by one merging task.
MERGED_CLAIM = 100_000


def is_pending(now: Column) -> Column:
    """Not processed, and not leased at ``now`` (a lease ending exactly now still holds)."""
    return F.col("processed_at").isNull() & (F.col("locked_until").isNull() | (F.col("locked_until") < now))


def is_expired(now: Column, age_ms: int = RETENTION_MS) -> Column:
    return F.coalesce(F.col("processed_at") < shift_millis(now, -age_ms), F.lit(False))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key. Tasks drop repeats before the shuffle, so a hot key does not travel."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(window)).where(F.col("__n") == 1).drop("__n")


def insert_if_absent(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[Column],
    new_rows_bound: int | None = None,
) -> DataFrame:
    """Rows of ``new`` to insert: the first per key, unless the key exists already.

    With a proven bound on the size of ``new`` (a micro-batch that was counted) its keys are sent to the table
    scan, which returns only the keys that collide; the table itself is not shuffled. Without one, both sides
    are shuffled by key.
    """
    first = first_per_key(new, keys, order)
    known = existing.select(*keys)
    if new_rows_bound is not None:
        asked = broadcast_if_small(new.select(*keys).distinct(), _ID_BYTES * len(keys), new_rows_bound)
        known = known.join(asked, list(keys), "left_semi").distinct()
    return first.join(known, list(keys), "left_anti")


def outbox_rows(items: DataFrame, now: Column, event_id: Column | None = None) -> DataFrame:
    """New outbox rows for extracted items (before the duplicate check)."""
    payload = encode_event(
        random_uuid() if event_id is None else event_id, now, F.col("source_id"), F.col("external_id"),
        F.col("title"), F.col("url"), F.col("published_at"),
    )
    return items.select(
        random_uuid().alias("id"), F.lit(AGGREGATE_TYPE).alias("aggregate_type"),
        aggregate_key(F.col("source_id"), F.col("external_id")).alias("aggregate_id"),
        F.lit(EVENT_TYPE).alias("type"), payload.alias("payload"), now.cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("processed_at"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp_ntz").alias("locked_until"),
        "source_id", "external_id", "position",
    )


def claim_batch(
    outbox: DataFrame, now: Column, limit: int = BATCH_SIZE, lease_ms: int = LEASE_MS,
) -> tuple[DataFrame, DataFrame]:
    """The oldest pending rows ``(id, aggregate_id, payload)``, and the outbox with their lease set.

    Only ids and times compete for the batch; payloads are fetched for the chosen ids. No task merges a large batch.
    """
    order = [F.col("created_at").asc_nulls_last(), F.col("id").asc()]
    choose = top_k if limit <= MERGED_CLAIM else first_n
    chosen = choose(outbox.where(is_pending(now)).select("id", "created_at"), limit, order).select("id")
    chosen = broadcast_if_small(chosen, _ID_BYTES, known_rows=limit)
    claimed = outbox.select("id", "aggregate_id", "payload").join(chosen, "id", "left_semi")
    marked = outbox.join(chosen.withColumn("__claimed", F.lit(True)), "id", "left")
    leased = marked.withColumn(
        "locked_until",
        F.when(F.col("__claimed"), shift_millis(now, lease_ms)).otherwise(F.col("locked_until")),
    ).drop("__claimed")
    return claimed, leased.select(*outbox.columns)


def apply_outcomes(outbox: DataFrame, outcomes: DataFrame, now: Column, outcome_rows: int | None = None) -> DataFrame:
    """Both transitions at once for ``outcomes(id, ok, error)``: processed, or one more retry with its error.

    A failed row stays pending and keeps its lease. ``outcome_rows`` is a proven bound, if there is one.
    """
    outcomes = outcomes.select("id", F.col("ok").alias("__ok"), F.col("error").alias("__error"))
    side = outcomes if outcome_rows is None else broadcast_if_small(outcomes, 4 * _ID_BYTES, outcome_rows)
    joined = outbox.join(side, "id", "left")
    failed = F.col("__ok").isNotNull() & ~F.col("__ok")
    return joined.withColumns({
        "processed_at": F.when(F.col("__ok"), now.cast("timestamp_ntz")).otherwise(F.col("processed_at")),
        "retry_count": F.when(failed, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "error_message": F.when(failed, F.col("__error")).otherwise(F.col("error_message")),
    }).select(*outbox.columns)


def mark_processed(outbox: DataFrame, ids: DataFrame, now: Column, rows: int | None = None) -> DataFrame:
    done = ids.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return apply_outcomes(outbox, done, now, rows)


def mark_failed(outbox: DataFrame, failures: DataFrame, rows: int | None = None) -> DataFrame:
    """``failures(id, error)``."""
    failed = failures.select("id", F.lit(False).alias("ok"), "error")
    return apply_outcomes(outbox, failed, F.lit(None), rows)


def published_count(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("ok")).alias("published"))


def purge_processed(outbox: DataFrame, now: Column, age_ms: int = RETENTION_MS) -> tuple[DataFrame, DataFrame]:
    """The outbox without rows processed longer ago than ``age_ms``, and the number removed."""
    expired = is_expired(now, age_ms)
    return outbox.where(~expired), outbox.agg(F.count_if(expired).alias("purged"))
