"""The recurring jobs: crawling feeds, publishing the outbox and clearing it, each a stream of ticks.

A tick is a micro-batch, so Spark's checkpoint counts the rounds, a round that was interrupted runs again, and two rounds
of one job never overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentspark.operators.outbox import BATCH_SIZE, LEASE_MS, RETENTION_MS
from contentspark.plans.ingest import new_outbox_rows
from contentspark.plans.publish import append_outbox, publish_outbox, purge_outbox, read_outbox
from contentspark.plans.schedule import CRAWL_SECONDS, PUBLISH_SECONDS, PURGE_SECONDS, scheduled
from contentspark.schemas import OUTBOX_EVENT


def _now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def start_job(spark: SparkSession, work: Callable[[], object], checkpoint: str, every_seconds: float | None) -> StreamingQuery:
    """Runs ``work`` at a fixed interval, or (without one) once and then ends. An error ends the job and is its error."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda tick, number: work() and None).option("checkpointLocation", checkpoint)
    return scheduled(writer, every_seconds).start()


def crawl_feeds(spark: SparkSession, payloads: Callable[[], DataFrame], outbox_path: str, now: Column | None = None) -> int:
    """Adds the items of the payloads landed so far that the outbox does not hold; their number.

    ``payloads`` gives the landed payloads, also those of earlier rounds: what is known is not added again.
    """
    at = _now() if now is None else now
    rows = new_outbox_rows(payloads(), read_outbox(spark, outbox_path), at).select(*OUTBOX_EVENT.fieldNames()).persist()
    try:
        count = rows.count()
        if count:
            append_outbox(spark, outbox_path, rows, at)
        return count
    finally:
        rows.unpersist()


def start_crawl(
    spark: SparkSession, payloads: Callable[[], DataFrame], outbox_path: str, checkpoint: str,
    every_seconds: float | None = CRAWL_SECONDS, now: Column | None = None,
) -> StreamingQuery:
    return start_job(spark, lambda: crawl_feeds(spark, payloads, outbox_path, now), checkpoint, every_seconds)


def start_publish(
    spark: SparkSession, outbox_path: str, send: Callable[[DataFrame], None], checkpoint: str,
    every_seconds: float | None = PUBLISH_SECONDS, now: Column | None = None, limit: int = BATCH_SIZE, lease_ms: int = LEASE_MS,
) -> StreamingQuery:
    def work() -> int:
        return publish_outbox(spark, outbox_path, send, _now() if now is None else now, limit, lease_ms)

    return start_job(spark, work, checkpoint, every_seconds)


def start_purge(
    spark: SparkSession, outbox_path: str, checkpoint: str, every_seconds: float | None = PURGE_SECONDS,
    now: Column | None = None, age_ms: int = RETENTION_MS,
) -> StreamingQuery:
    return start_job(spark, lambda: purge_outbox(spark, outbox_path, _now() if now is None else now, age_ms), checkpoint, every_seconds)
