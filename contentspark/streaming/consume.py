"""Topic records to content items: decode, check, drop repeats, enrich, store."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentspark.functions.events import decode_event
from contentspark.operators.constraints import constraint_violations, content_violations
from contentspark.operators.enrich import Embedder, enrich
from contentspark.operators.outbox import insert_if_absent
from contentspark.plans.schedule import scheduled
from contentspark.sources.tables import append_items, child_names, path_exists, read_items, with_item_defaults
from contentspark.sources.topics import dead_letter_rows

ITEM_KEY = ("source_id", "external_id")


class Consumed(NamedTuple):
    items: DataFrame
    dead_letters: DataFrame


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded events, and the records that are not events (``error_class``, ``error_message``)."""
    decoded = records.withColumn("__d", decode_event(F.col("value")))
    good = decoded.where(F.col("__d.error").isNull()).select(*records.columns, "__d.event.*")
    bad = decoded.where(F.col("__d.error").isNotNull()).select(
        *records.columns, F.lit("DecodingError").alias("error_class"), F.col("__d.error").alias("error_message"))
    return good, bad


def split_violating(rows: DataFrame, violations: Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with ``columns``, ``error_class`` and ``error_message``."""
    checked = rows.withColumn("__violations", violations)
    valid = checked.where(F.size("__violations") == 0).drop("__violations")
    bad = checked.where(F.size("__violations") > 0).select(
        *columns, F.lit("ConstraintError").alias("error_class"),
        F.array_join("__violations", "; ").alias("error_message"))
    return valid, bad


def consume_batch(
    records: DataFrame, existing: DataFrame, now: Column, embed: Embedder | None = None, dim: int | None = None,
    new_rows_bound: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Consumed:
    """One batch of topic records as new items and dead letters.

    The event carries no body, so the title is the text. Only rows that are new are embedded. Both results come from the
    enriched rows; ``keep`` may persist or store these, so that the model sees every row once.
    """
    events, undecodable = split_records(records.select("key", "value", "topic", "partition", "offset"))
    columns = undecodable.columns[:-2]
    rows = events.withColumn("content_text", F.col("title")).withColumn(
        "published_at", F.coalesce("published_at", now.cast("timestamp_ntz")))
    valid, invalid = split_violating(rows, content_violations(), columns)
    fresh = insert_if_absent(
        valid, existing, ITEM_KEY, [F.col("partition").asc(), F.col("offset").asc()], new_rows_bound)
    enriched = keep(enrich(fresh, embed))
    dead = undecodable.unionByName(invalid)
    if embed is not None and dim is not None:
        enriched, misfit = split_violating(enriched, constraint_violations({}, (), "embedding", dim), columns)
        dead = dead.unionByName(misfit)
    return Consumed(with_item_defaults(enriched, now), dead_letter_rows(dead))


def drop_recent_repeats(events: DataFrame, delay: str) -> DataFrame:
    """Cheap pre-filter with bounded state; repeats further apart are left to the insert itself.

    The state ages by arrival, not by the events' own times, so an event that comes late is not taken for an old one.
    """
    return (
        events.withColumn("__seen", F.current_timestamp()).withWatermark("__seen", delay)
        .dropDuplicatesWithinWatermark(list(ITEM_KEY)).drop("__seen")
    )


def run_number(spark: SparkSession, checkpoint: str, *outputs: str) -> int:
    """The number under which a consumer with this checkpoint stores its batches.

    A checkpoint keeps the number it was given first. A new one gets a number that no output holds yet, because its
    batches are counted from zero again and must not replace those of an earlier run.
    """
    marker = f"{checkpoint}/contentspark-run"
    if path_exists(spark, f"{marker}/_SUCCESS"):
        return spark.read.schema("run int").json(marker).first()["run"]
    taken = [int(n[4:]) for path in outputs for n in child_names(spark, path) if n.startswith("run=")]
    run = max(taken, default=0) + 1
    spark.range(1).select(F.lit(run).alias("run")).write.mode("overwrite").json(marker)
    return run


def start_consumer(
    records: DataFrame, items_path: str, dead_letter_path: str, checkpoint: str, *, embed: Embedder | None = None,
    dim: int | None = None, now: Column | None = None, every_seconds: float | None = None,
) -> StreamingQuery:
    """Runs :func:`consume_batch` on a stream of records into two folders.

    Both sinks are keyed by run (see :func:`run_number`) and batch number, and a batch is compared with everything but
    itself and its followers, so a batch that is repeated after a failure replaces its own output alone and nothing is
    stored twice. One consumer writes to a pair of folders at a time.
    """
    spark = records.sparkSession
    clock = F.current_timestamp() if now is None else now
    run = run_number(spark, checkpoint, items_path, dead_letter_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = [batch.persist()]

        def keep(rows: DataFrame) -> DataFrame:
            kept.append(rows.persist())
            return kept[-1]

        try:
            size = batch.count()
            stored = read_items(batch.sparkSession, items_path)
            existing = stored.where((F.col("run") != run) | (F.col("batch_id") < batch_id))
            result = consume_batch(batch, existing, clock, embed, dim, new_rows_bound=size, keep=keep)
            append_items(result.items, items_path, run, batch_id)
            result.dead_letters.write.mode("overwrite").parquet(f"{dead_letter_path}/run={run}/batch_id={batch_id}")
        finally:
            for rows in kept:
                rows.unpersist()

    writer = records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return scheduled(writer, every_seconds).start()
