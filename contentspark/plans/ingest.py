"""Feed payloads to outbox rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.operators.constraints import outbox_violations, split_by_violations
from contentspark.operators.extract import MAX_PAYLOAD_BYTES, extract_feed_items, split_by_size
from contentspark.operators.metrics import ingested_per_source
from contentspark.operators.outbox import insert_if_absent, outbox_rows
from contentspark.schemas import OUTBOX_EVENT
from contentspark.sources.payloads import too_long_files, with_source_by_path


def new_outbox_rows(
    payloads: DataFrame, outbox: DataFrame, now: Column, event_id: Column | None = None,
    new_rows_bound: int | None = None,
) -> DataFrame:
    """Outbox rows for items not seen before. A payload that holds no feed adds nothing and harms no other;
    neither does a row that breaks the outbox's limits (:func:`valid_outbox_rows` gives those)."""
    rows, _ = valid_outbox_rows(outbox_rows(extract_feed_items(payloads), now, event_id))
    order = [F.col("source_id").asc(), F.col("external_id").asc(), F.col("position").asc(), F.col("payload").asc()]
    return insert_if_absent(rows, outbox, ["aggregate_id"], order, new_rows_bound)


def rejected_payloads(payloads: DataFrame, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """Payloads that ingestion does not read, with the reason; a payload without a length or content is one of them."""
    too_long = split_by_size(payloads, max_bytes)[1].withColumn("reason", F.lit("too long"))
    empty = payloads.where("length IS NULL OR (length <= 0)").withColumn("reason", F.lit("empty"))
    return too_long.unionByName(empty)


def rejected_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """``(source_id, path, length, reason)`` of landed files that ingestion does not read. Spark itself skips empty files."""
    return with_source_by_path(too_long_files(spark, path, glob, max_bytes)).select(
        "source_id", "path", "length", F.lit("too long").alias("reason"))


def valid_outbox_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the outbox's limits, and the others with their ``violations``: one bad row holds up no other."""
    return split_by_violations(rows, outbox_violations())


def ingest_feeds(
    payloads: DataFrame, outbox: DataFrame, now: Column, new_rows_bound: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New outbox rows, and how many came from each source and in total.

    Persist or write the rows before counting them: their ids are random.
    """
    rows = new_outbox_rows(payloads, outbox, now, None, new_rows_bound)
    return rows.select(*OUTBOX_EVENT.fieldNames()), ingested_per_source(rows)
