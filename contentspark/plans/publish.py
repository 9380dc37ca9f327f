"""Outbox folder to topic, and clearing the outbox.

An outbox is a log of two tables partitioned by the day and batch of writing: rows are appended once, and every change of
a row (claimed, processed, failed) is appended as an event. A row's state is its events folded together. Every append is
a partition of its own, so writers do not meet. Clearing stores a cut-off time, from which on expired rows count no more,
and then overwrites those partitions of days before the cut-off that hold such rows, and these partitions alone: what is
being appended lies in the partitions of the present day.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentspark.operators.outbox import BATCH_SIZE, LEASE_MS, RETENTION_MS, claim_batch
from contentspark.schemas import OUTBOX_EVENT
from contentspark.sources.tables import delete_folder, path_exists
from contentspark.sources.topics import topic_rows

_EVENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("at", T.TimestampNTZType()),
    T.StructField("locked_until", T.TimestampNTZType()), T.StructField("error", T.StringType())])
_MOST_HALVINGS = 32


def _moment(spark: SparkSession, now: Column) -> datetime:
    """The time of a round, read once so that every step sees the same."""
    return spark.range(1).select(now.cast("timestamp_ntz")).first()[0]


def _read(spark: SparkSession, schema, path: str) -> DataFrame:
    """A table of the log, with the ``day`` and ``batch`` of writing."""
    kind = T.StructType([*schema.fields]).add("day", "date").add("batch", "string")
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in kind]))
    # A cleared partition keeps one row without an id.
    return spark.read.schema(kind).option("basePath", path).parquet(path).where("id is not null")


def _write(rows: DataFrame, path: str, at: datetime) -> str:
    folder = f"{path}/day={at.date()}/batch={uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return folder


def fold_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Outbox rows in the state that their events ``(id, kind, at, locked_until, error)`` have brought them to."""
    def last(value: str, kind: str) -> Column:
        return F.max_by(value, F.when(F.col("kind") == kind, F.col("at")))

    folded = events.groupBy("id").agg(
        F.max(F.when(F.col("kind") == "processed", F.col("at"))).alias("__processed"),
        F.count_if(F.col("kind") == "failed").cast("int").alias("__failed"),
        last("error", "failed").alias("__error"), last("locked_until", "claimed").alias("__locked"))
    return rows.join(folded, "id", "left").withColumns({
        "processed_at": F.coalesce("processed_at", "__processed"),
        "retry_count": F.col("retry_count") + F.coalesce("__failed", F.lit(0)),
        "error_message": F.coalesce("__error", "error_message"),
        "locked_until": F.coalesce("__locked", "locked_until"),
    }).select(*OUTBOX_EVENT.fieldNames())


def _state(spark: SparkSession, path: str) -> DataFrame:
    """All rows in their present state, cleared ones that are not overwritten yet included."""
    return fold_events(_read(spark, OUTBOX_EVENT, f"{path}/rows"), _read(spark, _EVENT, f"{path}/events"))


def _cut(spark: SparkSession, path: str) -> datetime | None:
    """Rows processed before this time are cleared."""
    if not path_exists(spark, f"{path}/cuts"):
        return None
    return spark.read.schema("cut timestamp_ntz").parquet(f"{path}/cuts").agg(F.max("cut")).first()[0]


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    """All outbox rows: pending ones, and processed ones not cleared yet."""
    state, cut = _state(spark, path), _cut(spark, path)
    return state if cut is None else state.where(F.col("processed_at").isNull() | (F.col("processed_at") >= F.lit(cut)))


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    return _state(spark, path).where(F.col("processed_at").isNull())


def read_done(spark: SparkSession, path: str) -> DataFrame:
    return read_outbox(spark, path).where(F.col("processed_at").isNotNull())


def append_outbox(spark: SparkSession, path: str, rows: DataFrame, now: Column | None = None) -> None:
    """Adds new rows; any number of writers may do so while others publish or clear."""
    at = _moment(spark, F.current_timestamp() if now is None else now)
    _write(rows.select(*OUTBOX_EVENT.fieldNames()), f"{path}/rows", at)


def _send(rows: DataFrame, send: Callable[[DataFrame], None], depth: int = 0) -> list[tuple[DataFrame, str | None]]:
    """Sends rows; those of a failing batch in halves, until the rows at fault stand alone. (rows, error) of each part."""
    try:
        send(topic_rows(rows))
        return [(rows, None)]
    except Exception as failure:
        if depth >= _MOST_HALVINGS or rows.limit(2).count() < 2:
            return [(rows, str(failure))]
        side = F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(2))
        halves = [rows.where(side == s) for s in (0, 1)]
        return [part for half in halves if not half.isEmpty() for part in _send(half, send, depth + 1)]


def publish_outbox(
    spark: SparkSession, path: str, send: Callable[[DataFrame], None], now: Column,
    limit: int = BATCH_SIZE, lease_ms: int = LEASE_MS,
) -> int:
    """Claims the oldest pending rows, sends them as ``(key, value)``, stores each row's outcome; rows published.

    The lease is stored before anything is sent. A crash after sending and before storing sends again. One publisher
    works on an outbox at a time.
    """
    at = _moment(spark, now)
    state = _state(spark, path)
    claimed, _ = claim_batch(state, F.lit(at), limit, lease_ms)
    until = at + timedelta(milliseconds=lease_ms)
    none = F.lit(None)

    def store(rows: DataFrame) -> DataFrame:
        folder = _write(rows.select("id", "kind", F.lit(at).alias("at"), "locked_until", "error"), f"{path}/events", at)
        return spark.read.schema(_EVENT).parquet(folder)

    # What was stored, not what would be chosen now.
    ids = store(claimed.select(
        "id", F.lit("claimed").alias("kind"), F.lit(until).alias("locked_until"), none.cast("string").alias("error"))).select("id")
    if ids.isEmpty():
        return 0
    rows = _read(spark, OUTBOX_EVENT, f"{path}/rows")
    mine = rows.join(F.broadcast(ids) if limit <= BATCH_SIZE else ids, "id", "left_semi").select("id", "aggregate_id", "payload")
    outcomes = None
    for part, error in _send(mine, send):
        told = part.select("id", F.lit("processed" if error is None else "failed").alias("kind"),
                           none.cast("timestamp_ntz").alias("locked_until"), F.lit(error).cast("string").alias("error"))
        outcomes = told if outcomes is None else outcomes.unionByName(told)
    return store(outcomes).where("kind = 'processed'").count()


def _overwrite(kept: DataFrame, touched: DataFrame, path: str) -> None:
    """Replaces the touched partitions by the rows kept of them, and one row without an id each."""
    names = [c for c in kept.columns if c not in ("day", "batch")]
    kinds = {f.name: f.dataType for f in kept.schema}
    marks = touched.select(*(F.lit(None).cast(kinds[n]).alias(n) for n in names), "day", "batch")
    kept.join(touched, ["day", "batch"], "left_semi").select(marks.columns).unionByName(marks).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def purge_outbox(spark: SparkSession, path: str, now: Column, age_ms: int = RETENTION_MS) -> int:
    """Clears rows processed longer ago than ``age_ms``; the number cleared.

    The rows are gone once the cut-off time is stored. Then the partitions written before the day of the cut-off lose
    them and afterwards their events; a stop in between leaves events of no row, which count for nothing.
    """
    cut = _moment(spark, now) - timedelta(milliseconds=age_ms)
    gone = read_outbox(spark, path).where(F.col("processed_at") < F.lit(cut)).count()
    if gone:
        spark.range(1).select(F.lit(cut).alias("cut")).write.mode("append").parquet(f"{path}/cuts")
    earlier = F.col("day") < F.lit(cut.date())
    rows, events = _read(spark, OUTBOX_EVENT, f"{path}/rows").where(earlier), _read(spark, _EVENT, f"{path}/events")
    until = events.where(F.col("day") <= F.lit(cut.date()))
    expired = fold_events(rows, until).where(F.col("processed_at") < F.lit(cut)).select("id")
    work = f"{path}/work/{uuid.uuid4().hex}"
    rows.join(expired, "id", "left_semi").select("id", "day", "batch").write.parquet(work)
    old = spark.read.schema("id string, day date, batch string").parquet(work)
    if not old.isEmpty():
        _overwrite(rows.join(old.select("id"), "id", "left_anti"), old.select("day", "batch").distinct(), f"{path}/rows")
        told = events.where(earlier)
        of_old = told.join(old.select("id"), "id", "left_semi").select("day", "batch").distinct()
        _overwrite(told.join(old.select("id"), "id", "left_anti"), of_old, f"{path}/events")
    delete_folder(spark, work)
    return gone
