"""Library tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.plans.sizing import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of content items, without vector and time."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content_text"), (F.col("doc_id") % 3 == 0).alias("read"),
    )


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("published_at"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return items.join(times, "id").join(vectors, "id", "left")


def outbox_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.lit("CONTENT").alias("aggregate_type"),
        F.col("event_id").cast("string").alias("aggregate_id"),
        F.lit("ContentDiscoveredEvent").alias("type"),
        F.col("props").alias("payload"), ts.alias("created_at"),
        F.when(kind.isin("signup", "purchase"), ts).alias("processed_at"),
        F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("error_message"),
        F.when(kind == "click", ts).alias("locked_until"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("domain"), "ts", F.col("event_id").alias("call_id"),
        (F.col("event_type") == "error").alias("failed"), F.col("value").alias("latency_ms"),
        F.col("event_type").alias("endpoint"),
    )
