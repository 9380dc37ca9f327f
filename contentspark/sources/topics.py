"""Keyed message topics: Kafka where its connector is on the class path, files of topic records elsewhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.schemas import TOPIC_RECORD

TOPIC = "content-discovered"
DEAD_LETTER_SUFFIX = ".DLT"
PRODUCER_OPTIONS = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.retries": "10"}


def kafka_options(servers: str, group: str, topic: str = TOPIC) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest",
        "groupIdPrefix": group, "failOnDataLoss": "true",
    }


def read_topic(
    spark: SparkSession, source: str, fmt: str = "kafka", topic: str = TOPIC, streaming: bool = True,
    options: Mapping[str, str] | None = None, group: str = "",
) -> DataFrame:
    """Topic records from brokers (``source`` names the servers, ``group`` the consumers) or from a folder of record files."""
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        raw = reader.format("kafka").options(**{**kafka_options(source, group, topic), **(options or {})}).load()
        return raw.select(
            F.col("key").cast("string"), F.col("value").cast("string"),
            "topic", "partition", "offset", "timestamp")
    return reader.format(fmt).schema(TOPIC_RECORD).options(**(options or {})).load(source)


def topic_rows(claimed: DataFrame) -> DataFrame:
    return claimed.select(F.col("aggregate_id").alias("key"), F.col("payload").alias("value"))


def dead_letter_rows(failed: DataFrame) -> DataFrame:
    """Original key and value, why they failed, where they came from, and the topic they go to."""
    return failed.select(
        "key", "value", F.concat("topic", F.lit(DEAD_LETTER_SUFFIX)).alias("topic"),
        "error_class", "error_message", F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"),
    )


def with_headers(dead: DataFrame) -> DataFrame:
    """Dead letters in the shape a broker takes: the reasons as record headers."""
    names = ["error_class", "error_message", "source_topic", "source_partition", "source_offset"]
    headers = F.array(*[
        F.struct(F.lit(n).alias("key"), F.col(n).cast("string").cast("binary").alias("value")) for n in names])
    return dead.select("key", "value", "topic", headers.alias("headers"))


def write_topic(rows: DataFrame, target: str, fmt: str = "kafka", topic: str | None = TOPIC) -> None:
    """Batch write of ``(key, value)``, acknowledged by all replicas; repeated after a crash."""
    if fmt == "kafka":
        writer = rows.write.format("kafka").option("kafka.bootstrap.servers", target).options(**PRODUCER_OPTIONS)
        (writer.option("topic", topic) if topic else writer).save()
    else:
        rows.write.format(fmt).mode("append").save(target)
