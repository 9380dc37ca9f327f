"""Declared schemas and column limits; nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR_DIM = 1536

CONTENT_ITEM = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("external_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("content_text", T.StringType()),
    T.StructField("raw_data", T.StringType()),
    T.StructField("read", T.BooleanType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("published_at", T.TimestampNTZType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

OUTBOX_EVENT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("aggregate_type", T.StringType(), False),
    T.StructField("aggregate_id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("processed_at", T.TimestampNTZType()),
    T.StructField("retry_count", T.IntegerType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("locked_until", T.TimestampNTZType()),
])

# Dates stay text here so that one bad date marks one record instead of nulling silently.
EVENT_JSON = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("sourceId", T.StringType()),
    T.StructField("externalId", T.StringType()),
    T.StructField("contentType", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
])

TOPIC_RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

PAYLOAD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("ingest_ts", T.TimestampNTZType()),
])

SOURCE = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
])

# Maximum lengths of the text columns; a missing entry means unlimited.
CONTENT_LIMITS = {"source_id": 64, "external_id": 255, "title": 512, "url": 2048}
CONTENT_REQUIRED = ("source_id", "external_id", "title", "url", "published_at")
OUTBOX_LIMITS = {"aggregate_type": 64, "aggregate_id": 128, "type": 128}
OUTBOX_REQUIRED = ("aggregate_type", "aggregate_id", "type", "payload", "created_at")
