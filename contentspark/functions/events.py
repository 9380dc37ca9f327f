"""The event value: eight fields as JSON text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentspark.schemas import EVENT_JSON

# Names and formats other readers of the topic rely on.
CONTENT_TYPE = "RSS"
EVENT_TYPE = "ContentDiscoveredEvent"
AGGREGATE_TYPE = "CONTENT"

_CORRUPT = "_corrupt"


def iso_local(ts: Column) -> Column:
    """``2025-03-19T21:05:00``, with a fraction only where there is one; no zone is involved."""
    return F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))


def encode_event(
    event_id: Column, timestamp: Column, source_id: Column, external_id: Column,
    title: Column, url: Column, published_at: Column, content_type: Column | None = None,
) -> Column:
    """Event JSON; missing text becomes empty, a missing publication time the event time."""
    def text(col: Column) -> Column:
        return F.coalesce(col.cast("string"), F.lit(""))

    return F.to_json(F.struct(
        text(event_id).alias("eventId"),
        iso_local(timestamp).alias("timestamp"),
        text(source_id).alias("sourceId"),
        text(external_id).alias("externalId"),
        text(F.lit(CONTENT_TYPE) if content_type is None else content_type).alias("contentType"),
        text(title).alias("title"),
        text(url).alias("url"),
        iso_local(F.coalesce(published_at, timestamp)).alias("publishedAt"),
    ))


def decode_event(value: Column) -> Column:
    """``struct(event, error)``: ``error`` is NULL for a well-formed event, a reason otherwise."""
    schema = T.StructType([*EVENT_JSON.fields, T.StructField(_CORRUPT, T.StringType())])
    raw = F.from_json(
        value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    timestamp = raw["timestamp"].try_cast("timestamp_ntz")
    published = raw["publishedAt"].try_cast("timestamp_ntz")
    event = F.struct(
        raw["eventId"].alias("event_id"),
        timestamp.alias("timestamp"),
        raw["sourceId"].alias("source_id"),
        raw["externalId"].alias("external_id"),
        raw["contentType"].alias("content_type"),
        raw["title"].alias("title"),
        raw["url"].alias("url"),
        published.alias("published_at"),
    )
    error = (
        F.when(value.isNull(), F.lit("missing value"))
        .when(raw.isNull() | raw[_CORRUPT].isNotNull(), F.lit("malformed json"))
        .when(raw["timestamp"].isNotNull() & timestamp.isNull(), F.lit("malformed timestamp"))
        .when(raw["publishedAt"].isNotNull() & published.isNull(), F.lit("malformed publishedAt"))
    )
    return F.struct(event.alias("event"), error.alias("error"))
