"""How often streams run."""

from __future__ import annotations

from pyspark.sql.streaming.readwriter import DataStreamWriter

CRAWL_SECONDS = 60.0
PUBLISH_SECONDS = 1.0
PURGE_SECONDS = 3600.0


def scheduled(writer: DataStreamWriter, every_seconds: float | None = None) -> DataStreamWriter:
    """A fixed interval, or (without one) all data available now and then an end."""
    if every_seconds is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{every_seconds} seconds")
