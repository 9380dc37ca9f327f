"""Landed feed payloads and the registry of their sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.functions.urls import is_safe_url, url_domain, url_host
from contentspark.operators.extract import MAX_PAYLOAD_BYTES
from contentspark.plans.sizing import broadcast_if_measured
from contentspark.schemas import SOURCE


def accepted_status(status: Column) -> Column:
    """Only complete answers count; redirects and errors are rejected."""
    return status.between(200, 299)


def source_registry(spark: SparkSession, sources: Mapping[str, str], enabled: bool = True) -> DataFrame:
    """``(source_id, url)``; empty while ingestion is switched off."""
    return spark.createDataFrame(list(sources.items()) if enabled else [], SOURCE)


def scan_payload_files(
    spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_PAYLOAD_BYTES, streaming: bool = False,
) -> DataFrame:
    """``(path, length, content, ingest_ts)`` of landed files; too long ones are not even read (see :func:`too_long_files`)."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path).where(F.col("length") <= max_bytes).select(
        "path", "length", "content", F.col("modificationTime").cast("timestamp_ntz").alias("ingest_ts"))


def too_long_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """``(path, length, ingest_ts)`` of the files that :func:`scan_payload_files` leaves out; their content is not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).where(F.col("length") > max_bytes).select(
        "path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("ingest_ts"))


def scan_payload_table(payloads: DataFrame) -> DataFrame:
    """Payload rows with a fetch status: the complete answers."""
    return payloads.where(accepted_status(F.col("status")))


def with_source(payloads: DataFrame, registry: DataFrame, key: str = "url") -> DataFrame:
    """``source_id`` for every payload whose ``key`` is registered."""
    return payloads.join(broadcast_if_measured(registry.select("source_id", key)), key)


def with_source_by_path(payloads: DataFrame) -> DataFrame:
    """``source_id`` from a landing path ``.../source_id=<id>/...``."""
    found = F.regexp_extract("path", r"source_id=([^/]+)", 1)
    return payloads.withColumn("source_id", F.url_decode(found)).where(F.col("source_id") != "")


def with_url_safety(rows: DataFrame, hosts: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds ``domain`` and ``safe``; ``hosts(host, addresses)`` says what names resolve to, if known."""
    located = rows.withColumn("domain", url_domain(F.col(url)))
    if hosts is None:
        return located.withColumn("safe", is_safe_url(F.col(url)))
    known = hosts.select(F.lower("host").alias("__host"), "addresses")
    joined = located.withColumn("__host", F.lower(url_host(F.col(url)))).join(
        broadcast_if_measured(known), "__host", "left")
    return joined.withColumn("safe", is_safe_url(F.col(url), F.col("addresses"))).drop("__host", "addresses")
