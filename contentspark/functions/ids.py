"""Identifiers and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(text: Column) -> Column:
    """Name-based (version 3) UUID of a text's UTF-8 bytes."""
    digest = F.md5(text.cast("binary"))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-3"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def aggregate_key(source_id: Column, external_id: Column) -> Column:
    """Stable id of an item; a missing part counts as the text ``null``."""
    null_text = F.lit("null")
    return name_uuid(F.concat(F.coalesce(source_id, null_text), F.lit(":"), F.coalesce(external_id, null_text)))


def random_uuid() -> Column:
    return F.expr("uuid()")


def query_key(query: Column, limit: Column) -> Column:
    """Cache key of a search: casing and outer blanks do not matter."""
    return F.concat_ws(":", F.lit("search"), F.lower(F.trim(query)), limit.cast("string"))


def feed_key(user_id: Column, version: Column, limit: Column) -> Column:
    return F.concat(
        F.lit("feed:"), user_id.cast("string"),
        F.lit(":v"), version.cast("string"),
        F.lit(":l"), limit.cast("string"),
    )


def shift_millis(ts: Column, millis: Column | int) -> Column:
    """A timestamp moved by a number of milliseconds (negative moves back)."""
    ms = F.lit(millis) if isinstance(millis, int) else millis
    return ts + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))
