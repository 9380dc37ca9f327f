"""Newest unread items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentspark.operators.ranking import first_n, top_k

DEFAULT_LIMIT = 20
#: Longer feeds are chosen and sorted range by range instead of by one merging task.
MERGED_FEED = 1000
FEED_COLUMNS = ("id", "source_id", "external_id", "title", "url")


def unread(read: Column) -> Column:
    return ~read


def feed_rows(items: DataFrame) -> DataFrame:
    """The seven output columns of a feed; the publication time loses its zone."""
    return items.select(
        *FEED_COLUMNS, F.col("content_text").alias("clean_content"),
        F.col("published_at").cast("timestamp_ntz").alias("published_at"),
    )


def unread_feed(items: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The ``limit`` newest unread items, undated ones last.

    The last place of the answer comes from a first look at three narrow columns. As scalar subqueries its time and,
    where undated rows are needed, its id reach the scan as filters, so the text columns are read only where row groups
    can hold a row of the answer. A feed of more than ``MERGED_FEED`` rows passes through no single task.
    """
    order = [F.col("published_at").desc_nulls_last(), F.col("id").asc()]
    open_items = items.where(unread(F.col("read")))
    merged = limit <= MERGED_FEED
    newest = (top_k if merged else first_n)(open_items.select("published_at", "id"), limit, order)
    oldest = newest.agg(F.min("published_at")).scalar()
    last_undated = newest.where(F.col("published_at").isNull()).agg(F.max("id")).scalar()
    wanted = (F.col("published_at") >= oldest) | (F.col("published_at").isNull() & (F.col("id") <= last_undated))
    rows = feed_rows(open_items.where(wanted))
    if merged:
        return top_k(rows, limit, order)
    # Rows at the place of the last one may be too many.
    return (rows if open_items.where(wanted).count() <= limit else first_n(rows, limit, order)).orderBy(*order)
