"""When one join side may be copied to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def row_count_up_to(df: DataFrame, bound: int) -> int:
    """Row count, but never more than ``bound + 1`` rows are looked at."""
    return df.limit(bound + 1).count()


def broadcast_if_small(df: DataFrame, row_bytes: int, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only for a side proven small; otherwise the planner shuffles and splits skewed keys.

    ``known_rows`` is a proof the caller already has (a limit, a count); without it the rows are counted
    up to the bound.
    """
    bound = min(MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES // max(1, row_bytes))
    rows = row_count_up_to(df, bound) if known_rows is None else known_rows
    return F.broadcast(df) if rows <= bound else df


def broadcast_if_measured(df: DataFrame) -> DataFrame:
    """Broadcast hint for a side whose rows and bytes were counted and are few; rows may hold arrays of any length."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    rows, held = df.limit(MAX_BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS and held <= MAX_BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than there are cores, dealt out to all cores.

    For work that is heavy per row (text). An input with enough splits is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
