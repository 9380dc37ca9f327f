"""Feed versions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_stream(invalidations: DataFrame) -> DataFrame:
    """``(user_id, version)`` of every user with a new invalidation; write it in update mode."""
    return invalidations.groupBy("user_id").agg((F.count("*") + 1).alias("version"))
