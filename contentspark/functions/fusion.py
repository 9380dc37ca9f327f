"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def rrf_score(*ranks: Column, k: int = RRF_K) -> Column:
    """Sum of 1/(k + rank); a missing or non-positive rank adds nothing."""
    score = F.lit(0.0)
    for rank in ranks:
        score = score + F.when(rank > 0, F.lit(1.0) / (F.lit(k) + rank)).otherwise(F.lit(0.0))
    return score
