"""Column constraints as data: every violated rule is a named reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentspark.schemas import CONTENT_LIMITS, CONTENT_REQUIRED, OUTBOX_LIMITS, OUTBOX_REQUIRED


def constraint_violations(
    limits: Mapping[str, int], required: Sequence[str], vector: str | None = None, dim: int | None = None,
) -> Column:
    """``array<string>`` of violated rules, empty for a valid row."""
    checks = [F.when(F.col(name).isNull(), F.lit(f"{name} is null")) for name in required]
    checks += [
        F.when(F.char_length(F.col(name)) > limit, F.lit(f"{name} longer than {limit}"))
        for name, limit in limits.items()
    ]
    if vector is not None:
        checks.append(F.when(F.size(vector) != dim, F.lit(f"{vector} size is not {dim}")))
    return F.array_compact(F.array(*checks))


def content_violations(dim: int | None = None, vector: str | None = None) -> Column:
    return constraint_violations(CONTENT_LIMITS, CONTENT_REQUIRED, vector, dim)


def outbox_violations() -> Column:
    return constraint_violations(OUTBOX_LIMITS, OUTBOX_REQUIRED)


def split_by_violations(rows: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their ``violations``."""
    checked = rows.withColumn("violations", violations)
    return (
        checked.where(F.size("violations") == 0).drop("violations"),
        checked.where(F.size("violations") > 0),
    )
