"""Top-k in the forms that stay small at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentspark.session import cut_lineage

MERGE_FAN_IN = 256


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows: every task keeps ``k``, one task merges those."""
    return df.orderBy(*order).limit(k)


def first_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows for an ``n`` too large for one task to merge.

    Rows are dealt by range and counted; whole ranges are taken as long as they fit, and the one in which the ``n``-th
    row lies is cut. The driver sees one count per range. The ranges are stored once because they are drawn from a
    sample.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    left, whole, cut = n, [], None
    for part, size in sorted(tuple(r) for r in ranged.groupBy("__range").count().collect()):
        if size > left:
            cut = part
            break
        whole.append(part)
        left -= size
    if cut is None:
        return ranged.drop("__range")
    inside = ranged.where(F.col("__range") == cut).orderBy(*order).limit(left)
    return ranged.where(F.col("__range") < cut).unionByName(inside).drop("__range") if whole else inside.drop("__range")


def with_rank(bounded: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row numbers for an input that a limit already bounds."""
    return bounded.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_k_per_group(
    df: DataFrame, k: int, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
    fan_in: int = MERGE_FAN_IN,
) -> DataFrame:
    """The first ``k`` rows of every group with their row number.

    A group may hold most of the input, so it is merged as a tree: tasks first keep ``k`` rows per group,
    ``fan_in`` merge tasks share a group, and one task per group sees at most ``fan_in * k`` rows.
    """
    slot = "__merge_slot"
    level1 = Window.partitionBy(*keys, slot).orderBy(*order)
    level2 = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(slot, F.pmod(F.spark_partition_id(), F.lit(fan_in)))
        .withColumn(name, F.row_number().over(level1)).where(F.col(name) <= k)
        .drop(name, slot)
        .withColumn(name, F.row_number().over(level2)).where(F.col(name) <= k)
    )
