"""Parquet tables of items and outbox rows, and a database read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentspark.functions.ids import random_uuid
from contentspark.schemas import CONTENT_ITEM

_BATCHED = T.StructType([*CONTENT_ITEM.fields, T.StructField("run", T.IntegerType()), T.StructField("batch_id", T.LongType())])


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Content items with the run and micro-batch that wrote them; empty before the first write."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], _BATCHED)
    return spark.read.schema(_BATCHED).parquet(path)


def read_items_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Items from a database, read in ranges of an indexed column."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table)
        .option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper)
        .option("numPartitions", partitions).options(**(options or {})).load()
    )


def with_item_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """The columns an insert fills in itself."""
    return rows.select(
        random_uuid().alias("id"), "source_id", "external_id", "title", "url", "content_text",
        F.lit(None).cast("string").alias("raw_data"), F.lit(False).alias("read"), "embedding",
        F.col("published_at").cast("timestamp_ntz").alias("published_at"),
        now.cast("timestamp_ntz").alias("created_at"), now.cast("timestamp_ntz").alias("updated_at"),
    )


def append_items(rows: DataFrame, path: str, run: int, batch_id: int) -> None:
    """Writes one batch of a run by source. Writing a batch again replaces it alone; big sources are split, small ones packed."""
    (
        rows.hint("rebalance", F.col("source_id")).write.mode("overwrite")
        .partitionBy("source_id").parquet(f"{path}/run={run}/batch_id={batch_id}")
    )
