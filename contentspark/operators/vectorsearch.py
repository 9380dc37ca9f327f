"""Nearest items by cosine distance: exact, by scan, with early top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentspark.functions.vectors import DISTANCE_DIGITS, cosine_distance, hash_vector, ranked_distance
from contentspark.operators.ranking import top_k, top_k_per_group, with_rank
from contentspark.plans.sizing import row_count_up_to

CANDIDATES = 50
# Queries and items that meet in one task, and item rows multiplied at once: a task holds a distance array of
# ROWS_PER_BLOCK x BAND_QUERIES numbers (16 MiB) and its two sides, whatever the tables' sizes.
BAND_QUERIES = 4096
SHARD_ROWS = 16384
ROWS_PER_BLOCK = 512


def has_vector(embedding: Column) -> Column:
    return embedding.isNotNull()


def query_vector(items: DataFrame, text: str, dim: int, embed: Callable[[Column], Column] | None = None) -> Column:
    """Vector of one query text, computed once per query run (not per item): the model's, else the hash vector."""
    fallback = hash_vector(F.lit(text), dim)
    vector = fallback if embed is None else F.coalesce(embed(F.lit(text)), fallback)
    return items.sparkSession.range(1).select(vector.alias("vector")).scalar()


def vector_candidates(
    items: DataFrame, vector: Column, k: int = CANDIDATES, norm_column: str | None = None,
) -> DataFrame:
    """``(id, distance, rank)`` of the ``k`` items nearest to one vector.

    Only the id and the distance travel; ``norm_column`` names a stored vector length if there is one.
    """
    stored = F.col(norm_column) if norm_column else None
    order = [F.col("distance").asc_nulls_last(), F.col("id").asc()]
    compared = items.where(has_vector(F.col("embedding"))).withColumn("__query", vector)
    near = compared.select("id", ranked_distance(
        cosine_distance(F.col("embedding"), F.col("__query"), a_norm=stored)).alias("distance"))
    return with_rank(top_k(near, k, order), order)


def _block_kernel(
    query_ids: list, queries: np.ndarray, k: int, out_schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    lengths = np.linalg.norm(queries, axis=1)
    dim = queries.shape[1]

    def distances(block: np.ndarray) -> np.ndarray:
        scale = np.linalg.norm(block, axis=1)[:, None] * lengths[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = 1.0 - (block @ queries.T) / scale
        return np.where(scale > 0, np.round(dist, DISTANCE_DIGITS), np.inf)

    def first_k(dist: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(dist) > k:
            close = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        else:
            close = np.arange(len(dist))
        return close[np.lexsort((ids[close], dist[close]))[:k]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [None] * len(query_ids)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(start, ROWS_PER_BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(flat) != part.num_rows * dim:
                    raise ValueError(f"every embedding must have {dim} components")
                dist = distances(flat.reshape(part.num_rows, dim).astype(np.float64))
                for q in range(len(query_ids)):
                    d, i = dist[:, q], ids
                    if best[q] is not None:
                        keep = d <= best[q][0][-1] if len(best[q][0]) >= k else slice(None)
                        d = np.concatenate([best[q][0], d[keep]])
                        i = np.concatenate([best[q][1], i[keep]])
                    chosen = first_k(d, i)
                    best[q] = (d[chosen], i[chosen])
        for query_id, found in zip(query_ids, best):
            if found is not None and len(found[0]):
                d = pa.array(np.where(np.isinf(found[0]), np.nan, found[0]), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query_id] * len(d), out_schema.field(0).type),
                     pa.array(found[1].tolist(), out_schema.field(1).type), d],
                    schema=out_schema,
                )

    return kernel


def vector_candidates_many(items: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """``(query_id, id, distance, rank)`` of the ``k`` nearest items of every query ``(query_id, vector)``.

    Up to ``BAND_QUERIES`` queries go to the scan tasks, which multiply them with item blocks and keep ``k`` rows per
    query. More are dealt into bands and the items into shards; a task has one of each. The plan is the same for any
    number of queries, and pairs beyond the ``k`` per query never leave a task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    queries = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    scan = items.where(has_vector(F.col("embedding"))).select("id", "embedding")
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", items.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    schema = to_arrow_schema(out)

    def kernel_of(rows: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in rows.column("vector").to_pylist()])
        return _block_kernel(rows.column("query_id").to_pylist(), matrix, k, schema)

    if row_count_up_to(queries, BAND_QUERIES) <= BAND_QUERIES:
        rows = queries.toArrow()
        if rows.num_rows == 0:
            return items.sparkSession.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())]))
        found = scan.mapInArrow(kernel_of(rows), out)
    else:
        bands, shards = -(-queries.count() // BAND_QUERIES), max(1, -(-scan.count() // SHARD_ROWS))

        def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
            place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
            return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

        def tile(asked, stored):
            if not asked.num_rows or not stored.num_rows:
                return schema.empty_table()
            return pa.Table.from_batches(kernel_of(asked)(iter(stored.select(["id", "embedding"]).to_batches())), schema)

        found = dealt(queries, "__band", bands, "__shard", shards).groupBy("__band", "__shard").cogroup(
            dealt(scan, "__shard", shards, "__band", bands).groupBy("__band", "__shard")).applyInArrow(tile, out)
    order = [F.col("distance").asc_nulls_last(), F.col("id").asc()]
    return top_k_per_group(found, k, ["query_id"], order)
