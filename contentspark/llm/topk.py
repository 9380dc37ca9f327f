"""Exact top-k by inner product of whole-number vectors: tiles of queries and shards, then a tree of merges.

Queries are dealt into bands and all rows into shards, both of bounded size. A task multiplies one band with one shard,
keeps k rows per query, and lists of one query are merged sixteen at a time. Rows are dealt by their place in the
input, so repeated ids or vectors spread evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
_BLOCK = 256


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, vec): floor(scale * x) of usable vectors. Null ids, null vectors and null or non-finite components go."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vec"))


def _matrices(table: pa.Table):
    """{dimension: (row numbers, ids, matrix)} of one side, ids in ascending order."""
    ids = table["id"].to_numpy()
    rows = table["row"].to_numpy()
    column = table["vec"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    lengths = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    out = {}
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        at = at[np.argsort(ids[at], kind="stable")]
        out[int(dim)] = rows[at], ids[at], values[starts[at][:, None] + np.arange(dim)].reshape(len(at), dim)
    return out


def _best(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of each query's k best candidates; own marks pairs that do not count. c is in order of id."""
    m, dim = len(c), q.shape[1]
    top = (int(max(np.abs(q).max(initial=0), 1)) * int(max(np.abs(c).max(initial=0), 1))) * max(dim, 1)
    if (top + 1) * (m + 1) < 2**53:
        # Exact in doubles; score and place share one number, so the partial selection settles ties by id.
        key = (q.astype(np.float64) @ c.T.astype(np.float64)) * m + np.arange(m - 1, -1, -1)
        key[own] = -np.inf
        best = np.argpartition(key, m - k, axis=1)[:, m - k:] if k < m else np.broadcast_to(np.arange(m), key.shape)
        value = np.take_along_axis(key, best, 1)
        score = np.where(np.isfinite(value), value, 0).astype(np.int64) // m
        return np.where(np.isfinite(value), best, -1), score
    exact = np.clip(q.astype(object) @ c.T.astype(object), -2**63 + 1, 2**63 - 1)
    places, scores = np.full((len(q), min(k, m)), -1), np.zeros((len(q), min(k, m)), np.int64)
    for i in range(len(q)):
        order = sorted((j for j in range(m) if not own[i, j]), key=lambda j: (-exact[i, j], j))[:k]
        places[i, :len(order)] = order
        scores[i, :len(order)] = [exact[i, j] for j in order]
    return places, scores


def exact_topk(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
               scale: int = 1024, band_rows: int = 2048, shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of `vectors` with the highest inner product with each query row.

    Rows with the query's id do not count, ties go to the smaller id, and vectors of another length have no score. A
    query without any candidate has no row; repeated query rows are answered each. Scores beyond 64 bits count
    as the nearest long.
    """
    rows, asked = scaled(vectors, id_col, vec_col, scale), scaled(queries, id_col, vec_col, scale)
    shards = max(1, -(-vectors.count() // shard_rows))
    bands = max(1, -(-queries.count() // band_rows))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        place = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = dealt(asked, "band", bands, "shard", shards)
    right = dealt(rows, "shard", shards, "band", bands)

    def tile(key, q_table, c_table):
        out = {"row": [], "query_id": [], "shard": [], "id": [], "score": []}
        q_side, c_side = _matrices(q_table), _matrices(c_table)
        for dim, (q_rows, q_ids, q) in q_side.items():
            if dim not in c_side:
                continue
            _, c_ids, c = c_side[dim]
            for at in range(0, len(q), _BLOCK):
                part = slice(at, at + _BLOCK)
                places, scores = _best(q[part], c, q_ids[part][:, None] == c_ids[None, :], k)
                i, j = np.nonzero(places >= 0)
                out["row"].append(q_rows[part][i])
                out["query_id"].append(q_ids[part][i])
                out["shard"].append(np.full(len(i), key[1].as_py(), np.int32))
                out["id"].append(c_ids[places[i, j]])
                out["score"].append(scores[i, j])
        kinds = {"row": np.int64, "query_id": np.int64, "shard": np.int32, "id": np.int64, "score": np.int64}
        return pa.table({n: np.concatenate(v).astype(kinds[n]) if v else np.zeros(0, kinds[n]) for n, v in out.items()})

    found = left.groupBy("band", "shard").cogroup(right.groupBy("band", "shard")).applyInArrow(
        tile, "row long, query_id long, shard int, id long, score long")

    def merged(df: DataFrame, entries) -> DataFrame:
        return df.groupBy("row", "query_id", "shard").agg(F.slice(F.array_sort(entries), 1, k).alias("top"))

    lists = merged(found, F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "score")))
    while shards > 1:
        shards = -(-shards // FAN_IN)
        lists = merged(lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")), F.flatten(F.collect_list("top")))
    return lists.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
