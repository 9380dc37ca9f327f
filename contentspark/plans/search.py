"""Hybrid search: nearest vectors and best text matches, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentspark.functions.fusion import RRF_K, rrf_score
from contentspark.functions.vectors import hash_vector
from contentspark.operators.ranking import top_k, top_k_per_group
from contentspark.operators.textsearch import (
    CANDIDATES, text_candidates, text_candidates_from_postings, text_candidates_many,
)
from contentspark.operators.vectorsearch import query_vector, vector_candidates, vector_candidates_many
from contentspark.plans.sizing import broadcast_if_small
from contentspark.schemas import VECTOR_DIM

DEFAULT_LIMIT = 20
_SCORE_ROW_BYTES = 64


def fuse(vector_side: DataFrame, text_side: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """Full outer join of two ranked candidate sets with the fused score."""
    left = vector_side.select(*keys, F.col("rank").alias("vector_rank"))
    right = text_side.select(*keys, F.col("rank").alias("text_rank"))
    return left.join(right, keys, "full_outer").withColumn(
        "rrf_score", rrf_score(F.col("vector_rank"), F.col("text_rank"), k=k))


def _result(items: DataFrame, scored: DataFrame, *first: str) -> DataFrame:
    texts = items.select("id", "title", "url", F.col("content_text").alias("clean_content"))
    return texts.join(scored, "id").select(
        *first, F.col("id").alias("content_id"), "title", "url", "clean_content", "rrf_score")


def hybrid_search(
    items: DataFrame, text: str, limit: int = DEFAULT_LIMIT, *, dim: int = VECTOR_DIM,
    vector: Column | None = None, embed: Callable[[Column], Column] | None = None,
    postings: DataFrame | None = None, stem: str = "snowball", candidates: int = CANDIDATES,
) -> DataFrame:
    """Best ``limit`` items for one query text.

    Both candidate sets are cut to ``candidates`` ids before they meet; titles and texts are fetched for the
    ids of the answer only.
    """
    near = vector_candidates(items, query_vector(items, text, dim, embed) if vector is None else vector, candidates)
    if postings is None:
        matching = text_candidates(items, text, candidates, stem)
    else:
        matching = text_candidates_from_postings(postings, text, candidates, stem)
    order = [F.col("rrf_score").desc(), F.col("id").asc()]
    best = top_k(fuse(near, matching, ["id"]).select("id", "rrf_score"), limit, order)
    small = broadcast_if_small(best, _SCORE_ROW_BYTES, known_rows=min(limit, 2 * candidates))
    return top_k(_result(items, small), limit, [F.col("rrf_score").desc(), F.col("content_id").asc()])


def hybrid_search_many(
    items: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT, *, postings: DataFrame | None = None,
    dim: int = VECTOR_DIM, embed: Callable[[Column], Column] | None = None, stem: str = "snowball",
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Best ``limit`` items for every row of ``queries(query_id, text)``."""
    vector = hash_vector(F.col("text"), dim)
    if embed is not None:
        vector = F.coalesce(embed(F.col("text")), vector)
    near = vector_candidates_many(items, queries.select("query_id", vector.alias("vector")), candidates)
    matching = text_candidates_many(items if postings is None else postings, queries, candidates, stem)
    order = [F.col("rrf_score").desc(), F.col("id").asc()]
    best = top_k_per_group(
        fuse(near, matching, ["query_id", "id"]).select("query_id", "id", "rrf_score"), limit, ["query_id"], order)
    return _result(items, best.drop("rank"), "query_id")
