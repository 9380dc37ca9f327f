"""Enrichment with a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Column], Column]

# What an item without a language model gets.
CATEGORY = "General"
READ_MINUTES = 1


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Embedder:
    """A column function from a model loader.

    ``load`` runs once per Python worker and returns a function from texts to vectors. A batch the model
    fails on is halved until the texts it fails on stand alone; these get NULL. Want of memory fails the task.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def vectors_of(texts: list[str]) -> list[list[float] | None]:
            try:
                return list(model(texts))
            except MemoryError:
                raise
            except Exception:
                half = len(texts) // 2
                return vectors_of(texts[:half]) + vectors_of(texts[half:]) if half else [None] * len(texts)

        for texts in batches:
            vectors = vectors_of(texts.tolist())
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return embed


def enrich(items: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Adds summary, tags, category, minutes, embedding and status to ``(title, content_text)`` rows.

    Without a model, or where it fails, there is no vector and the status is FALLBACK.
    """
    text = F.concat(
        F.coalesce("title", F.lit("null")), F.lit(" "), F.coalesce("content_text", F.lit("null")))
    vector = F.lit(None).cast("array<float>") if embed is None else embed(text)
    return items.withColumn("embedding", vector).withColumns({
        "summary": F.col("title"),
        "tags": F.array().cast("array<string>"),
        "primary_category": F.lit(CATEGORY),
        "estimated_read_minutes": F.lit(READ_MINUTES),
        "status": F.when(F.col("embedding").isNull(), "FALLBACK").otherwise("SUCCESS"),
    })
