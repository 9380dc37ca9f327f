"""Exact nearest items with pruning: items are stored by cell, and cells that cannot hold an answer are not read.

A cell has a centre and a radius, the largest distance of one of its items from the centre. For unit vectors the straight
distance orders like the cosine distance and keeps the triangle inequality, so no item of a cell is nearer to a query
than the centre's distance less the radius. The first look reads the cells around the query until they hold enough
items; the last of those bounds what else has to be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentspark.operators.vectorsearch import CANDIDATES, has_vector, vector_candidates

#: Cells of an index, and items from whose vectors the centres are learned.
CELLS = 256
SAMPLE_ROWS = 20_000
_ROUNDS = 8
#: Rounding of distances and radii is far below this.
_SLACK = 1e-6
#: Cell of vectors without a direction or of another length than most; their distance to anything is unknown.
UNPLACED = -1


class Found(NamedTuple):
    """Candidates as :func:`vector_candidates` gives them, and how much of the index was read for them."""

    candidates: DataFrame
    cells_read: int
    cells: int
    rows_read: int
    rows: int


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, and which rows have one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out, usable = np.zeros((len(column), dim)), lengths == dim
    rows = column.filter(pa.array(usable))
    out[usable] = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(out, axis=1)
    usable &= np.isfinite(norm) & (norm > 0)
    out[usable] /= norm[usable, None]
    out[~usable] = 0
    return out, usable


def _centres(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centres by a few rounds of moving each to the mean of what is nearest to it."""
    rng = np.random.default_rng(7)
    centres = vectors[rng.permutation(len(vectors))[:cells]].copy()
    for _ in range(_ROUNDS):
        nearest = np.argmax(vectors @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
        for cell in np.unique(nearest):
            centres[cell] = vectors[nearest == cell].mean(0)
    return centres


def build_vector_index(items: DataFrame, path: str, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS) -> None:
    """Stores ``(id, embedding)`` of the items that have a vector by cell, and the cells' centres and radii.

    The centres come from about ``sample_rows`` items chosen by hash; every item is placed, so only the reading share
    depends on the sample, never the answer. A large cell is split into several files by its writers.
    """
    with_vector = items.where(has_vector(F.col("embedding"))).select("id", "embedding")
    count = with_vector.count()
    span = 1 << 30
    share = min(span, -(-span * sample_rows // max(count, 1)))
    chosen = with_vector.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(span)) < share).select("embedding").toArrow()["embedding"]
    kinds = chosen.combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False) if len(chosen) else np.zeros(0, int)
    dim = int(np.bincount(kinds).argmax()) if len(kinds) else 0
    vectors, usable = _units(chosen, dim) if len(kinds) else (np.zeros((0, 0)), np.zeros(0, bool))
    centres = _centres(vectors[usable], cells) if usable.any() else np.zeros((0, dim))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit, good = _units(part.column(1), dim)
                cell, away = np.full(len(unit), UNPLACED, np.int32), np.zeros(len(unit))
                if len(centres) and good.any():
                    squares = np.maximum(0, (unit * unit).sum(1)[:, None] + (centres * centres).sum(1) - 2 * unit @ centres.T)
                    nearest = squares.argmin(1)
                    cell[good] = nearest[good]
                    away[good] = np.linalg.norm(unit - centres[nearest], axis=1)[good]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(away), pa.array(cell)], names=["id", "embedding", "away", "cell"])

    kind = T.StructType([*with_vector.schema.fields, T.StructField("away", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    with_vector.mapInArrow(placed, kind).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/items")
    spark = items.sparkSession
    facts = spark.read.schema(kind).parquet(f"{path}/items").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    facts.join(known, "cell", "left").write.parquet(f"{path}/cells")


def pruned_candidates(spark: SparkSession, path: str, vector: list[float], id_type: str, k: int = CANDIDATES) -> Found:
    """The ``k`` items of an index nearest to one vector: the rows that a scan of all items gives, from some of the cells."""
    cells = spark.read.schema("cell int, radius double, n long, centre array<double>").parquet(f"{path}/cells").collect()
    items = spark.read.schema(f"id {id_type}, embedding array<float>, cell int").parquet(f"{path}/items")
    query = F.lit([float(x) for x in vector]).cast("array<float>")
    rows = sum(c["n"] for c in cells)

    def near(numbers: list[int]) -> DataFrame:
        return vector_candidates(items.where(F.col("cell").isin(numbers)), query, k)

    unit, good = _units(pa.array([np.asarray(vector, np.float32)], pa.list_(pa.float32())), len(vector))
    some = [c for c in cells if c["centre"] is not None and len(c["centre"]) == len(vector)]
    if not good[0] or not some:
        every = [c["cell"] for c in cells]
        return Found(near(every), len(every), len(every), rows, rows)
    centre = np.linalg.norm(np.asarray([c["centre"] for c in some]) - unit[0], axis=1)
    least = np.maximum(0, centre - np.asarray([c["radius"] for c in some]) - _SLACK)
    taken = []
    for i in sorted(range(len(some)), key=lambda i: (least[i], centre[i])):
        taken.append(i)
        if sum(some[j]["n"] for j in taken) >= k:
            break
    numbers = [some[i]["cell"] for i in taken]
    first = near(numbers).select("distance").where("distance is not null").collect()
    if len(first) < k:
        numbers = [c["cell"] for c in cells]
    else:
        reach = max(r["distance"] for r in first) + _SLACK
        numbers = sorted({*numbers, *(some[i]["cell"] for i in range(len(some)) if least[i] ** 2 / 2 <= reach)})
    read = sum(c["n"] for c in cells if c["cell"] in set(numbers))
    return Found(near(numbers), len(numbers), len(cells), read, rows)
