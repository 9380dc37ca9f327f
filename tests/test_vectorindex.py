import numpy as np
import pytest
from pyspark.sql import functions as F

from contentspark.operators.vectorindex import build_vector_index, pruned_candidates
from contentspark.operators.vectorsearch import vector_candidates

KIND = "id long, embedding array<float>, title string"


def groups(n, spread, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return [(i, (centres[i % 20] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), "t") for i in range(n)]


def same(spark, folder, rows, vector, k=50, **options):
    items = spark.createDataFrame(rows, KIND)
    build_vector_index(items, folder, **options)
    found = pruned_candidates(spark, folder, vector, "long", k)
    plain = vector_candidates(items, F.lit([float(x) for x in vector]).cast("array<float>"), k)
    assert sorted(tuple(r) for r in found.candidates.select("rank", "id", "distance").collect()) == sorted(
        tuple(r) for r in plain.select("rank", "id", "distance").collect())
    return found


def test_grouped_vectors_are_read_in_part(spark, tmp_path):
    rows = groups(4000, 0.05) + [(10_000, None, "no vector"), (10_001, [0.0] * 16, "no direction"), (10_002, [1.0, 2.0], "short")]
    found = same(spark, str(tmp_path / "a"), rows, rows[7][1], cells=40)
    assert found.rows == 4002 and found.rows_read < 0.2 * found.rows


@pytest.mark.parametrize("spread", [0.5, 3.0])
def test_any_spread_gives_the_exact_answer(spark, tmp_path, spread):
    rows = groups(1500, spread, seed=4)
    rows += [(i + 5000, rows[i][1], "tie") for i in range(0, 300, 3)]
    query = np.random.default_rng(3).normal(size=16).tolist()
    same(spark, str(tmp_path / "a"), rows, query, cells=30, sample_rows=200)


def test_few_items_ask_for_all_cells(spark, tmp_path):
    rows = groups(30, 0.1) + [(100, [0.0] * 16, "no direction")]
    found = same(spark, str(tmp_path / "a"), rows, rows[0][1], cells=8)
    assert found.cells_read == found.cells and found.candidates.count() == 31
    zero = same(spark, str(tmp_path / "b"), rows, [0.0] * 16, cells=8)
    assert zero.rows_read == zero.rows
    assert same(spark, str(tmp_path / "c"), rows[:1], rows[0][1], k=1).candidates.count() == 1


def test_empty_table(spark, tmp_path):
    assert same(spark, str(tmp_path / "a"), [], [1.0, 0.0]).candidates.count() == 0
