import math
import random

from contentspark.llm import topk

KIND = "vec_id long, embedding array<double>"


def brute(vectors, queries, k):
    def whole(rows):
        return [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
                if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    out, data = [], whole(vectors)
    for i, q in whole(queries):
        scored = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in data if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, vectors, queries, **options):
    v, q = (spark.createDataFrame(rows, KIND) for rows in (vectors, queries))
    return sorted(tuple(r) for r in topk.exact_topk(v, q, **options).collect())


def test_ties_nulls_and_lengths(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1]) for _ in range(4)]) for i in range(300)]
    rows += [(1000, None), (1001, [None, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 4), (1003, [float("inf")] * 4),
             (1004, [1.0, 2.0]), (1005, [0.5, 0.5]), (1006, []), (None, [1.0] * 4)]
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0] + [rows[50], (1005, [0.5, 0.5])]
    for options in ({}, {"band_rows": 3, "shard_rows": 7}):
        assert run(spark, rows, queries, **options) == brute(rows, queries, 10)


def test_large_values_and_few_candidates(spark):
    rows = [(1, [1e12, -1e12]), (2, [1e12, 3.0]), (3, [-1e12, 1e-3]), (4, [2.0, 2.0])]
    assert run(spark, rows, rows) == brute(rows, rows, 10)
    assert run(spark, [], []) == []
    assert run(spark, [(1, [0.5])], [(1, [0.5])]) == []


def test_one_vector_everywhere(spark):
    rows = [(i, [0.5, 0.5]) for i in range(500)]
    assert run(spark, rows, rows[::100], shard_rows=20) == brute(rows, rows[::100], 10)
