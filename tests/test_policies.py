import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentspark.operators import metrics
from contentspark.operators.policies import breaker_trips, feed_versions, in_chunks, rate_limit, refresh_decision

START = datetime(2025, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(rows, "domain string, ts timestamp_ntz, call_id long, failed boolean")


def test_sixth_call_of_a_second_is_refused(spark):
    calls = [("a", START + timedelta(milliseconds=10 * i), i, False) for i in range(6)]
    calls += [("b", START, 10, False), ("a", START + timedelta(seconds=1), 11, False)]
    refused = rate_limit(log(spark, calls)).where("not admitted").collect()
    assert [r.call_id for r in refused] == [5]


@pytest.mark.parametrize("chunk", [None, 1, 7, 60])
def test_breaker_signal_does_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(3)
    rows, clock = [], {"hot": START, "cold": START}
    for i in range(400):
        domain = "hot" if rng.random() < 0.8 else "cold"
        clock[domain] += timedelta(seconds=int(rng.choice([0, 1, 5, 200], p=[.3, .4, .25, .05])))
        rows.append((domain, clock[domain], i, bool(rng.random() < 0.45)))
    got = {r.call_id: (r.window_calls, r.window_failures, r.tripped)
           for r in breaker_trips(log(spark, rows), chunks=chunk).collect()}
    expected = {}
    for domain in clock:
        mine = sorted((r for r in rows if r[0] == domain), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(mine):
            last = [x[3] for x in mine[max(0, n - 9):n + 1]]
            expected[r[2]] = (len(last), sum(last), len(last) >= 5 and sum(last) >= 0.5 * len(last))
    assert got == expected


def test_a_burst_within_one_second_is_spread(spark):
    rows = [("busy", START, i, i % 3 == 0) for i in range(3000)] + [("calm", START, 5000 + i, False) for i in range(6)]
    sizes = [r["count"] for r in in_chunks(log(spark, rows), 10).groupBy("chunk").count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 900
    got = {r.call_id: (r.window_calls, r.window_failures) for r in breaker_trips(log(spark, rows), chunks=10).collect()}
    assert len(got) == 3006 and all(got[i] == (min(10, i + 1), sum(j % 3 == 0 for j in range(max(0, i - 9), i + 1))) for i in range(3000))


def test_early_refresh(spark, one):
    def decide(left, r):
        return one(refresh_decision(F.lit(left), F.lit(0), F.lit(200), F.lit(50), F.lit(r)))

    edge = math.exp(-40 / 50)
    assert decide(40, edge * 0.99) == "refresh"
    assert decide(40, edge * 1.01) == "fresh"
    assert decide(151, 0.0001) == "fresh"
    assert decide(0, 0.5) == decide(-5, 0.5) == "expired"


def test_versions(spark):
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    marks = spark.createDataFrame([("u",), ("u",)], "user_id string")
    assert {tuple(r) for r in feed_versions(users, marks).collect()} == {("u", 3), ("v", 1)}


def test_histogram_quantiles_interpolate(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 500.0)], "k string, v double")
    got = {r.k: r for r in metrics.histogram_quantiles(rows, ["k"], "v", [10, 50, 100], (0.5, 0.95, 0.999)).collect()}
    assert got["a"].p50 == pytest.approx(50.0)
    assert got["a"].p95 == pytest.approx(95.0)
    assert got["b"].p95 == 100.0
    assert "p99_9" in got["a"].asDict()


def test_sketch_is_close_to_exact(spark):
    rows = spark.range(10000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    exact = metrics.latency_quantiles(rows, ["k"], "v").first()
    sketch = metrics.latency_quantiles(rows, ["k"], "v", accuracy=1000).first()
    for a, b in zip(exact[1:], sketch[1:]):
        assert abs(a - b) <= 20


def test_merged_sketches_keep_their_rank_error(spark):
    """Minutes merged into hours and these into days: every quantile's rank is within 2 % of what it should be."""
    rng = np.random.default_rng(11)
    rows = [("a", START + timedelta(seconds=int(s)), i, bool(i % 10 == 0), float(v))
            for i, (s, v) in enumerate(zip(rng.integers(0, 86_400, 40_000), rng.lognormal(3, 1, 40_000)))]
    rows += [("empty", START, 1, True, None)]
    calls = spark.createDataFrame(rows, "domain string, ts timestamp_ntz, call_id long, failed boolean, ms double")
    minutes = metrics.minute_state(calls, ["domain"], "ms", F.col("failed"))
    days = metrics.merged_state(metrics.merged_state(minutes, ["domain"], "hour"), ["domain"], "day")
    got = {r.domain: r for r in metrics.state_metrics(days, seconds=86_400.0).collect()}
    values = np.sort([r[4] for r in rows if r[4] is not None])
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
        assert abs(np.searchsorted(values, got["a"][name]) / len(values) - q) < 0.02
    assert got["a"].max_value == values[-1] and got["a"].error_rate == 0.1 and abs(got["a"].rate - 40_000 / 86_400) < 1e-12
    assert got["empty"].p50 is None and got["empty"].error_rate == 1.0


def test_counts(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "source_id string")
    assert {tuple(r) for r in metrics.ingested_per_source(rows).collect()} == {("a", 2), ("b", 1), (None, 3)}
    assert metrics.row_counts(rows, a=F.col("source_id") == "a").first().a == 2


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_exact_quantiles_of_one_huge_group(spark, partitions):
    rng = np.random.default_rng(5)
    values = {"hot": rng.normal(size=3000).round(2), "cold": rng.normal(size=7), "one": np.array([3.5]), "same": np.ones(50)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None)], "k string, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.k: r[1:] for r in metrics.latency_quantiles(rows, ["k"], "v", (0.0, 0.5, 0.9, 0.99, 1.0)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, [0.0, 0.5, 0.9, 0.99, 1.0])))


def test_quantiles_keep_null_groups_and_null_values(spark):
    from contentspark.operators.metrics import latency_quantiles, service_levels

    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), (None, None), ("empty", None)]
    log = spark.createDataFrame(rows, "g string, v double")
    want = {"a": 2.0, None: 5.0, "empty": None}
    assert {r.g: r.p50 for r in latency_quantiles(log, ["g"], "v", (0.5,)).collect()} == want
    assert set(r.g for r in latency_quantiles(log, ["g"], "v", (0.5,), accuracy=100).collect()) == set(want)
    levels = {r.g: r.p95 for r in service_levels(log, "g", "v", F.lit(False), F.lit(9.0), F.lit(9.0)).collect()}
    assert levels == {"a": 2.9, None: 5.0, "empty": None}
