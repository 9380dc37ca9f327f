"""Counts, rates, latency quantiles and service levels over logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentspark.session import cut_lineage

QUANTILES = (0.5, 0.9, 0.95, 0.99)
MAX_ERROR_RATE = 0.001
#: Size of a sketch; its rank error is about 0.7 %.
SKETCH_SIZE = 400


def _minute(ts: Column) -> Column:
    return F.window(ts, "1 minute")["start"].alias("window_start")


def ingested_per_source(inserted: DataFrame) -> DataFrame:
    """New rows per source, and in total (``source_id`` NULL)."""
    return inserted.rollup("source_id").agg(F.count("*").alias("ingested"))


def row_counts(rows: DataFrame, **predicates: Column) -> DataFrame:
    """One count per named predicate, from one scan."""
    return rows.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def request_rate(log: DataFrame) -> DataFrame:
    """Requests per second, averaged over each minute."""
    return log.groupBy(_minute(F.col("ts"))).agg((F.count("*") / F.lit(60.0)).alias("rate"))


def max_gauge(log: DataFrame, value: str) -> DataFrame:
    return log.groupBy(_minute(F.col("ts"))).agg(F.max(value).alias("max_value"))


def quantile_name(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def exact_quantiles(log: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """Interpolated quantiles per group, as one column per quantile; a group may be larger than any task.

    Values are counted, dealt out by range, and ranked inside their range from the number of rows in the ranges
    before it, so a group is spread over as many tasks as its values need. The ranges are stored once because
    they are drawn from a sample. A NULL key is a group like any other; a group of NULL values has NULL quantiles.
    """
    counts = log.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(value).alias("__n"))
    ranged = cut_lineage(counts.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size")).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"),
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"), F.sum("__size").over(group).alias("__total"))
    inside = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    ranked = ranged.join(offsets, [F.col("__range") == F.col("__r"), *same]).withColumn(
        "__end", F.col("__before") + F.sum("__n").over(inside))

    def at(position: Column) -> Column:
        here = (position < F.col("__end")) & (position >= F.col("__end") - F.col("__n"))
        return F.max(F.when(here, F.col("__v")))

    def position(q: float) -> Column:
        return F.lit(q) * (F.col("__total") - 1)

    found = ranked.groupBy(*keys).agg(F.first("__total").alias("__total"), *[
        end for i, q in enumerate(quantiles)
        for end in (at(F.floor(position(q))).alias(f"__lo{i}"), at(F.ceil(position(q))).alias(f"__hi{i}"))])
    return found.select(*keys, *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (position(q) - F.floor(position(q))))
        .alias(quantile_name(q)) for i, q in enumerate(quantiles)])


def latency_quantiles(
    log: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES, accuracy: int | None = None,
) -> DataFrame:
    """Quantiles per group: exact and interpolated, or with ``accuracy`` a sketch from a single pass."""
    if accuracy is None:
        return exact_quantiles(log, keys, value, quantiles)
    points = F.array(*[F.lit(q) for q in quantiles])
    return log.groupBy(*keys).agg(F.percentile_approx(value, points, accuracy).alias("q")).select(
        *keys, *[F.col("q")[i].alias(quantile_name(q)) for i, q in enumerate(quantiles)])


def latency_quantiles_per_minute(
    log: DataFrame, value: str, quantiles: Sequence[float] = QUANTILES, accuracy: int | None = None,
) -> DataFrame:
    return latency_quantiles(
        log.withColumn("window_start", _minute(F.col("ts"))), ["window_start"], value, quantiles, accuracy)


def histogram_quantiles(
    log: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float], quantiles: Sequence[float] = (0.95, 0.99),
) -> DataFrame:
    """Quantiles read off bucket counts, linear inside a bucket; the open last bucket yields its lower bound.

    The state per group is one count per bucket whatever the input size.
    """
    bounds = sorted(bounds)
    counts = log.groupBy(*keys).agg(*[
        F.count_if(F.col(value) <= bound).cast("double").alias(f"__le{i}") for i, bound in enumerate(bounds)
    ], F.count(value).cast("double").alias("__all"))

    def quantile(q: float) -> Column:
        target = F.lit(q) * F.col("__all")
        found, low_count, low_bound = F.when(F.col("__all") == 0, F.lit(None).cast("double")), F.lit(0.0), 0.0
        for i, bound in enumerate(bounds):
            inside = F.try_divide(target - low_count, F.col(f"__le{i}") - low_count)
            found = found.when(
                F.col(f"__le{i}") >= target, F.lit(low_bound) + F.lit(bound - low_bound) * F.coalesce(inside, F.lit(0.0)))
            low_count, low_bound = F.col(f"__le{i}"), bound
        return found.otherwise(F.lit(bounds[-1]))

    return counts.select(*keys, *[quantile(q).alias(quantile_name(q)) for q in quantiles])


def minute_state(log: DataFrame, keys: Sequence[str], value: str, failed: Column) -> DataFrame:
    """Per group and minute: calls, failures, largest value and a sketch of all values, from one pass over the log.

    States of a group merge into those of longer windows (:func:`merged_state`) without the log.
    """
    return log.groupBy(*keys, _minute(F.col("ts")).alias("window_start")).agg(
        F.count("*").alias("calls"), F.count_if(failed).alias("failures"), F.max(value).alias("max_value"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_state(state: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Per group and hour, day or other unit: the states of :func:`minute_state` (or of shorter units) together."""
    return state.groupBy(*keys, F.date_trunc(unit, "window_start").cast("timestamp_ntz").alias("window_start")).agg(
        F.sum("calls").alias("calls"), F.sum("failures").alias("failures"), F.max("max_value").alias("max_value"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))


def state_metrics(state: DataFrame, quantiles: Sequence[float] = QUANTILES, seconds: float = 60.0) -> DataFrame:
    """Rate, error rate, maximum and quantiles of every state, windows being so many seconds long.

    A quantile's rank is off by about 0.7 % of the calls, whatever their number and however often states were
    merged. A state without values has NULL quantiles.
    """
    some = F.kll_sketch_get_n_double("sketch") > 0
    others = [c for c in state.columns if c not in ("calls", "failures", "max_value", "sketch")]
    return state.select(
        *others, (F.col("calls") / F.lit(seconds)).alias("rate"), F.try_divide("failures", "calls").alias("error_rate"), "max_value",
        *[F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(quantile_name(q)) for q in quantiles])


def service_levels(
    log: DataFrame, key: str, value: str, failed: Column, p95_ms: Column, p99_ms: Column,
    max_error_rate: float = MAX_ERROR_RATE, accuracy: int | None = None,
) -> DataFrame:
    """Per key: error rate, p95, p99 and whether each keeps its limit. With ``accuracy`` the log is read once."""
    if accuracy is not None:
        points = F.array(F.lit(0.95), F.lit(0.99))
        once = log.groupBy(key).agg((F.count_if(failed) / F.count("*")).alias("error_rate"), F.percentile_approx(value, points, accuracy).alias("q"))
        return _judged(once.select(key, "error_rate", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99")),
                       key, p95_ms, p99_ms, max_error_rate)
    errors = log.groupBy(key).agg((F.count_if(failed) / F.count("*")).alias("error_rate"))
    quantiles = latency_quantiles(log, [key], value, (0.95, 0.99)).withColumnRenamed(key, "__key")
    measured = errors.join(quantiles, F.col(key).eqNullSafe(F.col("__key")), "left")
    return _judged(measured, key, p95_ms, p99_ms, max_error_rate)


def _judged(measured: DataFrame, key: str, p95_ms: Column, p99_ms: Column, max_error_rate: float) -> DataFrame:
    return measured.select(
        key, "error_rate", "p95", "p99", (F.col("error_rate") < max_error_rate).alias("errors_ok"),
        (F.col("p95") < p95_ms).alias("p95_ok"), (F.col("p99") < p99_ms).alias("p99_ok"),
    )
