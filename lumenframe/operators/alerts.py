"""Alert rules over event streams: error ratio, slow p95, failure rate, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.operators.events import bound_name, bucket_counts
from lumenframe.operators.ordered import HOT_ROWS, split_row_number, with_neighbour

STEP_SECONDS = 30
ERROR_RATIO, MIN_RATE = 0.05, 0.001
REQUEST_P95, TASK_P95 = 2.0, 120.0
FAILURE_RATE = 0.05
SILENCE_SECONDS = 60


def seconds(ts: str) -> Column:
    """Whole seconds since the epoch."""
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def sliding(rows: DataFrame, ts: str, window_seconds: int, measures: dict[str, Column],
            step: int = STEP_SECONDS) -> DataFrame:
    """``(tick, measures...)``: sums over ``[tick - window, tick)`` at every multiple of ``step``.

    Rows are first summed per step; only these sums are copied to the windows they belong to.
    """
    steps = rows.groupBy((F.floor(seconds(ts) / step) * step).alias("_step")).agg(
        *[m.alias(name) for name, m in measures.items()])
    ends = F.sequence(F.col("_step") + step, F.col("_step") + window_seconds, F.lit(step))
    return (steps.withColumn("tick", F.explode(ends)).groupBy("tick")
            .agg(*[F.sum(name).alias(name) for name in measures]))


def islands(points: DataFrame, hold_seconds: int, step: int = STEP_SECONDS) -> DataFrame:
    """Runs of consecutive true points ``tick``; ``firing`` once a run has lasted ``hold_seconds``.

    Points are numbered day by day, so a long history is spread over many tasks.
    """
    daily = points.withColumn("_day", F.floor(F.col("tick") / 86_400))
    runs = (split_row_number(daily, [], "_day", ["tick"], "_n")
            .withColumn("_run", F.col("tick") - F.col("_n") * step))
    return (runs.groupBy("_run").agg(F.min("tick").alias("since"), F.max("tick").alias("until"),
                                     F.count(F.lit(1)).alias("points"))
            .drop("_run").withColumn("firing", F.col("until") - F.col("since") >= hold_seconds))


def error_ratio_points(requests: DataFrame, window_seconds: int = 300, threshold: float = ERROR_RATIO) -> DataFrame:
    errors = F.count_if(F.col("status_code").between(500, 599))
    points = sliding(requests, "ts", window_seconds, {"errors": errors, "total": F.count(F.lit(1))})
    ratio = (F.col("errors") / window_seconds) / F.greatest(F.col("total") / window_seconds, F.lit(MIN_RATE))
    return points.withColumn("ratio", ratio).filter(F.col("ratio") > threshold)


def error_ratio_alerts(requests: DataFrame, window_seconds: int = 300, hold_seconds: int = 300,
                       threshold: float = ERROR_RATIO) -> DataFrame:
    return islands(error_ratio_points(requests, window_seconds, threshold), hold_seconds)


def histogram_quantile(q: float, bounds: list[float], total: str = "count") -> Column:
    """Quantile from cumulative buckets, linear inside the bucket that holds its rank."""
    rank = F.col(total) * q
    value = F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        upper, cumulative = bounds[i], F.col(bound_name(bounds[i]))
        lower = bounds[i - 1] if i else 0.0
        before = F.col(bound_name(bounds[i - 1])) if i else F.lit(0)
        inside = lower + (upper - lower) * F.try_divide(rank - before, cumulative - before)
        value = F.when(cumulative >= rank, inside).otherwise(value)
    return F.when(F.col(total) > 0, value)


def p95_points(rows: DataFrame, ts: str, duration: Column, bounds: list[float], window_seconds: int,
               threshold: float) -> DataFrame:
    counts = dict(zip([bound_name(b) for b in bounds], bucket_counts(duration, bounds)))
    points = sliding(rows, ts, window_seconds, {**counts, "count": F.count(F.lit(1))})
    return (points.withColumn("p95", histogram_quantile(0.95, bounds)).filter(F.col("p95") > threshold)
            .select("tick", "count", "p95"))


def p95_alerts(rows: DataFrame, ts: str, duration: Column, bounds: list[float], window_seconds: int = 300,
               hold_seconds: int = 600, threshold: float = REQUEST_P95) -> DataFrame:
    return islands(p95_points(rows, ts, duration, bounds, window_seconds, threshold), hold_seconds)


def failure_rate_alerts(events: DataFrame, ts: str, failed: Column, window_seconds: int = 300,
                        hold_seconds: int = 600, threshold: float = FAILURE_RATE) -> DataFrame:
    points = sliding(events, ts, window_seconds, {"failures": F.count_if(failed)})
    return islands(points.filter(F.col("failures") / window_seconds > threshold), hold_seconds)


def silences(events: DataFrame, key: str, ts: str, id_column: str, longest: int = SILENCE_SECONDS,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Gaps longer than ``longest`` seconds between two events of one service."""
    paired = with_neighbour(events, [key], [ts, id_column], F.col(ts), "next_at", hot_rows=hot_rows)
    gap = (F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return (paired.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") > longest)
            .select(key, F.col(ts).alias("last_seen"), "next_at", "gap_seconds"))
