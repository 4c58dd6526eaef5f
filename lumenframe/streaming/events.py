"""Streaming forms of the event rollup, the counters, the histograms and the error ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.operators.alerts import ERROR_RATIO, MIN_RATE
from lumenframe.operators.events import bucket_counts

WATERMARK = "1 day"


def stream_rollup(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Daily rollup that keeps sum and count of durations. Events later than the watermark are dropped."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    day = F.window("created_at", "1 day")
    return (timed.groupBy(day.alias("_day"), "event_type")
            .agg(F.count(F.lit(1)).alias("total_count"),
                 F.count_if(F.col("status") == "success").alias("success_count"),
                 F.count_if(F.col("status") != "success").alias("failure_count"),
                 F.sum("duration_ms").alias("duration_sum"), F.count("duration_ms").alias("duration_count"),
                 F.max("created_at").alias("last_event_at"))
            .select(F.to_date("_day.start").alias("summary_date"), "event_type", "total_count", "success_count",
                    "failure_count", F.try_divide(F.col("duration_sum"), F.col("duration_count"))
                    .alias("avg_duration_ms"), "duration_sum", "duration_count", "last_event_at"))


def stream_counters(requests: DataFrame, labels: list[str]) -> DataFrame:
    """Running totals per label set; the labels bound the state."""
    return requests.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def stream_histogram(rows: DataFrame, labels: list[str], duration: Column, bounds: list[float]) -> DataFrame:
    """Running cumulative buckets per label set."""
    return rows.groupBy(*labels).agg(*bucket_counts(duration, bounds), F.count(F.lit(1)).alias("count"),
                                     F.sum(F.greatest(duration, F.lit(0.0))).alias("sum"))


def stream_error_ratio(requests: DataFrame, watermark: str = "10 minutes", threshold: float = ERROR_RATIO,
                       width: str = "5 minutes", slide: str = "30 seconds", seconds: int = 300) -> DataFrame:
    """Windows with their share of failed requests, and whether it is above the threshold.

    All windows come out: one that falls below the threshold later must replace what was said of it before. Readers keep
    the newest row of each tick and then those that are ``high``.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    counted = timed.groupBy(F.window("ts", width, slide).alias("_w")).agg(
        F.count_if(F.col("status_code").between(500, 599)).alias("errors"), F.count(F.lit(1)).alias("total"))
    ratio = (F.col("errors") / seconds) / F.greatest(F.col("total") / seconds, F.lit(MIN_RATE))
    return counted.select(F.unix_seconds("_w.end").alias("tick"), "errors", "total", ratio.alias("ratio"),
                          (ratio > threshold).alias("high"))
