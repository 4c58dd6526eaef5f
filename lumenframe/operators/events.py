"""Event rollups, dashboard summaries, run history and duration histograms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.operators.ordered import newest_per_group
from lumenframe.session import materialise

# Event names shown on the dashboard.
EVENT_NAMES = {
    "signups": "user_signup",
    "logins": "user_login",
    "uploads": "file_upload",
    "analysis_requests": "analysis_requested",
    "executions": "task_execution",
    "cancellations": "task_canceled",
}

# Histogram bounds in seconds.
REQUEST_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
TASK_BOUNDS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]

PREVIEW_CHARS = 200


def latest_time(df: DataFrame, column: str, as_of: dt.datetime | None = None) -> dt.datetime | None:
    """``as_of`` or else the newest value of ``column``: one value, so later filters carry a literal and prune."""
    return as_of if as_of is not None else df.agg(F.max(column)).first()[0]


def _since(df: DataFrame, column: str, moment: dt.datetime | None) -> DataFrame:
    if moment is None:
        return df
    return df.filter(F.col(column) >= F.lit(moment).cast(df.schema[column].dataType))


def recent(df: DataFrame, column: str, days: int, as_of: dt.datetime | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the bound is pushed to the scan."""
    end = latest_time(df, column, as_of)
    return _since(df, column, end - dt.timedelta(days=days) if end else None)


def daily_rollup(events: DataFrame) -> DataFrame:
    """UTC date x event type. Sum and count of durations are kept so that averages can be merged rightly."""
    return (events.groupBy(F.to_date("created_at").alias("summary_date"), "event_type")
            .agg(F.count(F.lit(1)).alias("total_count"),
                 F.count_if(F.col("status") == "success").alias("success_count"),
                 F.count_if(F.col("status") != "success").alias("failure_count"),
                 F.avg("duration_ms").alias("avg_duration_ms"),
                 F.sum("duration_ms").alias("duration_sum"),
                 F.count("duration_ms").alias("duration_count"),
                 F.max("created_at").alias("last_event_at")))


def rolling_rollup(events: DataFrame, days: int = 30, as_of: dt.datetime | None = None) -> DataFrame:
    """Rollup of the last ``days`` whole days."""
    end = latest_time(events, "created_at", as_of)
    if end is None:
        return daily_rollup(events)
    first = dt.datetime.combine(end.date() - dt.timedelta(days=days), dt.time.min)
    return daily_rollup(_since(events, "created_at", first))


def merge_rollups(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Additive upsert of two rollups: counts add, the average comes from sum and count."""
    key = ["summary_date", "event_type"]
    both = stored.unionByName(fresh)
    return (both.groupBy(*key)
            .agg(F.sum("total_count").alias("total_count"), F.sum("success_count").alias("success_count"),
                 F.sum("failure_count").alias("failure_count"),
                 F.try_divide(F.sum("duration_sum"), F.sum("duration_count")).alias("avg_duration_ms"),
                 F.sum("duration_sum").alias("duration_sum"), F.sum("duration_count").alias("duration_count"),
                 F.max("last_event_at").alias("last_event_at")))


def replace_days(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rolling rebuild: whole days present in ``fresh`` replace the stored ones."""
    days = fresh.select("summary_date").distinct()
    return stored.join(days, "summary_date", "left_anti").unionByName(fresh)


def _window_days(rollup: DataFrame, days: int, as_of: dt.date | None) -> DataFrame:
    end = latest_time(rollup, "summary_date", as_of)
    if end is None:
        return rollup
    return rollup.filter(F.col("summary_date") >= F.lit(end - dt.timedelta(days=days)))


def summary_by_type(rollup: DataFrame, days: int = 7, as_of: dt.date | None = None) -> DataFrame:
    """Sums per type; ``avg_duration_ms`` is the plain mean of daily means, ``weighted_duration_ms`` the true one."""
    return (_window_days(rollup, days, as_of).groupBy("event_type")
            .agg(F.sum("total_count").alias("total_count"), F.sum("success_count").alias("success_count"),
                 F.sum("failure_count").alias("failure_count"), F.avg("avg_duration_ms").alias("avg_duration_ms"),
                 F.try_divide(F.sum("duration_sum"), F.sum("duration_count")).alias("weighted_duration_ms"))
            .orderBy(F.col("total_count").desc(), "event_type"))


def summary_totals(rollup: DataFrame, days: int = 7, as_of: dt.date | None = None) -> DataFrame:
    total = [F.coalesce(F.sum(c), F.lit(0)) for c in ("total_count", "success_count", "failure_count")]
    return (_window_days(rollup, days, as_of)
            .agg(total[0].alias("total_events"), total[1].alias("success_events"),
                 total[2].alias("failure_events"))
            .withColumn("success_rate", F.coalesce(
                F.try_divide(F.col("success_events"), F.col("total_events")), F.lit(0.0))))


def dashboard_cards(rollup: DataFrame, days: int = 7, names: dict[str, str] = EVENT_NAMES,
                    as_of: dt.date | None = None) -> DataFrame:
    """One row of dashboard numbers."""
    by_type = summary_by_type(rollup, days, as_of)

    def one(card: str, column: str) -> Column:
        return F.max(F.when(F.col("event_type") == names[card], F.col(column)))

    counts = [F.coalesce(one(c, "total_count"), F.lit(0)).alias(c)
              for c in ("signups", "logins", "uploads", "analysis_requests")]
    rate = F.try_divide(one("executions", "success_count"), one("executions", "total_count"))
    return by_type.agg(*counts, F.coalesce(rate, F.lit(0.0)).alias("task_success_rate"),
                       one("analysis_requests", "avg_duration_ms").alias("analysis_avg_duration_ms"))


def upload_distribution(events: DataFrame, days: int = 7, names: dict[str, str] = EVENT_NAMES,
                        as_of: dt.datetime | None = None) -> DataFrame:
    return (recent(events, "created_at", days, as_of).filter(F.col("event_type") == names["uploads"])
            .groupBy(F.coalesce("file_type", F.lit("unknown")).alias("file_type"))
            .agg(F.count(F.lit(1)).alias("upload_count"),
                 F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("total_bytes"),
                 F.avg("file_size_bytes").alias("avg_size_bytes"),
                 F.max("file_size_bytes").alias("max_size_bytes"))
            .orderBy(F.col("upload_count").desc(), "file_type"))


def user_overview(events: DataFrame, days: int = 7, names: dict[str, str] = EVENT_NAMES,
                  as_of: dt.datetime | None = None) -> DataFrame:
    """Activity cards for every user at once."""
    def hits(card: str) -> Column:
        return F.count_if(F.col("event_type") == names[card]).alias(card)

    uploaded = F.when(F.col("event_type") == names["uploads"], F.col("file_size_bytes"))
    return (recent(events, "created_at", days, as_of).groupBy("user_id")
            .agg(hits("logins"), hits("uploads"), hits("analysis_requests"), hits("cancellations"),
                 F.coalesce(F.sum(uploaded), F.lit(0)).alias("total_upload_bytes")))


def user_event_counts(events: DataFrame, days: int = 7, as_of: dt.datetime | None = None) -> DataFrame:
    return (recent(events, "created_at", days, as_of).groupBy("user_id", "event_type")
            .agg(F.count(F.lit(1)).alias("count")))


def performance_series(rollup: DataFrame, days: int = 7, names: dict[str, str] = EVENT_NAMES,
                       as_of: dt.date | None = None) -> DataFrame:
    """Daily requests, mean duration, executions and success rate."""
    asked, run = names["analysis_requests"], names["executions"]

    def one(kind: str, column: Column) -> Column:
        return F.max(F.when(F.col("event_type") == kind, column))

    return (_window_days(rollup, days, as_of).filter(F.col("event_type").isin(asked, run))
            .groupBy(F.col("summary_date").alias("date"))
            .agg(F.coalesce(one(asked, F.col("total_count")), F.lit(0)).alias("analysis_requests"),
                 one(asked, F.col("avg_duration_ms")).alias("analysis_avg_duration_ms"),
                 F.coalesce(one(run, F.col("total_count")), F.lit(0)).alias("task_executions"),
                 one(run, F.try_divide(F.col("success_count"), F.col("total_count"))).alias("task_success_rate"))
            .orderBy("date"))


# Run history ---------------------------------------------------------------------------------------------------

def enrich_runs(runs: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Preview, metric columns (key case does not matter) and defaults for a run log."""
    parsed = F.from_json(F.lower(F.col(metrics)), "accuracy double, auc double, f1 double")
    return (runs.withColumn("_m", parsed)
            .withColumn("answer_preview", F.left("answer", F.lit(PREVIEW_CHARS)))
            .withColumn("accuracy", F.col("_m.accuracy")).withColumn("auc", F.col("_m.auc"))
            .withColumn("f1", F.col("_m.f1")).drop("_m"))


def history_items(runs: DataFrame) -> DataFrame:
    """Display form of a run: SUCCESS when there is an answer, defaults for missing fields."""
    preview = F.coalesce("answer_preview", F.lit(""))
    return runs.select(
        "id", "user_id", F.coalesce("question", F.lit("")).alias("query"), preview.alias("result"),
        F.col("created_at").alias("timestamp"), F.coalesce("confidence_score", F.lit(0.0)).alias("confidence"),
        F.when(preview != "", "SUCCESS").otherwise("FAILURE").alias("status"),
        F.coalesce("task_type", F.lit("analysis")).alias("task_type"))


def history_page(runs: DataFrame, user, limit: int = 20, offset: int = 0) -> DataFrame:
    """One user's page, newest first, with the user's total beside each row."""
    mine = runs.filter(F.col("user_id") == user)
    total = mine.agg(F.count(F.lit(1))).scalar()
    return (mine.withColumn("total", total)
            .orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit))


def history_pages(runs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """The same page for every user."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id"))
    totals = runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return (runs.withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= offset + limit).filter(F.col("position") > offset)
            .join(totals, "user_id"))


def search_history(items: DataFrame, text: str | None = None, status: str | None = None,
                   min_confidence: float | None = None, since_hours: int | None = None,
                   as_of: dt.datetime | None = None) -> DataFrame:
    """Filters over the whole history, before any paging. Missing and zero confidence never pass a minimum."""
    found = items
    if text:
        needle = text.lower()
        found = found.filter(F.lower("query").contains(needle) | F.lower("result").contains(needle))
    if status and status != "all":
        found = found.filter(F.col("status") == status)
    if min_confidence is not None:
        found = found.filter((F.col("confidence") != 0) & (F.col("confidence") >= min_confidence))
    if since_hours is not None:
        end = latest_time(items, "timestamp", as_of)
        found = _since(found, "timestamp", end - dt.timedelta(hours=since_hours) if end else None)
    return found


def sort_history(items: DataFrame, by: str = "date") -> DataFrame:
    orders = {
        "date": [F.col("timestamp").desc()],
        "confidence": [F.coalesce("confidence", F.lit(0.0)).desc()],
        "status": [F.col("status").asc()],
    }
    return items.orderBy(*orders[by], "id")


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """A sorted frame with each row's place, from 1. The sort deals the rows into ranges; only the sizes of these, one row
    per range, are summed in one task."""
    numbered = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (numbered.withColumn("_part", part).join(starts, "_part")
            .withColumn(name, F.col("_start") + inside + 1).drop("_at", "_part", "_start"))


def history_stats(items: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return items.agg(
        n.alias("total_queries"),
        F.coalesce(F.try_divide(F.count_if(F.col("status") == "SUCCESS"), n) * 100, F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"))


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return newest_per_group(runs, ["user_id"], [F.col("created_at").desc(), F.col("id")], limit)


# Counters and histograms ---------------------------------------------------------------------------------------

def request_counters(requests: DataFrame) -> DataFrame:
    return (requests.groupBy(F.upper("method").alias("method"), "path",
                             F.col("status_code").cast("string").alias("status"))
            .agg(F.count(F.lit(1)).alias("total")))


def task_counters(events: DataFrame, name: str = "event_type", status: str = "status") -> DataFrame:
    return (events.groupBy(F.col(name).alias("task_name"), F.col(status).alias("status"))
            .agg(F.count(F.lit(1)).alias("total")))


def bound_name(bound: float) -> str:
    return "b_" + f"{bound:g}".replace(".", "_")


def bucket_counts(duration: Column, bounds: list[float]) -> list[Column]:
    """One cumulative count per bound: a single pass with map-side combine, no row is multiplied."""
    return [F.count_if(duration <= b).alias(bound_name(b)) for b in bounds]


def duration_histogram(rows: DataFrame, labels: list[Column], duration: Column, bounds: list[float],
                       clamp_buckets: bool = False) -> DataFrame:
    """Cumulative ``le`` buckets in long form, with ``+Inf``, the sum of non-negative durations and the count."""
    positive = F.greatest(duration, F.lit(0.0))
    grouped = rows.groupBy(*labels).agg(
        *bucket_counts(positive if clamp_buckets else duration, bounds),
        F.count(F.lit(1)).alias("count"), F.sum(positive).alias("sum"))
    keys = [c for c in grouped.columns if not c.startswith("b_") and c not in ("count", "sum")]
    lines = [F.struct(F.lit(str(b)).alias("le"), F.col(bound_name(b)).alias("cumulative")) for b in bounds]
    lines.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))
    return (grouped.select(*keys, "sum", "count", F.explode(F.array(*lines)).alias("line"))
            .select(*keys, "line.le", "line.cumulative", "sum", "count"))
