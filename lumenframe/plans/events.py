"""Registered queries over the event log, the run history and duration histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import events as ev
from lumenframe.plans.inputs import view
from lumenframe.plans.shape import day, moment, round_columns, rounded

# The names the given event table uses for the dashboard cards.
NAMES = {"signups": "signup", "logins": "click", "uploads": "purchase", "analysis_requests": "view",
         "executions": "error", "cancellations": "cancel"}

ROLLUP_SQL = """
SELECT CAST(created_at AS DATE) AS summary_date, event_type, COUNT(*) AS total_count,
  SUM(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS success_count,
  SUM(CASE WHEN status <> 'success' THEN 1 ELSE 0 END) AS failure_count, AVG(duration_ms) AS avg_duration_ms,
  SUM(duration_ms) AS duration_sum, COUNT(duration_ms) AS duration_count, MAX(created_at) AS last_event_at
FROM analytics_events GROUP BY 1, 2"""

ROLLUP_OUT = """SELECT CAST(summary_date AS VARCHAR) AS summary_date, event_type,
  CAST(total_count AS BIGINT) AS total_count, CAST(success_count AS BIGINT) AS success_count,
  CAST(failure_count AS BIGINT) AS failure_count, ROUND(avg_duration_ms, 8) AS avg_duration_ms,
  strftime(last_event_at, '%Y-%m-%d %H:%M:%S.%f') AS last_event_at"""

WEEK = "summary_date >= (SELECT MAX(summary_date) FROM r) - INTERVAL 7 DAY"


def rollup_out(df):
    return df.select(day("summary_date"), "event_type", "total_count", "success_count", "failure_count",
                     rounded("avg_duration_ms", 8), moment("last_event_at"))


def _events(spark, sf):
    return view(spark, sf, "analytics_events")


def a08_recent_events(spark, sf):
    return ev.recent(_events(spark, sf), "created_at", 7).select("id", "event_type", "status", "user_id")


def g01_daily_rollup(spark, sf):
    return rollup_out(ev.daily_rollup(_events(spark, sf)))


def g02_rolling_rollup(spark, sf):
    stored = ev.daily_rollup(_events(spark, sf))
    fresh = ev.rolling_rollup(_events(spark, sf), days=10)
    return rollup_out(ev.replace_days(stored, fresh))


def a12_upsert_rollup(spark, sf):
    """Two halves of the log merged: the same as one rollup over all of it."""
    events = _events(spark, sf)
    old, new = events.filter(F.col("id") % 3 != 0), events.filter(F.col("id") % 3 == 0)
    return rollup_out(ev.merge_rollups(ev.daily_rollup(old), ev.daily_rollup(new)))


def g04_summary_by_type(spark, sf):
    return round_columns(ev.summary_by_type(ev.daily_rollup(_events(spark, sf))),
                       "avg_duration_ms", "weighted_duration_ms")


def g05_totals(spark, sf):
    return round_columns(ev.summary_totals(ev.daily_rollup(_events(spark, sf))), "success_rate")


def g06_dashboard_cards(spark, sf):
    cards = ev.dashboard_cards(ev.daily_rollup(_events(spark, sf)), names=NAMES)
    return round_columns(cards, "task_success_rate", "analysis_avg_duration_ms")


def g07_upload_distribution(spark, sf):
    return round_columns(ev.upload_distribution(_events(spark, sf), names=NAMES), "avg_size_bytes")


def g08_user_overview(spark, sf):
    return ev.user_overview(_events(spark, sf), names=NAMES)


def g08_user_event_counts(spark, sf):
    return ev.user_event_counts(_events(spark, sf))


def g09_performance_series(spark, sf):
    series = ev.performance_series(ev.daily_rollup(_events(spark, sf)), names=NAMES)
    return round_columns(series, "analysis_avg_duration_ms", "task_success_rate").withColumn("date", day("date"))


def _runs(spark, sf):
    return ev.enrich_runs(view(spark, sf, "run_log"))


def g10_history_page(spark, sf):
    page = ev.history_page(_runs(spark, sf), user=0, limit=20, offset=5)
    return page.select("id", "question", "answer_preview", moment("created_at"), "total")


def g10_history_pages(spark, sf):
    return ev.history_pages(_runs(spark, sf), limit=10, offset=3).select("user_id", "id", "position", "total")


def g11_history_search(spark, sf):
    items = ev.history_items(_runs(spark, sf))
    found = ev.search_history(items, text="EN ", status="SUCCESS", min_confidence=0.2, since_hours=7 * 24)
    return found.select("id", "status", "confidence")


def g12_history_sort(spark, sf):
    """The whole history, with each row's place in the order."""
    items = ev.placed(ev.sort_history(ev.history_items(_runs(spark, sf)), "confidence"))
    return items.select("id", "confidence", "status", "place")


def g13_history_stats(spark, sf):
    return round_columns(ev.history_stats(ev.history_items(_runs(spark, sf))), "success_rate", "average_confidence")


def g14_history_items(spark, sf):
    return ev.history_items(_runs(spark, sf)).withColumn("timestamp", moment("timestamp"))


def g15_enriched_runs(spark, sf):
    return _runs(spark, sf).select("id", "answer_preview", "accuracy", "auc", "f1")


def g16_request_counters(spark, sf):
    return ev.request_counters(view(spark, sf, "http_requests"))


def g16_task_counters(spark, sf):
    return ev.task_counters(_events(spark, sf))


def g17_request_histogram(spark, sf):
    rows = view(spark, sf, "http_requests")
    hist = ev.duration_histogram(rows, [F.upper("method").alias("method"), F.col("path")],
                                 F.col("duration_seconds"), ev.REQUEST_BOUNDS)
    return round_columns(hist, "sum")


def g17_task_histogram(spark, sf):
    rows = _events(spark, sf).filter(F.col("duration_ms").isNotNull())
    hist = ev.duration_histogram(rows, [F.col("event_type").alias("task_name")], F.col("duration_ms") / 1000,
                                 ev.TASK_BOUNDS, clamp_buckets=True)
    return round_columns(hist, "sum")


def _histogram_sql(source, labels, duration, bounds, bucket_value):
    pairs = ", ".join(f"('{b}', CAST({b} AS DOUBLE))" for b in bounds) + ", ('+Inf', CAST('infinity' AS DOUBLE))"
    keys = ", ".join(alias for _, alias in labels)
    select = ", ".join(f"{expr} AS {alias}" for expr, alias in labels)
    return f"""
SELECT {keys}, le, CAST(SUM(CASE WHEN bv <= bound THEN 1 ELSE 0 END) AS BIGINT) AS cumulative,
  ROUND(SUM(GREATEST(d, 0.0)), 4) AS sum, COUNT(*) AS count
FROM (SELECT {select}, {duration} AS d, {bucket_value} AS bv FROM {source}) x
CROSS JOIN (VALUES {pairs}) b(le, bound) GROUP BY {keys}, le"""


WEEK_EVENTS = "created_at >= (SELECT MAX(created_at) FROM analytics_events) - INTERVAL 7 DAY"
RUNS_SQL = "e AS (SELECT *, substr(answer, 1, 200) AS answer_preview FROM run_log)"
ITEMS_SQL = RUNS_SQL + """, items AS (SELECT id, user_id, coalesce(question, '') AS query,
  coalesce(answer_preview, '') AS result, created_at AS timestamp, coalesce(confidence_score, 0.0) AS confidence,
  CASE WHEN coalesce(answer_preview, '') <> '' THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
  coalesce(task_type, 'analysis') AS task_type FROM e)"""

SQL = {
    "a08_recent_events": f"SELECT id, event_type, status, user_id FROM analytics_events WHERE {WEEK_EVENTS}",
    "g01_daily_rollup": f"WITH r AS ({ROLLUP_SQL}) {ROLLUP_OUT} FROM r",
    "g02_rolling_rollup": f"WITH r AS ({ROLLUP_SQL}) {ROLLUP_OUT} FROM r",
    "a12_upsert_rollup": f"WITH r AS ({ROLLUP_SQL}) {ROLLUP_OUT} FROM r",
    "g04_summary_by_type": f"""WITH r AS ({ROLLUP_SQL}) SELECT event_type,
  CAST(SUM(total_count) AS BIGINT) AS total_count, CAST(SUM(success_count) AS BIGINT) AS success_count,
  CAST(SUM(failure_count) AS BIGINT) AS failure_count, ROUND(AVG(avg_duration_ms), 4) AS avg_duration_ms,
  ROUND(SUM(duration_sum) / SUM(duration_count), 4) AS weighted_duration_ms FROM r WHERE {WEEK} GROUP BY 1""",
    "g05_totals": f"""WITH r AS ({ROLLUP_SQL}) SELECT CAST(COALESCE(SUM(total_count), 0) AS BIGINT) AS total_events,
  CAST(COALESCE(SUM(success_count), 0) AS BIGINT) AS success_events,
  CAST(COALESCE(SUM(failure_count), 0) AS BIGINT) AS failure_events,
  ROUND(COALESCE(SUM(success_count) / SUM(total_count), 0.0), 4) AS success_rate FROM r WHERE {WEEK}""",
    "g06_dashboard_cards": f"""WITH r AS ({ROLLUP_SQL}) SELECT
  CAST(COALESCE(SUM(total_count) FILTER (WHERE event_type = 'signup'), 0) AS BIGINT) AS signups,
  CAST(COALESCE(SUM(total_count) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS logins,
  CAST(COALESCE(SUM(total_count) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS uploads,
  CAST(COALESCE(SUM(total_count) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS analysis_requests,
  ROUND(COALESCE(SUM(success_count) FILTER (WHERE event_type = 'error')
    / SUM(total_count) FILTER (WHERE event_type = 'error'), 0.0), 4) AS task_success_rate,
  ROUND(AVG(avg_duration_ms) FILTER (WHERE event_type = 'view'), 4) AS analysis_avg_duration_ms
FROM r WHERE {WEEK}""",
    "g07_upload_distribution": f"""SELECT COALESCE(file_type, 'unknown') AS file_type, COUNT(*) AS upload_count,
  CAST(COALESCE(SUM(file_size_bytes), 0) AS BIGINT) AS total_bytes, ROUND(AVG(file_size_bytes), 4) AS avg_size_bytes,
  MAX(file_size_bytes) AS max_size_bytes FROM analytics_events
WHERE event_type = 'purchase' AND {WEEK_EVENTS} GROUP BY 1""",
    "g08_user_overview": f"""SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS logins,
  COUNT(*) FILTER (WHERE event_type = 'purchase') AS uploads,
  COUNT(*) FILTER (WHERE event_type = 'view') AS analysis_requests,
  COUNT(*) FILTER (WHERE event_type = 'cancel') AS cancellations,
  CAST(COALESCE(SUM(file_size_bytes) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS total_upload_bytes
FROM analytics_events WHERE {WEEK_EVENTS} GROUP BY 1""",
    "g08_user_event_counts": f"""SELECT user_id, event_type, COUNT(*) AS count FROM analytics_events
WHERE {WEEK_EVENTS} GROUP BY 1, 2""",
    "g09_performance_series": f"""WITH r AS ({ROLLUP_SQL}) SELECT CAST(summary_date AS VARCHAR) AS date,
  COALESCE(MAX(CASE WHEN event_type = 'view' THEN total_count END), 0) AS analysis_requests,
  ROUND(MAX(CASE WHEN event_type = 'view' THEN avg_duration_ms END), 4) AS analysis_avg_duration_ms,
  COALESCE(MAX(CASE WHEN event_type = 'error' THEN total_count END), 0) AS task_executions,
  ROUND(MAX(CASE WHEN event_type = 'error' THEN success_count / total_count END), 4) AS task_success_rate
FROM r WHERE {WEEK} AND event_type IN ('view', 'error') GROUP BY 1""",
    "g10_history_page": f"""WITH {RUNS_SQL} SELECT id, question, answer_preview,
  strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, (SELECT COUNT(*) FROM e WHERE user_id = 0) AS total
FROM e WHERE user_id = 0 ORDER BY created_at DESC, id LIMIT 20 OFFSET 5""",
    "g10_history_pages": """SELECT user_id, id, position, total FROM (SELECT user_id, id,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position,
  COUNT(*) OVER (PARTITION BY user_id) AS total FROM run_log) WHERE position > 3 AND position <= 13""",
    "g11_history_search": f"""WITH {ITEMS_SQL} SELECT id, status, confidence FROM items
WHERE (contains(lower(query), 'en ') OR contains(lower(result), 'en ')) AND status = 'SUCCESS'
  AND confidence <> 0 AND confidence >= 0.2
  AND timestamp >= (SELECT MAX(timestamp) FROM items) - INTERVAL 168 HOUR""",
    "g12_history_sort": f"WITH {ITEMS_SQL} SELECT id, confidence, status, "
                        "ROW_NUMBER() OVER (ORDER BY confidence DESC, id) AS place FROM items",
    "g13_history_stats": f"""WITH {ITEMS_SQL} SELECT COUNT(*) AS total_queries,
  ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'SUCCESS') / COUNT(*), 4) AS success_rate,
  ROUND(AVG(confidence), 4) AS average_confidence FROM items""",
    "g14_history_items": f"""WITH {ITEMS_SQL} SELECT id, user_id, query, result,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, confidence, status, task_type FROM items""",
    "g15_enriched_runs": """SELECT id, substr(answer, 1, 200) AS answer_preview,
  CAST(json_extract(lower(metrics), '$.accuracy') AS DOUBLE) AS accuracy,
  CAST(json_extract(lower(metrics), '$.auc') AS DOUBLE) AS auc,
  CAST(json_extract(lower(metrics), '$.f1') AS DOUBLE) AS f1 FROM run_log""",
    "g16_request_counters": """SELECT upper(method) AS method, path, CAST(status_code AS VARCHAR) AS status,
  COUNT(*) AS total FROM http_requests GROUP BY 1, 2, 3""",
    "g16_task_counters": """SELECT event_type AS task_name, status, COUNT(*) AS total FROM analytics_events
GROUP BY 1, 2""",
    "g17_request_histogram": _histogram_sql("http_requests", [("upper(method)", "method"), ("path", "path")],
                                            "duration_seconds", ev.REQUEST_BOUNDS, "duration_seconds"),
    "g17_task_histogram": _histogram_sql(
        "analytics_events WHERE duration_ms IS NOT NULL", [("event_type", "task_name")], "duration_ms / 1000",
        ev.TASK_BOUNDS, "GREATEST(duration_ms / 1000, 0.0)"),
}

QUERIES = [a08_recent_events, g01_daily_rollup, g02_rolling_rollup, a12_upsert_rollup, g04_summary_by_type, g05_totals,
           g06_dashboard_cards, g07_upload_distribution, g08_user_overview, g08_user_event_counts,
           g09_performance_series, g10_history_page, g10_history_pages, g11_history_search, g12_history_sort,
           g13_history_stats, g14_history_items, g15_enriched_runs, g16_request_counters, g16_task_counters,
           g17_request_histogram, g17_task_histogram]
