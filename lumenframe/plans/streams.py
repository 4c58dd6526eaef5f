"""Registered streaming queries: each runs over three spans of the events, late ones among them, and is read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import sessions as se
from lumenframe.operators.events import REQUEST_BOUNDS, bound_name
from lumenframe.plans import alerts as batch_alerts, events as batch_events, sessions as batch_sessions
from lumenframe.plans.inputs import VIEWS, table
from lumenframe.plans.shape import day, moment, round_columns, rounded
from lumenframe.streaming import events as st, sink, state as ss


BATCHES = 3


def steps(events, late_seconds=300):
    """The events in the order in which they come: three spans of time, in which every seventh event is late and may come with
    the span behind its own."""
    ends = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    if ends["first"] is None:
        return [events] * BATCHES
    comes = F.col("ts") + F.when(F.col("event_id") % 7 == 0, F.expr(f"INTERVAL {late_seconds} SECONDS")).otherwise(
        F.expr("INTERVAL 0 SECONDS"))
    cuts = [ends["first"] + (ends["last"] - ends["first"]) * i / BATCHES for i in range(1, BATCHES)]
    span = sum((F.when(comes >= F.lit(c).cast("timestamp_ntz"), 1).otherwise(0) for c in cuts), F.lit(0))
    return [events.filter(span == i) for i in range(BATCHES)]


def _run(spark, sf, name, build, late_seconds=300, **options):
    """``build`` over the view ``name`` of the events, in three micro-batches."""
    return sink.run_in_steps(steps(table(spark, sf, "events"), late_seconds),
                             lambda events: build(spark.sql(VIEWS[name], events=events)), **options)


def g03_stream_rollup(spark, sf):
    rows = _run(spark, sf, "analytics_events", st.stream_rollup, label="rollup")
    found = sink.latest_per_key(rows, ["summary_date", "event_type"])
    return found.select(day("summary_date"), "event_type", "total_count", "success_count", "failure_count",
                        rounded("avg_duration_ms", 8), moment("last_event_at"))


def g16_stream_counters(spark, sf):
    labels = ["method", "path", "status"]
    rows = _run(spark, sf, "http_requests", lambda r: st.stream_counters(
        r.withColumn("status", F.col("status_code").cast("string")), labels), label="counters")
    return sink.latest_per_key(rows, labels)


def g17_stream_histogram(spark, sf):
    rows = _run(spark, sf, "http_requests", lambda r: st.stream_histogram(
        r, ["method", "path"], F.col("duration_seconds"), REQUEST_BOUNDS), label="histogram")
    return round_columns(sink.latest_per_key(rows, ["method", "path"]), "sum")


def g18_stream_error_ratio(spark, sf):
    rows = _run(spark, sf, "http_requests", st.stream_error_ratio, label="error-ratio")
    return sink.latest_per_key(rows, ["tick"]).filter("high").select("tick", "errors", "total")


def i08_stream_progress(spark, sf):
    rows = _run(spark, sf, "task_progress", se.normalise_progress, mode="append", label="progress")
    return rows.select("seq", "type", "progress_percent", "eta_seconds", "can_cancel", "token_count_total")


def i09_stream_latest_terminal(spark, sf):
    sink.use_rocks(spark)
    rows = _run(spark, sf, "task_progress", ss.stream_latest_terminal, label="terminal", idle_batches=False)
    return sink.latest_per_key(rows, ["task_id"]).select("task_id", "seq", "status")


def i13_stream_heartbeats(spark, sf):
    """Heartbeats of the silences that ended; the last silence of a task is still open. Messages come in order."""
    sink.use_rocks(spark)
    rows = _run(spark, sf, "task_progress", ss.stream_heartbeats, late_seconds=0, mode="append", label="heartbeats",
                idle_batches=False)
    ends = table(spark, sf, "events").groupBy((F.col("event_id") % 50).cast("string").alias("task_id")).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("seq"))
    closed = rows.join(ends, ["task_id", "seq"], "left_anti")
    return closed.groupBy("seq").agg(F.sum("heartbeats").alias("heartbeats"))


_HIST_COLUMNS = ", ".join(f"COUNT(*) FILTER (WHERE duration_seconds <= {b}) AS {bound_name(b)}" for b in REQUEST_BOUNDS)
_ERRORS = batch_alerts._steps("http_requests", "ts", {
    "errors": "COUNT(*) FILTER (WHERE status_code BETWEEN 500 AND 599)", "n": "COUNT(*)"}, 300)

SQL = {
    "g03_stream_rollup": batch_events.SQL["g01_daily_rollup"],
    "g16_stream_counters": """SELECT method, path, CAST(status_code AS VARCHAR) AS status, COUNT(*) AS total
FROM http_requests GROUP BY 1, 2, 3""",
    "g17_stream_histogram": f"""SELECT method, path, {_HIST_COLUMNS}, COUNT(*) AS count,
  ROUND(SUM(GREATEST(duration_seconds, 0.0)), 4) AS sum FROM http_requests GROUP BY 1, 2""",
    "g18_stream_error_ratio": f"""WITH {_ERRORS} SELECT tick, errors, n AS total FROM points
WHERE (errors / 300) / GREATEST(n / 300, 0.001) > 0.05""",
    "i08_stream_progress": """SELECT seq, CASE status WHEN 'started' THEN 'started' WHEN 'processing' THEN 'processing'
    WHEN 'completed' THEN 'result' ELSE 'error' END AS type,
  CASE status WHEN 'started' THEN 5 WHEN 'processing' THEN 50 ELSE 100 END AS progress_percent,
  CASE status WHEN 'started' THEN 120 WHEN 'processing' THEN 60 END AS eta_seconds,
  status IN ('started', 'processing') AS can_cancel, 0 AS token_count_total FROM task_progress""",
    "i09_stream_latest_terminal": f"WITH {batch_sessions._LATEST.format(hours=24 * 365)} SELECT task_id, seq, status FROM terminal",
    "i13_stream_heartbeats": """SELECT seq, CAST(CASE WHEN status IN ('completed', 'failed') THEN 0
  ELSE (epoch_us(nx) - epoch_us(emitted_at)) // 15000000 END AS BIGINT) AS heartbeats FROM (SELECT *, LEAD(emitted_at)
  OVER (PARTITION BY task_id ORDER BY emitted_at, seq) AS nx FROM task_progress) WHERE nx IS NOT NULL""",
}

QUERIES = [g03_stream_rollup, g16_stream_counters, g17_stream_histogram, g18_stream_error_ratio, i08_stream_progress,
           i09_stream_latest_terminal, i13_stream_heartbeats]
