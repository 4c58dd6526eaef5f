"""Registered queries of alert rules and request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import alerts as al, limits as li
from lumenframe.operators.events import REQUEST_BOUNDS, TASK_BOUNDS
from lumenframe.plans.inputs import view
from lumenframe.plans.shape import moment, round_columns


def _requests(spark, sf):
    return view(spark, sf, "http_requests")


def g18_error_ratio_alerts(spark, sf):
    return al.error_ratio_alerts(_requests(spark, sf))


def g19_request_p95_points(spark, sf):
    points = al.p95_points(_requests(spark, sf), "ts", F.col("duration_seconds"), REQUEST_BOUNDS, 300, 0.3)
    return round_columns(points, "p95", digits=8)


def g19_request_p95_alerts(spark, sf):
    return al.p95_alerts(_requests(spark, sf), "ts", F.col("duration_seconds"), REQUEST_BOUNDS, threshold=0.3)


def g19_task_p95_alerts(spark, sf):
    events = view(spark, sf, "analytics_events").filter(F.col("duration_ms").isNotNull())
    return al.p95_alerts(events, "created_at", F.col("duration_ms") / 1000, TASK_BOUNDS, 600, 900, 0.4)


def g20_failure_rate_alerts(spark, sf):
    return al.failure_rate_alerts(view(spark, sf, "analytics_events"), "created_at", F.col("status") != "success",
                                  threshold=0.003)


def g21_silences(spark, sf):
    gaps = al.silences(_requests(spark, sf), "path", "ts", "event_id")
    return round_columns(gaps, "gap_seconds", digits=6).select("path", moment("last_seen"), moment("next_at"), "gap_seconds")


def _limited(spark, sf):
    """One client per event type, so that limits are reached."""
    return _requests(spark, sf).select("event_id", "ts", F.lit("ask").alias("scope"), F.col("path").alias("identity"))


def j01_clock_windows(spark, sf):
    return li.clock_windows(_limited(spark, sf), limit=3, window=3600)


def j04_client_keys(spark, sf):
    n = F.col("event_id")
    forwarded = F.when(n % 3 == 0, F.concat(F.lit(" 10.0.0."), (n % 250).cast("string"), F.lit(" , 172.16.0.1"))).when(
        n % 3 == 1, F.lit(""))
    host = F.when(n % 2 == 0, F.concat(F.lit("host-"), F.col("path")))
    headers = li.limit_headers(F.lit(5), 3 - (n % 7), n % 4 - 1)
    return _requests(spark, sf).select("event_id", li.client_key(forwarded, host).alias("client"), *headers)


def _steps(source, ts, measures, width):
    inner = ", ".join(f"{expr} AS {name}" for name, expr in measures.items())
    outer = ", ".join(f"CAST(SUM({name}) AS BIGINT) AS {name}" for name in measures)
    return f"""steps AS (SELECT CAST(floor(epoch_us({ts}) / 30000000) AS BIGINT) * 30 AS step, {inner} FROM {source}
  GROUP BY 1), points AS (SELECT tick, {outer} FROM (SELECT *, unnest(range(step + 30, step + {width} + 1, 30)) AS tick
  FROM steps) GROUP BY 1)"""


def _islands(condition, hold):
    return f"""isl AS (SELECT tick, tick - 30 * ROW_NUMBER() OVER (ORDER BY tick) AS run FROM points WHERE {condition})
SELECT MIN(tick) AS since, MAX(tick) AS until, COUNT(*) AS points, MAX(tick) - MIN(tick) >= {hold} AS firing FROM isl GROUP BY run"""


def _bucket_measures(duration, bounds):
    found = {f"b{i}": f"COUNT(*) FILTER (WHERE {duration} <= {b})" for i, b in enumerate(bounds)}
    return {**found, "n": "COUNT(*)"}


def _quantile_sql(bounds):
    text = "CASE"
    for i, upper in enumerate(bounds):
        lower, before = (bounds[i - 1], f"b{i - 1}") if i else (0.0, "0")
        text += f" WHEN b{i} >= 0.95 * n THEN {lower} + ({upper} - {lower}) * (0.95 * n - {before}) / (b{i} - {before})"
    return text + f" ELSE {bounds[-1]} END"


_REQUEST_STEPS = _steps("http_requests", "ts", _bucket_measures("duration_seconds", REQUEST_BOUNDS), 300)
_TASK_STEPS = _steps("analytics_events WHERE duration_ms IS NOT NULL", "created_at",
                     _bucket_measures("duration_ms / 1000", TASK_BOUNDS), 600)

SQL = {
    "g18_error_ratio_alerts": "WITH " + _steps("http_requests", "ts", {
        "errors": "COUNT(*) FILTER (WHERE status_code BETWEEN 500 AND 599)", "n": "COUNT(*)"}, 300) + ", "
        + _islands("(errors / 300) / GREATEST(n / 300, 0.001) > 0.05", 300),
    "g19_request_p95_points": f"""WITH {_REQUEST_STEPS} SELECT tick, n AS count, ROUND(p, 8) AS p95
FROM (SELECT *, {_quantile_sql(REQUEST_BOUNDS)} AS p FROM points) WHERE p > 0.3""",
    "g19_request_p95_alerts": f"WITH {_REQUEST_STEPS}, " + _islands(f"({_quantile_sql(REQUEST_BOUNDS)}) > 0.3", 600),
    "g19_task_p95_alerts": f"WITH {_TASK_STEPS}, " + _islands(f"({_quantile_sql(TASK_BOUNDS)}) > 0.4", 900),
    "g20_failure_rate_alerts": "WITH " + _steps("analytics_events", "created_at", {
        "f": "COUNT(*) FILTER (WHERE status <> 'success')"}, 300) + ", " + _islands("f / 300 > 0.003", 600),
    "g21_silences": """SELECT path, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last_seen,
  strftime(nx, '%Y-%m-%d %H:%M:%S.%f') AS next_at, ROUND((epoch_us(nx) - epoch_us(ts)) / 1000000, 6) AS gap_seconds
FROM (SELECT *, LEAD(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nx FROM http_requests)
WHERE epoch_us(nx) - epoch_us(ts) > 60000000""",
    "j01_clock_windows": """SELECT 'ask' AS scope, path AS identity,
  CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS window_start, COUNT(*) AS requests,
  LEAST(COUNT(*), 3) AS allowed, GREATEST(COUNT(*) - 3, 0) AS rejected FROM http_requests GROUP BY 2, 3""",
    "j04_client_keys": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (event_id % 250)
    WHEN event_id % 2 = 0 THEN 'host-' || path ELSE 'unknown' END AS client, '5' AS x_ratelimit_limit,
  CAST(GREATEST(3 - event_id % 7, 0) AS VARCHAR) AS x_ratelimit_remaining,
  CAST(GREATEST(event_id % 4 - 1, 0) AS VARCHAR) AS x_ratelimit_reset FROM http_requests""",
}

QUERIES = [g18_error_ratio_alerts, g19_request_p95_points, g19_request_p95_alerts, g19_task_p95_alerts,
           g20_failure_rate_alerts, g21_silences, j01_clock_windows, j04_client_keys]
