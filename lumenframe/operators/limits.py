"""Request limits: client keys, headers and windows aligned to the clock.

Windows that start at a client's first request, and penalties that depend on every earlier decision, are left to the
service that takes the requests: replaying them is a step-by-step simulation, not a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW_SECONDS = 60


def client_key(forwarded: Column, host: Column) -> Column:
    """First forwarded address, else the host, else 'unknown'."""
    first = F.trim(F.element_at(F.split(F.nullif(forwarded, F.lit("")), ","), 1))
    return F.coalesce(first, F.nullif(host, F.lit("")), F.lit("unknown"))


def limit_headers(limit: Column, remaining: Column, reset: Column) -> list[Column]:
    floor = lambda c: F.greatest(c, F.lit(0)).cast("string")
    return [floor(limit).alias("x_ratelimit_limit"), floor(remaining).alias("x_ratelimit_remaining"),
            floor(reset).alias("x_ratelimit_reset")]


def clock_windows(requests: DataFrame, limit: int, window: int = WINDOW_SECONDS, ts: str = "ts") -> DataFrame:
    """Requests, allowed and rejected per scope, identity and clock window: one aggregate. Nulls are a group."""
    start = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / window) * window
    n = F.count(F.lit(1))
    return (requests.groupBy("scope", "identity", start.alias("window_start"))
            .agg(n.alias("requests"), F.least(n, F.lit(limit)).alias("allowed"),
                 F.greatest(n - limit, F.lit(0)).alias("rejected")))
