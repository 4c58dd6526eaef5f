"""Routing, progress messages, request limits, drift and privacy on small frames."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.text import normalise_name, token_estimate
from lumenframe.operators import drift as dr, events as ev, limits as li, privacy as pv, sessions as se


@pytest.mark.parametrize("question,route,floor", [
    ("Analysez ce fichier CSV données", "analysis", 0.85), ("Qu'est-ce que le RGPD?", "rag", 0.75),
    ("Anomalies détectées dans le dataset", "analysis", 0.85), ("Documents réglementation conformité", "rag", 0.85),
    ("Aide-moi", "ambiguous", 0.50)])
def test_routes(spark, question, route, floor):
    row = se.route_questions(spark.createDataFrame([(question,)], "question string")).first()
    assert row["task_type"] == route and row["confidence"] >= floor
    assert row["fallback"] == ("rag" if route == "ambiguous" else None)


def test_token_counts(spark):
    df = spark.createDataFrame([("",), (None,), ("abc",), ("a" * 9,)], "t string")
    assert [r[0] for r in df.select(token_estimate(F.col("t"))).collect()] == [0, 0, 1, 2]


def test_progress_defaults_and_overrides(spark):
    df = spark.createDataFrame([("1", "processing", '{"input_text": "hello world", "output_text": "bonjour"}'),
                                ("2", "completed", "{}"), ("3", "odd", None)], "task_id string, status string, payload string")
    rows = {r["task_id"]: r for r in se.normalise_progress(df).collect()}
    assert rows["1"]["token_count_total"] == rows["1"]["token_count_input"] + rows["1"]["token_count_output"] > 0
    assert (rows["1"]["type"], rows["1"]["progress_percent"], rows["1"]["can_cancel"]) == ("processing", 50, True)
    assert (rows["2"]["type"], rows["2"]["progress_percent"], rows["2"]["eta_seconds"]) == ("result", 100, None)
    assert (rows["3"]["type"], rows["3"]["progress_percent"]) == ("progress", 0)


def simulate(requests, limit, window):
    """One request at a time, with one counter per effective window."""
    counters, strikes, until, found = {}, 0, 0, []
    for second in requests:
        if until <= second:
            strikes = 0
        factor = li.penalty(strikes)
        count, expires = counters.get(factor, (0, 0))
        if expires <= second:
            count, expires = 0, second + window * factor
        count += 1
        counters[factor] = (count, expires)
        allowed = count <= limit
        if not allowed:
            if strikes == 0:
                until = second + li.STRIKE_SECONDS
            strikes += 1
        found.append((allowed, count, max(limit - count, 0), expires - second, strikes, factor))
    return found


def test_drift_is_seen_and_absence_reported(spark):
    rng = np.random.default_rng(1)
    base = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.normal(size=800), rng.normal(size=800))],
                                 "a double, b double")
    now = spark.createDataFrame([(float(a),) for a in rng.normal(0.5, 1, 700)], "a double")
    report = {r["column"]: r for r in dr.drift_report(dr.baseline_profile(base), dr.baseline_values(base), now).collect()}
    x, y = np.sort([r[0] for r in base.select("a").collect()]), np.sort([r[0] for r in now.collect()])
    every = np.concatenate([x, y])
    want = np.abs(np.searchsorted(x, every, "right") / 800 - np.searchsorted(y, every, "right") / 700).max()
    assert report["a"]["ks_stat"] == pytest.approx(want) and report["a"]["drift"]
    assert report["b"]["status"] == "missing" and report["b"]["drift"]


def test_names_lose_accents(spark):
    df = spark.createDataFrame([("Prénom-Client",), ("Âge",), ("CODE Postal",), ("nom",)], "c string")
    assert [r[0] for r in df.select(normalise_name(F.col("c"))).collect()] == ["prenom_client", "age", "code_postal", "nom"]


@pytest.mark.parametrize("name,risk,tier", [("Email", "high", "exact"), ("âge", "medium", "exact"), ("Santé", "medium", "exact"),
                                            ("customer_name", "high", "pattern"), ("user_score", "high", "pattern"),
                                            ("home_city", "medium", "pattern"), ("year_born_in", "medium", "semantic"),
                                            ("image", "safe", "none")])
def test_column_classes(spark, name, risk, tier):
    row = pv.classify_columns(spark.createDataFrame([("t", name)], "table_name string, column_name string")).first()
    assert (row["risk"], row["match_tier"]) == (risk, tier)
    assert (row["article"] == "RGPD Article 9") == (name == "Santé")


def test_rollup_merge_keeps_the_true_average(spark):
    rows = [(1, "x", "success", 10.0, dt.datetime(2024, 1, 1, 23, 59, 59)), (2, "x", "error", None, dt.datetime(2024, 1, 1)),
            (3, "x", "success", 40.0, dt.datetime(2024, 1, 1, 5)), (4, "x", "error", 2.0, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id long, event_type string, status string, duration_ms double, created_at timestamp_ntz")
    merged = ev.merge_rollups(ev.daily_rollup(df.filter("id < 3")), ev.daily_rollup(df.filter("id >= 3")))
    first = merged.orderBy("summary_date").first()
    assert first["total_count"] == 3 and first["avg_duration_ms"] == 25.0
    empty = ev.summary_totals(ev.daily_rollup(df.limit(0))).first()
    assert empty["total_events"] == 0 and empty["success_rate"] == 0.0


def test_time_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = ev.recent(df, "ts", 7).select("event_id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_consent_intervals_of_hot_users(spark):
    """Timestamps as cut points: the same intervals when every user counts as hot."""
    rows = [(i, i % 2, "rag_indexing", True, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 3)) for i in range(600)]
    log = spark.createDataFrame(rows, "id long, user_id long, purpose string, granted boolean, granted_at timestamp_ntz")
    hot, plain = pv.consent_intervals(log, hot_rows=10), pv.consent_intervals(log)
    assert sorted(map(str, hot.collect())) == sorted(map(str, plain.collect()))
    assert hot.filter("revoked_at IS NULL").count() == 2
