"""Registered queries of drift checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import drift as dr
from lumenframe.plans.inputs import view
from lumenframe.plans.shape import round_columns

COLUMNS = ["o_totalprice", "shifted"]


def _side(spark, sf, name):
    return view(spark, sf, "drift_pair").filter(F.col("side") == name)


def e01_baseline_profile(spark, sf):
    return round_columns(dr.baseline_profile(_side(spark, sf, "baseline"), COLUMNS), "mean", "std")


def e01_baseline_values(spark, sf):
    return dr.baseline_values(_side(spark, sf, "baseline"), COLUMNS)


def _report(spark, sf):
    """The baseline also knows a column that is gone and one without values."""
    base = _side(spark, sf, "baseline").withColumn("gone", F.col("shifted")).withColumn("empty", F.col("shifted"))
    now = _side(spark, sf, "current").withColumn("empty", F.lit(None).cast("double"))
    names = [*COLUMNS, "gone", "empty"]
    return dr.drift_report(dr.baseline_profile(base, names), dr.baseline_values(base, names), now)


def e02_ks_distances(spark, sf):
    return round_columns(_report(spark, sf), "ks_stat", "p_value", "current_mean", "baseline_mean").filter(
        "status = 'ok'")


def e03_drift_status(spark, sf):
    return _report(spark, sf).select("column", "status", "drift")


def e03_drift_verdict(spark, sf):
    return dr.drift_verdict(_report(spark, sf))


_KS = """v AS (SELECT 'o_totalprice' AS "column", side, o_totalprice AS value FROM drift_pair
  UNION ALL SELECT 'shifted', side, shifted FROM drift_pair),
t AS (SELECT "column", value, COUNT(*) FILTER (WHERE side = 'baseline') AS b,
  COUNT(*) FILTER (WHERE side = 'current') AS c FROM v GROUP BY 1, 2),
f AS (SELECT "column", SUM(b) OVER w / SUM(b) OVER (PARTITION BY "column") AS fb,
  SUM(c) OVER w / SUM(c) OVER (PARTITION BY "column") AS fc FROM t
  WINDOW w AS (PARTITION BY "column" ORDER BY value)),
d AS (SELECT "column", MAX(ABS(fb - fc)) AS ks FROM f GROUP BY 1),
s AS (SELECT "column", COUNT(*) FILTER (WHERE side = 'baseline') AS n, COUNT(*) FILTER (WHERE side = 'current') AS m,
  AVG(value) FILTER (WHERE side = 'baseline') AS bm, AVG(value) FILTER (WHERE side = 'current') AS cm FROM v GROUP BY 1),
z AS (SELECT *, sqrt(n * m / (n + m)) * ks AS z FROM d JOIN s USING ("column")),
p AS (SELECT *, CASE WHEN z < 1 THEN 1 - sqrt(2 * pi()) / z * (SELECT SUM(exp(-((2 * k - 1) ** 2) * pi() ** 2 / (8 * z * z)))
    FROM range(1, 101) r(k)) ELSE 2 * (SELECT SUM(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * z * z))
    FROM range(1, 101) r(k)) END AS p_raw FROM z),
rep AS (SELECT *, GREATEST(0.0, LEAST(1.0, p_raw)) AS p_value FROM p)"""

SQL = {
    "e01_baseline_profile": "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT({c}) AS rows, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_POP({c}), 4) AS std "
        f"FROM drift_pair WHERE side = 'baseline'" for c in COLUMNS),
    "e01_baseline_values": "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS copies FROM drift_pair WHERE side = 'baseline' GROUP BY 2"
        for c in COLUMNS),
    "e02_ks_distances": f"""WITH {_KS} SELECT "column", 'ok' AS status, p_value < 0.05 AS drift,
  ROUND(p_value, 4) AS p_value, ROUND(ks, 4) AS ks_stat, ROUND(cm, 4) AS current_mean, ROUND(bm, 4) AS baseline_mean
FROM rep""",
    "e03_drift_status": f"""WITH {_KS} SELECT "column", 'ok' AS status, p_value < 0.05 AS drift FROM rep
UNION ALL SELECT 'gone', 'missing', true UNION ALL SELECT 'empty', 'insufficient_data', false""",
    "e03_drift_verdict": f"WITH {_KS} SELECT COUNT(*) > 0 AS drift_detected FROM rep",
}

QUERIES = [e01_baseline_profile, e01_baseline_values, e02_ks_distances, e03_drift_status, e03_drift_verdict]
