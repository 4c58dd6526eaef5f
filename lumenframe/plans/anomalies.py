"""Registered queries of the anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import anomaly as an, near_trees as nt, neighbours as nb
from lumenframe.plans.inputs import table, view
from lumenframe.plans.shape import rounded

NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURES = [*NUMERIC, "l_returnflag", "l_linestatus", "ship_text", "constant_col"]


def _rows(spark, sf):
    """The profile table with a row key."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_extendedprice", "ship_text", "l_tax", "l_quantity")
    return view(spark, sf, "profile_input").withColumn("row_key", key).drop("l_orderkey")


def c01_ordinal_codes(spark, sf):
    return an.ordinal_codes(_rows(spark, sf), ["l_returnflag", "l_linestatus", "ship_text"])


def c01_encoded(spark, sf):
    matrix = an.encoded_matrix(_rows(spark, sf), "row_key", FEATURES)
    return matrix.select("row_key", "l_returnflag", "l_linestatus", "ship_text")


def c02_imputed(spark, sf):
    matrix = an.encoded_matrix(_rows(spark, sf), "row_key", FEATURES)
    return an.impute(matrix, FEATURES).select("row_key", "l_discount", "l_returnflag")


def c03_scaled(spark, sf):
    scaled = an.scaled_matrix(_rows(spark, sf), "row_key", FEATURES)
    return scaled.select("row_key", *[rounded(c) for c in FEATURES])


def c04_distance_scores(spark, sf):
    return an.distance_scores(_rows(spark, sf), "row_key", NUMERIC).select("row_key", rounded("distance_score"))


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def _scaled_customers(spark, sf):
    return an.scaled_matrix(_customers(spark, sf), "c_custkey")


PARTS = ["c_nationkey", "c_acctbal", "c_mktsegment"]


def c05_histogram_scores(spark, sf):
    scores = an.histogram_scores(_scaled_customers(spark, sf), "c_custkey", PARTS)
    return scores.select("c_custkey", rounded("histogram_score"))


def c06_neighbour_scores(spark, sf):
    scores = nb.neighbour_scores(_scaled_customers(spark, sf), "c_custkey", PARTS, 5)
    return scores.select("c_custkey", rounded("neighbour_score"))


def c06_approximate_recall(spark, sf):
    """The approximate mode on twelve columns of the embeddings: the share of rows whose k-th distance is the true one."""
    rows = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(12)])
    names = [f"x{i}" for i in range(12)]
    exact, near = nb.neighbour_scores(rows, "vec_id", names, 5), nt.approximate_scores(rows, "vec_id", names, 5, leaf_rows=128)
    return nt.score_recall(exact, near, "vec_id")


def c07_isolation_scores(spark, sf):
    scaled = an.scaled_matrix(_rows(spark, sf), "row_key", FEATURES)
    return an.isolation_scores(scaled, "row_key", FEATURES)


def _ensemble(spark, sf):
    """Two models with exact SQL twins."""
    return an.anomaly_scores(_customers(spark, sf), "c_custkey", models=("histogram", "neighbour"))


def c08_ensemble_scores(spark, sf):
    return _ensemble(spark, sf).select("c_custkey", rounded("histogram_score"), rounded("neighbour_score"),
                                       rounded("ensemble_score"))


def c09_labels(spark, sf):
    return _ensemble(spark, sf).select("c_custkey", "label")


def c10_hybrid_scores(spark, sf):
    return _ensemble(spark, sf).select("c_custkey", rounded("hybrid_score"))


def c11_severities(spark, sf):
    return _ensemble(spark, sf).select("c_custkey", "severity")


def c12_anomaly_totals(spark, sf):
    return an.anomaly_totals(_ensemble(spark, sf))


def c12_full_ensemble(spark, sf):
    """All three models over the whole order table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                               "o_orderpriority")
    return an.anomaly_totals(an.anomaly_scores(orders, "o_orderkey"))


def c08_full_scores(spark, sf):
    """Scores, labels and severities of all three models over the customers."""
    found = an.anomaly_scores(_customers(spark, sf), "c_custkey")
    names = ("isolation_score", "histogram_score", "neighbour_score", "ensemble_score", "hybrid_score")
    return found.select("c_custkey", *[rounded(c, 8) for c in names], "label", "severity")


def c13_full_top(spark, sf):
    """The ten most anomalous customers of all three models."""
    found = an.anomaly_scores(_customers(spark, sf), "c_custkey")
    return an.top_anomalies(found, "c_custkey", 10).select("c_custkey", "severity", rounded("hybrid_score", 8))


def c13_top_anomalies(spark, sf):
    top = an.top_anomalies(_ensemble(spark, sf), "c_custkey", 10)
    return top.select("c_custkey", "severity", rounded("hybrid_score"))


def c14_driving_features(spark, sf):
    encoded = an.encoded_matrix(_customers(spark, sf), "c_custkey")
    top = an.top_anomalies(_ensemble(spark, sf), "c_custkey", 10)
    return an.driving_features(encoded, "c_custkey", PARTS, top).select("c_custkey", "feature", rounded("percentile"))


_ROWS = """rows AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_extendedprice, ship_text, l_tax, l_quantity)
  AS row_key FROM profile_input)"""
_CODE = "CASE WHEN {c} IS NOT NULL THEN CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS DOUBLE) END AS {c}"
_STRINGS = ["l_returnflag", "l_linestatus", "ship_text"]
_ENC = _ROWS + ", enc AS (SELECT row_key, " + ", ".join(
    _CODE.format(c=c) if c in _STRINGS else f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES) + " FROM rows)"
_IMP = _ENC + ", imp AS (SELECT row_key, " + ", ".join(
    f"COALESCE({c}, MEDIAN({c}) OVER ()) AS {c}" for c in FEATURES) + " FROM enc)"
_DIST = _ROWS + ", fill AS (SELECT row_key, " + ", ".join(
    f"COALESCE({c}, (SELECT MEDIAN({c}) FROM rows)) AS {c}" for c in NUMERIC) + " FROM rows), q AS (SELECT " + ", ".join(
    f"MEDIAN({c}) AS m_{c}, QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25) AS i_{c}" for c in NUMERIC) + """
  FROM fill), dist AS (SELECT row_key, """ + " + ".join(
    f"CASE WHEN i_{c} > 0 THEN 1 - 1 / (1 + ABS({c} - m_{c}) / i_{c} / 3) ELSE 0 END" for c in NUMERIC) + """ AS s
  FROM fill, q)"""
_CUST = """cust AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS a, c_acctbal AS b,
  CAST(DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS m FROM customer),
sc AS (SELECT c_custkey, (a - AVG(a) OVER ()) / STDDEV_POP(a) OVER () AS x, (b - AVG(b) OVER ()) / STDDEV_POP(b) OVER ()
  AS y, (m - AVG(m) OVER ()) / STDDEV_POP(m) OVER () AS z FROM cust)"""


def _bin(c):
    return f"LEAST(CAST(floor(({c} - MIN({c}) OVER ()) / ((MAX({c}) OVER () - MIN({c}) OVER ()) / 10) + 1e-9) AS INTEGER), 9)"


def _density(c):
    return (f"log2(COUNT(*) OVER (PARTITION BY bn_{c}) / (n * w{c}) + 0.1)")


_HIST = _CUST + ", bins AS (SELECT c_custkey, COUNT(*) OVER () AS n, " + ", ".join(
    f"{_bin(c)} AS bn_{c}, (MAX({c}) OVER () - MIN({c}) OVER ()) / 10 AS w{c}" for c in "xyz") + """ FROM sc),
hist AS (SELECT c_custkey, -(""" + " + ".join(_density(c) for c in "xyz") + ") AS h FROM bins)"
_KNN = """pairs AS (SELECT p.c_custkey, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d
  FROM sc p JOIN sc q ON p.c_custkey <> q.c_custkey),
knn AS (SELECT c_custkey, d AS k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY d) AS rn FROM pairs)
  WHERE rn = 5)"""
_ENSEMBLE = _HIST + ", " + _KNN + """, norm AS (SELECT c_custkey, (h - MIN(h) OVER ()) / (MAX(h) OVER () - MIN(h) OVER ())
  AS h, (k - MIN(k) OVER ()) / (MAX(k) OVER () - MIN(k) OVER ()) AS k FROM hist JOIN knn USING (c_custkey)),
qq AS (SELECT MEDIAN(a) AS ma, QUANTILE_CONT(a, 0.75) - QUANTILE_CONT(a, 0.25) AS ia, MEDIAN(b) AS mb,
  QUANTILE_CONT(b, 0.75) - QUANTILE_CONT(b, 0.25) AS ib FROM cust),
rd AS (SELECT c_custkey, 1 - 1 / (1 + ABS(a - ma) / ia / 3) + 1 - 1 / (1 + ABS(b - mb) / ib / 3) AS s FROM cust, qq),
ens AS (SELECT c_custkey, h, k, (h + k) / 2 AS e, s / MAX(s) OVER () AS s FROM norm JOIN rd USING (c_custkey)),
lab AS (SELECT *, CASE WHEN e >= (SELECT QUANTILE_CONT(e, 0.95) FROM ens) THEN 1 ELSE 0 END AS label,
  e * 0.7 + s * 0.3 AS hy FROM ens),
sev AS (SELECT *, CASE WHEN hy >= 0.7 THEN 'high' WHEN hy >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM lab),
top10 AS (SELECT * FROM sev WHERE label = 1 ORDER BY hy DESC, c_custkey LIMIT 10)"""

SQL = {
    "c01_ordinal_codes": "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, CAST(ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code "
        f"FROM (SELECT DISTINCT {c} FROM profile_input WHERE {c} IS NOT NULL)" for c in _STRINGS),
    "c01_encoded": f"WITH {_ENC} SELECT row_key, l_returnflag, l_linestatus, ship_text FROM enc",
    "c02_imputed": f"WITH {_IMP} SELECT row_key, l_discount, l_returnflag FROM imp",
    "c03_scaled": f"WITH {_IMP} SELECT row_key, " + ", ".join(
        f"ROUND(({c} - AVG({c}) OVER ()) / CASE WHEN STDDEV_POP({c}) OVER () = 0 THEN 1 ELSE STDDEV_POP({c}) OVER () END, 4)"
        f" + 0.0 AS {c}" for c in FEATURES) + " FROM imp",
    "c04_distance_scores": f"WITH {_DIST} SELECT row_key, ROUND(s / (SELECT MAX(s) FROM dist), 4) AS distance_score FROM dist",
    "c05_histogram_scores": f"WITH {_HIST} SELECT c_custkey, ROUND(h, 4) AS histogram_score FROM hist",
    "c06_neighbour_scores": f"WITH {_CUST}, {_KNN} SELECT c_custkey, ROUND(k, 4) AS neighbour_score FROM knn",
    "c08_ensemble_scores": f"""WITH {_ENSEMBLE} SELECT c_custkey, ROUND(h, 4) AS histogram_score,
  ROUND(k, 4) AS neighbour_score, ROUND(e, 4) AS ensemble_score FROM ens""",
    "c09_labels": f"WITH {_ENSEMBLE} SELECT c_custkey, label FROM lab",
    "c10_hybrid_scores": f"WITH {_ENSEMBLE} SELECT c_custkey, ROUND(hy, 4) AS hybrid_score FROM lab",
    "c11_severities": f"WITH {_ENSEMBLE} SELECT c_custkey, severity FROM sev",
    "c12_anomaly_totals": f"""WITH {_ENSEMBLE} SELECT COUNT(*) FILTER (WHERE label = 1) AS anomaly_count,
  ROUND(COUNT(*) FILTER (WHERE label = 1) / COUNT(*) * 100, 2) AS anomaly_rate,
  COUNT(*) FILTER (WHERE label = 1 AND severity = 'high') AS high,
  COUNT(*) FILTER (WHERE label = 1 AND severity = 'medium') AS medium,
  COUNT(*) FILTER (WHERE label = 1 AND severity = 'low') AS low FROM sev""",
    "c13_top_anomalies": f"WITH {_ENSEMBLE} SELECT c_custkey, severity, ROUND(hy, 4) AS hybrid_score FROM top10",
    "c14_driving_features": f"WITH {_ENSEMBLE}, pct AS (" + " UNION ALL ".join(
        f"SELECT t.c_custkey, '{name}' AS feature, 100.0 * (SELECT COUNT(*) FROM cust o WHERE o.{c} < u.{c}) "
        f"/ (SELECT COUNT(*) FROM cust) AS p FROM top10 t JOIN cust u USING (c_custkey)"
        for c, name in zip("abm", PARTS)) + """)
SELECT c_custkey, feature, ROUND(p, 4) AS percentile FROM pct WHERE p > 95 OR p < 5""",
}

QUERIES = [c01_ordinal_codes, c01_encoded, c02_imputed, c03_scaled, c04_distance_scores, c05_histogram_scores,
           c06_neighbour_scores, c06_approximate_recall, c07_isolation_scores, c08_ensemble_scores, c09_labels, c10_hybrid_scores,
           c11_severities, c12_anomaly_totals, c12_full_ensemble, c08_full_scores, c13_full_top, c13_top_anomalies, c14_driving_features]
