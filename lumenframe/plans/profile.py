"""Registered queries of the table profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import dates, profile as pr
from lumenframe.plans.inputs import table, view
from lumenframe.plans.shape import rounded

NUMERIC = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant_col"]
STRINGS = ["l_returnflag", "l_linestatus", "ship_text"]
CATEGORIES = ["l_returnflag", "l_linestatus"]
ALL = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
       "l_linestatus", "ship_text", "constant_col"]


def _table(spark, sf):
    return view(spark, sf, "profile_input")


def b01_column_types(spark, sf):
    return pr.column_types(_table(spark, sf)).select("column", "semantic_type")


def _dated(spark, sf):
    """Order dates as texts in one form, in several, and with a value that is no date."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    form = lambda f: F.date_format(d, f)
    mixed = (F.when(key % 4 == 0, form("yyyy-MM-dd")).when(key % 4 == 1, form("MM/dd/yyyy"))
             .when(key % 4 == 2, form("MMM d, yyyy")).otherwise(form("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return table(spark, sf, "orders").select(
        form("MM/dd/yyyy").alias("month_day"), form("dd.MM.yyyy").alias("day_month"), form("d MMM yyyy").alias("named"),
        mixed.alias("mixed"), F.when(key % 100 == 7, "31/02/2024").otherwise(form("yyyy-MM-dd")).alias("broken"))


def b01_date_forms(spark, sf):
    rows = _dated(spark, sf)
    return dates.date_forms(pr.value_counts(rows, rows.columns))


def b01_date_columns(spark, sf):
    return pr.column_types(_dated(spark, sf)).select("column", "semantic_type")


def b02_missing_values(spark, sf):
    return pr.missing_values(_table(spark, sf))


def b03_duplicate_rows(spark, sf):
    """Whole rows."""
    return pr.duplicate_rows(_table(spark, sf))


def b04_table_bytes(spark, sf):
    return pr.table_bytes(_table(spark, sf))


def b05_numeric_profile(spark, sf):
    return pr.numeric_profile(_table(spark, sf), NUMERIC).select(
        "column", "mean", "median", "std", "min", "max", "q1", "q3", "iqr", "missing_count")


def b06_outliers(spark, sf):
    return pr.numeric_profile(_table(spark, sf), NUMERIC).select("column", "outlier_count", "outlier_percentage")


def b07_skewness(spark, sf):
    return pr.numeric_profile(_table(spark, sf), NUMERIC).select("column", "skewness", "skew_label")


def b08_categorical_profile(spark, sf):
    return pr.categorical_profile(_table(spark, sf), STRINGS).drop("ordinal")


def b09_top_values(spark, sf):
    return pr.top_values(_table(spark, sf), STRINGS)


def b10_correlation_matrix(spark, sf):
    matrix = pr.correlation_matrix(_table(spark, sf), NUMERIC)
    return matrix.select("column_a", "column_b", rounded("correlation", 3))


def b11_strong_pairs(spark, sf):
    """Order prices against a scaled copy, so that strong pairs exist."""
    pairs = pr.correlations(_orders(spark, sf))
    return pr.strong_pairs(pairs).select("column_a", "column_b", "strength", "direction",
                                         rounded("correlation", 3))


def _orders(spark, sf):
    return view(spark, sf, "drift_pair").select(
        "o_totalprice", "shifted", (-F.col("o_totalprice")).alias("negated"))


def b12_insights(spark, sf):
    return pr.profile_table(_table(spark, sf))["insights"].select("priority", "ordinal", "step", "insight")


def b13_full_profile(spark, sf):
    """Every part of the profile as (part, rows, columns)."""
    found = None
    for name, frame in pr.profile_table(_table(spark, sf)).items():
        part = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows",
                                                                 F.lit(len(frame.columns)).alias("columns"))
        found = part if found is None else found.unionByName(part)
    return found


def _facts(spark, sf, language):
    table = _table(spark, sf)
    flagged = F.count_if(F.col("l_extendedprice") > 100000)
    return table.agg(F.count(F.lit(1)).alias("rows"), flagged.alias("anomaly_count")).select(
        F.lit("lineitem.csv").alias("file_name"), "rows", F.lit(len(table.columns)).alias("columns"),
        "anomaly_count", F.lit("GBTRegressor").alias("best_model"), F.lit(0.8734).alias("r2"),
        F.lit(language).alias("language"))


def b14_report(spark, sf):
    parts = pr.profile_table(_table(spark, sf))
    facts = _facts(spark, sf, "en").unionByName(_facts(spark, sf, "fr"))
    return pr.summary_report(facts, parts["insights"]).select("language", "report")


def b14_narrative(spark, sf):
    parts = pr.profile_table(_table(spark, sf))
    facts = _facts(spark, sf, "fr").select(
        "*", F.array(F.struct(F.lit("accuracy").alias("name"), F.lit(0.92).alias("value"))).alias("metrics"),
        F.array(F.lit("l_quantity"), F.lit("l_tax")).alias("top_features"),
        (F.col("anomaly_count") / F.col("rows") * 100).alias("anomaly_rate"), F.lit(2).alias("high"),
        F.lit(3).alias("medium"), (F.col("anomaly_count") - 5).alias("low"))
    return pr.narrative_report(facts, parts["insights"]).select("report")


def b15_target_column(spark, sf):
    return pr.detect_target(view(spark, sf, "classification"))


def _each(columns, template):
    return "\nUNION ALL ".join(template.format(i=i, c=c) for i, c in enumerate(columns))


_TYPES = "SELECT '{c}' AS \"column\", 'numeric' AS semantic_type FROM (SELECT 1)"
_STRING_TYPE = """SELECT '{c}' AS "column", CASE
  WHEN COUNT({c}) > 0 AND COUNT(TRY_CAST({c} AS TIMESTAMP)) = COUNT({c}) THEN 'datetime'
  WHEN COUNT(DISTINCT {c}) <= 20 OR (COUNT(*) > 50 AND COUNT(DISTINCT {c}) / COUNT(*) < 0.2) THEN 'categorical'
  ELSE 'text' END AS semantic_type FROM profile_input"""
_MISSING = """SELECT {i} AS ordinal, '{c}' AS "column", COUNT(*) AS rows, 10 AS columns,
  COUNT(*) - COUNT({c}) AS missing_count, ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 2) AS missing_percentage
FROM profile_input"""
_NUMERIC = """SELECT {i} AS ordinal, '{c}' AS "column", ROUND(AVG({c}), 4) AS mean, ROUND(MEDIAN({c}), 4) AS median,
  ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min,
  ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max, ROUND(QUANTILE_CONT({c}, 0.25), 4) AS q1,
  ROUND(QUANTILE_CONT({c}, 0.75), 4) AS q3,
  ROUND(QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25), 4) AS iqr,
  ROUND(COALESCE(SKEWNESS({c}), 0), 4) AS skewness,
  CASE WHEN ABS(COALESCE(SKEWNESS({c}), 0)) < 0.5 THEN 'symmetric' WHEN SKEWNESS({c}) > 0 THEN 'right-skewed'
    ELSE 'left-skewed' END AS skew_label,
  (SELECT COUNT(*) FROM profile_input, (SELECT QUANTILE_CONT({c}, 0.25) AS a, QUANTILE_CONT({c}, 0.75) AS b
     FROM profile_input) z WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
  COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS missing_count FROM profile_input"""
_COUNTS = "SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS copies FROM profile_input WHERE {c} IS NOT NULL GROUP BY 2"
_NUM = "num AS (SELECT *, ROUND(outlier_count / n * 100, 2) AS outlier_percentage FROM (" + _each(NUMERIC, _NUMERIC) + "))"
_CNT = "cnt AS (" + _each(STRINGS, _COUNTS) + ")"
_RANKED = """ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY copies DESC, value) AS position
  FROM cnt)"""
_CAT = """cat AS (SELECT "column", COUNT(*) AS unique_count, MAX(CASE WHEN position = 1 THEN value END) AS most_common,
  CAST(MAX(CASE WHEN position = 1 THEN copies END) AS BIGINT) AS most_common_count,
  ROUND(MAX(CASE WHEN position = 1 THEN copies END) / SUM(copies) * 100, 2) AS most_common_percentage,
  CAST((SELECT COUNT(*) FROM profile_input) - SUM(copies) AS BIGINT) AS missing_count FROM ranked GROUP BY 1)"""


def _number(x):
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,4)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"


def _correlation_sql(columns, source):
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN isnan(r) THEN NULL ELSE r END AS correlation "
        f"FROM (SELECT CORR({a}, {b}) AS r FROM {source})"
        if "constant_col" not in (a, b) else
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST(NULL AS DOUBLE) AS correlation"
        for a in columns for b in columns)


_MISS = "miss AS (" + _each(ALL, _MISSING) + ")"
_DUP = f"""dup AS (SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows
  FROM (SELECT COUNT(*) AS n FROM profile_input GROUP BY {', '.join(ALL)}))"""
_ORDINAL = {c: i for i, c in enumerate(CATEGORIES)}
_INSIGHTS = f"""lines AS (
SELECT 1 AS priority, 0 AS ordinal, 0 AS step, 'Dataset contains ' || format('{{:,}}', MAX(rows)) || ' rows and '
  || MAX(columns) || ' columns.' AS insight FROM miss
UNION ALL SELECT 2, 0, 0, 'Missing values detected: ' || format('{{:,}}', CAST(SUM(missing_count) AS BIGINT))
  || ' total. Worst column: ''' || (SELECT "column" FROM miss ORDER BY missing_percentage DESC, ordinal LIMIT 1)
  || ''' with ' || {_number('MAX(missing_percentage)')} || '% missing.' FROM miss
UNION ALL SELECT 3, 0, 0, 'Found ' || format('{{:,}}', duplicate_rows) || ' duplicate rows ('
  || {_number('ROUND(duplicate_rows / rows * 100, 1)')} || '% of data).' FROM dup WHERE duplicate_rows > 0
UNION ALL SELECT 4, ordinal, 0, 'Column ''' || "column" || ''' has ' || {_number('outlier_percentage')}
  || '% outliers. Range: ' || {_number('min')} || ' to ' || {_number('max')} || '. Distribution is ' || skew_label || '.'
  FROM num WHERE outlier_percentage > 5
UNION ALL SELECT 4, ordinal, 1, 'Column ''' || "column" || ''' is ' || skew_label || ' (skewness='
  || {_number('skewness')} || '). Median (' || {_number('median')} || ') differs from mean (' || {_number('mean')}
  || ').' FROM num WHERE skew_label <> 'symmetric'
UNION ALL SELECT 5, CASE "column" WHEN 'l_returnflag' THEN 0 ELSE 1 END, 0, 'Column ''' || "column"
  || ''' is dominated by ''' || most_common || ''' (' || {_number('most_common_percentage')}
  || '% of values). Only ' || unique_count || ' unique values total.'
  FROM cat WHERE most_common_percentage > 50 AND "column" <> 'ship_text'
UNION ALL SELECT 6, 0, 0, 'Strong correlation' FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM pairs
  WHERE column_a < column_b AND ABS(ROUND(correlation, 4)) > 0.7))"""
_ALL_PARTS = ", ".join(["pairs AS (" + _correlation_sql(NUMERIC, "profile_input") + ")", _NUM, _CNT, _RANKED, _CAT,
                        _MISS, _DUP, _INSIGHTS])
_TOP3 = "(SELECT string_agg('- ' || insight || chr(10), '' ORDER BY priority, ordinal, step) FROM (SELECT * FROM lines ORDER BY priority, ordinal, step LIMIT 3))"
_FACT = """f AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE l_extendedprice > 100000) AS a FROM profile_input)"""

_DATED = """o AS (SELECT o_orderkey % 4 AS k, o_orderkey % 100 = 7 AS bad, o_orderdate AS d FROM orders),
v AS (SELECT 'month_day' AS "column", strftime(d, '%m/%d/%Y') AS v, 'month_first' AS form, false AS zoned FROM o
  UNION ALL SELECT 'day_month', strftime(d, '%d.%m.%Y'), CASE WHEN day(d) <= 12 THEN 'month_first' ELSE 'day_first' END, false FROM o
  UNION ALL SELECT 'named', strftime(d, '%-d %b %Y'), 'named', false FROM o
  UNION ALL SELECT 'mixed', CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%m/%d/%Y')
    WHEN 2 THEN strftime(d, '%b %-d, %Y') ELSE strftime(d, '%Y-%m-%dT%H:%M:%SZ') END, CASE k WHEN 1 THEN 'month_first' WHEN 2 THEN 'named' ELSE 'year_first' END, k = 3 FROM o
  UNION ALL SELECT 'broken', CASE WHEN bad THEN '31/02/2024' ELSE strftime(d, '%Y-%m-%d') END,
    CASE WHEN bad THEN 'other' ELSE 'year_first' END, false FROM o)"""

SQL = {
    "b01_date_forms": f"""WITH {_DATED} SELECT "column", form, zoned, COUNT(DISTINCT v) AS distinct_values, COUNT(*) AS rows
FROM v GROUP BY 1, 2, 3""",
    "b01_date_columns": f"""WITH {_DATED} SELECT "column", CASE WHEN COUNT(*) FILTER (WHERE form = 'other') = 0 THEN 'datetime'
  WHEN COUNT(DISTINCT v) <= 20 OR (COUNT(*) > 50 AND COUNT(DISTINCT v) / COUNT(*) < 0.2) THEN 'categorical' ELSE 'text' END
  AS semantic_type FROM v GROUP BY 1""",
    "b01_column_types": _each(NUMERIC, _TYPES) + "\nUNION ALL " + _each(STRINGS, _STRING_TYPE),
    "b02_missing_values": _each(ALL, _MISSING),
    "b03_duplicate_rows": """SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT *, COUNT(*) AS n FROM profile_input GROUP BY ALL)""",
    "b04_table_bytes": """SELECT b AS bytes, ROUND(b / 1048576, 2) AS memory_usage_mb FROM (SELECT CAST(
  8 * (COUNT(l_orderkey) + COUNT(l_quantity) + COUNT(l_extendedprice) + COUNT(l_discount) + COUNT(l_tax)
       + COUNT(constant_col)) + 4 * COUNT(l_linenumber)
  + SUM(COALESCE(strlen(l_returnflag), 0) + strlen(l_linestatus) + strlen(ship_text)) AS BIGINT) AS b
FROM profile_input)""",
    "b05_numeric_profile": f"""WITH {_NUM} SELECT "column", mean, median, std, min, max, q1, q3, iqr, missing_count
FROM num""",
    "b06_outliers": f'WITH {_NUM} SELECT "column", outlier_count, outlier_percentage FROM num',
    "b07_skewness": f'WITH {_NUM} SELECT "column", skewness, skew_label FROM num',
    "b08_categorical_profile": f"WITH {_CNT}, {_RANKED}, {_CAT} SELECT * FROM cat",
    "b09_top_values": f'WITH {_CNT}, {_RANKED} SELECT "column", value, copies, position FROM ranked WHERE position <= 10',
    "b10_correlation_matrix": f"""WITH pairs AS ({_correlation_sql(NUMERIC, 'profile_input')})
SELECT column_a, column_b, ROUND(ROUND(correlation, 4), 3) AS correlation FROM pairs""",
    "b11_strong_pairs": """WITH o AS (SELECT o_totalprice, shifted, -o_totalprice AS negated FROM drift_pair),
p AS (SELECT 'o_totalprice' AS column_a, 'shifted' AS column_b, CORR(o_totalprice, shifted) AS r FROM o
  UNION ALL SELECT 'o_totalprice', 'negated', CORR(o_totalprice, negated) FROM o
  UNION ALL SELECT 'shifted', 'negated', CORR(shifted, negated) FROM o)
SELECT column_a, column_b, CASE WHEN ABS(ROUND(r, 4)) > 0.9 THEN 'very strong' ELSE 'strong' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, ROUND(ROUND(r, 4), 3) AS correlation
FROM p WHERE ABS(ROUND(r, 4)) > 0.7""",
    "b12_insights": f"WITH {_ALL_PARTS} SELECT priority, ordinal, step, insight FROM lines",
    "b14_report": f"""WITH {_ALL_PARTS}, {_FACT} SELECT 'en' AS language, 'I analysed **lineitem.csv** containing ' || n
  || ' rows and 10 columns.' || chr(10) || chr(10) || '**Statistical insights:**' || chr(10) || {_TOP3} || chr(10)
  || '**Best model:** GBTRegressor (R² = 87.34%)' || chr(10) || chr(10)
  || CASE WHEN a > 0 THEN '**Anomalies detected:** ' || a || ' suspicious rows found.'
     ELSE '**Anomalies:** No anomalies detected.' END || chr(10) AS report FROM f
UNION ALL SELECT 'fr', 'J''ai analysé le fichier **lineitem.csv** contenant ' || n
  || ' lignes et 10 colonnes.' || chr(10) || chr(10) || '**Insights statistiques :**' || chr(10) || {_TOP3} || chr(10)
  || '**Meilleur modèle :** GBTRegressor (R² = 87.34%)' || chr(10) || chr(10)
  || CASE WHEN a > 0 THEN '**Anomalies détectées :** ' || a || ' lignes suspectes trouvées.'
     ELSE '**Anomalies :** Aucune anomalie détectée.' END || chr(10) FROM f""",
    "b14_narrative": f"""WITH {_ALL_PARTS}, {_FACT} SELECT 'J''ai analysé le fichier **lineitem.csv** contenant '
  || format('{{:,}}', n) || ' lignes et 10 colonnes.' || chr(10) || chr(10) || '**Insights statistiques :**' || chr(10)
  || {_TOP3} || chr(10) || '**Modèle ML :** GBTRegressor (accuracy: 0.920)' || chr(10) || chr(10)
  || '**Variables les plus importantes :** l_quantity, l_tax' || chr(10) || chr(10)
  || CASE WHEN a > 0 THEN '**Anomalies détectées :** ' || a || ' anomalies (' || printf('%.1f', a / n * 100)
     || '% des données) — 2 critiques, 3 moyennes, ' || (a - 5) || ' faibles.'
     ELSE '**Anomalies :** Aucune anomalie détectée.' END AS report FROM f""",
    "b15_target_column": """SELECT 'quality' AS "column", 2 AS priority FROM classification
HAVING COUNT(DISTINCT quality) = 2 AND MIN(quality) = 0 AND MAX(quality) = 1""",
}

QUERIES = [b01_column_types, b01_date_forms, b01_date_columns, b02_missing_values, b03_duplicate_rows, b04_table_bytes, b05_numeric_profile, b06_outliers,
           b07_skewness, b08_categorical_profile, b09_top_values, b10_correlation_matrix, b11_strong_pairs,
           b12_insights, b13_full_profile, b14_report, b14_narrative, b15_target_column]
