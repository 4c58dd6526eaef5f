"""Registered queries of the personal-data scan, consent, erasure and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lumenframe.functions.text import normalise_name
from lumenframe.operators import privacy as pv
from lumenframe.operators.events import latest_time
from lumenframe.operators.personal_names import (
    HIGH_ENDS, HIGH_EXACT, HIGH_STARTS, MEDIUM_ENDS, MEDIUM_EXACT, MEDIUM_STARTS, QUICK_KEYS, SEMANTIC)
from lumenframe.plans.inputs import TABLES, table, view
from lumenframe.plans.shape import moment


def _names(spark, sf):
    """Column names of all tables, and the words of every document source read as header names."""
    pairs = [(t, c) for t in TABLES for c in table(spark, sf, t).columns]
    catalog = spark.createDataFrame(pairs, "table_name string, column_name string")
    words = (table(spark, sf, "documents")
             .select(F.col("source").alias("table_name"), F.explode(F.split("text", r"[ \n\t]+")).alias("column_name"))
             .filter(F.col("column_name") != "").distinct())
    return catalog.unionByName(words)


def _classified(spark, sf):
    return pv.classify_columns(_names(spark, sf))


def h01_normalised_names(spark, sf):
    return _names(spark, sf).withColumn("normalised", normalise_name(F.col("column_name")))


def h02_classified_columns(spark, sf):
    return _classified(spark, sf)


def h03_table_verdicts(spark, sf):
    return pv.table_verdicts(_classified(spark, sf))


def h03_recommendations(spark, sf):
    return pv.recommendations(_classified(spark, sf))


def h04_quick_scan(spark, sf):
    return pv.quick_scan(_names(spark, sf))


def h05_consent_intervals(spark, sf):
    found = pv.consent_intervals(view(spark, sf, "consent_log"))
    return found.select("id", "user_id", "purpose", "granted", moment("granted_at"), moment("revoked_at"))


def h05_rejected_consents(spark, sf):
    return pv.rejected_consents(view(spark, sf, "consent_log")).select("id", "purpose")


def h06_active_consents(spark, sf):
    return pv.active_consents(view(spark, sf, "consent_log")).select("id", "user_id", "purpose", "granted")


def h07_newest_audit_rows(spark, sf):
    return pv.newest_audit_rows(view(spark, sf, "audit_logs")).select("user_id", "id", moment("created_at"))


def _consents(spark, sf):
    return view(spark, sf, "consent_log")


def h08_access_export(spark, sf):
    return pv.access_export(view(spark, sf, "users"), _consents(spark, sf), view(spark, sf, "audit_logs"))


def h08_access_totals(spark, sf):
    return pv.access_totals(view(spark, sf, "users"), _consents(spark, sf), view(spark, sf, "audit_logs"))


def _erased(spark, sf):
    """Users whose last consent decision on data analysis was a refusal."""
    return (pv.active_consents(_consents(spark, sf))
            .filter((F.col("purpose") == "data_analysis") & ~F.col("granted")).select(F.col("user_id").alias("id")))


def h09_erased_users(spark, sf):
    return pv.erase_users(view(spark, sf, "users"), _erased(spark, sf))


def h09_remaining_tokens(spark, sf):
    return pv.erase_tokens(view(spark, sf, "refresh_tokens"), _erased(spark, sf)).select("id", "user_id")


def _survivors(spark, sf):
    return view(spark, sf, "users").join(_erased(spark, sf), "id", "left_anti")


def h10_cascade_delete(spark, sf):
    return pv.cascade_delete(view(spark, sf, "refresh_tokens"), _survivors(spark, sf)).select("id", "user_id")


def h10_set_null(spark, sf):
    return pv.set_null(view(spark, sf, "audit_logs"), _survivors(spark, sf)).select("id", "user_id")


def h11_purge_counts(spark, sf):
    tokens = view(spark, sf, "refresh_tokens")
    end = latest_time(tokens, "created_at")
    hit = pv.purge_condition(end - dt.timedelta(days=300))
    return tokens.agg(F.count_if(hit).alias("candidates"), F.count_if(~hit).alias("kept"))


def h12_token_status(spark, sf):
    return pv.token_status(view(spark, sf, "refresh_tokens")).select("id", "status")


def h12_token_rotation(spark, sf):
    return pv.token_rotation(view(spark, sf, "refresh_tokens")).select("id", "user_id", moment("rotated_at"))


def _listed(words):
    return ", ".join(f"'{w}'" for w in words)


def _pairs(rules):
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in rules.items())


_NAMES = "names AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in TABLES) + """
UNION ALL SELECT DISTINCT source, w FROM (SELECT source, unnest(string_split_regex(text, '[ \\n\\t]+')) AS w
  FROM documents) WHERE w <> '')"""
_NORM = _NAMES + """, norm AS (SELECT *, replace(replace(strip_accents(lower(column_name)), ' ', '_'), '-', '_')
  AS normalised FROM names)"""
_JUDGED = _NORM + f""", high(k, why) AS (VALUES {_pairs(HIGH_EXACT)}), medium(k, why) AS (VALUES {_pairs(MEDIUM_EXACT)}),
tok AS (SELECT n.*, high.why AS hw, medium.why AS mw, string_split(normalised, '_') AS t FROM norm n
  LEFT JOIN high ON high.k = normalised LEFT JOIN medium ON medium.k = normalised),
rule AS (SELECT *, t[-1] AS l, t[1] AS f,
  list_sort(list_filter(t, lambda x: x IN ({_listed(SEMANTIC)})))[1] AS w FROM tok),
judged AS (SELECT *, CASE WHEN hw IS NOT NULL THEN 1 WHEN mw IS NOT NULL THEN 2 WHEN l IN ({_listed(HIGH_ENDS)}) THEN 3
  WHEN f IN ({_listed(HIGH_STARTS)}) THEN 4 WHEN l IN ({_listed(MEDIUM_ENDS)}) THEN 5
  WHEN f IN ({_listed(MEDIUM_STARTS)}) THEN 6 WHEN w IS NOT NULL THEN 7 ELSE 8 END AS r FROM rule),
done AS (SELECT table_name, column_name, normalised,
  CASE WHEN r IN (1, 3, 4) THEN 'high' WHEN r = 8 THEN 'safe' ELSE 'medium' END AS risk,
  CAST(CASE WHEN r <= 2 THEN 1.0 WHEN r <= 6 THEN 0.85 WHEN r = 7 THEN 0.65 ELSE 0.0 END AS DOUBLE) AS confidence,
  CASE r WHEN 1 THEN hw WHEN 2 THEN mw
    WHEN 3 THEN 'Identifiant personnel — colonne se terminant par ''' || l || ''''
    WHEN 4 THEN 'Identifiant personnel — colonne commençant par ''' || f || ''''
    WHEN 5 THEN 'Quasi-identifiant — colonne se terminant par ''' || l || ''''
    WHEN 6 THEN 'Quasi-identifiant — colonne commençant par ''' || f || ''''
    WHEN 7 THEN 'Quasi-identifiant probable — contient le terme ''' || w || ''''
    ELSE 'Donnée statistique — Faible risque' END AS reason,
  CASE WHEN r = 8 THEN '' WHEN r = 2 AND mw LIKE 'Donnée sensible%' THEN 'RGPD Article 9'
    ELSE 'RGPD Article 4(1)' END AS article,
  CASE WHEN r <= 2 THEN 'exact' WHEN r <= 6 THEN 'pattern' WHEN r = 7 THEN 'semantic' ELSE 'none' END AS match_tier
  FROM judged)"""
_PURPOSES = _listed(pv.PURPOSES)
_INTERVALS = f"""iv AS (SELECT *, LEAD(granted_at) OVER (PARTITION BY user_id, purpose ORDER BY granted_at, id)
  AS revoked_at FROM consent_log WHERE purpose IN ({_PURPOSES}))"""
_ERASED = _INTERVALS + """, erased AS (SELECT user_id AS id FROM iv WHERE revoked_at IS NULL
  AND purpose = 'data_analysis' AND NOT granted)"""
_TS = "'%Y-%m-%d %H:%M:%S.%f'"

SQL = {
    "h01_normalised_names": f"WITH {_NORM} SELECT table_name, column_name, normalised FROM norm",
    "h02_classified_columns": f"WITH {_JUDGED} SELECT * FROM done",
    "h03_table_verdicts": f"""WITH {_JUDGED} SELECT table_name, bool_or(risk <> 'safe') AS has_personal_data,
  CASE WHEN bool_or(risk = 'high') THEN 'high' WHEN bool_or(risk = 'medium') THEN 'medium' ELSE 'safe' END AS risk_level,
  COUNT(*) FILTER (WHERE risk <> 'safe') AS flagged, COUNT(*) FILTER (WHERE risk = 'safe') AS safe
FROM done GROUP BY 1""",
    "h03_recommendations": f"""WITH {_JUDGED} SELECT table_name, COALESCE('Supprimer ou anonymiser les colonnes : '
  || string_agg(column_name, ', ' ORDER BY column_name) FILTER (WHERE risk <> 'safe'),
  'Aucune donnée personnelle détectée. Analyse sécurisée.') AS recommendation FROM done GROUP BY 1""",
    "h04_quick_scan": f"WITH {_NORM} SELECT table_name, column_name FROM norm WHERE normalised IN ({_listed(QUICK_KEYS)})",
    "h05_consent_intervals": f"""WITH {_INTERVALS} SELECT id, user_id, purpose, granted,
  strftime(granted_at, {_TS}) AS granted_at, strftime(revoked_at, {_TS}) AS revoked_at FROM iv""",
    "h05_rejected_consents": f"SELECT id, purpose FROM consent_log WHERE purpose NOT IN ({_PURPOSES})",
    "h06_active_consents": f"WITH {_INTERVALS} SELECT id, user_id, purpose, granted FROM iv WHERE revoked_at IS NULL",
    "h07_newest_audit_rows": f"""SELECT user_id, id, strftime(created_at, {_TS}) AS created_at FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn FROM audit_logs) WHERE rn <= 100""",
    "h08_access_export": """SELECT id AS user_id, 'profile' AS section, CAST(id AS VARCHAR) AS record_id,
  '{"email":"' || email || '","full_name":"' || full_name || '","is_active":' || is_active || '}' AS payload FROM users
UNION ALL SELECT user_id, 'consent', CAST(id AS VARCHAR), '{"purpose":"' || purpose || '","granted":' || granted || '}'
FROM consent_log WHERE user_id IN (SELECT id FROM users)
UNION ALL SELECT user_id, 'audit', CAST(id AS VARCHAR), '{"action":"' || action || '","details":'
  || CAST(to_json(details) AS VARCHAR) || '}' FROM audit_logs WHERE user_id IN (SELECT id FROM users)""",
    "h08_access_totals": """SELECT id, email, full_name, COALESCE(c.n, 0) AS consents, COALESCE(l.n, 0) AS audit_logs
FROM users LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM consent_log GROUP BY 1) c ON c.user_id = id
LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM audit_logs GROUP BY 1) l ON l.user_id = id""",
    "h09_erased_users": f"""WITH {_ERASED} SELECT u.id,
  CASE WHEN e.id IS NULL THEN email ELSE 'deleted_' || u.id || '@anonymised.rgpd' END AS email,
  CASE WHEN e.id IS NULL THEN full_name END AS full_name, CASE WHEN e.id IS NOT NULL THEN 'ERASED' END AS password_marker,
  e.id IS NULL AS is_active FROM users u LEFT JOIN erased e ON e.id = u.id""",
    "h09_remaining_tokens": f"""WITH {_ERASED} SELECT id, user_id FROM refresh_tokens
WHERE user_id NOT IN (SELECT id FROM erased)""",
    "h10_cascade_delete": f"""WITH {_ERASED} SELECT id, user_id FROM refresh_tokens
WHERE user_id NOT IN (SELECT id FROM erased) AND user_id IN (SELECT id FROM users)""",
    "h10_set_null": f"""WITH {_ERASED} SELECT id, CASE WHEN user_id IN (SELECT id FROM users)
  AND user_id NOT IN (SELECT id FROM erased) THEN user_id END AS user_id FROM audit_logs""",
    "h11_purge_counts": """WITH n AS (SELECT MAX(created_at) - INTERVAL 300 DAY AS t FROM refresh_tokens),
m AS (SELECT expires_at < t - INTERVAL 7 DAY OR (revoked AND created_at < t - INTERVAL 30 DAY) AS hit
  FROM refresh_tokens, n) SELECT COUNT(*) FILTER (WHERE hit) AS candidates, COUNT(*) FILTER (WHERE NOT hit) AS kept
FROM m""",
    "h12_token_status": """SELECT id, CASE WHEN revoked THEN 'invalid'
  WHEN expires_at < (SELECT MAX(created_at) FROM refresh_tokens) THEN 'expired' ELSE 'valid' END AS status
FROM refresh_tokens""",
    "h12_token_rotation": f"""SELECT id, user_id, strftime(LEAD(created_at) OVER (PARTITION BY user_id
  ORDER BY created_at, id), {_TS}) AS rotated_at FROM refresh_tokens""",
}

QUERIES = [h01_normalised_names, h02_classified_columns, h03_table_verdicts, h03_recommendations, h04_quick_scan,
           h05_consent_intervals, h05_rejected_consents, h06_active_consents, h07_newest_audit_rows, h08_access_export,
           h08_access_totals, h09_erased_users, h09_remaining_tokens, h10_cascade_delete, h10_set_null,
           h11_purge_counts, h12_token_status, h12_token_rotation]
