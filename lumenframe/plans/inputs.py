"""Input views over the given tables. The same SELECT runs on Spark and on the checking engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "analytics_events": """
SELECT event_id AS id, event_type, CASE WHEN value < 10 THEN 'failure' ELSE 'success' END AS status,
  user_id, CAST(user_id AS STRING) AS session_id, CAST(event_id % 50 AS STRING) AS task_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 10 END AS duration_ms,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'csv' ELSE 'pdf' END AS file_type,
  CASE WHEN event_type = 'purchase' THEN CAST(FLOOR(value * 1000) AS BIGINT) END AS file_size_bytes,
  props AS metadata, ts AS created_at FROM {events}""",
    "http_requests": """
SELECT event_id, ts, 'GET' AS method, event_type AS path,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 500 ELSE 200 END AS status_code,
  value / 100 AS duration_seconds FROM {events}""",
    "profile_input": """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, NULLIF(l_discount, 0) AS l_discount, l_tax,
  CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS ship_text, CAST(5 AS DOUBLE) AS constant_col FROM {lineitem}""",
    "chunks_input": "SELECT doc_id, source, 1 AS page, text FROM {documents}",
    "vectors": "SELECT vec_id AS id, CAST(label AS STRING) AS source, embedding FROM {embeddings}",
    "consent_log": """
SELECT event_id AS id, user_id, CASE event_type WHEN 'click' THEN 'data_analysis' WHEN 'view' THEN 'rag_indexing'
  WHEN 'signup' THEN 'agent_query' WHEN 'purchase' THEN 'code_execution' ELSE 'unknown_purpose' END AS purpose,
  value >= 10 AS granted, ts AS granted_at FROM {events}""",
    "audit_logs": """
SELECT event_id AS id, user_id, event_type AS action, props AS details, ts AS created_at FROM {events}""",
    "users": """
SELECT c_custkey AS id, CONCAT(LOWER(c_name), '@example.org') AS email, c_name AS full_name, TRUE AS is_active
FROM {customer}""",
    "refresh_tokens": """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
  o_orderdate + INTERVAL '7' DAY AS expires_at, o_orderstatus = 'F' AS revoked FROM {orders}""",
    "runs": """
SELECT CONCAT(CAST(q.conv_id AS STRING), '-', CAST(q.turn AS STRING)) AS id, q.conv_id AS session_id, q.turn,
  q.text AS question, a.text AS answer FROM {conversations} q
  LEFT JOIN {conversations} a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'""",
    "run_log": """
SELECT CONCAT(CAST(q.conv_id AS STRING), '-', CAST(q.turn AS STRING)) AS id, q.conv_id % 25 AS user_id,
  q.conv_id AS session_id, q.turn, q.text AS question, a.text AS answer,
  CASE WHEN q.turn % 4 = 0 THEN 'analysis' ELSE 'rag' END AS task_type,
  CASE WHEN q.conv_id % 3 = 0 THEN NULL WHEN q.conv_id % 5 = 0 THEN 0.0
       ELSE CAST(LENGTH(q.text) % 100 AS DOUBLE) / 100 END AS confidence_score,
  CONCAT('{{"Accuracy": 0.', CAST(q.conv_id % 10 AS STRING), ', "f1": 0.5}}') AS metrics,
  TIMESTAMP '2024-01-01 00:00:00' + q.conv_id * INTERVAL '1' HOUR + q.turn * INTERVAL '1' MINUTE AS created_at
  FROM {conversations} q
  LEFT JOIN {conversations} a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'""",
    "task_progress": """
SELECT event_id AS seq, CAST(event_id % 50 AS STRING) AS task_id, user_id, ts AS emitted_at,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
    ELSE 'processing' END AS status, props AS payload FROM {events}""",
    "classification": """
SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    "regression": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, l_discount, l_tax, l_returnflag, l_extendedprice
FROM {lineitem}""",
    "drift_pair": """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'current' END AS side, o_totalprice,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice * 1.5 END AS shifted FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in _tables(name)}
    return spark.sql(VIEWS[name], **used)


def checking_sql(body: str) -> str:
    """``body`` with every named view in front of it as a common table expression."""
    needed = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    parts = []
    for name in needed:
        text = VIEWS[name].strip()
        for t in _tables(name):
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text.replace('{{', '{').replace('}}', '}')})")
    body = body.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _tables(name: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in VIEWS[name]]
