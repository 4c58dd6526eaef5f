"""Registered queries of question routing, session memory and task state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.text import token_estimate
from lumenframe.operators import sessions as se
from lumenframe.plans.inputs import table, view
from lumenframe.plans.shape import moment


def _runs(spark, sf):
    return view(spark, sf, "runs")


UUID = "550e8400-e29b-41d4-a716-446655440000_"


def i01_without_uuid(spark, sf):
    named = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(UUID), F.col("question"))).otherwise(F.col("question"))
    return _runs(spark, sf).select("id", se.without_uuid(named).alias("question"))


def _routed(spark, sf):
    file_name = (F.when(F.col("session_id") % 10 == 0, "notes.PDF").when(F.col("session_id") % 10 == 1, "sales.csv")
                 .otherwise("image.png"))
    return se.route_questions(_runs(spark, sf).withColumn("file_name", file_name), file_name="file_name")


def i02_route_hits(spark, sf):
    return _routed(spark, sf).select("id", "analysis_hits", "rag_hits", "code_hits")


def i03_routes(spark, sf):
    return se.route_questions(_runs(spark, sf)).select("id", "task_type", "confidence", "fallback")


def i04_file_routes(spark, sf):
    return _routed(spark, sf).select("id", "task_type", "confidence")


def i05_session_memory(spark, sf):
    return se.session_memory(_runs(spark, sf))


def i05_prior_context(spark, sf):
    return se.prior_context(_runs(spark, sf)).select("id", "prior_excerpt")


def i06_accepted_language(spark, sf):
    header = F.when(F.col("doc_id") % 7 == 0, "").otherwise(
        F.concat(F.lit(" "), F.upper("lang"), F.lit("-XX;q=0.9,en;q=0.8")))
    return table(spark, sf, "documents").select("doc_id", se.accepted_language(header).alias("language"))


def i07_token_estimates(spark, sf):
    return _runs(spark, sf).select("id", token_estimate(F.col("question")).alias("question_tokens"),
                                   token_estimate(F.col("answer")).alias("answer_tokens"))


def _messages(spark, sf):
    """Progress messages; every third carries texts, every fifth overrides its percentage."""
    payload = F.when(F.col("seq") % 3 == 0, F.lit('{"input_text": "abcdefghij", "output_text": "abcdefgh"}')).when(
        F.col("seq") % 5 == 0, F.lit('{"progress_percent": 77, "can_cancel": false}')).otherwise(F.col("payload"))
    return view(spark, sf, "task_progress").withColumn("payload", payload)


def i08_progress(spark, sf):
    return se.normalise_progress(_messages(spark, sf)).select(
        "seq", "type", "progress_percent", "eta_seconds", "can_cancel", "reconnect_after_seconds",
        "token_count_input", "token_count_output", "token_count_total")


def i09_latest_terminal(spark, sf):
    return se.latest_terminal(view(spark, sf, "task_progress"), 24 * 3600).select("task_id", "seq", "status")


def i10_user_history(spark, sf):
    progress = view(spark, sf, "task_progress")
    submitted = progress.filter(F.col("status") == "started").select(
        "user_id", "task_id", "seq", F.col("emitted_at").alias("submitted_at"))
    cached = se.latest_terminal(progress, 24 * 3600).select("task_id", F.col("status").alias("cached_status"))
    return se.user_history(submitted, cached, 5).select("user_id", "seq", "task_id", "cached_status")


def i11_task_view(spark, sf):
    progress = view(spark, sf, "task_progress")
    n = F.col("task_id").cast("int") % 5
    engine = progress.select("task_id").distinct().select(
        "task_id", F.when(n == 0, "SUCCESS").when(n == 1, "FAILURE").when(n == 2, "REVOKED").when(n == 3, "PENDING")
        .otherwise("STARTED").alias("engine_status"), F.lit("boom").alias("engine_result"))
    cached = se.latest_terminal(progress, 48 * 3600).select(
        "task_id", "status", F.when(F.col("status") == "failed", "late").alias("error"), F.lit(False).alias("can_cancel"))
    return se.task_view(engine, cached)


def i12_dead_letters(spark, sf):
    retries = F.get_json_object("payload", "$.k").cast("int") % 5
    failures = view(spark, sf, "task_progress").withColumn("retries", retries).withColumn("max_retries", F.lit(3))
    return se.dead_letters(failures).select("seq", "task_id", "retries")


def i13_heartbeat_gaps(spark, sf):
    return se.heartbeat_gaps(view(spark, sf, "task_progress")).select("seq", "heartbeats", moment("next_at"))


def i14_decoded_messages(spark, sf):
    raw = F.when(F.col("seq") % 11 == 0, F.left("payload", F.lit(4))).when(
        F.col("seq") % 13 == 0, F.lit("[1, 2]")).otherwise(F.col("payload"))
    messages = view(spark, sf, "task_progress").withColumn("payload", raw)
    return se.decode_messages(messages).select("seq", "status", "type", "message", "error", "error_code")


def i15_merged_answers(spark, sf):
    runs = _runs(spark, sf)
    failed = lambda n, text: F.when(F.col("turn") % n == 0, text)
    analysis = runs.filter(F.col("session_id") % 3 != 0).select(
        F.col("id").alias("run_id"), "answer", failed(4, "no dataset").alias("error"))
    documents = runs.filter(F.col("session_id") % 3 != 1).select(
        F.col("id").alias("run_id"), F.col("question").alias("answer"), failed(6, "no index").alias("error"))
    return se.merge_answers(analysis, documents)


def _hits_sql(route, column):
    return " + ".join("CASE WHEN contains(lower({}), '{}') THEN 1 ELSE 0 END".format(column, w)
                      for w in se.ROUTE_WORDS[route])


_HITS = f"""hits AS (SELECT id, session_id, {_hits_sql('analysis', 'question')} AS a,
  {_hits_sql('rag', 'question')} AS r, {_hits_sql('code', 'question')} AS c FROM runs)"""
_ROUTED = _HITS + """, lead2 AS (SELECT *, GREATEST(a, r, c) AS top, list_sort([a, r, c])[2] AS sec FROM hits),
routed AS (SELECT *, CASE WHEN top > sec THEN CASE top WHEN a THEN 'analysis' WHEN r THEN 'rag' ELSE 'code' END
    ELSE 'ambiguous' END AS task_type,
  CAST(CASE WHEN top > sec THEN CASE WHEN top >= 5 THEN 0.95 WHEN top >= 2 THEN 0.85 WHEN sec = 0 THEN 0.75
    ELSE 0.60 END WHEN top > 0 THEN 0.70 ELSE 0.50 END AS DOUBLE) AS confidence FROM lead2)"""
_LATEST = """terminal AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY task_id
  ORDER BY emitted_at DESC, seq DESC) AS rn FROM task_progress WHERE status IN ('completed', 'failed', 'canceled')
  AND emitted_at >= (SELECT MAX(emitted_at) FROM task_progress) - INTERVAL {hours} HOUR) WHERE rn = 1)"""

SQL = {
    "i01_without_uuid": "SELECT id, question FROM runs",
    "i02_route_hits": f"WITH {_HITS} SELECT id, a AS analysis_hits, r AS rag_hits, c AS code_hits FROM hits",
    "i03_routes": f"""WITH {_ROUTED} SELECT id, task_type, confidence,
  CASE WHEN task_type = 'ambiguous' THEN 'rag' END AS fallback FROM routed""",
    "i04_file_routes": f"""WITH {_ROUTED} SELECT id, CASE session_id % 10 WHEN 0 THEN 'rag' WHEN 1 THEN 'analysis'
  ELSE task_type END AS task_type, CASE WHEN session_id % 10 <= 1 THEN 1.0::DOUBLE ELSE confidence END AS confidence
FROM routed""",
    "i05_session_memory": """SELECT session_id, arg_max(id, turn) AS id,
  arg_max(substr(coalesce(answer, ''), 1, 200), turn) AS answer_excerpt, COUNT(*) AS analyses FROM runs GROUP BY 1""",
    "i05_prior_context": """SELECT id, LAG(substr(coalesce(answer, ''), 1, 200)) OVER (PARTITION BY session_id
  ORDER BY turn, id) AS prior_excerpt FROM runs""",
    "i06_accepted_language": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN lang LIKE 'fr%' THEN 'fr'
  WHEN lang LIKE 'en%' THEN 'en' END AS language FROM documents""",
    "i07_token_estimates": """SELECT id, CASE WHEN length(coalesce(question, '')) = 0 THEN 0
    ELSE CAST(GREATEST(1, length(question) // 4) AS INTEGER) END AS question_tokens,
  CASE WHEN length(coalesce(answer, '')) = 0 THEN 0 ELSE CAST(GREATEST(1, length(answer) // 4) AS INTEGER) END
    AS answer_tokens FROM runs""",
    "i08_progress": """SELECT seq, CASE status WHEN 'started' THEN 'started' WHEN 'processing' THEN 'processing'
    WHEN 'completed' THEN 'result' ELSE 'error' END AS type,
  CASE WHEN seq % 3 <> 0 AND seq % 5 = 0 THEN 77 WHEN status = 'started' THEN 5 WHEN status = 'processing' THEN 50
    ELSE 100 END AS progress_percent,
  CASE status WHEN 'started' THEN 120 WHEN 'processing' THEN 60 END AS eta_seconds,
  CASE WHEN seq % 3 <> 0 AND seq % 5 = 0 THEN false ELSE status IN ('started', 'processing') END AS can_cancel,
  3 AS reconnect_after_seconds, CASE WHEN seq % 3 = 0 THEN 2 ELSE 0 END AS token_count_input,
  CASE WHEN seq % 3 = 0 THEN 2 ELSE 0 END AS token_count_output, CASE WHEN seq % 3 = 0 THEN 4 ELSE 0 END
    AS token_count_total FROM task_progress""",
    "i09_latest_terminal": f"WITH {_LATEST.format(hours=24)} SELECT task_id, seq, status FROM terminal",
    "i10_user_history": f"""WITH {_LATEST.format(hours=24)}, sub AS (SELECT user_id, task_id, seq,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY emitted_at DESC, seq DESC) AS n FROM task_progress
  WHERE status = 'started') SELECT sub.user_id, sub.seq, sub.task_id, t.status AS cached_status
FROM sub JOIN terminal t ON t.task_id = sub.task_id WHERE n <= 5""",
    "i11_task_view": f"""WITH {_LATEST.format(hours=48)}, e AS (SELECT DISTINCT task_id, CAST(task_id AS INTEGER) % 5 AS n
  FROM task_progress)
SELECT e.task_id, CASE n WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'canceled'
    WHEN 3 THEN coalesce(t.status, 'pending') ELSE coalesce(t.status, 'started') END AS status,
  n <= 2 OR t.status IS NOT NULL AS terminal, CASE WHEN n > 2 AND t.status IS NOT NULL THEN 'cache' ELSE 'engine' END
    AS origin, n > 2 AND t.status IS NULL AS can_cancel,
  CASE WHEN n = 1 THEN 'boom' WHEN n = 2 THEN 'Task canceled by user' WHEN n > 2 AND t.status = 'failed' THEN 'late' END
    AS error FROM e LEFT JOIN terminal t ON t.task_id = e.task_id""",
    "i12_dead_letters": """SELECT seq, task_id, CAST(json_extract(payload, '$.k') AS INTEGER) % 5 AS retries
FROM task_progress WHERE status = 'failed' AND CAST(json_extract(payload, '$.k') AS INTEGER) % 5 >= 3
ORDER BY emitted_at DESC, task_progress.seq DESC LIMIT 1000""",
    "i13_heartbeat_gaps": """SELECT seq, CAST(CASE WHEN status IN ('completed', 'failed') OR nx IS NULL THEN 0
  ELSE (epoch_us(nx) - epoch_us(emitted_at)) // 15000000 END AS BIGINT) AS heartbeats,
  strftime(nx, '%Y-%m-%d %H:%M:%S.%f') AS next_at FROM (SELECT *, LEAD(emitted_at) OVER (PARTITION BY task_id
  ORDER BY emitted_at, seq) AS nx FROM task_progress)""",
    "i14_decoded_messages": """WITH m AS (SELECT *, CASE WHEN seq % 11 = 0 THEN substr(payload, 1, 4)
  WHEN seq % 13 = 0 THEN '[1, 2]' ELSE payload END AS raw FROM task_progress),
v AS (SELECT *, json_valid(raw) AS ok, raw LIKE '{%' AS obj FROM m)
SELECT seq, CASE WHEN NOT ok THEN 'failed' WHEN NOT obj THEN 'processing' ELSE status END AS status,
  CASE WHEN NOT ok THEN 'error' WHEN NOT obj THEN 'progress' END AS type, CASE WHEN ok AND NOT obj THEN raw END AS message,
  CASE WHEN NOT ok THEN 'Invalid task progress payload' END AS error,
  CASE WHEN NOT ok THEN 'progress_payload_invalid' END AS error_code FROM v""",
    "i15_merged_answers": """WITH a AS (SELECT id, answer, CASE WHEN turn % 4 = 0 THEN 'no dataset' END AS error
  FROM runs WHERE session_id % 3 <> 0),
d AS (SELECT id, question AS answer, CASE WHEN turn % 6 = 0 THEN 'no index' END AS error FROM runs
  WHERE session_id % 3 <> 1),
j AS (SELECT coalesce(a.id, d.id) AS run_id, CASE WHEN a.error IS NULL THEN nullif(a.answer, '') END AS x,
  CASE WHEN d.error IS NULL THEN nullif(d.answer, '') END AS y, a.error AS xe, d.error AS ye
  FROM a FULL JOIN d ON a.id = d.id)
SELECT run_id, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN '## Insights d''analyse de données' || chr(10) || x
    || chr(10) || chr(10) || '## Insights documentaires' || chr(10) || y WHEN x IS NOT NULL THEN x
    WHEN y IS NOT NULL THEN y ELSE 'Analyse: ' || coalesce(xe, 'failed') || chr(10) || 'RAG: ' || coalesce(ye, 'failed')
    END AS answer,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN NULL WHEN x IS NOT NULL THEN ye WHEN y IS NOT NULL THEN xe
    ELSE 'analysis_and_rag_failed' END AS error FROM j""",
}

QUERIES = [i01_without_uuid, i02_route_hits, i03_routes, i04_file_routes, i05_session_memory, i05_prior_context,
           i06_accepted_language, i07_token_estimates, i08_progress, i09_latest_terminal, i10_user_history,
           i11_task_view, i12_dead_letters, i13_heartbeat_gaps, i14_decoded_messages, i15_merged_answers]
