"""Question routing, session memory and task state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.text import token_estimate
from lumenframe.operators.events import latest_time
from lumenframe.operators.ordered import HOT_ROWS, newest_per_group, with_neighbour

# Words that speak for a route.
ROUTE_WORDS = {
    "analysis": ["analys", "csv", "dataset", "données", "donnée", "colonnes", "modèle", "prédire", "prédiction", "ml",
                 "machine learning", "anomalie", "anomalies", "détect", "statistique", "corrélation", "régression",
                 "classification", "fichier", "entraîne", "entraînement"],
    "rag": ["rgpd", "cnil", "document", "pdf", "réglementation", "loi", "article", "règlement", "droit", "obligation",
            "conformité", "protection", "données personnelles", "open source", "ia"],
    "code": ["exécute", "exécuter", "calcule", "calculer", "génère", "générer", "script", "code", "programme", "python",
             "plot", "graphique", "visualise", "visualiser", "simule", "simuler"],
}
UUID_PREFIX = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_"
FALLBACK_ROUTE = "rag"

# Defaults per task status as (type, percent, seconds left, can be cancelled).
STATUS_DEFAULTS = {
    "started": ("started", 5, 120, True),
    "processing": ("processing", 50, 60, True),
    "retrying": ("progress", 40, 30, True),
    "completed": ("result", 100, None, False),
    "failed": ("error", 100, None, False),
    "canceled": ("error", 100, None, False),
}
TERMINAL = ["completed", "failed", "canceled"]
RECONNECT_SECONDS = 3
RESULT_TTL_SECONDS = 3600
HISTORY_ROWS = 100
DEAD_LETTERS = 1000
HEARTBEAT_SECONDS = 15
EXCERPT_CHARS = 200


def without_uuid(text: Column) -> Column:
    return F.regexp_replace(text, UUID_PREFIX, "")


def route_hits(question: Column, route: str) -> Column:
    """How many of the route's words occur; each counts once, also inside other words."""
    low = F.lower(question)
    hits = [F.when(low.contains(w), 1).otherwise(0) for w in ROUTE_WORDS[route]]
    return sum(hits[1:], hits[0])


def route_questions(runs: DataFrame, question: str = "question", file_name: str | None = None) -> DataFrame:
    """``runs`` with hit counts, ``task_type``, ``confidence`` and the ``fallback`` route of ambiguous rows."""
    cleaned = without_uuid(F.coalesce(F.col(question), F.lit("")))
    scored = runs
    for route in ROUTE_WORDS:
        scored = scored.withColumn(f"{route}_hits", route_hits(cleaned, route))
    names = list(ROUTE_WORDS)
    hits = [F.col(f"{r}_hits") for r in names]
    top = F.greatest(*hits)
    second = F.element_at(F.sort_array(F.array(*hits), asc=False), 2)
    clear = (top > 0) & (top > second)
    leader = F.when(hits[0] == top, names[0]).when(hits[1] == top, names[1]).otherwise(names[2])
    confidence = (F.when(clear & (top >= 5), 0.95).when(clear & (top >= 2), 0.85)
                  .when(clear & (second == 0), 0.75).when(clear, 0.60).when(top > 0, 0.70).otherwise(0.50))
    kind = F.lit(None).cast("string")
    if file_name:
        suffix = F.lower(F.regexp_extract(F.coalesce(F.col(file_name), F.lit("")), r"\.([^.]+)$", 1))
        kind = F.when(suffix == "pdf", "rag").when(suffix == "csv", "analysis")
    return (scored.withColumn("_kind", kind)
            .withColumn("confidence", F.when(F.col("_kind").isNotNull(), 1.0).otherwise(confidence))
            .withColumn("task_type", F.coalesce("_kind", F.when(clear, leader).otherwise("ambiguous")))
            .withColumn("fallback", F.when(F.col("task_type") == "ambiguous", FALLBACK_ROUTE))
            .drop("_kind"))


def session_memory(runs: DataFrame) -> DataFrame:
    """Latest analysis and number of analyses per session."""
    row = F.struct("id", F.left(F.coalesce("answer", F.lit("")), F.lit(EXCERPT_CHARS)).alias("answer_excerpt"))
    return (runs.groupBy("session_id").agg(F.max_by(row, "turn").alias("_last"), F.count(F.lit(1)).alias("analyses"))
            .select("session_id", "_last.*", "analyses"))


def prior_context(runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each turn with the excerpt of the turn before it."""
    excerpt = F.left(F.coalesce("answer", F.lit("")), F.lit(EXCERPT_CHARS))
    return with_neighbour(runs, ["session_id"], ["turn", "id"], excerpt, "prior_excerpt", step=-1, hot_rows=hot_rows)


def accepted_language(header: Column) -> Column:
    primary = F.lower(F.trim(F.split(F.split(header, ",")[0], ";")[0]))
    return F.when(primary.startswith("fr"), "fr").when(primary.startswith("en"), "en")


# Task state ----------------------------------------------------------------------------------------------------

PAYLOAD = ("type string, progress_percent int, eta_seconds int, can_cancel boolean, reconnect_after_seconds int, "
           "input_text string, output_text string, token_count_input int, token_count_output int, error string, "
           "retries int, max_retries int, result string")


def _default(position: int, otherwise) -> Column:
    status = F.col("status")
    value = F.lit(otherwise)
    for name, row in STATUS_DEFAULTS.items():
        value = F.when(status == name, F.lit(row[position])).otherwise(value)
    return value


def normalise_progress(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Messages with every field filled: what the payload says, else the default of the status.

    Works on batch and on streaming frames.
    """
    said = F.from_json(F.col(payload), PAYLOAD)
    tokens_in = F.coalesce("_p.token_count_input", token_estimate(F.col("_p.input_text")))
    tokens_out = F.coalesce("_p.token_count_output", token_estimate(F.col("_p.output_text")))
    return (messages.withColumn("status", F.coalesce("status", F.lit("processing"))).withColumn("_p", said)
            .withColumn("type", F.coalesce(F.nullif("_p.type", F.lit("")), _default(0, "progress")))
            .withColumn("progress_percent", F.coalesce("_p.progress_percent", _default(1, 0)))
            .withColumn("eta_seconds", F.coalesce("_p.eta_seconds", _default(2, None).cast("int")))
            .withColumn("can_cancel", F.coalesce("_p.can_cancel", _default(3, False)))
            .withColumn("reconnect_after_seconds", F.coalesce("_p.reconnect_after_seconds", F.lit(RECONNECT_SECONDS)))
            .withColumn("token_count_input", tokens_in).withColumn("token_count_output", tokens_out)
            .withColumn("token_count_total", tokens_in + tokens_out).drop("_p"))


def decode_messages(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw payloads: unreadable JSON becomes a failed message, JSON that is not an object a progress message."""
    parsed = F.try_parse_json(payload)
    readable, is_object = parsed.isNotNull(), F.trim(payload).startswith("{")
    text = F.lit(None).cast("string")
    return messages.select(
        *[c for c in messages.columns if c not in ("status", payload)],
        F.when(~readable, "failed").when(~is_object, "processing").otherwise(F.col("status")).alias("status"),
        F.when(~readable, "error").when(~is_object, "progress").otherwise(text).alias("type"),
        F.when(readable & ~is_object, F.col(payload)).alias("message"),
        F.when(~readable, "Invalid task progress payload").alias("error"),
        F.when(~readable, "progress_payload_invalid").alias("error_code"))


def latest_terminal(messages: DataFrame, ttl_seconds: int | None = RESULT_TTL_SECONDS,
                    as_of: dt.datetime | None = None) -> DataFrame:
    """Newest finished message per task, if it is not older than the time to live."""
    done = messages.filter(F.col("status").isin(TERMINAL))
    if ttl_seconds is not None:
        end = latest_time(messages, "emitted_at", as_of)
        if end is not None:
            done = done.filter(F.col("emitted_at") >= F.lit(end - dt.timedelta(seconds=ttl_seconds))
                               .cast(messages.schema["emitted_at"].dataType))
    rest = [c for c in messages.columns if c != "task_id"]
    return (done.groupBy("task_id").agg(F.max_by(F.struct(*rest), F.struct("emitted_at", "seq")).alias("_row"))
            .select("task_id", "_row.*"))


def user_history(submissions: DataFrame, cached: DataFrame, limit: int = 20) -> DataFrame:
    """The user's newest ``limit`` submissions that still have a cached payload; the limit applies first."""
    newest = newest_per_group(submissions, ["user_id"], [F.col("submitted_at").desc(), F.col("seq").desc()],
                              min(limit, HISTORY_ROWS))
    return newest.join(cached, "task_id")


def task_view(engine: DataFrame, cached: DataFrame) -> DataFrame:
    """One row per task: the engine's final status first, then the cached message, then the engine's open status.

    ``engine``: task_id, engine_status, engine_result. ``cached``: task_id, status, error, can_cancel.
    """
    finals = {"SUCCESS": "completed", "FAILURE": "failed", "REVOKED": "canceled"}
    final = F.lit(None).cast("string")
    for name, status in finals.items():
        final = F.when(F.col("engine_status") == name, status).otherwise(final)
    has_cache = F.col("_cached").isNotNull()
    low = F.lower("engine_status")
    error = (F.when(F.col("engine_status") == "FAILURE", F.col("engine_result"))
             .when(F.col("engine_status") == "REVOKED", F.lit("Task canceled by user"))
             .when(F.col("_final").isNull() & has_cache, F.col("error")))
    stored = cached.select("task_id", F.coalesce("status", F.lit("completed")).alias("status"), "error", "can_cancel",
                           F.lit(True).alias("_cached"))
    return (engine.join(stored, "task_id", "left").withColumn("_final", final)
            .select("task_id",
                    F.coalesce("_final", "status", low).alias("status"),
                    F.when(F.col("_final").isNotNull(), True).when(has_cache, F.col("status").isin(TERMINAL))
                    .otherwise(False).alias("terminal"),
                    F.when(F.col("_final").isNull() & has_cache, "cache").otherwise("engine").alias("origin"),
                    F.when(F.col("_final").isNotNull(), False).when(has_cache, F.coalesce("can_cancel", F.lit(False)))
                    .otherwise(low.isin("pending", "started", "retry")).alias("can_cancel"),
                    error.alias("error")))


def dead_letters(failures: DataFrame, limit: int = DEAD_LETTERS) -> DataFrame:
    """Final failures, newest first."""
    final = failures.filter((F.col("status") == "failed") & (F.col("retries") >= F.col("max_retries")))
    return final.orderBy(F.col("emitted_at").desc(), F.col("seq").desc()).limit(limit)


def heartbeat_gaps(messages: DataFrame, every: int = HEARTBEAT_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per message the number of heartbeats until the task's next one; none after a terminal message."""
    paired = with_neighbour(messages, ["task_id"], ["emitted_at", "seq"], F.col("emitted_at"), "next_at",
                            hot_rows=hot_rows)
    micros = (F.unix_micros(F.col("next_at").cast("timestamp"))
              - F.unix_micros(F.col("emitted_at").cast("timestamp")))
    beats = F.when(F.col("status").isin(TERMINAL) | F.col("next_at").isNull(), F.lit(0)).otherwise(
        F.floor(micros / (every * 1_000_000)))
    return paired.withColumn("heartbeats", beats.cast("long"))


def heartbeats(gaps: DataFrame, every: int = HEARTBEAT_SECONDS) -> DataFrame:
    """One row per heartbeat."""
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("heartbeats")))
    return (gaps.filter(F.col("heartbeats") > 0).select("task_id", "emitted_at", nth.alias("n"))
            .select("task_id", "n", (F.col("emitted_at") + F.make_dt_interval(secs=F.col("n") * every))
                    .alias("beat_at")))


# Headings of a merged answer.
HEADINGS = {"en": ("## Data analysis insights\n", "## Document insights\n"),
            "fr": ("## Insights d'analyse de données\n", "## Insights documentaires\n")}


def merge_answers(analysis: DataFrame, documents: DataFrame, language: str = "fr") -> DataFrame:
    """Both partial answers of a run joined; one alone stands with the other's error; none is a failure.

    Each side: run_id, answer, error.
    """
    first, second = HEADINGS[language]
    left = analysis.select("run_id", F.col("answer").alias("_a"), F.col("error").alias("_ae"))
    right = documents.select("run_id", F.col("answer").alias("_d"), F.col("error").alias("_de"))
    a = F.when(F.col("_ae").isNull(), F.nullif("_a", F.lit("")))
    d = F.when(F.col("_de").isNull(), F.nullif("_d", F.lit("")))
    both, only_a, only_d = a.isNotNull() & d.isNotNull(), a.isNotNull(), d.isNotNull()
    failed = F.concat(F.lit("Analyse: "), F.coalesce("_ae", F.lit("failed")), F.lit("\nRAG: "),
                      F.coalesce("_de", F.lit("failed")))
    return left.join(right, "run_id", "full_outer").select(
        "run_id",
        F.when(both, F.concat(F.lit(first), a, F.lit("\n\n"), F.lit(second), d))
        .when(only_a, a).when(only_d, d).otherwise(failed).alias("answer"),
        F.when(both, F.lit(None).cast("string")).when(only_a, F.col("_de")).when(only_d, F.col("_ae"))
        .otherwise("analysis_and_rag_failed").alias("error"))
