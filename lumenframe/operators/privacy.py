"""Personal-data scan of column names, consent intervals, access export, erasure, retention, token status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenframe.functions.text import normalise_name
from lumenframe.operators.events import latest_time
from lumenframe.operators.ordered import HOT_ROWS, newest_per_group, with_neighbour
from lumenframe.operators.personal_names import (
    ARTICLE_BASIC, ARTICLE_SENSITIVE, HIGH_ENDS, HIGH_EXACT, HIGH_STARTS, MEDIUM_ENDS, MEDIUM_EXACT, MEDIUM_STARTS,
    QUICK_KEYS, SEMANTIC, SENSITIVE_PREFIX)

# Purposes a user can consent to.
PURPOSES = ["data_analysis", "rag_indexing", "agent_query", "code_execution"]

AUDIT_ROWS = 100
EXPIRED_DAYS, REVOKED_DAYS = 7, 30


def _exact_rules(spark: SparkSession) -> DataFrame:
    """Whole-name rules as a fixed table of some 140 rows."""
    rows = [(k, "high", v) for k, v in HIGH_EXACT.items()]
    rows += [(k, "medium", v) for k, v in MEDIUM_EXACT.items() if k not in HIGH_EXACT]
    return spark.createDataFrame(rows, "_norm string, _risk string, _reason string")


def classify_columns(names: DataFrame, column: str = "column_name") -> DataFrame:
    """``names`` with risk, confidence, reason, article and match tier per column name.

    Whole names meet a fixed rule table in a broadcast join; tokens are judged in place. The first match wins: whole
    name, last token, first token, then any token.
    """
    tokens = F.split("_norm", "_")
    last, first = F.element_at("_tokens", -1), F.element_at("_tokens", 1)
    word = F.array_min(F.array_intersect("_tokens", F.array(*[F.lit(w) for w in SEMANTIC])))
    basic = F.lit(ARTICLE_BASIC)
    quote = lambda text, token: F.concat(F.lit(text + " '"), token, F.lit("'"))

    def verdict(risk: str, confidence: float, reason: Column, article: Column, tier: str) -> Column:
        return F.struct(F.lit(risk).alias("risk"), F.lit(confidence).alias("confidence"), reason.alias("reason"),
                        article.alias("article"), F.lit(tier).alias("match_tier"))

    sensitive = F.col("_reason").startswith(SENSITIVE_PREFIX)
    judged = (
        F.when(F.col("_risk") == "high", verdict("high", 1.0, F.col("_reason"), basic, "exact"))
        .when(F.col("_risk") == "medium", verdict(
            "medium", 1.0, F.col("_reason"), F.when(sensitive, ARTICLE_SENSITIVE).otherwise(ARTICLE_BASIC), "exact"))
        .when(last.isin(HIGH_ENDS), verdict(
            "high", 0.85, quote("Identifiant personnel — colonne se terminant par", last), basic, "pattern"))
        .when(first.isin(HIGH_STARTS), verdict(
            "high", 0.85, quote("Identifiant personnel — colonne commençant par", first), basic, "pattern"))
        .when(last.isin(MEDIUM_ENDS), verdict(
            "medium", 0.85, quote("Quasi-identifiant — colonne se terminant par", last), basic, "pattern"))
        .when(first.isin(MEDIUM_STARTS), verdict(
            "medium", 0.85, quote("Quasi-identifiant — colonne commençant par", first), basic, "pattern"))
        .when(F.col("_word").isNotNull(), verdict(
            "medium", 0.65, quote("Quasi-identifiant probable — contient le terme", F.col("_word")), basic,
            "semantic"))
        .otherwise(verdict("safe", 0.0, F.lit("Donnée statistique — Faible risque"), F.lit(""), "none")))
    return (names.withColumn("_norm", normalise_name(F.col(column)))
            .withColumn("_tokens", tokens).withColumn("_word", word)
            .join(F.broadcast(_exact_rules(names.sparkSession)), "_norm", "left")
            .withColumn("_verdict", judged)
            .select(*names.columns, F.col("_norm").alias("normalised"), "_verdict.*"))


def table_verdicts(classified: DataFrame, table: str = "table_name", column: str = "column_name") -> DataFrame:
    """Risk per table with counts. The flagged names themselves stay rows, see ``flagged_columns``."""
    high, medium = F.col("risk") == "high", F.col("risk") == "medium"
    return (classified.groupBy(table)
            .agg(F.bool_or(high | medium).alias("has_personal_data"),
                 F.when(F.bool_or(high), "high").when(F.bool_or(medium), "medium").otherwise("safe")
                 .alias("risk_level"),
                 F.count_if(high | medium).alias("flagged"), F.count_if(~(high | medium)).alias("safe")))


def flagged_columns(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("risk") != "safe")


def recommendations(classified: DataFrame, table: str = "table_name", column: str = "column_name") -> DataFrame:
    """One text per table naming the columns to drop or mask. For catalogs: a schema bounds the list."""
    risky = F.array_sort(F.collect_list(F.when(F.col("risk") != "safe", F.col(column))))
    return (classified.groupBy(table).agg(risky.alias("_risky"))
            .select(table, F.when(F.size("_risky") > 0, F.concat(
                F.lit("Supprimer ou anonymiser les colonnes : "), F.array_join("_risky", ", ")))
                .otherwise("Aucune donnée personnelle détectée. Analyse sécurisée.").alias("recommendation")))


def quick_scan(names: DataFrame, column: str = "column_name") -> DataFrame:
    """Names whose normalised form is on the quick list."""
    return names.filter(normalise_name(F.col(column)).isin(QUICK_KEYS))


# Consent -------------------------------------------------------------------------------------------------------

def rejected_consents(log: DataFrame) -> DataFrame:
    return log.filter(~F.coalesce(F.col("purpose").isin(PURPOSES), F.lit(False)))


def consent_intervals(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each record is valid until the next one of the same user and purpose."""
    valid = log.filter(F.col("purpose").isin(PURPOSES))
    return with_neighbour(valid, ["user_id", "purpose"], ["granted_at", "id"], F.col("granted_at"), "revoked_at",
                          hot_rows=hot_rows)


def active_consents(log: DataFrame) -> DataFrame:
    """The open record per user and purpose: an aggregate, no window needed."""
    valid = log.filter(F.col("purpose").isin(PURPOSES))
    newest = F.max_by(F.struct("id", "granted", "granted_at"), F.struct("granted_at", "id"))
    return valid.groupBy("user_id", "purpose").agg(newest.alias("_row")).select("user_id", "purpose", "_row.*")


def newest_audit_rows(logs: DataFrame, limit: int = AUDIT_ROWS) -> DataFrame:
    return newest_per_group(logs, ["user_id"], [F.col("created_at").desc(), F.col("id")], limit)


# Access, erasure, retention ------------------------------------------------------------------------------------

def access_export(users: DataFrame, consents: DataFrame, logs: DataFrame) -> DataFrame:
    """Everything about every known user as rows ``(user_id, section, record_id, payload)``.

    Rows and not one collected document per user: a user with very many log lines stays many rows.
    """
    profile = users.select(F.col("id").alias("user_id"), F.lit("profile").alias("section"),
                           F.col("id").cast("string").alias("record_id"),
                           F.to_json(F.struct("email", "full_name", "is_active")).alias("payload"))
    known = users.select(F.col("id").alias("user_id"))

    def part(name: str, frame: DataFrame, fields: list[str]) -> DataFrame:
        return (frame.join(known, "user_id", "left_semi")
                .select("user_id", F.lit(name).alias("section"), F.col("id").cast("string").alias("record_id"),
                        F.to_json(F.struct(*fields)).alias("payload")))

    return (profile.unionByName(part("consent", consents, ["purpose", "granted"]))
            .unionByName(part("audit", logs, ["action", "details"])))


def access_totals(users: DataFrame, consents: DataFrame, logs: DataFrame) -> DataFrame:
    """Per user: profile with the number of consent and log records. Both sides are aggregated before the join."""
    n = F.count(F.lit(1))
    return (users.join(consents.groupBy(F.col("user_id").alias("id")).agg(n.alias("consents")), "id", "left")
            .join(logs.groupBy(F.col("user_id").alias("id")).agg(n.alias("audit_logs")), "id", "left")
            .select("id", "email", "full_name", F.coalesce("consents", F.lit(0)).alias("consents"),
                    F.coalesce("audit_logs", F.lit(0)).alias("audit_logs")))


def erase_users(users: DataFrame, erased: DataFrame) -> DataFrame:
    """Users with those in ``erased`` (column ``id``) made anonymous and inactive."""
    marks = erased.select("id").distinct().withColumn("_gone", F.lit(True))
    gone = F.coalesce(F.col("_gone"), F.lit(False))
    return (users.join(marks, "id", "left")
            .withColumn("email", F.when(gone, F.concat(F.lit("deleted_"), F.col("id").cast("string"),
                                                       F.lit("@anonymised.rgpd"))).otherwise(F.col("email")))
            .withColumn("full_name", F.when(~gone, F.col("full_name")))
            .withColumn("password_marker", F.when(gone, "ERASED"))
            .withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active")))
            .drop("_gone"))


def erase_tokens(tokens: DataFrame, erased: DataFrame) -> DataFrame:
    return tokens.join(erased.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_anti")


def cascade_delete(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child rows whose parent survives."""
    return children.join(parents.select(F.col("id").alias("user_id")), "user_id", "left_semi")


def set_null(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child rows kept; the reference is nulled where the parent is gone."""
    alive = parents.select(F.col("id").alias("user_id"), F.lit(True).alias("_alive"))
    return (children.join(alive, "user_id", "left")
            .withColumn("user_id", F.when(F.col("_alive"), F.col("user_id"))).drop("_alive"))


def purge_condition(as_of: dt.datetime, expired_days: int = EXPIRED_DAYS, revoked_days: int = REVOKED_DAYS) -> Column:
    return ((F.col("expires_at") < F.lit(as_of - dt.timedelta(days=expired_days)).cast("timestamp_ntz"))
            | (F.col("revoked") & (F.col("created_at")
                                   < F.lit(as_of - dt.timedelta(days=revoked_days)).cast("timestamp_ntz"))))


def token_status(tokens: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    end = latest_time(tokens, "created_at", as_of)
    return tokens.withColumn("status", F.when(F.col("revoked"), "invalid").when(
        F.col("expires_at") < F.lit(end).cast("timestamp_ntz"), "expired").otherwise("valid"))


def token_rotation(tokens: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """When each token was replaced by the user's next one."""
    return with_neighbour(tokens, ["user_id"], ["created_at", "id"], F.col("created_at"), "rotated_at",
                          hot_rows=hot_rows)
