"""Side tables (campaigns, verdicts, heartbeats, audit, rules) derived from the test events, in both dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions.text import severity_rank
from duskwatch.operators.rules import alert_candidates
from duskwatch.plans.base import sec_events

RANK_SQL = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"

CAMPAIGNS_SQL = (
    "camp AS (SELECT tenant_id, campaign_id, 'Campaign ' || campaign_id AS name, CASE max(" + RANK_SQL + ") WHEN 4 THEN "
    "'critical' WHEN 3 THEN 'high' ELSE 'medium' END AS severity, max(" + RANK_SQL + ") AS severity_num, max(meta_score) AS "
    "meta_score, min(timestamp) AS created_at, max(timestamp) AS updated_at, count(*) > 5 AS active, "
    "list(DISTINCT technique_id) AS techniques FROM sec WHERE campaign_id IS NOT NULL GROUP BY tenant_id, campaign_id)"
)
VERDICT = "CASE k % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'escalated' END"
VERDICTS_SQL = (
    "verd AS (SELECT tenant_id, event_id AS id, 'FE-' || event_id AS event_id, " + VERDICT + " AS verdict, 'an-' || (k % 5) AS "
    "analyst_id, timestamp AS created_at, src_ip AS entity_value, 'seen ' || dst_ip || ' ' || message AS notes FROM sec WHERE "
    "value >= 60)"
)
AUDIT_SQL = (
    "aud AS (SELECT event_id AS id, timestamp, tenant_id, CASE event_type WHEN 'signup' THEN 'auth' WHEN 'error' THEN "
    "'soar_execution' WHEN 'click' THEN 'retention' ELSE 'config' END AS category, action, outcome FROM sec)"
)


def campaigns(spark, sf_dir):
    rank = severity_rank(F.col("severity"))
    return (
        sec_events(spark, sf_dir).where("campaign_id IS NOT NULL")
        .groupBy("tenant_id", "campaign_id")
        .agg(
            F.max(rank).alias("severity_num"), F.max("meta_score").alias("meta_score"),
            F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"),
            (F.count("*") > 5).alias("active"), F.collect_set("technique_id").alias("techniques"),
        )
        .withColumn("name", F.concat(F.lit("Campaign "), "campaign_id"))
        .withColumn(
            "severity",
            F.when(F.col("severity_num") == 4, "critical").when(F.col("severity_num") == 3, "high").otherwise("medium"),
        )
    )


def verdicts(spark, sf_dir):
    return sec_events(spark, sf_dir).where("value >= 60").select(
        "tenant_id", F.col("event_id").alias("id"), F.concat(F.lit("FE-"), "event_id").alias("event_id"),
        F.expr(VERDICT).alias("verdict"), F.concat(F.lit("an-"), (F.col("k") % 5).cast("string")).alias("analyst_id"),
        F.col("timestamp").alias("created_at"), F.col("src_ip").alias("entity_value"),
        F.concat(F.lit("seen "), "dst_ip", F.lit(" "), "message").alias("notes"),
    )


def heartbeats(spark, sf_dir):
    return sec_events(spark, sf_dir).select(
        F.concat("source_type", F.lit("-"), (F.col("k") % 40).cast("string")).alias("connector_id"), "timestamp"
    )


HEARTBEATS_SQL = "hb AS (SELECT source_type || '-' || (k % 40) AS connector_id, timestamp FROM sec)"


def audit(spark, sf_dir):
    cat = (
        F.when(F.col("event_type") == "signup", "auth").when(F.col("event_type") == "error", "soar_execution")
        .when(F.col("event_type") == "click", "retention").otherwise("config")
    )
    return sec_events(spark, sf_dir).select(
        F.col("event_id").alias("id"), "timestamp", "tenant_id", cat.alias("category"), "action", "outcome"
    )


RULES_SQL = "rl AS (SELECT DISTINCT user_id::VARCHAR AS id, 'Rule for host-' || (user_id % 40) AS title, 'high' AS level FROM sec)"


def rules_table(spark, sf_dir):
    return sec_events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("id"),
        F.concat(F.lit("Rule for host-"), (F.col("user_id") % 40).cast("string")).alias("title"), F.lit("high").alias("level"),
    ).distinct()


def as_finding_rows(ev):
    """Severe events in the findings shape, with a status."""
    return ev.where("meta_score >= 0.5").select(
        F.concat(F.lit("FE-"), F.col("event_id").cast("string")).alias("id"), F.col("message").alias("title"), "severity", "tenant_id",
        F.expr("CASE k % 4 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'approved' ELSE 'open' END").alias("status"),
        F.col("timestamp").alias("created_at"),
    )


FINDING_ROWS_SQL = (
    "fr AS (SELECT 'FE-' || event_id AS id, message AS title, severity, tenant_id, CASE k % 4 WHEN 0 THEN 'dismissed' WHEN 1 THEN "
    "'approved' ELSE 'open' END AS status, timestamp AS created_at FROM sec WHERE meta_score >= 0.5)"
)


HUNTS_SQL = (
    "hq AS (SELECT 'h-' || event_id AS id, tenant_id, 'an-' || (k % 5) AS user_id, 'severity = ' || severity AS query_text, CASE WHEN k % 2 = 0 THEN 'uql' ELSE 'nl' END AS query_mode, "
    "CASE WHEN k % 2 = 1 THEN 'severity:' || severity END AS uql_output, k AS result_count, timestamp AS executed_at FROM sec WHERE event_type = 'view')"
)
CASES_SQL = (
    "cs AS (SELECT tenant_id, 'case-' || event_id AS case_id, timestamp AS created_at, severity, CASE k % 3 WHEN 0 THEN 'closed' ELSE 'open' END AS status, message AS title FROM sec WHERE "
    "severity IN ('high', 'critical'))"
)
ALERTS_SQL = (
    "al AS (SELECT tenant_id, 'al-' || event_id AS alert_id, timestamp AS created_at, event_id::VARCHAR AS event_id, meta_score AS ml_score, severity FROM sec WHERE NOT is_synthetic AND "
    "(meta_score >= 0.85 OR severity IN ('high', 'critical')))"
)
REPORTS_SQL = (
    "rp AS (SELECT 'r-' || event_id AS id, tenant_id, 'Report ' || severity AS report_name, CASE k % 2 WHEN 0 THEN 'csv' ELSE 'pdf' END AS report_type, 'an-' || (k % 5) AS generated_by, "
    "bytes_in AS file_size_bytes, timestamp AS created_at FROM sec WHERE event_type = 'purchase')"
)


def hunts_table(spark, sf_dir):
    return sec_events(spark, sf_dir).where("event_type = 'view'").select(
        F.concat(F.lit("h-"), "event_id").alias("id"), "tenant_id", F.concat(F.lit("an-"), (F.col("k") % 5).cast("string")).alias("user_id"),
        F.concat(F.lit("severity = "), "severity").alias("query_text"), F.when(F.col("k") % 2 == 0, "uql").otherwise("nl").alias("query_mode"),
        F.when(F.col("k") % 2 == 1, F.concat(F.lit("severity:"), "severity")).alias("uql_output"), F.col("k").alias("result_count"), F.col("timestamp").alias("executed_at"),
    )


def cases_table(spark, sf_dir):
    return sec_events(spark, sf_dir).where("severity IN ('high', 'critical')").select(
        "tenant_id", F.concat(F.lit("case-"), "event_id").alias("case_id"), F.col("timestamp").alias("created_at"), "severity",
        F.when(F.col("k") % 3 == 0, "closed").otherwise("open").alias("status"), F.col("message").alias("title"),
    )


def alerts_table(spark, sf_dir):
    return alert_candidates(sec_events(spark, sf_dir)).select(
        "tenant_id", F.concat(F.lit("al-"), "event_id").alias("alert_id"), F.col("timestamp").alias("created_at"), F.col("event_id").cast("string").alias("event_id"),
        F.col("meta_score").alias("ml_score"), "severity",
    )


def reports_table(spark, sf_dir):
    return sec_events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.concat(F.lit("r-"), "event_id").alias("id"), "tenant_id", F.concat(F.lit("Report "), "severity").alias("report_name"),
        F.when(F.col("k") % 2 == 0, "csv").otherwise("pdf").alias("report_type"), F.concat(F.lit("an-"), (F.col("k") % 5).cast("string")).alias("generated_by"),
        F.col("bytes_in").alias("file_size_bytes"), F.col("timestamp").alias("created_at"),
    )
