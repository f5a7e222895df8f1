"""Template narratives and small routing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.rules import percent

# Header text by severity and sentence by predicted class.
SEVERITY_TEXT = {
    "critical": "CRITICAL THREAT",
    "high": "High-severity threat",
    "medium": "Moderate suspicious activity",
    "low": "Low-priority anomaly",
    "info": "Informational event",
}
CLASS_TEXT = {
    "dos": "Denial of Service attack pattern detected — high volume traffic from {src} targeting {dst}.",
    "ddos": "Distributed Denial of Service indicators — coordinated flood traffic targeting {dst}.",
    "brute_force": "Brute force credential attack from {src} — repeated authentication failures against {dst}.",
    "web_attack": "Web application attack from {src} against {dst}:{port} — possible injection or exploitation attempt.",
    "infiltration": "Network infiltration pattern — {src} exhibiting lateral movement behaviors toward {dst}.",
    "botnet": "Botnet communication indicators — {src} showing automated C2 callback patterns.",
    "port_scan": "Network reconnaissance — {src} scanning ports on {dst}, service enumeration detected.",
    "sql_injection": "SQL injection attempt from {src} against {dst}:{port} — malicious query patterns in payload.",
    "fuzzers": "Fuzzing activity from {src} — automated input testing detected against {dst}.",
    "backdoors": "Backdoor indicators — persistent unauthorized access channel detected between {src} and {dst}.",
    "exploits": "Exploitation attempt from {src} targeting {dst} — known vulnerability exploitation pattern.",
    "reconnaissance": "Active reconnaissance — {src} performing network discovery and enumeration.",
    "benign": "Normal network activity from {src} to {dst} — no threat indicators detected.",
}
# Late stages that select the deep triage tier, and actions that select deep retrieval.
DEEP_STAGES = ["execution", "lateral_movement", "exfiltration", "impact", "command_and_control"]
DEEP_ACTIONS = ["lateral_movement", "c2", "exfil"]
# Response actions by signature name or id.
RESPONSE_BY_SIGNATURE = [
    ("Suspicious PowerShell Download", "isolate_host"),
    ("Ransomware File Extension Observed", "isolate_host"),
    ("Known Malicious IP Connection", "block_ip"),
]


def entity_label(hostname: Column, identifier: Column) -> Column:
    named = F.when(hostname != "", F.concat(hostname, F.lit(" ("), identifier, F.lit(")")))
    return F.coalesce(named, identifier, F.lit("unknown"))


def narrative(matches: str = "rule_matches", iocs: str = "ioc_matches") -> Column:
    score = F.col("meta_score")
    icon = F.when(score >= 0.8, "🔴").when(score >= 0.5, "🟡").when(score >= 0.3, "🟢").otherwise("ℹ️")
    sev = F.create_map(*[F.lit(x) for kv in SEVERITY_TEXT.items() for x in kv])
    head = F.concat(icon, F.lit(" "), F.coalesce(sev[F.coalesce("severity", F.lit("info"))], F.lit("Event")), F.lit(": "))

    label = F.when(F.col("ensemble_label").isin(list(CLASS_TEXT)), F.col("ensemble_label")).otherwise("benign")
    text = F.create_map(*[F.lit(x) for kv in CLASS_TEXT.items() for x in kv])[label]
    for hole, value in (
        ("{src}", entity_label(F.col("hostname"), F.col("src_ip"))),
        ("{dst}", F.coalesce("dst_ip", F.lit("unknown"))),
        ("{port}", F.coalesce(F.col("dst_port").cast("string"), F.lit(""))),
    ):
        text = F.replace(text, F.lit(hole), value)

    rules = F.array_join(F.slice(F.transform(matches, lambda m: m["rule_name"]), 1, 3), ", ")
    refs = F.transform(
        matches, lambda m: F.concat(m["mitre_technique_id"], F.lit(" ("), m["mitre_tactic"], F.lit(")"))
    )
    refs = F.array_join(F.slice(F.array_sort(F.array_distinct(refs)), 1, 3), ", ")
    hits = F.array_join(F.slice(F.transform(iocs, lambda i: i["threat_name"]), 1, 2), ", ")
    none = F.lit("")
    return F.concat(
        head, text, F.lit(" [Confidence: "), percent(score, 0), F.lit("]"),
        F.when(F.size(matches) > 0, F.concat(F.lit(" | Sigma: "), rules, F.lit(" | MITRE: "), refs)).otherwise(none),
        F.when(F.size(iocs) > 0, F.concat(F.lit(" | IOC Hit: "), hits)).otherwise(none),
        F.when(
            F.col("bytes_out") > 100000,
            F.concat(F.lit(" | "), F.format_number("bytes_out", 0), F.lit(" bytes outbound (potential exfil)")),
        ).otherwise(none),
    )


def sequence_alert_to_event(alerts: DataFrame) -> DataFrame:
    """Event row for each fired sequence; feeds the event table, not the matcher."""
    return alerts.select(
        F.concat_ws("-", "pattern_id", "triggering_event_id").alias("event_id"),
        "tenant_id",
        F.lit("cep").alias("source_type"),
        F.when(F.upper("severity") == "CRITICAL", "critical").otherwise("high").alias("severity"),
        F.lit("alert").alias("action"),
        F.lit(0.92).alias("ensemble_score"),
        F.lit(0.95).alias("meta_score"),
        F.col("pattern_id").alias("cep_sequence_id"),
        F.col("mitre_tactic").alias("tactic"),
        F.col("entity_key").alias("source_entity"),
        F.col("triggering_event_id").alias("parent_event_id"),
    )


def response_candidates(events: DataFrame) -> DataFrame:
    """One row per (event, action, target). Nothing is executed; rows without a target are dropped."""
    table = F.create_map(*[F.lit(x) for kv in RESPONSE_BY_SIGNATURE for x in kv])
    mapped = F.coalesce(table[F.coalesce("signature_name", F.lit(""))], table[F.coalesce("signature_id", F.lit(""))])
    malware = (F.col("severity") == "critical") & F.lower(F.coalesce("message", F.lit(""))).contains("malware")
    actions = F.array_distinct(F.array_compact(F.array(mapped, F.when(malware, F.lit("isolate_host")))))
    src = F.when(F.col("source_entity_type") == "host", F.col("source_entity"))
    dst = F.when(F.col("destination_entity_type") == "host", F.col("destination_entity"))
    target = F.when(F.col("response") == "block_ip", F.coalesce("src_ip", "source_entity")).otherwise(F.coalesce(src, dst))
    return (
        events.withColumn("response", F.explode(actions)).withColumn("target", target).where("target IS NOT NULL")
    )


def triage_tier(score: Column, stage: Column, threshold: float = 0.7) -> Column:
    deep = (score > threshold) | F.coalesce(F.lower(stage).isin(DEEP_STAGES), F.lit(False))
    return F.when(deep, "deep").otherwise("standard")


def retrieval_tier(score: Column, action: Column) -> Column:
    return F.when((score > 0.7) | action.isin(DEEP_ACTIONS), "high").otherwise("low")


def retrieval_query(action: Column, event_type: Column, message: Column) -> Column:
    blank = F.lit("")
    return F.trim(F.concat(action, F.lit(" "), F.coalesce(event_type, blank), F.lit(" "), F.coalesce(message, blank)))
