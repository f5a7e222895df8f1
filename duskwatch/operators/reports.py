"""Reports: top-k lists, conditional aggregates, profiles, digests and posture figures.

Figures that come from several tables are computed as one aggregate per table, stacked as
(metric, value) rows and folded by one more aggregate, so no join of unrelated tables is planned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import severity_rank
from duskwatch.operators.segments import segmented


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)


def recent_events(events: DataFrame, tenant: str, min_score: float = 0.0, limit: int = 100) -> DataFrame:
    return newest(events.where((F.col("tenant_id") == tenant) & (F.col("meta_score") >= min_score)), limit)


def events_page(
    events: DataFrame, tenant: str, limit: int = 20, offset: int = 0, min_score: float = 0.0,
    campaign: str | None = None, source: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page, one-row total)."""
    rows = events.where(F.col("tenant_id") == tenant)
    if min_score > 0:
        rows = rows.where(F.col("meta_score") >= min_score)
    if campaign:
        rows = rows.where(F.col("campaign_id") == campaign)
    if source:
        rows = rows.where(F.col("source_type") == source)
    page = rows.orderBy(F.desc("timestamp"), F.desc("event_id")).offset(offset).limit(limit)
    return page, rows.agg(F.count("*").alias("total"))


def event_by_id(events: DataFrame, tenant: str, event_id) -> DataFrame:
    return events.where((F.col("tenant_id") == tenant) & (F.col("event_id") == event_id))


def events_by_ids(events: DataFrame, tenant: str, ids: list) -> DataFrame:
    if len(ids) > 20:
        raise ValueError("at most 20 ids")
    return events.where((F.col("tenant_id") == tenant) & F.col("event_id").isin(ids))


def event_count(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id").agg(F.count("*").alias("events"))


def severity_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", "severity").agg(F.count("*").alias("events"))


def holds(col: str, text: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(text.lower()))


def search_events(events: DataFrame, tenant: str, text: str, limit: int = 10) -> DataFrame:
    cols = ["message", "raw_log", "src_ip", "dst_ip", "action"]
    hit = reduce(lambda a, b: a | b, [holds(c, text) for c in cols])
    return newest(events.where((F.col("tenant_id") == tenant) & hit), limit)


def posture_history(events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    rows = events.where(F.col("timestamp") >= now - F.make_interval(days=F.lit(days)))
    out = rows.groupBy("tenant_id", F.to_date("timestamp").alias("day")).agg(
        F.avg("meta_score").alias("avg_score"),
        F.count_if(F.col("meta_score") > 0.7).alias("threats"),
        F.count("*").alias("events"),
    )
    score = F.round(F.least(F.greatest(100 - F.col("avg_score") * 100, F.lit(0.0)), F.lit(100.0)), 1)
    return out.withColumn("score", score)


# ---- entity pages ----------------------------------------------------------------------------


def entity_filter(kind: str, value: str) -> Column:
    if kind == "ip":
        return (F.col("src_ip") == value) | (F.col("dst_ip") == value)
    if kind in ("user", "host"):
        return holds("message", value) | holds("raw_log", value)
    return holds("message", value)


def entity_events(events: DataFrame, tenant: str, kind: str, value: str) -> DataFrame:
    return events.where((F.col("tenant_id") == tenant) & entity_filter(kind, value))


def entity_profile(events: DataFrame, tenant: str, kind: str, value: str, now: Column, hours: int = 24) -> DataFrame:
    rows = entity_events(events, tenant, kind, value)
    rows = rows.where(F.col("timestamp") >= now - F.make_interval(hours=F.lit(hours)))
    return rows.agg(
        F.count("*").alias("frequency"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"), F.round(F.coalesce(F.avg("meta_score"), F.lit(0.0)), 4).alias("risk_score"),
    )


def entity_recent(events: DataFrame, tenant: str, kind: str, value: str, limit: int = 20) -> DataFrame:
    cols = ["event_id", "timestamp", "severity", "message", "action", "meta_score", "source_type"]
    return newest(entity_events(events, tenant, kind, value).select(*cols), limit)


def entity_trend(events: DataFrame, tenant: str, kind: str, value: str, now: Column, days: int = 7) -> DataFrame:
    rows = entity_events(events, tenant, kind, value)
    rows = rows.where(F.col("timestamp") >= now - F.make_interval(days=F.lit(days)))
    return rows.groupBy(F.to_date("timestamp").alias("day")).agg(F.round(F.avg("meta_score") * 100, 2).alias("score"))


def entity_rules(events: DataFrame, tenant: str, kind: str, value: str, top: int = 10) -> DataFrame:
    rows = entity_events(events, tenant, kind, value).where("signature_id IS NOT NULL AND signature_id <> ''")
    out = rows.groupBy("signature_id").agg(
        F.min("signature_name").alias("name"), F.min("severity").alias("severity"), F.count("*").alias("hits")
    )
    return out.orderBy(F.desc("hits"), "signature_id").limit(top)


# ---- findings --------------------------------------------------------------------------------


def all_findings(events: DataFrame, campaigns: DataFrame, tenant: str, min_severity: str = "medium") -> DataFrame:
    """Event findings and campaign findings in one shape, before the cut."""
    ev = events.where(
        (F.col("tenant_id") == tenant) & (F.col("meta_score") >= 0.5)
        & (severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))
    ).select(
        F.concat(F.lit("FE-"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("campaign_id").isNotNull(), "campaign").otherwise("detection").alias("source"),
        F.coalesce("message", F.concat(F.lit("High-risk event from "), "source_type")).alias("title"),
        "severity",
        F.col("campaign_id").alias("linked_campaign"),
        "meta_score",
        F.lit("open").alias("status"),
        F.col("timestamp").alias("created_at"),
    )
    camp = campaigns.where(F.col("tenant_id") == tenant).select(
        F.concat(F.lit("FC-"), "campaign_id").alias("id"),
        F.lit("campaign").alias("source"),
        F.concat(F.lit("Active campaign: "), "campaign_id").alias("title"),
        F.coalesce("severity", F.lit("high")).alias("severity"),
        F.col("campaign_id").alias("linked_campaign"),
        "meta_score",
        F.lit("open").alias("status"),
        "created_at",
    )
    return ev.unionByName(camp)


def findings(events, campaigns, tenant: str, min_severity: str = "medium", limit: int = 20) -> DataFrame:
    rows = all_findings(events, campaigns, tenant, min_severity)
    return rows.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("meta_score"), "id").limit(limit)


def finding_history(events: DataFrame, campaigns: DataFrame, verdicts: DataFrame, finding_id: str, tenant: str) -> DataFrame:
    """Creation row and analyst rows of one finding, newest first."""
    key = finding_id[3:]
    if finding_id.startswith("FE-"):
        made = events.where((F.col("tenant_id") == tenant) & (F.col("event_id").cast("string") == key)).select(
            F.lit("creation").alias("type"), "timestamp", F.lit("Finding generated from raw event").alias("message"),
            F.col("source_type").alias("by"),
        )
    else:
        made = campaigns.where((F.col("tenant_id") == tenant) & (F.col("campaign_id") == key)).select(
            F.lit("creation").alias("type"), F.col("created_at").alias("timestamp"),
            F.lit(f"Finding generated from campaign: {key}").alias("message"), F.lit("campaign_engine").alias("by"),
        )
    acts = verdicts.where((F.col("tenant_id") == tenant) & (F.col("event_id") == finding_id)).select(
        F.lit("analyst_action").alias("type"), F.col("created_at").alias("timestamp"),
        F.concat(F.lit("Analyst decision: "), "verdict").alias("message"), F.col("analyst_id").alias("by"),
    )
    return made.unionByName(acts).orderBy(F.desc("timestamp"), "type")


def omnibar_search(
    events: DataFrame, finding_rows: DataFrame, campaigns: DataFrame, rules: DataFrame, tenant: str, text: str, limit: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(first ``limit`` results by type, one-row total). Each kind is cut to ``limit`` first."""
    none = F.lit(None).cast("timestamp")
    ev = search_events(events, tenant, text, limit).select(
        F.lit(0).alias("_rank"), F.lit("event").alias("type"), F.col("event_id").cast("string").alias("id"),
        F.substring("message", 1, 120).alias("title"), "severity", "timestamp",
    )
    fi = finding_rows.where(holds("title", text)).orderBy(F.desc("created_at"), "id").limit(limit).select(
        F.lit(1).alias("_rank"), F.lit("finding").alias("type"), "id", "title", "severity", F.col("created_at").alias("timestamp")
    )
    ca = campaigns.where(
        (F.col("tenant_id") == tenant)
        & (holds("name", text) | F.contains(F.lower(F.array_join("techniques", ",")), F.lit(text.lower())))
    ).select(
        F.lit(2).alias("_rank"), F.lit("campaign").alias("type"), F.col("campaign_id").alias("id"), F.col("name").alias("title"),
        F.coalesce("severity", F.lit("medium")).alias("severity"), F.col("created_at").alias("timestamp"),
    )
    ru = rules.where(holds("title", text)).orderBy("id").limit(limit).select(
        F.lit(3).alias("_rank"), F.lit("sigma_rule").alias("type"), "id", "title", F.col("level").alias("severity"),
        none.alias("timestamp"),
    )
    rows = ev.unionByName(fi).unionByName(ca).unionByName(ru)
    top = rows.orderBy("_rank", F.desc("timestamp"), "id").limit(limit).drop("_rank")
    return top, rows.agg(F.count("*").alias("total"))


# ---- dashboards ------------------------------------------------------------------------------


def stack_metrics(*parts: DataFrame) -> DataFrame:
    """Fold one-row frames into a single row by stacking (metric, value) and aggregating once."""
    names: list[str] = []
    long = None
    for part in parts:
        names += part.columns
        pairs = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in part.columns]
        )
        rows = part.select(F.explode(pairs).alias("p")).select("p.*")
        long = rows if long is None else long.unionByName(rows)
    return long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def hunt_history(hunts: DataFrame, tenant: str, user: str, limit: int = 20) -> DataFrame:
    """An analyst's last hunts. ``hunts``: id, tenant_id, user_id, query_text, query_mode, uql_output, result_count, executed_at."""
    rows = latest(hunts, "executed_at", "id", limit, tenant_id=tenant, user_id=user)
    return rows.select("id", "query_text", "query_mode", "uql_output", "result_count", "executed_at")


def latest_cases(cases: DataFrame, tenant: str, limit: int = 50) -> DataFrame:
    """A tenant's newest cases: tenant_id, case_id, created_at, severity, status, title."""
    return latest(cases, "created_at", "case_id", limit, tenant_id=tenant).select("tenant_id", "case_id", "created_at", "severity", "status", "title")


def latest_alerts(alerts: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    """A tenant's newest alerts: tenant_id, alert_id, created_at, event_id, ml_score, severity."""
    return latest(alerts, "created_at", "alert_id", limit, tenant_id=tenant).select("tenant_id", "alert_id", "created_at", "event_id", "ml_score", "severity")


def reports_list(reports: DataFrame, tenant: str, limit: int = 50) -> DataFrame:
    """A tenant's newest reports: id, report_name, report_type, generated_by, file_size_bytes, created_at."""
    return latest(reports, "created_at", "id", limit, tenant_id=tenant).select("id", "report_name", "report_type", "generated_by", "file_size_bytes", "created_at")


def latest_verdict_share(verdicts: DataFrame, n: int = 100) -> DataFrame:
    latest = verdicts.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return latest.agg(
        F.count("*").alias("verdicts"), F.count_if(F.col("verdict") == "true_positive").alias("true_positives")
    )


def analyst_accuracy(verdicts: DataFrame, n: int = 100) -> DataFrame:
    """Share of true positives among the latest ``n`` verdicts in percent; null without verdicts."""
    share = latest_verdict_share(verdicts, n)
    pct = F.round(F.col("true_positives") / F.when(F.col("verdicts") > 0, F.col("verdicts")) * 100, 1)
    return share.select(pct.alias("analyst_accuracy"))


def liveness(heartbeats: DataFrame, now: Column, timeout: int = 120) -> DataFrame:
    last = heartbeats.groupBy("connector_id").agg(F.max("timestamp").alias("last_beat"))
    age = F.unix_micros(now) - F.unix_micros("last_beat")
    return last.withColumn("alive", age < timeout * 1_000_000)


def alive_share(heartbeats: DataFrame, now: Column, timeout: int = 120) -> DataFrame:
    return liveness(heartbeats, now, timeout).agg(
        F.count("*").alias("connectors_total"), F.count_if("alive").alias("connectors_online")
    )


def dashboard_kpis(
    events: DataFrame, campaigns: DataFrame, heartbeats: DataFrame, verdicts: DataFrame, posture: DataFrame, now: Column,
    timeout: int = 120,
) -> DataFrame:
    """Single-row dashboard; ``posture`` is (posture_score, posture_prev)."""
    ev = events.agg(
        F.count("*").alias("total_events"),
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in ("info", "low", "medium", "high", "critical")],
    )
    camp = campaigns.agg(
        F.count("*").alias("active_campaigns"), F.count_if(F.col("severity") == "critical").alias("critical_campaigns")
    )
    row = stack_metrics(ev, camp, alive_share(heartbeats, now, timeout), analyst_accuracy(verdicts), posture)
    return row.select(
        F.round("posture_score", 1).alias("posture_score"),
        F.round(F.round("posture_score", 1) - F.round("posture_prev", 1), 1).alias("posture_delta"),
        F.round(F.col("total_events") / 60, 1).alias("events_per_second"),
        "analyst_accuracy",
        *[
            F.col(c).cast("long").alias(c)
            for c in row.columns
            if c not in ("posture_score", "posture_prev", "analyst_accuracy")
        ],
    )


# Weight of each posture domain.
DOMAIN_WEIGHTS = {
    "detection_coverage": 0.25,
    "tool_health": 0.20,
    "incident_response": 0.20,
    "config_risk": 0.20,
    "threat_exposure": 0.15,
}


def domain_scores(
    rules: DataFrame, events: DataFrame, heartbeats: DataFrame, verdicts: DataFrame, finding_rows: DataFrame,
    campaigns: DataFrame, now: Column, timeout: int = 120,
) -> DataFrame:
    severe = finding_rows.agg(F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))
    row = stack_metrics(
        rules.agg(F.count("*").alias("rules")),
        events.agg(F.count("*").alias("detections")),
        alive_share(heartbeats, now, timeout),
        latest_verdict_share(verdicts),
        severe,
        campaigns.agg(F.count("*").alias("campaigns")),
    )
    one = F.lit(1.0)
    rule_n = F.greatest("rules", one)
    return row.select(
        F.least(F.lit(100), F.floor(70 + F.col("detections") / rule_n * 10)).cast("double").alias("detection_coverage"),
        F.floor(F.col("connectors_online") / F.greatest("connectors_total", one) * 100).cast("double").alias("tool_health"),
        F.when(F.col("verdicts") > 0, F.floor(F.col("true_positives") / F.greatest("verdicts", one) * 100))
        .otherwise(71).cast("double").alias("incident_response"),
        F.greatest(F.lit(0.0), 100 - F.col("severe") * 8).alias("config_risk"),
        F.greatest(F.lit(0.0), 100 - F.col("campaigns") * 5).alias("threat_exposure"),
    )


def composite_score(domains: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(d) * w for d, w in DOMAIN_WEIGHTS.items()])
    return domains.select(F.round(total, 1).alias("composite"), *DOMAIN_WEIGHTS)


def remediation_queue(finding_rows: DataFrame, n: int = 50) -> DataFrame:
    """Severe findings among the first ``n`` by arrival, priority falling with the arrival index."""
    first = finding_rows.orderBy(F.desc("created_at"), "id").limit(n)
    items = first.agg(
        F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("o"), "id", "title", "severity"))).alias("a")
    ).select(F.posexplode("a").alias("i", "f"))
    start = F.when(F.col("f.severity") == "critical", 10.0).otherwise(8.0)
    out = items.where(F.col("f.severity").isin("critical", "high")).select(
        F.concat(F.lit("R-"), F.substring("f.id", 1, 8)).alias("id"), F.col("f.id").alias("finding_id"), "f.title", "f.severity",
        F.round(F.greatest(F.lit(1.0), start - F.col("i") * 0.2), 1).alias("priority"),
    )
    return out.orderBy(F.desc("priority"), "finding_id")


def posture_snapshot(campaigns: DataFrame, events: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Snapshot score of every tenant known from campaigns, events or earlier snapshots, with an alert
    when it falls from above 70 to 70 or below. A tenant without campaign and finding scores 100."""
    camp = campaigns.where("active").groupBy("tenant_id").agg(
        F.count("*").alias("active"), F.avg("severity_num").alias("avg_sev"), F.lit(0).cast("long").alias("vulns"),
    )
    recent = events.where(
        (F.col("action") == "vulnerability_found") & (F.col("timestamp") >= now - F.make_interval(days=F.lit(7)))
    )
    vuln = recent.groupBy("tenant_id").agg(
        F.lit(0).cast("long").alias("active"), F.lit(0.0).alias("avg_sev"), F.count("*").alias("vulns")
    )
    known = events.select("tenant_id").unionByName(previous.select("tenant_id")).distinct().select(
        "tenant_id", F.lit(0).cast("long").alias("active"), F.lit(0.0).alias("avg_sev"), F.lit(0).cast("long").alias("vulns")
    )
    both = camp.unionByName(vuln).unionByName(known).groupBy("tenant_id").agg(
        F.sum("active").alias("active"), F.sum("avg_sev").alias("avg_sev"), F.sum("vulns").alias("vulns")
    )
    raw = 100 - 2.0 * F.col("active") - 5.0 * F.col("avg_sev") - 0.5 * F.col("vulns")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return (
        both.join(previous.withColumnRenamed("tenant_id", "_tenant"), F.col("tenant_id").eqNullSafe(F.col("_tenant")), "left")
        .select("tenant_id", score.alias("score"), "previous_score")
        .withColumn("dropped", F.coalesce((F.col("previous_score") > 70) & (F.col("score") <= 70), F.lit(False)))
    )


def executive_summary(events: DataFrame) -> DataFrame:
    counts = events.groupBy("tenant_id").agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")],
    )
    raw = 100 - F.col("critical") * 5 - F.col("high") * 2 - F.col("medium") * 0.5
    return counts.withColumn("posture_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def top_categories(events: DataFrame, tenant: str, n: int = 10) -> DataFrame:
    cat = F.coalesce("event_category", F.lit("unknown")).alias("category")
    rows = events.where(F.col("tenant_id") == tenant).groupBy(cat).agg(F.count("*").alias("events"))
    return rows.orderBy(F.desc("events"), "category").limit(n)


def top_severe(events: DataFrame, tenant: str, n: int = 15, width: int = 60) -> DataFrame:
    rows = events.where((F.col("tenant_id") == tenant) & F.col("severity").isin("high", "critical"))
    return rows.orderBy(F.desc("meta_score"), F.desc("event_id")).limit(n).select(
        "event_id", F.substring("message", 1, width).alias("message"), F.upper("severity").alias("severity"), "meta_score"
    )


def soc2_auth_counts(events: DataFrame) -> DataFrame:
    login = F.col("action").isin("login", "authenticate")
    return events.groupBy("tenant_id").agg(
        F.count_if(login).alias("auth_events"),
        F.count_if(login & (F.col("outcome") == "success")).alias("successful_logins"),
        F.count_if(login & (F.col("outcome") == "failure")).alias("failed_logins"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("severity") == "high").alias("high_alerts"),
    )


def compliance_digest(events: DataFrame, top: int | None = None) -> DataFrame:
    """Events with at least one tag; ``top`` gives the short form sorted by score."""
    rows = events.where(F.size("compliance_tags") > 0).withColumn("tags", F.array_join("compliance_tags", ", "))
    return rows if top is None else rows.orderBy(F.desc("meta_score"), F.desc("event_id")).limit(top)


def audit_trail(
    audit: DataFrame, tenant: str, category: str | None = None, since: Column | None = None, limit: int = 100
) -> DataFrame:
    rows = audit.where(F.col("tenant_id") == tenant)
    if category:
        rows = rows.where(F.col("category") == category)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= since)
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def compliance_status(audit: DataFrame, now: Column, days: int = 90, hours: int = 24) -> DataFrame:
    t = F.col("timestamp")
    recent = t >= now - F.make_interval(hours=F.lit(hours))
    rows = audit.where(t >= now - F.make_interval(days=F.lit(days)))
    return rows.groupBy("tenant_id").agg(
        F.count("*").alias("total_audit_events"),
        F.count_if((F.col("category") == "auth") & (F.col("outcome") == "failure") & recent).alias("failed_auth"),
        F.count_if((F.col("category") == "soar_execution") & recent).alias("soar_executions"),
    )


def verdicts_for_entity(verdicts: DataFrame, entity: str, limit: int = 10) -> DataFrame:
    """Exact entity matches; only if there are none, verdicts whose notes mention the entity.

    The fallback is gated by a one-row aggregate, joined on a constant key that has one row.
    """
    exact = F.coalesce(F.col("entity_value") == entity, F.lit(False))
    rows = verdicts.where(exact | holds("notes", entity)).withColumn("_p", F.when(exact, 0).otherwise(1))
    top = rows.orderBy("_p", F.desc("created_at"), F.desc("id")).limit(limit)
    best = top.agg(F.min("_p").alias("_p"))
    return top.join(best, "_p", "left_semi").drop("_p")


def note_rank(text: Column, query: str) -> Column:
    """Number of query-term occurrences when every term is present, else null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    terms = sorted(set(query.lower().split()))
    all_in = reduce(lambda a, b: a & b, [F.array_contains(words, t) for t in terms])
    hits = F.size(F.filter(words, lambda w: w.isin(terms)))
    return F.when(all_in, hits)


def notes_search(notes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    ranked = notes.withColumn("rank", note_rank(F.col("text"), query)).where("rank IS NOT NULL")
    return ranked.orderBy(F.desc("rank"), "id").limit(limit)


def active_campaigns(campaigns: DataFrame, members: DataFrame, tenant: str, limit: int = 50) -> DataFrame:
    """Active campaigns newest first; affected assets = distinct member entities."""
    sizes = members.groupBy("tenant_id", "campaign_id").agg(F.count_distinct("entity").alias("affected_assets"))
    rows = campaigns.where((F.col("tenant_id") == tenant) & F.col("active")).join(sizes, ["tenant_id", "campaign_id"], "left")
    return rows.orderBy(F.desc("updated_at"), "campaign_id").limit(limit)


def latest(df: DataFrame, time: str, tie: str, limit: int, **equals) -> DataFrame:
    """Newest rows matching equality filters: hunt history, cases, alerts, report lists."""
    for c, v in equals.items():
        df = df.where(F.col(c) == v)
    return df.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def incident_timeline(annotations: DataFrame, tenant: str, incident: str) -> DataFrame:
    rows = annotations.where((F.col("tenant_id") == tenant) & (F.col("incident_id") == incident))
    return rows.orderBy("created_at", "id")


def mark_unresolved_critical(finding_rows: DataFrame) -> DataFrame:
    return finding_rows.where((F.col("severity") == "critical") & ~F.col("status").isin("dismissed", "approved"))


def link_campaign_techniques(coverage: DataFrame, campaigns: DataFrame) -> DataFrame:
    used = campaigns.select(F.explode("techniques").alias("technique_id")).distinct().withColumn("campaign_linked", F.lit(True))
    return coverage.join(used, "technique_id", "left").withColumn(
        "campaign_linked", F.coalesce("campaign_linked", F.lit(False))
    )


# ---- sequence groups -------------------------------------------------------------------------


def sequence_groups(events: DataFrame, tenant: str, now: Column, hours: int = 24, limit: int = 20) -> DataFrame:
    rows = events.where(
        (F.col("tenant_id") == tenant) & (F.col("cep_sequence_id") != "")
        & (F.col("timestamp") >= now - F.make_interval(hours=F.lit(hours)))
    )
    top = (
        rows.groupBy("cep_sequence_id")
        .agg(
            F.min("tactic").alias("tactic"), F.min("technique_id").alias("technique"), F.count("*").alias("event_count"),
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
            F.max_by("severity", F.struct("timestamp", "event_id")).alias("peak_severity"),
        )
        .orderBy(F.desc("event_count"), "cep_sequence_id")
        .limit(limit)
    )
    return top.orderBy(F.desc(severity_rank(F.col("peak_severity"))), F.desc("event_count"), "cep_sequence_id")


def sequence_group_events(events: DataFrame, groups: DataFrame, tenant: str, now: Column, hours: int = 24) -> DataFrame:
    """Member event ids of the listed groups as rows; a group may be too large for one array."""
    rows = events.where(
        (F.col("tenant_id") == tenant) & (F.col("timestamp") >= now - F.make_interval(hours=F.lit(hours)))
    )
    return rows.select("cep_sequence_id", "event_id").join(groups.select("cep_sequence_id"), "cep_sequence_id", "left_semi")


def timeline_by_entity(events: DataFrame) -> DataFrame:
    """First time each tactic is seen per (entity, sequence), with point counts."""
    return events.groupBy("tenant_id", F.col("src_ip").alias("entity"), "cep_sequence_id", "tactic").agg(
        F.min("timestamp").alias("first_seen"), F.count("*").alias("points")
    )


def timeline_points(events: DataFrame) -> DataFrame:
    """The points of each entity's timeline as rows, numbered by time within (entity, sequence).

    Points are rows, so an entity may have any number; the numbering is cut into segments when one is hot.
    """
    keys = ["tenant_id", "entity", "cep_sequence_id"]
    rows = events.select("tenant_id", F.col("src_ip").alias("entity"), "cep_sequence_id", "tactic", "timestamp", "event_id", F.unix_micros("timestamp").alias("_us"))
    return segmented(rows, keys, ["_us", "event_id"]).running(sums={"point": F.lit(1)}).rows.drop("_us")


def timeline_entities(events: DataFrame) -> DataFrame:
    """Distinct entities per tenant and sequence, with their first and last point."""
    return events.where("src_ip IS NOT NULL").groupBy("tenant_id", "cep_sequence_id", F.col("src_ip").alias("entity")).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("points")
    )


def throughput(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event counts per window, source and severity, with latency percentiles."""
    win = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return events.groupBy(win.alias("w"), "source_type", "severity").agg(
        F.count("*").alias("events"),
        F.percentile_approx("duration_ms", F.array(F.lit(0.95), F.lit(0.99))).alias("latency"),
    )


#: Size parameter of the latency sketches; the rank of a quantile is off by about 1.65 / SKETCH_K at 99 % confidence.
SKETCH_K = 400


def latency_minutes(rows: DataFrame, dims: list[str], value: str = "duration_ms") -> DataFrame:
    """Per minute and dimensions (source, severity, status; step; method, endpoint): count, sum, maximum and a quantile sketch of ``value``.

    Sketches merge, so this table serves every wider or sliding window; it works on a stream with a watermark as well.
    """
    return rows.groupBy(F.window("timestamp", "1 minute").alias("_w"), *dims).agg(
        F.count("*").alias("events"), F.sum(value).alias("total"), F.max(value).alias("longest"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch")
    ).withColumn("minute", F.col("_w.start")).drop("_w")


def latency_rollup(minutes: DataFrame, dims: list[str], width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts, mean, maximum and the 95 and 99 % quantiles per window and dimensions, from the sketches of its minutes."""
    win = F.window("minute", width, slide) if slide else F.window("minute", width)
    out = minutes.groupBy(win.alias("w"), *dims).agg(
        F.sum("events").alias("events"), (F.sum("total") / F.sum("events")).alias("mean"), F.max("longest").alias("longest"),
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("_sketch"),
    )
    return out.withColumns({f"p{p}": F.kll_sketch_get_quantile_double("_sketch", F.lit(p / 100)) for p in (95, 99)}).drop("_sketch")
