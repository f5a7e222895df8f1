"""Reports over the security-event view and its side tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import intel, reports as R, rules
from duskwatch.plans import side
from duskwatch.plans.base import NOW, SEC, Suite, sec_events, table
from duskwatch.plans.detection import RM, _TAG_SQL
from duskwatch.plans.side import (
    AUDIT_SQL, CAMPAIGNS_SQL, FINDING_ROWS_SQL, HEARTBEATS_SQL, RANK_SQL, RULES_SQL, VERDICTS_SQL,
)

SUITE = Suite()
T1 = "tenant-1"
MONTH = 24 * 365


def now():
    return F.expr(NOW)


def us(col: str, name: str | None = None):
    return F.unix_micros(col).alias(name or f"{col}_us")


@SUITE.query("recent_events", SEC + f" SELECT event_id, meta_score FROM sec WHERE tenant_id='{T1}' AND meta_score >= 0.4 "
             "ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def _(spark, sf_dir):
    return R.recent_events(sec_events(spark, sf_dir), T1, 0.4, 100).select("event_id", "meta_score")


_PAGE = f"FROM sec WHERE tenant_id='{T1}' AND meta_score >= 0.1 AND source_type='zeek'"


@SUITE.query("events_page", SEC + f" SELECT event_id, severity {_PAGE} ORDER BY timestamp DESC, event_id DESC LIMIT 20 OFFSET 40")
def _(spark, sf_dir):
    return R.events_page(sec_events(spark, sf_dir), T1, 20, 40, 0.1, source="zeek")[0].select("event_id", "severity")


@SUITE.query("events_page_total", SEC + f" SELECT count(*) AS total {_PAGE}")
def _(spark, sf_dir):
    return R.events_page(sec_events(spark, sf_dir), T1, 20, 40, 0.1, source="zeek")[1]


@SUITE.query("event_by_id", SEC + " SELECT event_id, message, severity FROM sec WHERE event_id = 42")
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    tenants = [R.event_by_id(ev, f"tenant-{i}", 42) for i in range(3)]
    out = tenants[0].unionByName(tenants[1]).unionByName(tenants[2])
    return out.select("event_id", "message", "severity")


@SUITE.query("events_by_ids", SEC + f" SELECT event_id, message FROM sec WHERE tenant_id='{T1}' AND event_id IN (1,2,3,5,8,13,21,34,55,89)")
def _(spark, sf_dir):
    return R.events_by_ids(sec_events(spark, sf_dir), T1, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]).select("event_id", "message")


@SUITE.query("event_count", SEC + " SELECT tenant_id, count(*) AS events FROM sec GROUP BY 1")
def _(spark, sf_dir):
    return R.event_count(sec_events(spark, sf_dir))


@SUITE.query("severity_distribution", SEC + " SELECT tenant_id, severity, count(*) AS events FROM sec GROUP BY 1, 2")
def severity_distribution(spark, sf_dir):
    return R.severity_distribution(sec_events(spark, sf_dir))


@SUITE.query(
    "search_events",
    SEC + f" SELECT event_id, message FROM sec WHERE tenant_id='{T1}' AND (contains(lower(message),'nmap') OR "
    "contains(lower(raw_log),'nmap') OR contains(src_ip,'nmap') OR contains(dst_ip,'nmap') OR contains(action,'nmap')) "
    "ORDER BY timestamp DESC, event_id DESC LIMIT 50",
)
def _(spark, sf_dir):
    return R.search_events(sec_events(spark, sf_dir), T1, "NMAP", 50).select("event_id", "message")


@SUITE.query(
    "posture_history",
    SEC + f" SELECT tenant_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, avg(meta_score) AS avg_score, count(*) FILTER "
    "(WHERE meta_score > 0.7) AS threats, count(*) AS events, round(least(greatest(100 - avg(meta_score)*100, 0), 100), 1) AS "
    f"score FROM sec WHERE timestamp >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return R.posture_history(sec_events(spark, sf_dir), now()).withColumn("day", F.col("day").cast("string"))


# ---- entity pages ----

IP = "10.0.0.7"
_ENT = f"tenant_id='{T1}' AND (src_ip='{IP}' OR dst_ip='{IP}')"
_HOST = f"tenant_id='{T1}' AND (contains(lower(message),'cobaltstrike') OR contains(lower(raw_log),'cobaltstrike'))"


@SUITE.query(
    "entity_profile",
    SEC + f" SELECT count(*) AS frequency, epoch_us(min(timestamp)) AS first_seen_us, epoch_us(max(timestamp)) AS last_seen_us, "
    f"round(avg(meta_score), 4) AS risk_score FROM sec WHERE {_ENT} AND timestamp >= {NOW} - INTERVAL {MONTH} HOUR",
)
def _(spark, sf_dir):
    p = R.entity_profile(sec_events(spark, sf_dir), T1, "ip", IP, now(), MONTH)
    return p.select("frequency", us("first_seen"), us("last_seen"), "risk_score")


@SUITE.query("entity_recent", SEC + f" SELECT event_id, action FROM sec WHERE {_HOST} ORDER BY timestamp DESC, event_id DESC LIMIT 20")
def _(spark, sf_dir):
    return R.entity_recent(sec_events(spark, sf_dir), T1, "host", "CobaltStrike").select("event_id", "action")


@SUITE.query(
    "entity_trend",
    SEC + f" SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, round(avg(meta_score)*100, 2) AS score FROM sec WHERE {_HOST} "
    f"AND timestamp >= {NOW} - INTERVAL 7 DAY GROUP BY 1",
)
def _(spark, sf_dir):
    t = R.entity_trend(sec_events(spark, sf_dir), T1, "host", "cobaltstrike", now())
    return t.withColumn("day", F.col("day").cast("string"))


@SUITE.query(
    "entity_rules",
    SEC + f" SELECT signature_id, min(signature_name) AS name, min(severity) AS severity, count(*) AS hits FROM sec WHERE {_ENT} "
    "AND signature_id IS NOT NULL GROUP BY 1 ORDER BY hits DESC, signature_id LIMIT 10",
)
def _(spark, sf_dir):
    return R.entity_rules(sec_events(spark, sf_dir), T1, "ip", IP)


# ---- findings ----

_FIND = (
    SEC + ", " + CAMPAIGNS_SQL + f", fi AS (SELECT 'FE-' || event_id AS id, CASE WHEN campaign_id IS NULL THEN 'detection' ELSE "
    f"'campaign' END AS source, message AS title, severity, meta_score, timestamp AS created_at FROM sec WHERE tenant_id='{T1}' AND "
    f"meta_score >= 0.5 AND {RANK_SQL} >= 3 UNION ALL SELECT 'FC-' || campaign_id, 'campaign', 'Active campaign: ' || campaign_id, "
    f"severity, meta_score, created_at FROM camp WHERE tenant_id='{T1}')"
)


@SUITE.query(
    "findings",
    _FIND + f" SELECT id, source, title, severity, meta_score FROM fi ORDER BY {RANK_SQL} DESC, meta_score DESC, id LIMIT 100",
)
def _(spark, sf_dir):
    f = R.findings(sec_events(spark, sf_dir), side.campaigns(spark, sf_dir), T1, "high", 100)
    return f.select("id", "source", "title", "severity", "meta_score")


@SUITE.query("findings_total", _FIND + " SELECT severity, count(*) AS total FROM fi GROUP BY 1")
def _(spark, sf_dir):
    f = R.all_findings(sec_events(spark, sf_dir), side.campaigns(spark, sf_dir), T1, "high")
    return f.groupBy("severity").agg(F.count("*").alias("total"))


@SUITE.query(
    "finding_history",
    SEC + ", " + CAMPAIGNS_SQL + ", " + VERDICTS_SQL + ", v2 AS (SELECT * REPLACE ('FC-' || ('camp-' || (id % 7)) AS event_id) FROM "
    f"verd) SELECT 'creation' AS type, epoch_us(created_at) AS timestamp_us, 'Finding generated from campaign: camp-3' AS message, "
    f"'campaign_engine' AS by FROM camp WHERE tenant_id='{T1}' AND campaign_id='camp-3' UNION ALL SELECT 'analyst_action', "
    f"epoch_us(created_at), 'Analyst decision: ' || verdict, analyst_id FROM v2 WHERE tenant_id='{T1}' AND event_id='FC-camp-3'",
)
def _(spark, sf_dir):
    v = side.verdicts(spark, sf_dir).withColumn("event_id", F.concat(F.lit("FC-camp-"), (F.col("id") % 7).cast("string")))
    h = R.finding_history(sec_events(spark, sf_dir), side.campaigns(spark, sf_dir), v, "FC-camp-3", T1)
    return h.select("type", us("timestamp"), "message", "by")


_OMNI = (
    _FIND + ", " + RULES_SQL + f", o AS (SELECT * FROM (SELECT 0 AS rk, 'event' AS type, event_id::VARCHAR AS id, message AS title, "
    f"timestamp AS ts FROM sec WHERE tenant_id='{T1}' AND (contains(lower(message),'host-3') OR contains(lower(raw_log),'host-3') OR "
    "contains(lower(message),'camp')) LIMIT 0) UNION ALL SELECT * FROM (SELECT 1, 'finding', id, title, created_at FROM fi WHERE "
    "contains(lower(title),'camp-') ORDER BY created_at DESC, id LIMIT 20) UNION ALL SELECT 2, 'campaign', campaign_id, name, "
    f"created_at FROM camp WHERE tenant_id='{T1}' AND contains(lower(name),'camp-') UNION ALL SELECT * FROM (SELECT 3, 'sigma_rule', "
    "id, title, CAST(NULL AS TIMESTAMP) FROM rl WHERE contains(lower(title),'camp-') ORDER BY id LIMIT 20))"
)


def _omni(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    camp = side.campaigns(spark, sf_dir)
    found = R.all_findings(ev, camp, T1, "high")
    return R.omnibar_search(ev, found, camp, side.rules_table(spark, sf_dir), T1, "Camp-", 20)


@SUITE.query("omnibar_search", _OMNI + " SELECT type, id, title FROM o ORDER BY rk, ts DESC, id LIMIT 20")
def _(spark, sf_dir):
    return _omni(spark, sf_dir)[0].select("type", "id", "title")


@SUITE.query("omnibar_search_total", _OMNI + " SELECT count(*) AS total FROM o")
def _(spark, sf_dir):
    return _omni(spark, sf_dir)[1]


# ---- dashboards ----

_LIVE = (
    f"live AS (SELECT connector_id, max(timestamp) AS lb, epoch_us({NOW}) - epoch_us(max(timestamp)) < CAST(432000 AS BIGINT)*1000000 "
    "AS alive FROM hb GROUP BY 1)"
)
#: test heartbeats are days apart, so the liveness timeout is widened
TIMEOUT = 432000
_ACC = (
    "lv AS (SELECT * FROM verd ORDER BY created_at DESC, id DESC LIMIT 100), acc AS (SELECT count(*) AS verdicts, count(*) FILTER "
    "(WHERE verdict='true_positive') AS tp FROM lv)"
)


@SUITE.query("liveness", SEC + ", " + HEARTBEATS_SQL + ", " + _LIVE + " SELECT connector_id, epoch_us(lb) AS last_beat_us, alive FROM live")
def _(spark, sf_dir):
    return R.liveness(side.heartbeats(spark, sf_dir), now(), TIMEOUT).select("connector_id", us("last_beat"), "alive")


@SUITE.query("analyst_accuracy", SEC + ", " + VERDICTS_SQL + ", " + _ACC + " SELECT round(tp / verdicts * 100, 1) AS analyst_accuracy FROM acc")
def _(spark, sf_dir):
    return R.analyst_accuracy(side.verdicts(spark, sf_dir))


_POSTURE_PAIR = "(SELECT avg(meta_score) * 100 AS ps, min(meta_score) * 50 AS pp FROM sec)"


@SUITE.query(
    "dashboard_kpis",
    SEC + ", " + CAMPAIGNS_SQL + ", " + HEARTBEATS_SQL + ", " + VERDICTS_SQL + ", " + _LIVE + ", " + _ACC + ", e AS (SELECT count(*) AS "
    "total_events, " + ", ".join(f"count(*) FILTER (WHERE severity='{s}') AS severity_{s}" for s in ("info", "low", "medium", "high", "critical"))
    + " FROM sec), c AS (SELECT count(*) AS active_campaigns, count(*) FILTER (WHERE severity='critical') AS critical_campaigns FROM camp), "
    "l AS (SELECT count(*) AS connectors_total, count(*) FILTER (WHERE alive) AS connectors_online FROM live) SELECT round(ps,1) AS "
    "posture_score, round(round(ps,1)-round(pp,1),1) AS posture_delta, round(total_events/60,1) AS events_per_second, round(tp/verdicts*100,1) "
    f"AS analyst_accuracy, e.*, c.*, l.* FROM e, c, l, acc, {_POSTURE_PAIR} p",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    posture = ev.agg((F.avg("meta_score") * 100).alias("posture_score"), (F.min("meta_score") * 50).alias("posture_prev"))
    return R.dashboard_kpis(
        ev, side.campaigns(spark, sf_dir), side.heartbeats(spark, sf_dir), side.verdicts(spark, sf_dir), posture, now(), TIMEOUT
    )


_DOM = (
    SEC + ", " + CAMPAIGNS_SQL + ", " + HEARTBEATS_SQL + ", " + VERDICTS_SQL + ", " + RULES_SQL + ", " + FINDING_ROWS_SQL + ", " + _LIVE + ", "
    + _ACC + ", d AS (SELECT CAST(least(100, floor(70 + (SELECT count(*) FROM sec) / (SELECT count(*) FROM rl) * 10)) AS "
    "DOUBLE) AS detection_coverage, CAST(floor((SELECT count(*) FILTER (WHERE alive) FROM live) / (SELECT count(*) FROM live) * 100) AS DOUBLE) "
    "AS tool_health, CAST(floor((SELECT tp / verdicts * 100 FROM acc)) AS DOUBLE) AS incident_response, CAST(greatest(0, 100 - 8 * (SELECT "
    "count(*) FROM fr WHERE severity IN ('critical','high') AND tenant_id='tenant-2')) AS "
    "DOUBLE) AS config_risk, CAST(greatest(0, 100 - 5 * (SELECT count(*) FROM camp WHERE tenant_id='tenant-2')) AS DOUBLE) AS threat_exposure)"
)


def _domains(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    found = side.as_finding_rows(ev).where("tenant_id = 'tenant-2'")
    camp = side.campaigns(spark, sf_dir).where("tenant_id = 'tenant-2'")
    return R.domain_scores(
        side.rules_table(spark, sf_dir), ev, side.heartbeats(spark, sf_dir), side.verdicts(spark, sf_dir),
        found, camp, now(), TIMEOUT,
    )


@SUITE.query("domain_scores", _DOM + " SELECT * FROM d")
def _(spark, sf_dir):
    return _domains(spark, sf_dir)


@SUITE.query(
    "composite_score",
    _DOM + " SELECT *, round(detection_coverage*0.25::DOUBLE + tool_health*0.2::DOUBLE + incident_response*0.2::DOUBLE + "
    "config_risk*0.2::DOUBLE + threat_exposure*0.15::DOUBLE, 1) AS composite FROM d",
)
def _(spark, sf_dir):
    return R.composite_score(_domains(spark, sf_dir))


@SUITE.query(
    "remediation_queue",
    SEC + ", " + FINDING_ROWS_SQL + ", f AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS i FROM fr ORDER BY created_at "
    "DESC, id LIMIT 50) SELECT 'R-' || substr(id, 1, 8) AS id, id AS finding_id, title, severity, round(greatest(1.0, CASE severity WHEN "
    "'critical' THEN 10.0 ELSE 8.0 END - i * 0.2::DOUBLE), 1) AS priority FROM f WHERE severity IN ('critical','high')",
)
def _(spark, sf_dir):
    return R.remediation_queue(side.as_finding_rows(sec_events(spark, sf_dir)))


@SUITE.query(
    "posture_snapshot",
    SEC + ", " + CAMPAIGNS_SQL + f", c AS (SELECT tenant_id, count(*) AS a, avg(severity_num) AS s FROM camp WHERE active GROUP BY 1), v AS "
    f"(SELECT tenant_id, count(*) AS v FROM sec WHERE k % 50 = 7 AND timestamp >= {NOW} - INTERVAL 7 DAY GROUP BY 1), p AS (SELECT tenant_id, "
    "100 - avg(meta_score) * 10 AS previous_score FROM sec GROUP BY 1), x AS (SELECT p.tenant_id, greatest(0, least(100, 100 - 2*coalesce(a,0) "
    "- 5*coalesce(s,0) - 0.5::DOUBLE*coalesce(v,0))) AS score, previous_score FROM p LEFT JOIN c USING (tenant_id) LEFT JOIN v USING "
    "(tenant_id)) SELECT *, previous_score > 70 AND score <= 70 AS dropped FROM x",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    found = ev.withColumn("action", F.when(F.col("k") % 50 == 7, "vulnerability_found").otherwise(F.col("action")))
    prev = ev.groupBy("tenant_id").agg((100 - F.avg("meta_score") * 10).alias("previous_score"))
    return R.posture_snapshot(side.campaigns(spark, sf_dir), found, prev, now())


@SUITE.query(
    "executive_summary",
    SEC + ", c AS (SELECT tenant_id, count(*) AS events, count(*) FILTER (WHERE severity='critical') AS critical, count(*) FILTER (WHERE "
    "severity='high') AS high, count(*) FILTER (WHERE severity='medium') AS medium, count(*) FILTER (WHERE severity='low') AS low FROM sec "
    "GROUP BY 1) SELECT *, CAST(greatest(0, least(100, 100 - critical*5 - high*2 - medium*0.5::DOUBLE)) AS DOUBLE) AS "
    "posture_score FROM c",
)
def _(spark, sf_dir):
    return R.executive_summary(sec_events(spark, sf_dir))


@SUITE.query(
    "top_categories",
    SEC + f" SELECT tactic AS category, count(*) AS events FROM sec WHERE tenant_id='{T1}' GROUP BY 1 ORDER BY events DESC, category LIMIT 10",
)
def _(spark, sf_dir):
    return R.top_categories(sec_events(spark, sf_dir).withColumnRenamed("tactic", "event_category"), T1)


@SUITE.query(
    "top_severe",
    SEC + f" SELECT event_id, substr(message,1,20) AS message, upper(severity) AS severity, meta_score FROM sec WHERE tenant_id='{T1}' AND "
    "severity IN ('high','critical') ORDER BY meta_score DESC, event_id DESC LIMIT 15",
)
def _(spark, sf_dir):
    return R.top_severe(sec_events(spark, sf_dir), T1, 15, 20)


@SUITE.query(
    "soc2_auth_counts",
    SEC + " SELECT tenant_id, count(*) FILTER (WHERE action='authenticate') AS auth_events, count(*) FILTER (WHERE action='authenticate' AND "
    "outcome='success') AS successful_logins, count(*) FILTER (WHERE action='authenticate' AND outcome='failure') AS failed_logins, count(*) "
    "FILTER (WHERE severity='critical') AS critical_alerts, count(*) FILTER (WHERE severity='high') AS high_alerts FROM sec GROUP BY 1",
)
def _(spark, sf_dir):
    return R.soc2_auth_counts(sec_events(spark, sf_dir))


@SUITE.query(
    "compliance_digest",
    RM + f", tg AS (SELECT DISTINCT event_id, tag FROM ({_TAG_SQL})), dg AS (SELECT event_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM tg GROUP BY 1) "
    "SELECT event_id, tags FROM dg JOIN sec USING (event_id) ORDER BY meta_score DESC, event_id DESC LIMIT 50",
)
def _(spark, sf_dir):
    tagged = rules.match_rules(sec_events(spark, sf_dir), mask="rule_mask").withColumn("compliance_tags", rules.compliance_tags(mask="rule_mask"))
    return R.compliance_digest(tagged, 50).select("event_id", "tags")


@SUITE.query(
    "audit_trail",
    SEC + ", " + AUDIT_SQL + f" SELECT id, category, action FROM aud WHERE tenant_id='{T1}' AND category='auth' AND timestamp >= {NOW} - "
    "INTERVAL 20 DAY ORDER BY timestamp DESC, id DESC LIMIT 100",
)
def _(spark, sf_dir):
    since = now() - F.make_interval(days=F.lit(20))
    return R.audit_trail(side.audit(spark, sf_dir), T1, "auth", since).select("id", "category", "action")


@SUITE.query(
    "compliance_status",
    SEC + ", " + AUDIT_SQL + f" SELECT tenant_id, count(*) AS total_audit_events, count(*) FILTER (WHERE category='auth' AND outcome='failure' "
    f"AND timestamp >= {NOW} - INTERVAL 72 HOUR) AS failed_auth, count(*) FILTER (WHERE category='soar_execution' AND timestamp >= {NOW} - "
    f"INTERVAL 72 HOUR) AS soar_executions FROM aud WHERE timestamp >= {NOW} - INTERVAL 90 DAY GROUP BY 1",
)
def _(spark, sf_dir):
    return R.compliance_status(side.audit(spark, sf_dir), now(), hours=72)


def _verdicts_for(name: str, entity: str, where: str):
    @SUITE.query(
        name,
        SEC + ", " + VERDICTS_SQL + f" SELECT id, verdict FROM verd WHERE {where} ORDER BY created_at DESC, id DESC LIMIT 10",
    )
    def _(spark, sf_dir):
        return R.verdicts_for_entity(side.verdicts(spark, sf_dir), entity).select("id", "verdict")


_verdicts_for("verdicts_for_entity", "10.0.0.7", "entity_value = '10.0.0.7'")
_verdicts_for("verdicts_for_entity_fallback", "203.0.113.5", "contains(notes, '203.0.113.5')")


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@SUITE.query(
    "notes_search",
    f"WITH w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents) SELECT id, len(list_filter(ws, lambda x: x IN ('data','license'))) AS rank "
    "FROM w WHERE list_contains(ws,'data') AND list_contains(ws,'license') ORDER BY rank DESC, id LIMIT 10",
)
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.notes_search(notes, "license data").select("id", "rank")


@SUITE.query(
    "merge_notes",
    f"WITH w AS (SELECT doc_id AS id, source, {_WORDS} AS ws FROM documents), a AS (SELECT 0 AS s, id, len(list_filter(ws, lambda x: x = 'license')) "
    "AS rank FROM w WHERE list_contains(ws,'license')), b AS (SELECT 1, id, len(list_filter(ws, lambda x: x = 'email')) FROM w WHERE "
    "list_contains(ws,'email')), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)) SELECT id, rank FROM u "
    "ORDER BY s, rank, id LIMIT 40",
)
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    a = notes.select("id", R.note_rank(F.col("text"), "license").alias("rank")).where("rank IS NOT NULL")
    b = notes.select("id", R.note_rank(F.col("text"), "email").alias("rank")).where("rank IS NOT NULL")
    return intel.merge_notes(a, b, 40)


@SUITE.query(
    "active_campaigns",
    SEC + ", " + CAMPAIGNS_SQL + ", m AS (SELECT tenant_id, campaign_id, count(DISTINCT entity) AS affected_assets FROM (SELECT tenant_id, "
    "campaign_id, src_ip AS entity FROM sec WHERE campaign_id IS NOT NULL UNION ALL SELECT tenant_id, campaign_id, dst_ip FROM sec WHERE "
    f"campaign_id IS NOT NULL) GROUP BY 1, 2) SELECT campaign_id, severity, affected_assets FROM camp JOIN m USING (tenant_id, campaign_id) "
    f"WHERE tenant_id='{T1}' AND active ORDER BY updated_at DESC, campaign_id LIMIT 50",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir).where("campaign_id IS NOT NULL")
    members = ev.select("tenant_id", "campaign_id", F.explode(F.array("src_ip", "dst_ip")).alias("entity"))
    return R.active_campaigns(side.campaigns(spark, sf_dir), members, T1).select("campaign_id", "severity", "affected_assets")


def _listed(name, table_sql, source, columns, tenant, order, operator, build, where=""):
    """A tenant's newest rows of a table of its own; times in microseconds."""
    named = ", ".join(f"epoch_us({c}) AS {c}_us" if c.endswith("_at") else c for c in columns)

    @SUITE.query(name, SEC + ", " + table_sql + f" SELECT {named} FROM {source} WHERE tenant_id = '{tenant}'{where} ORDER BY {order} LIMIT 25")
    def _(spark, sf_dir):
        out = operator(build(spark, sf_dir))
        return out.select(*[us(c) if c.endswith("_at") else c for c in columns])


_listed(
    "hunt_history", side.HUNTS_SQL, "hq", ["id", "query_text", "query_mode", "uql_output", "result_count", "executed_at"], T1, "executed_at DESC, id DESC",
    lambda t: R.hunt_history(t, T1, "an-2", 25), side.hunts_table, " AND user_id = 'an-2'",
)
_listed(
    "latest_cases", side.CASES_SQL, "cs", ["tenant_id", "case_id", "created_at", "severity", "status", "title"], "tenant-2", "created_at DESC, case_id DESC",
    lambda t: R.latest_cases(t, "tenant-2", 25), side.cases_table,
)
_listed(
    "latest_alerts", side.ALERTS_SQL, "al", ["tenant_id", "alert_id", "created_at", "event_id", "ml_score", "severity"], "tenant-0", "created_at DESC, alert_id DESC",
    lambda t: R.latest_alerts(t, "tenant-0", 25), side.alerts_table,
)
_listed(
    "reports_list", side.REPORTS_SQL, "rp", ["id", "report_name", "report_type", "generated_by", "file_size_bytes", "created_at"], T1, "created_at DESC, id DESC",
    lambda t: R.reports_list(t, T1, 25), side.reports_table,
)


@SUITE.query(
    "incident_timeline",
    SEC + f" SELECT event_id AS id, epoch_us(timestamp) AS created_at_us, message AS content FROM sec WHERE tenant_id='{T1}' AND "
    "'inc-' || (user_id % 20) = 'inc-4'",
)
def _(spark, sf_dir):
    notes = sec_events(spark, sf_dir).select(
        "tenant_id", F.concat(F.lit("inc-"), (F.col("user_id") % 20).cast("string")).alias("incident_id"),
        F.col("event_id").alias("id"), F.col("timestamp").alias("created_at"), F.col("message").alias("content"),
    )
    return R.incident_timeline(notes, T1, "inc-4").select("id", us("created_at"), "content")


@SUITE.query(
    "mark_unresolved_critical",
    SEC + ", " + FINDING_ROWS_SQL + " SELECT id, status FROM fr WHERE severity='critical' AND status NOT IN ('dismissed','approved')",
)
def _(spark, sf_dir):
    return R.mark_unresolved_critical(side.as_finding_rows(sec_events(spark, sf_dir))).select("id", "status")


@SUITE.query(
    "link_campaign_techniques",
    SEC + ", " + CAMPAIGNS_SQL + ", cov AS (SELECT technique_id, count(*) AS events FROM sec GROUP BY 1) SELECT technique_id, events, technique_id "
    "IN (SELECT unnest(techniques) FROM camp WHERE campaign_id = 'camp-2' AND tenant_id = 'tenant-0') AS campaign_linked FROM cov",
)
def _(spark, sf_dir):
    cov = sec_events(spark, sf_dir).groupBy("technique_id").agg(F.count("*").alias("events"))
    camp = side.campaigns(spark, sf_dir).where("campaign_id = 'camp-2' AND tenant_id = 'tenant-0'")
    return R.link_campaign_techniques(cov, camp)


_GRP = (
    SEC + f", g AS (SELECT cep_sequence_id, min(tactic) AS tactic, min(technique_id) AS technique, count(*) AS event_count, max_by(severity, "
    f"epoch_us(timestamp)) AS peak_severity FROM sec WHERE tenant_id='{T1}' AND cep_sequence_id IS NOT NULL AND timestamp >= {NOW} - INTERVAL "
    f"{MONTH} HOUR GROUP BY 1 ORDER BY event_count DESC, cep_sequence_id LIMIT 10)"
)


@SUITE.query("sequence_groups", _GRP + " SELECT * FROM g")
def _(spark, sf_dir):
    return R.sequence_groups(sec_events(spark, sf_dir), T1, now(), MONTH, 10).drop("first_seen", "last_seen")


@SUITE.query(
    "sequence_group_events",
    _GRP + f" SELECT cep_sequence_id, event_id FROM sec WHERE tenant_id='{T1}' AND cep_sequence_id IN (SELECT cep_sequence_id FROM g)",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    return R.sequence_group_events(ev, R.sequence_groups(ev, T1, now(), MONTH, 10), T1, now(), MONTH)


@SUITE.query(
    "timeline_by_entity",
    SEC + " SELECT tenant_id, src_ip AS entity, cep_sequence_id, tactic, epoch_us(min(timestamp)) AS first_seen_us, count(*) AS points FROM "
    "sec GROUP BY 1, 2, 3, 4",
)
def _(spark, sf_dir):
    t = R.timeline_by_entity(sec_events(spark, sf_dir))
    return t.select("tenant_id", "entity", "cep_sequence_id", "tactic", us("first_seen"), "points")


@SUITE.query(
    "timeline_points",
    SEC + " SELECT tenant_id, src_ip AS entity, cep_sequence_id, tactic, event_id, row_number() OVER (PARTITION BY tenant_id, src_ip, cep_sequence_id ORDER BY timestamp, event_id) AS point FROM sec",
)
def _(spark, sf_dir):
    return R.timeline_points(sec_events(spark, sf_dir)).select("tenant_id", "entity", "cep_sequence_id", "tactic", "event_id", "point")


@SUITE.query(
    "timeline_entities",
    SEC + " SELECT tenant_id, cep_sequence_id, src_ip AS entity, epoch_us(min(timestamp)) AS first_seen_us, epoch_us(max(timestamp)) AS last_seen_us, count(*) AS points FROM sec GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    return R.timeline_entities(sec_events(spark, sf_dir)).select("tenant_id", "cep_sequence_id", "entity", us("first_seen"), us("last_seen"), "points")


@SUITE.query(
    "throughput",
    SEC + " SELECT epoch_us(date_trunc('day', timestamp)) AS start_us, source_type, severity, count(*) AS events FROM sec GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    t = R.throughput(sec_events(spark, sf_dir).withColumn("duration_ms", F.col("value")), "1 day")
    return t.select(us("w.start", "start_us"), "source_type", "severity", "events")


_REQUESTS = "rq AS (SELECT *, outcome AS status, action AS step, 'GET' AS method, '/' || event_type AS endpoint, value AS duration_ms FROM sec)"


def requests_view(spark, sf_dir):
    return sec_events(spark, sf_dir).withColumns(
        {"status": F.col("outcome"), "step": F.col("action"), "method": F.lit("GET"), "endpoint": F.concat(F.lit("/"), "event_type"), "duration_ms": F.col("value")}
    )


def _rolled(name, dims, width, slide=None, sliding_days=1):
    days = ", ".join(f"timestamp - INTERVAL {d} DAY" for d in range(sliding_days))
    cols = ", ".join(dims)

    @SUITE.query(
        name,
        SEC + f", {_REQUESTS} SELECT epoch_us(date_trunc('day', t)) AS start_us, {cols}, count(*) AS events, round(avg(duration_ms) + 1e-9, 4) AS mean, max(duration_ms) AS longest, "
        f"true AS p95_near, true AS p99_near FROM (SELECT *, unnest([{days}]) AS t FROM rq) GROUP BY 1, {cols}",
    )
    def _(spark, sf_dir):
        rows = requests_view(spark, sf_dir)
        out = R.latency_rollup(R.latency_minutes(rows, dims), dims, width, slide)
        # how many rows lie at or below the sketched quantile must be within the stated rank error
        win = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
        exact = rows.select(win.alias("w"), *dims, "duration_ms").join(out.select("w", *dims, "p95", "p99", "events"), ["w", *dims])
        share = lambda p: F.count_if(F.col("duration_ms") <= F.col(f"p{p}")) / F.max("events")
        off = lambda p: (share(p) - p / 100 >= -1.65 / R.SKETCH_K) & (F.count_if(F.col("duration_ms") < F.col(f"p{p}")) / F.max("events") - p / 100 <= 1.65 / R.SKETCH_K)
        near = exact.groupBy("w", *dims).agg(off(95).alias("p95_near"), off(99).alias("p99_near"))
        return out.join(near, ["w", *dims]).select(us("w.start", "start_us"), *dims, "events", F.round(F.col("mean") + 1e-9, 4).alias("mean"), "longest", "p95_near", "p99_near")


_rolled("throughput_status", ["source_type", "severity", "status"], "1 day")
_rolled("throughput_steps", ["step"], "1 day")
_rolled("throughput_endpoints", ["method", "endpoint"], "2 days", "1 day", 2)


@SUITE.query("throughput_latency")
def _(spark, sf_dir):
    t = R.throughput(sec_events(spark, sf_dir).withColumn("duration_ms", F.col("value")), "2 days", "1 day")
    return t.select(us("w.start", "start_us"), "source_type", "severity", F.col("latency")[0].alias("p95"), F.col("latency")[1].alias("p99"))
