"""Rules, indicators, responses and narratives over the security-event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import intel, narrative as narr, rules
from duskwatch.plans.base import NOW, SEC, Suite, sec_events, table

SUITE = Suite()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql() -> str:
    out = []
    for pos, (rid, name, tid, tname, tactic, cond, conf) in enumerate(rules.RULES):
        tests = []
        for field, pattern in cond.items():
            tests.append(
                {
                    "message": f"regexp_matches(lower(message), {q(str(pattern))})",
                    "action": f"action = '{pattern}'",
                    "dst_port": f"dst_port = {pattern}",
                    "outcome_failure": "outcome = 'failure'",
                    "severity_high": "severity IN ('high','critical')",
                    "high_bytes_out": "bytes_out >= 1000000",
                }[field]
            )
        out.append(
            f"SELECT event_id, {pos} AS ord, {q(rid)} AS rule_id, {q(name)} AS rule_name, {q(tid)} AS tid, "
            f"{q(tname)} AS tname, {q(tactic)} AS tac, CAST({conf} AS DOUBLE) AS conf "
            f"FROM sec WHERE {' AND '.join(tests)}"
        )
    return " UNION ALL ".join(out)


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({q(i)},{q(t)},{q(n)},CAST({c} AS DOUBLE),{p})" for p, (i, t, n, c) in enumerate(rows))


RM = f"{SEC}, rm AS ({_rule_sql()})"
_IOC_COLS = "(indicator, threat_type, threat_name, conf, pos)"
IOC = (
    f"ips AS (SELECT * FROM (VALUES {_values(intel.IOC_IPS)}) AS t{_IOC_COLS}), "
    f"doms AS (SELECT * FROM (VALUES {_values(intel.IOC_DOMAINS)}) AS t{_IOC_COLS}), "
    f"hashes AS (SELECT * FROM (VALUES {_values(intel.IOC_HASHES)}) AS t{_IOC_COLS}), "
    "im AS (SELECT event_id, 0 AS grp, i.* FROM sec JOIN ips i ON indicator = src_ip "
    "UNION ALL SELECT event_id, 1, i.* FROM sec JOIN ips i ON indicator = dst_ip "
    "UNION ALL SELECT event_id, 2, i.* FROM sec JOIN doms i ON contains(lower(message), indicator))"
)


def matched(spark, sf_dir):
    """Events with rule and indicator matches attached, in one pass."""
    ev = rules.match_rules(sec_events(spark, sf_dir), mask="rule_mask")
    return ev.withColumn("ioc_matches", intel.ioc_match_array())


@SUITE.query("match_rules", RM + " SELECT event_id, rule_id, rule_name, conf AS confidence FROM rm")
def _(spark, sf_dir):
    ev = rules.match_rules(sec_events(spark, sf_dir))
    return ev.select("event_id", F.explode("rule_matches").alias("m")).select(
        "event_id", "m.rule_id", "m.rule_name", "m.confidence"
    )


@SUITE.query(
    "to_mitre",
    RM + " SELECT tid AS technique_id, tname AS technique_name, tac AS tactic, count(*) AS hits, "
    "max(conf) AS confidence FROM rm GROUP BY ALL",
)
def _(spark, sf_dir):
    ev = rules.match_rules(sec_events(spark, sf_dir))
    return (
        ev.select(F.explode(rules.to_mitre()).alias("m"))
        .groupBy("m.technique_id", "m.technique_name", "m.tactic")
        .agg(F.count("*").alias("hits"), F.max("m.confidence").alias("confidence"))
    )


def _tags(names: list[str]) -> str:
    return "[" + ",".join(q(n) for n in names) + "]"


_TAG_SQL = " UNION ALL ".join(
    [
        f"SELECT event_id, unnest({_tags(tags)}) AS tag FROM rm WHERE regexp_matches(lower(rule_name), '{rx}')"
        for rx, tags in rules.COMPLIANCE_BY_NAME
    ]
    + [
        f"SELECT event_id, unnest({_tags(rules.COMPLIANCE_TEMPORAL)}) FROM sec WHERE temporal_score > 0.8",
        f"SELECT event_id, unnest({_tags(rules.COMPLIANCE_EXFIL)}) FROM sec WHERE bytes_out > 50000000",
    ]
)


@SUITE.query(
    "compliance_tags",
    RM + f", tg AS (SELECT DISTINCT event_id, tag FROM ({_TAG_SQL})) "
    "SELECT event_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tg GROUP BY event_id",
)
def _(spark, sf_dir):
    ev = rules.match_rules(sec_events(spark, sf_dir), mask="rule_mask").withColumn("t", rules.compliance_tags(mask="rule_mask"))
    return ev.where(F.size("t") > 0).select("event_id", F.array_join("t", ",").alias("tags"))


_RECOMMEND = (
    RM + ", " + IOC + ", r AS (SELECT event_id, count(*) FILTER (WHERE conf >= 0.85) AS strong, "
    "array_to_string(list_slice(list(rule_name ORDER BY ord), 1, 3), ', ') AS names FROM rm GROUP BY event_id), "
    "i AS (SELECT event_id, max(conf) AS ic, array_to_string(list_slice(list(threat_name ORDER BY grp, pos), 1, 2), ', ') "
    "AS threats FROM im GROUP BY event_id), l AS (SELECT sec.*, names, threats, greatest("
    "CASE WHEN meta_score>=0.85 THEN 5 WHEN meta_score>=0.7 THEN 4 WHEN meta_score>=0.5 THEN 3 "
    "WHEN meta_score>=0.3 THEN 2 ELSE 1 END, CASE WHEN ic>=0.9 THEN 4 WHEN ic>=0.7 THEN 3 ELSE 1 END, "
    "CASE WHEN strong>=2 THEN 4 WHEN strong=1 THEN 3 ELSE 1 END, CASE WHEN campaign_id IS NOT NULL THEN 3 ELSE 1 END) "
    "AS lvl FROM sec LEFT JOIN r USING (event_id) LEFT JOIN i USING (event_id)), "
    "rec AS (SELECT *, CASE lvl WHEN 5 THEN 'ISOLATE' WHEN 4 THEN 'BLOCK' WHEN 3 THEN 'INVESTIGATE' WHEN 2 THEN "
    "'MONITOR' ELSE 'LOG' END AS act, CASE WHEN lvl>=4 THEN 'immediate' WHEN lvl=3 THEN 'high' WHEN lvl=2 THEN "
    "'medium' ELSE 'low' END AS urg, concat_ws(' | ', 'ML composite score: ' || printf('%.2f', meta_score*100) || '%', "
    "'Sigma rule matches: ' || names, 'IOC matches: ' || threats, 'Part of active campaign: ' || campaign_id) AS why FROM l)"
)


@SUITE.query(
    "recommend_response",
    _RECOMMEND + " SELECT event_id, act AS action, urg AS urgency, why AS reasoning, meta_score AS confidence, "
    "lvl >= 4 AS auto_applicable FROM rec",
)
def _(spark, sf_dir):
    r = rules.recommend_response(matched(spark, sf_dir), mask="rule_mask")
    rec = "recommendation"
    return r.select("event_id", *[f"{rec}.{c}" for c in ("action", "urgency", "reasoning", "confidence", "auto_applicable")])


@SUITE.query(
    "response_by_severity",
    _RECOMMEND + " SELECT tenant_id, severity, act AS action, count(*) AS events, max(meta_score) AS top_score "
    "FROM rec GROUP BY ALL",
)
def response_by_severity(spark, sf_dir):
    """Flagship: scan, rules, indicators, response level, then counts per tenant and severity."""
    r = rules.recommend_response(matched(spark, sf_dir), mask="rule_mask")
    return r.groupBy("tenant_id", "severity", F.col("recommendation.action").alias("action")).agg(
        F.count("*").alias("events"), F.max("meta_score").alias("top_score")
    )


@SUITE.query(
    "alert_candidates",
    SEC + " SELECT event_id, severity, CASE WHEN meta_score > 0.9 THEN 'red' ELSE 'orange' END AS colour FROM sec "
    "WHERE NOT is_synthetic AND (meta_score >= 0.85 OR severity IN ('high','critical'))",
)
def _(spark, sf_dir):
    return rules.alert_candidates(sec_events(spark, sf_dir)).select("event_id", "severity", "colour")


@SUITE.query("triage_candidates", SEC + " SELECT event_id, meta_score FROM sec WHERE NOT is_synthetic AND meta_score >= 0.7")
def _(spark, sf_dir):
    return rules.triage_candidates(sec_events(spark, sf_dir)).select("event_id", "meta_score")


# ---- indicators ------------------------------------------------------------------------------


@SUITE.query(
    "match_ioc_ip",
    SEC + ", " + IOC + " SELECT event_id, indicator, threat_name, conf AS confidence, "
    "CASE grp WHEN 0 THEN 'src' ELSE 'dst' END AS side FROM im WHERE grp < 2",
)
def _(spark, sf_dir):
    m = intel.match_ioc_ip(sec_events(spark, sf_dir), intel.embedded_iocs(spark))
    return m.select("event_id", "indicator", "threat_name", "confidence", "side")


@SUITE.query(
    "match_ioc_domain",
    SEC + ", " + IOC + " SELECT event_id, indicator, threat_type, conf AS confidence FROM im WHERE grp = 2",
)
def _(spark, sf_dir):
    m = intel.match_ioc_domain(sec_events(spark, sf_dir), intel.embedded_iocs(spark))
    return m.select("event_id", "indicator", "threat_type", "confidence")


_HASHED = (
    "(SELECT CONCAT(message, CASE WHEN k % 17 = 0 THEN ' md5 5D41402ABC4B2A76B9719D911017C592' ELSE '' END) AS message, "
    "CASE WHEN k % 34 = 0 THEN '5d41402abc4b2a76b9719d911017c592' ELSE signature_id END AS signature_id, event_id FROM sec)"
)


@SUITE.query(
    "match_ioc_hash",
    SEC + ", " + IOC + f", h AS {_HASHED} SELECT event_id, indicator, count(*) AS hits FROM ("
    "SELECT event_id, indicator FROM h JOIN hashes ON contains(lower(message), indicator) UNION ALL "
    "SELECT event_id, indicator FROM h JOIN hashes ON contains(lower(signature_id), indicator)) GROUP BY ALL",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    md5 = F.when(F.col("k") % 17 == 0, " md5 5D41402ABC4B2A76B9719D911017C592").otherwise("")
    ev = ev.withColumn("message", F.concat("message", md5)).withColumn(
        "signature_id",
        F.when(F.col("k") % 34 == 0, "5d41402abc4b2a76b9719d911017c592").otherwise(F.col("signature_id")),
    )
    m = intel.match_ioc_hash(ev, intel.embedded_iocs(spark))
    return m.groupBy("event_id", "indicator").agg(F.count("*").alias("hits"))


_FEED_SQL = (
    "feed AS (SELECT DISTINCT dst_ip AS indicator, CASE WHEN k % 4 = 0 THEN NULL ELSE 'c2' END AS tt, "
    "CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(0.85 AS DOUBLE) END AS fc FROM sec WHERE outcome = 'failure')"
)


@SUITE.query(
    "match_ioc_feeds",
    SEC + ", " + IOC + ", " + _FEED_SQL + " SELECT e.event_id, e.ip AS indicator, coalesce(tt,'unknown') AS threat_type, "
    "'Feed IOC' AS threat_name, coalesce(fc, 0.5) AS confidence FROM (SELECT event_id, src_ip AS ip FROM sec UNION ALL "
    "SELECT event_id, dst_ip FROM sec) e JOIN feed ON feed.indicator = e.ip WHERE NOT EXISTS (SELECT 1 FROM im WHERE "
    "im.event_id = e.event_id AND im.indicator = e.ip AND grp < 2)",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    feed = (
        ev.where("outcome = 'failure'")
        .select(
            F.col("dst_ip").alias("indicator"), F.lit("ip").alias("itype"),
            F.when(F.col("k") % 4 != 0, F.lit("c2")).alias("threat_type"),
            F.lit(None).cast("string").alias("threat_name"),
            F.when(F.col("k") % 8 != 0, F.lit(0.85)).alias("confidence"),
        )
        .distinct()
    )
    return intel.match_ioc_feeds(ev, intel.match_ioc_ip(ev, intel.embedded_iocs(spark)), feed).drop("tenant_id")


@SUITE.query(
    "lookup_indicator",
    SEC + ", " + IOC + " SELECT indicator, threat_name, count(event_id) AS events FROM doms LEFT JOIN sec ON "
    "contains(message, indicator) WHERE indicator = lower('EVIL-C2.example.com') GROUP BY ALL",
)
def _(spark, sf_dir):
    hit = intel.lookup_indicator(intel.embedded_iocs(spark), "domain", "EVIL-C2.example.com")
    m = intel.match_ioc_domain(sec_events(spark, sf_dir), hit)
    return m.groupBy("indicator", "threat_name").agg(F.count("*").alias("events"))


@SUITE.query(
    "expire_iocs",
    SEC + f" SELECT dst_ip AS indicator, source_type AS source, count(*) AS kept FROM (SELECT dst_ip, timestamp, CASE "
    "WHEN k % 2 = 0 THEN 'misp' ELSE 'urlhaus' END AS source_type FROM sec) WHERE epoch_us(" + NOW +
    ") - epoch_us(timestamp) < CASE source_type WHEN 'misp' THEN 604800 ELSE 86400 END * CAST(1000000 AS BIGINT) GROUP BY ALL",
)
def _(spark, sf_dir):
    iocs = sec_events(spark, sf_dir).select(
        F.col("dst_ip").alias("indicator"), F.when(F.col("k") % 2 == 0, "misp").otherwise("urlhaus").alias("source"),
        F.col("timestamp").alias("ingest_ts"),
    )
    kept = intel.expire_iocs(iocs, F.expr(NOW))
    return kept.groupBy("indicator", "source").agg(F.count("*").alias("kept"))


@SUITE.query(
    "reputation_score",
    SEC + " SELECT event_id, least(0.3::DOUBLE + 0.05::DOUBLE * (k % 20), 0.99::DOUBLE) AS vendor_score, CAST(k AS DOUBLE) / 100 AS abuse_score FROM sec",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    return ev.select("event_id", intel.reputation_score(F.col("k") % 20, F.col("k")).alias("r")).select("event_id", "r.*")


# ---- enrichment joins ------------------------------------------------------------------------

_LEASES = (
    "leases AS (SELECT tenant_id, src_ip AS ip, timestamp AS lts, CONCAT('Lease-', CAST(k AS VARCHAR), '.') AS host "
    "FROM sec WHERE action = 'authenticate')"
)


@SUITE.query(
    "resolve_dhcp",
    SEC + ", " + _LEASES + " SELECT event_id, CASE WHEN hostname IS NOT NULL THEN hostname ELSE (SELECT "
    "max_by(rtrim(lower(host), '.'), CAST(epoch_us(lts) AS VARCHAR) || rtrim(lower(host), '.')) FROM leases l "
    "WHERE l.tenant_id = s.tenant_id AND l.ip = s.src_ip AND l.lts <= s.timestamp) END AS hostname FROM sec s",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    leases = ev.where("action = 'authenticate'").select(
        "tenant_id", F.col("src_ip").alias("ip"), F.concat(F.lit("Lease-"), "k", F.lit(".")).alias("host"),
        F.col("timestamp").alias("ts"),
    )
    return intel.resolve_dhcp(ev, leases).select("event_id", "hostname")


@SUITE.query(
    "resolve_user_alias",
    SEC + ", al AS (SELECT DISTINCT tenant_id, user_id, 'person' || user_id || '@corp.example' AS canon FROM sec WHERE "
    "action = 'authenticate') SELECT event_id, coalesce(canon, 'u' || sec.user_id || '@corp') AS canonical_user FROM sec LEFT "
    "JOIN al ON al.tenant_id = sec.tenant_id AND al.user_id = sec.user_id",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir).withColumn("user", F.concat(F.lit(" CORP\\U"), "user_id"))
    aliases = ev.where("action = 'authenticate'").select(
        "tenant_id", F.concat(F.lit("u"), "user_id", F.lit("@CORP")).alias("alias"),
        F.concat(F.lit("Person"), "user_id", F.lit("@corp.example")).alias("canonical"),
    ).distinct()
    return intel.resolve_user_alias(ev, aliases, "user").select("event_id", "canonical_user")


@SUITE.query(
    "enrich_asset_criticality",
    SEC + ", reg AS (SELECT DISTINCT tenant_id, hostname, CAST(user_id % 40 AS DOUBLE) / 40 AS sc FROM sec WHERE hostname "
    "IS NOT NULL AND user_id % 40 < 20), cm AS (SELECT DISTINCT hostname, user_id % 40 % 5 AS code FROM sec WHERE "
    "hostname IS NOT NULL AND user_id % 40 % 3 = 0) SELECT event_id, coalesce(CASE WHEN code = 1 THEN 0.9 WHEN code = 2 "
    "THEN 0.7 WHEN code = 3 THEN 0.5 WHEN code IS NOT NULL THEN 0.3 END, sc, 0.5)::DOUBLE AS asset_criticality FROM sec "
    "LEFT JOIN cm ON cm.hostname = sec.hostname LEFT JOIN reg ON reg.hostname = sec.hostname AND reg.tenant_id = sec.tenant_id",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    n = F.col("user_id") % 40
    named = ev.where("hostname IS NOT NULL")
    registry = named.where(n < 20).select(
        "tenant_id", F.col("hostname").alias("asset_name"), (n.cast("double") / 40).alias("criticality_score")
    ).distinct()
    cmdb = named.where(n % 3 == 0).select(
        F.col("hostname").alias("name"), (n % 5).cast("string").alias("business_criticality")
    ).distinct()
    return intel.enrich_asset_criticality(ev, registry, cmdb, "hostname").select("event_id", "asset_criticality")


@SUITE.query(
    "enrich_cve",
    SEC + ", ids AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(message || ' ' || raw_log, "
    "'CVE-\\d{4}-\\d{4,7}')) AS cve_id FROM sec), cv AS (SELECT * FROM (VALUES ('CVE-2021-44228', 10.0::DOUBLE), "
    "('CVE-2014-0160', 7.5::DOUBLE)) t(cve_id, score)) SELECT event_id, string_agg(cve_id || '=' || score, ',' ORDER BY "
    "cve_id) AS cves FROM ids JOIN cv USING (cve_id) GROUP BY event_id",
)
def _(spark, sf_dir):
    cves = spark.createDataFrame([("CVE-2021-44228", 10.0), ("CVE-2014-0160", 7.5)], "cve_id string, score double")
    out = intel.enrich_cve(sec_events(spark, sf_dir), cves).where("cve_context IS NOT NULL")
    text = F.transform("cve_context", lambda c: F.concat(c["cve_id"], F.lit("="), c["score"].cast("string")))
    return out.select("event_id", F.array_join(text, ",").alias("cves"))


@SUITE.query(
    "enrich_exposure",
    SEC + ", x AS (SELECT DISTINCT dst_ip AS ip, k % 100 AS ports FROM sec WHERE outcome = 'success') SELECT event_id, e.ip AS "
    "exposed_ip, CASE WHEN e.ip IS NOT NULL THEN x.ip IS NOT NULL END AS is_exposed, ports FROM (SELECT event_id, CASE "
    "WHEN NOT (starts_with(a,'10.') OR starts_with(a,'192.168.') OR starts_with(a,'127.')) THEN a END AS ip FROM (SELECT "
    "event_id, CASE WHEN k % 3 = 0 THEN src_ip ELSE dst_ip END AS a FROM sec)) e LEFT JOIN x ON x.ip = e.ip",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir).withColumn("src_ip", F.when(F.col("k") % 3 == 0, F.col("src_ip")))
    exposures = ev.where("outcome = 'success'").select(F.col("dst_ip").alias("ip"), (F.col("k") % 100).alias("ports")).distinct()
    return intel.enrich_exposure(ev, exposures).select("event_id", "exposed_ip", "is_exposed", "ports")


# ---- detection-block rules -------------------------------------------------------------------

BLOCK_RULES = [
    {"id": "blk-1", "detection": {
        "selection": {"Image|endswith": ["powershell.exe", "pwsh.exe"], "CommandLine|contains|all": ["Register", "-n"]},
        "selection2": {"Image|endswith": "procdump.exe", "CommandLine|contains": "LSASS"},
        "condition": "selection or selection2"}, "tags": ["attack.execution", "attack.t1059.001"]},
    {"id": "blk-2", "detection": {
        "selection": {"DestinationPort": [80, 443]},
        "filter_local": {"DestinationIp|startswith": ["10.", "192.168."]},
        "condition": "selection and not filter_local"}, "tags": ["attack.exfiltration", "attack.t1048"]},
    {"id": "blk-3", "detection": {
        "selection": {"DestinationPort": 3389, "action": "allow"},
        "outside": {"not SourceIp|startswith": ["10.0.0.1", "192.168."]},
        "condition": "selection and outside"}, "tags": ["attack.lateral_movement", "attack.t1021.001"]},
    {"id": "blk-4", "detection": {
        "selection": [{"message|re": "(Nmap|mimikatz)"}, {"severity": "critical"}],
        "condition": "selection"}, "tags": ["attack.discovery", "attack.T1046", "attack.t1003"]},
    {"id": "blk-5", "enabled": False, "detection": {"selection": {"action": "allow"}}, "tags": []},
]
_BLOCK_SQL = (
    SEC + ", hits AS (SELECT event_id, timestamp, 'blk-1' AS rule_id FROM sec WHERE ((ends_with(process_name,"
    "'powershell.exe') OR ends_with(process_name,'pwsh.exe')) AND contains(lower(command_line),'register') AND "
    "contains(lower(command_line),'-n')) OR (ends_with(process_name,'procdump.exe') AND contains(lower(command_line),"
    "'lsass')) UNION ALL SELECT event_id, timestamp, 'blk-2' FROM sec WHERE dst_port IN (80,443) AND NOT "
    "starts_with(dst_ip,'10.') UNION ALL SELECT event_id, timestamp, 'blk-3' FROM sec WHERE dst_port = 3389 AND action = "
    "'allow' AND NOT starts_with(src_ip,'10.0.0.1') UNION ALL SELECT event_id, timestamp, 'blk-4' FROM sec WHERE "
    "regexp_matches(message, '(Nmap|mimikatz)') OR severity = 'critical')"
)


def block_matched(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    fields = {c: F.col(c) for c in ev.columns} | {
        "Image": F.col("process_name"), "CommandLine": F.col("command_line"), "DestinationPort": F.col("dst_port"),
        "DestinationIp": F.col("dst_ip"), "SourceIp": F.col("src_ip"),
    }
    return rules.match_detection_rules(ev, BLOCK_RULES, fields)


@SUITE.query("match_detection_rules", _BLOCK_SQL + " SELECT event_id, rule_id FROM hits")
def _(spark, sf_dir):
    return block_matched(spark, sf_dir).select("event_id", F.explode("matched_rule_ids").alias("rule_id"))


@SUITE.query(
    "rule_hit_stats",
    _BLOCK_SQL + " SELECT rule_id, count(*) AS match_count, epoch_us(max(timestamp)) AS last_matched_us FROM hits GROUP BY 1",
)
def _(spark, sf_dir):
    s = rules.rule_hit_stats(block_matched(spark, sf_dir))
    return s.select("rule_id", "match_count", F.unix_micros("last_matched").alias("last_matched_us"))


# rules derived from events: one per user, tags from the user's tactics and techniques
_COV_SQL = (
    SEC + ", pairs AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS rule_id, replace(tactic,'-','_') AS slug, CASE WHEN "
    "k % 3 = 0 THEN technique_id || '.00' || CAST(k % 7 AS VARCHAR) ELSE technique_id END AS tech FROM sec), tg AS "
    "(SELECT DISTINCT rule_id, slug FROM pairs), te AS (SELECT DISTINCT rule_id, tech FROM pairs)"
)


def _rule_table(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    tech = F.when(F.col("k") % 3 == 0, F.concat("technique_id", F.lit(".00"), (F.col("k") % 7).cast("string"))).otherwise(
        F.col("technique_id")
    )
    tag = F.explode(
        F.array(
            F.concat(F.lit("attack."), F.replace("tactic", F.lit("-"), F.lit("_"))),
            F.concat(F.lit("attack."), F.lower(tech)),
        )
    )
    pairs = ev.select(F.col("user_id").cast("string").alias("id"), tag.alias("tag")).distinct()
    return pairs.groupBy("id").agg(F.collect_set("tag").alias("tags"))


@SUITE.query(
    "rule_coverage",
    _COV_SQL + " SELECT slug AS tactic_slug, split_part(p.tech,'.',1) AS base_technique, count(DISTINCT CASE WHEN "
    "contains(p.tech,'.') THEN p.tech END) AS sub_techniques, count(DISTINCT te.rule_id) AS rules FROM (SELECT DISTINCT "
    "slug, tech FROM te JOIN tg USING (rule_id)) p JOIN te ON te.tech = p.tech GROUP BY ALL",
)
def _(spark, sf_dir):
    return rules.rule_coverage(_rule_table(spark, sf_dir))


@SUITE.query(
    "rule_coverage_summary",
    _COV_SQL + " SELECT c.*, 196 AS total_techniques, 14 AS total_tactics, round(covered_techniques / 196.0::DOUBLE * "
    "100, 1) AS coverage_pct FROM (SELECT (SELECT count(DISTINCT split_part(tech,'.',1)) FROM te) AS covered_techniques, "
    "(SELECT count(DISTINCT slug) FROM tg) AS covered_tactics, (SELECT count(DISTINCT rule_id) FROM te) AS total_rules) c",
)
def _(spark, sf_dir):
    return rules.rule_coverage_summary(_rule_table(spark, sf_dir))


# ---- narratives and routing ------------------------------------------------------------------


def _narrative_sql() -> str:
    sev = "CASE severity " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in narr.SEVERITY_TEXT.items()) + " END"
    cls = "CASE ensemble_label " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in narr.CLASS_TEXT.items()) + " END"
    return (
        RM + ", " + IOC + ", r AS (SELECT event_id, array_to_string(list_slice(list(rule_name ORDER BY ord),1,3), ', ') "
        "AS names, array_to_string(list_slice(list_sort(list_distinct(list(tid || ' (' || tac || ')'))),1,3), ', ') AS refs FROM rm "
        "GROUP BY event_id), i AS (SELECT event_id, array_to_string(list_slice(list(threat_name ORDER BY grp, pos),1,2), "
        "', ') AS threats FROM im GROUP BY event_id) SELECT event_id, CASE WHEN meta_score>=0.8 THEN '🔴' WHEN "
        "meta_score>=0.5 THEN '🟡' WHEN meta_score>=0.3 THEN '🟢' ELSE 'ℹ️' END || ' ' || " + sev + " || ': ' || "
        "replace(replace(replace(" + cls + ", '{src}', CASE WHEN hostname IS NULL THEN src_ip ELSE hostname || ' (' || "
        "src_ip || ')' END), '{dst}', dst_ip), '{port}', CAST(dst_port AS VARCHAR)) || ' [Confidence: ' || "
        "printf('%.0f', meta_score*100) || '%]' || coalesce(' | Sigma: ' || names || ' | MITRE: ' || refs, '') || "
        "coalesce(' | IOC Hit: ' || threats, '') || CASE WHEN bytes_out > 100000 THEN ' | ' || format('{:,}', bytes_out) || "
        "' bytes outbound (potential exfil)' ELSE '' END AS narrative FROM sec LEFT JOIN r USING (event_id) LEFT JOIN i "
        "USING (event_id)"
    )


@SUITE.query("narrative", _narrative_sql())
def _(spark, sf_dir):
    return matched(spark, sf_dir).select("event_id", narr.narrative().alias("narrative"))


@SUITE.query(
    "response_candidates",
    SEC + " SELECT event_id, r AS response, CASE WHEN r = 'block_ip' THEN src_ip ELSE hostname END AS target FROM (SELECT "
    "*, unnest(list_distinct([CASE signature_name WHEN 'Ransomware File Extension Observed' THEN 'isolate_host' WHEN "
    "'Known Malicious IP Connection' THEN 'block_ip' END, CASE WHEN severity = 'critical' AND contains(lower(message), "
    "'malware') THEN 'isolate_host' END])) AS r FROM sec) WHERE r IS NOT NULL AND (r = 'block_ip' OR hostname IS NOT NULL)",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir).withColumns(
        {
            "source_entity_type": F.when(F.col("hostname").isNotNull(), "host").otherwise("ip"),
            "source_entity": F.coalesce("hostname", "src_ip"),
            "destination_entity_type": F.lit("ip"),
            "destination_entity": F.col("dst_ip"),
        }
    )
    return narr.response_candidates(ev).select("event_id", "response", "target")


@SUITE.query(
    "triage_tier",
    SEC + " SELECT event_id, CASE WHEN meta_score > 0.7 OR replace(tactic,'-','_') IN ('execution','lateral_movement',"
    "'exfiltration','impact','command_and_control') THEN 'deep' ELSE 'standard' END AS tier FROM sec",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    stage = F.replace("tactic", F.lit("-"), F.lit("_"))
    return ev.select("event_id", narr.triage_tier(F.col("meta_score"), stage).alias("tier"))


@SUITE.query(
    "retrieval_tier",
    SEC + " SELECT event_id, CASE WHEN meta_score > 0.7 THEN 'high' ELSE 'low' END AS tier, action || ' ' || event_type "
    "|| ' ' || message AS query FROM sec",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    return ev.select(
        "event_id",
        narr.retrieval_tier(F.col("meta_score"), F.col("action")).alias("tier"),
        narr.retrieval_query(F.col("action"), F.col("event_type"), F.col("message")).alias("query"),
    )
