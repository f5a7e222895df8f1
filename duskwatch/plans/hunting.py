"""Hunt templates and predicates over the security-event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import hunts
from duskwatch.plans.base import NOW, SEC, Suite, sec_events

SUITE = Suite()

#: the test events span a month, so lookbacks are widened to cover all of it
WIDE = 24 * 365
_LOOK = f"timestamp >= {NOW} - INTERVAL {WIDE} HOUR"
_PROC = "CASE WHEN k % 10 = 3 THEN 'process_access' WHEN k % 10 = 5 THEN 'process_creation' ELSE action END"
_IN = r"'^(10\.|192\.168\.|127\.|172\.(1[6-9]|2[0-9]|3[01])\.)'"
_H = SEC + f", h AS (SELECT * REPLACE ({_PROC} AS action) FROM sec WHERE {_LOOK})"


def hunt_events(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    return ev.withColumn("action", F.expr(_PROC))


def now():
    return F.expr(NOW)


_SQL = {
    "HUNT-001": "SELECT tenant_id, user_id, count(DISTINCT geo_country) AS unique_countries, min(timestamp) AS lo, max(timestamp) AS hi "
    "FROM h WHERE action IN ('login','authenticate') AND outcome = 'success' GROUP BY tenant_id, user_id HAVING count(DISTINCT "
    "geo_country) > 1 AND date_diff('hour', min(timestamp), max(timestamp)) <= 400",
    "HUNT-002": "SELECT tenant_id, src_ip, count(*) FILTER (WHERE outcome='failure') AS failures, count(*) FILTER (WHERE "
    "outcome='success') AS successes, count(DISTINCT user_id) FILTER (WHERE outcome='success') AS compromised_users FROM "
    "h WHERE action IN ('login','authenticate') GROUP BY tenant_id, src_ip HAVING failures > 5 AND successes > 0",
    "HUNT-003": "SELECT tenant_id, src_ip, count(DISTINCT dst_ip) AS unique_destinations, CAST(sum(bytes_out) AS BIGINT) AS "
    f"total_bytes FROM h WHERE dst_port = 445 AND regexp_matches(src_ip, {_IN}) AND regexp_matches(dst_ip, {_IN}) "
    "GROUP BY tenant_id, src_ip HAVING unique_destinations >= 5",
    "HUNT-004": "SELECT tenant_id, src_ip, dst_ip, CAST(sum(bytes_out) AS BIGINT) AS total_outbound_bytes FROM h WHERE dst_port IN "
    f"(80,443) AND regexp_matches(src_ip, {_IN}) AND NOT regexp_matches(dst_ip, {_IN}) GROUP BY tenant_id, src_ip, dst_ip HAVING "
    "total_outbound_bytes > 10485760",
    "HUNT-005": "SELECT tenant_id, src_ip, dst_ip, count(*) AS connection_count, avg(date_diff('second', timestamp, " + NOW +
    ")) AS avg_age_sec, CASE WHEN count(*) > 1 THEN (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 / "
    f"(count(*) - 1) END AS avg_interval_sec FROM h WHERE dst_port IN (80,443) AND regexp_matches(src_ip, {_IN}) AND NOT "
    f"regexp_matches(dst_ip, {_IN}) GROUP BY tenant_id, src_ip, dst_ip HAVING connection_count > 1",
    "HUNT-006": "SELECT tenant_id, hostname, process_name, count(*) AS access_count FROM h WHERE action = 'process_access' AND "
    "target_process = 'lsass.exe' GROUP BY tenant_id, hostname, process_name",
    "HUNT-007": "SELECT DISTINCT tenant_id, hostname, process_name, command_line FROM h WHERE action = 'process_creation' AND "
    "(process_name ILIKE '%schtasks.exe%' OR command_line ILIKE '%Register-ScheduledTask%')",
    "HUNT-008": "SELECT tenant_id, src_ip, url, http_referrer, count(*) AS clicks FROM h WHERE http_referrer ILIKE '%mail%' OR "
    "http_referrer ILIKE '%outlook%' GROUP BY tenant_id, src_ip, url, http_referrer",
}
#: thresholds widened to fit the month of test data
_ARGS = {"HUNT-001": {"max_span_hours": 400}, "HUNT-005": {"min_count": 1}}


@SUITE.query(
    "hunt_001",
    _H + ", x AS (" + _SQL["HUNT-001"] + ") SELECT x.tenant_id, x.user_id, unique_countries, epoch_us(lo) AS first_us, epoch_us(hi) AS "
    "last_us, (SELECT string_agg(geo_country || ':' || n, ',' ORDER BY geo_country) FROM (SELECT geo_country, count(*) AS n "
    "FROM h WHERE h.tenant_id = x.tenant_id AND h.user_id = x.user_id AND action IN ('login','authenticate') AND outcome='success' GROUP BY 1)) AS "
    "countries FROM x",
)
def _(spark, sf_dir):
    out = hunts.hunt_001(hunt_events(spark, sf_dir), now(), WIDE, 400)
    text = F.transform("countries", lambda c: F.concat(c["geo_country"], F.lit(":"), c["n"].cast("string")))
    return out.select(
        "tenant_id", "user_id", "unique_countries", F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"), F.array_join(text, ",").alias("countries"),
    )


def _register(hid: str) -> None:
    name = hid.replace("-", "_").lower()

    @SUITE.query(name, _H + " " + _SQL[hid])
    def _(spark, sf_dir):
        return hunts.HUNTS[hid](hunt_events(spark, sf_dir), now(), WIDE, **_ARGS.get(hid, {}))


for _hid in list(_SQL)[1:]:
    _register(_hid)


@SUITE.query(
    "hunt_002_users",
    _H + ", x AS (" + _SQL["HUNT-002"] + ") SELECT tenant_id, src_ip, user_id, count(*) AS successes FROM h WHERE action IN "
    "('login','authenticate') AND outcome = 'success' AND (tenant_id, src_ip) IN (SELECT (tenant_id, src_ip) FROM x) GROUP BY ALL",
)
def _(spark, sf_dir):
    return hunts.hunt_002_users(hunt_events(spark, sf_dir), now(), WIDE)


_ENTITY = {"HUNT-001": "CAST(user_id AS VARCHAR)", "HUNT-006": "coalesce(hostname,'unknown')", "HUNT-007": "coalesce(hostname,'unknown')"}


@SUITE.query(
    "run_hunts",
    _H + " SELECT tenant_id, entity, template, tactic, decision, count(*) AS hits FROM ("
    + " UNION ALL ".join(
        f"SELECT tenant_id, {_ENTITY.get(hid, 'src_ip')} AS entity, '{hid}' AS template, '{tactic}' AS tactic, "
        f"'{'approve' if conf == 'high' else 'pending'}' AS decision FROM ({_SQL[hid]})"
        for hid, _n, tactic, conf, _h in hunts.TEMPLATES
    )
    + ") GROUP BY ALL",
)
def _(spark, sf_dir):
    rows = hunts.run_hunts(
        hunt_events(spark, sf_dir), now(), WIDE, hunt_001={"max_span_hours": 400}, hunt_005={"min_count": 1}
    )
    return rows.groupBy("tenant_id", "entity", "template", "tactic", "decision").agg(F.count("*").alias("hits"))


def predicted(spark, sf_dir):
    """Events with a mitre_predictions array built from the tactic columns."""
    pred = F.array(
        F.struct("technique_id", F.col("tactic").alias("technique_name"), "tactic", F.col("meta_score").alias("confidence"))
    )
    return sec_events(spark, sf_dir).withColumn("mitre_predictions", pred)


def _hunted(name, sql_where, predicates, limit=100):
    @SUITE.query(
        name,
        SEC + f" SELECT event_id, epoch_us(timestamp) AS us FROM sec WHERE tenant_id = 'tenant-1' AND {sql_where} ORDER BY "
        f"timestamp DESC, event_id DESC LIMIT {limit}",
    )
    def _(spark, sf_dir):
        out = hunts.hunt(predicted(spark, sf_dir), "tenant-1", predicates(), limit)
        return out.select("event_id", F.unix_micros("timestamp").alias("us"))


_hunted("p_ml", "meta_score >= 0.6", lambda: [hunts.p_ml(">=", 0.6)])
_hunted("p_tactic", "tactic = 'lateral-movement'", lambda: [hunts.p_tactic("Lateral-Movement")])
_hunted("p_source", "source_type = 'zeek'", lambda: [hunts.p_source("zeek")], 50)
_hunted("p_field", "src_ip = '10.0.0.7'", lambda: [hunts.p_field("source_ip", "=", "10.0.0.7")])
_hunted(
    "hunt",
    "meta_score > 0.3 AND tactic = 'discovery' AND action <> 'allow'",
    lambda: [hunts.p_ml(">", 0.3), hunts.p_tactic("discovery"), hunts.p_field("action", "!=", "allow")],
    1000,
)


# a low score followed within two days by a high one of the same address
_PS = 2 * 86400 * 1_000_000


@SUITE.query(
    "p_sequence",
    SEC.replace("WITH ", "WITH RECURSIVE ", 1) + ", h AS (SELECT tenant_id, src_ip, epoch_us(timestamp) AS us, event_id, (meta_score < 0.5)::INT + 2 * (meta_score >= 0.6)::INT AS "
    "mask, row_number() OVER (PARTITION BY tenant_id, src_ip ORDER BY timestamp, event_id) AS rn FROM sec WHERE meta_score < 0.5 OR meta_score >= 0.6), w AS (SELECT tenant_id, "
    "src_ip, rn, us, event_id, mask & 1 AS n, us AS t0, false AS fired, CAST(0 AS BIGINT) AS span FROM h WHERE rn = 1 UNION ALL SELECT tenant_id, src_ip, rn, us, event_id, CASE "
    "WHEN hit AND n0 = 1 THEN 0 WHEN hit THEN 1 ELSE n0 END, CASE WHEN hit AND n0 = 0 THEN us ELSE t0 END, hit AND n0 = 1, us - t0 FROM (SELECT *, (mask >> n0) & 1 = 1 AS hit FROM "
    f"(SELECT h.*, w.t0, CASE WHEN w.n > 0 AND h.us - w.t0 > {_PS} THEN 0 ELSE w.n END AS n0 FROM w JOIN h ON h.tenant_id = w.tenant_id AND h.src_ip = w.src_ip AND h.rn = w.rn + 1))) "
    "SELECT tenant_id, src_ip, event_id AS triggering_event_id, round(span / 1e6, 1) AS span_seconds FROM w WHERE fired",
)
def _(spark, sf_dir):
    ev = predicted(spark, sf_dir)
    return hunts.p_sequence(ev, [hunts.p_ml("<", 0.5), hunts.p_ml(">=", 0.6)], span="2d")
