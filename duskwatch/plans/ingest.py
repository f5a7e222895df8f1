"""Normalisers, OCSF projections, feeds and table jobs over raw logs derived from the test events."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import graph as G
from duskwatch.plans.base import NOW, SEC, Suite, sec_events, table
from duskwatch.plans.side import AUDIT_SQL, audit
from duskwatch.schema import flatten_events, validate_events
from duskwatch.session import shared_folder
from duskwatch.sources import feeds, normalize as N, ocsf as O, tables as TB
from duskwatch.sources.current import CurrentTable

SUITE = Suite()


def raw(spark, sf_dir, value, broken=True, topic=None):
    """Raw lines made of each event; one in sixteen is cut short when ``broken``."""
    ev = sec_events(spark, sf_dir)
    line = value
    if broken:
        line = F.when(F.col("event_id") % 16 == 5, F.substring(value, 1, 12)).otherwise(value)
    cols = [line.alias("value"), F.col("timestamp").alias("received_at"), "tenant_id"]
    return ev.select(*cols) if topic is None else ev.select(topic.alias("topic"), *cols)


def js(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


ISO = lambda c="timestamp": F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
GOOD = "event_id % 16 <> 5"


def flat(parsed):
    f = flatten_events(parsed.events)
    return f.withColumn("us", F.unix_micros("timestamp"))


def suricata_line():
    sev = (F.col("k") % 6).cast("int")
    return js(
        timestamp=ISO(), event_type=F.lit("alert"), src_ip=F.col("src_ip"), src_port=F.col("src_port"), dest_ip=F.col("dst_ip"),
        dest_port=F.col("dst_port"), proto=F.upper("protocol"),
        alert=F.struct(
            F.when(F.col("k") % 2 == 0, "blocked").otherwise("allowed").alias("action"), sev.alias("severity"), F.col("message").alias("signature"),
            F.col("event_id").alias("signature_id"), F.col("tactic").alias("category"),
        ),
    )


@SUITE.query(
    "normalize_suricata",
    SEC + f" SELECT CAST(event_id AS VARCHAR) AS signature_id, epoch_us(timestamp) AS us, tenant_id, tactic AS event_type, CASE WHEN k % 2 = 0 THEN 'block' ELSE 'alert' END "
    "AS action, CASE WHEN k % 2 = 0 THEN 'success' ELSE 'unknown' END AS outcome, CASE k % 6 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' "
    f"ELSE 'info' END AS severity, message, src_ip, src_port, dst_ip, dst_port, 0::BIGINT AS bytes_in FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    f = flat(N.normalize_suricata(raw(spark, sf_dir, suricata_line())))
    return f.select("signature_id", "us", "tenant_id", "event_type", "action", "outcome", "severity", "message", "src_ip", "src_port", "dst_ip", "dst_port", "bytes_in")


@SUITE.query(
    "dead_letters",
    SEC + " SELECT 'suricata' AS original_topic, substr('{\"timestamp\":\"', 1, 12) AS raw_log, 'invalid_json' AS error_reason, count(*) AS letters FROM sec WHERE event_id % 16 = 5",
)
def _(spark, sf_dir):
    d = N.normalize_suricata(raw(spark, sf_dir, suricata_line())).dead_letters
    return d.groupBy("original_topic", "raw_log", "error_reason").agg(F.count("*").alias("letters"))


def zeek_line():
    state = F.expr("CASE k % 7 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' WHEN 3 THEN 'RSTO' WHEN 4 THEN 'RSTR' WHEN 5 THEN 'OTH' ELSE 'XX' END")
    return F.to_json(
        F.struct(
            (F.unix_micros("timestamp") / 1e6).alias("ts"), state.alias("conn_state"), F.col("event_type").alias("service"), F.col("protocol").alias("proto"),
            F.col("src_ip").alias("id.orig_h"), F.col("src_port").alias("id.orig_p"), F.col("dst_ip").alias("id.resp_h"), F.col("dst_port").alias("id.resp_p"),
            F.col("bytes_out").alias("orig_bytes"), F.col("bytes_in").alias("resp_bytes"), F.col("packets_out").alias("orig_pkts"), F.col("event_id").alias("resp_pkts"),
        )
    )


@SUITE.query(
    "normalize_zeek",
    SEC + " SELECT event_id AS packets_in, epoch_us(timestamp) AS us, event_type, CASE k % 7 WHEN 0 THEN 'allow' WHEN 1 THEN 'connect' WHEN 2 THEN 'deny' WHEN 3 THEN 'block' "
    "WHEN 4 THEN 'block' ELSE 'unknown' END AS action, CASE k % 7 WHEN 0 THEN 'success' WHEN 5 THEN 'unknown' WHEN 6 THEN 'unknown' ELSE 'failure' END AS outcome, 'Zeek conn: ' || "
    f"src_ip || ' → ' || dst_ip || ':' || dst_port AS message, bytes_in, bytes_out, packets_out FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    f = flat(N.normalize_zeek(raw(spark, sf_dir, zeek_line())))
    return f.select("packets_in", "us", "event_type", "action", "outcome", "message", "bytes_in", "bytes_out", "packets_out")


def palo_line():
    action = F.expr("CASE k % 5 WHEN 0 THEN 'Allow' WHEN 1 THEN 'deny' WHEN 2 THEN 'drop' WHEN 3 THEN 'reset-both' ELSE 'other' END")
    return js(
        type=F.lit("THREAT"), subtype=F.col("tactic"), time_generated=F.when(F.col("k") % 2 == 0, ISO()), receive_time=F.concat(ISO(), F.lit("Z")),
        severity=F.when(F.col("severity") == "info", "informational").otherwise(F.initcap("severity")), action=action, src=F.col("src_ip"), dst=F.col("dst_ip"),
        sport=F.col("src_port"), dport=F.col("dst_port"), bytes_sent=F.col("bytes_out"), bytes_received=F.col("bytes_in"), threat_id=F.col("event_id"),
        threat_name=F.when(F.col("k") % 3 == 0, F.col("message")), app=F.col("event_type"),
    )


@SUITE.query(
    "normalize_palo_alto",
    SEC + " SELECT CAST(event_id AS VARCHAR) AS signature_id, epoch_us(timestamp) AS us, 'threat' AS event_category, tactic AS event_type, CASE k % 5 WHEN 0 THEN 'allow' WHEN 1 THEN "
    "'deny' WHEN 2 THEN 'drop' WHEN 3 THEN 'block' ELSE 'unknown' END AS action, CASE k % 5 WHEN 0 THEN 'success' ELSE 'failure' END AS outcome, severity, CASE WHEN k % 3 = 0 THEN "
    f"message ELSE event_type END AS message, src_port, dst_port, 'tcp' AS protocol, bytes_in, bytes_out FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    f = flat(N.normalize_palo_alto(raw(spark, sf_dir, palo_line())))
    return f.select("signature_id", "us", "event_category", "event_type", "action", "outcome", "severity", "message", "src_port", "dst_port", "protocol", "bytes_in", "bytes_out")


_WIN_ID = "CASE k % 12 " + " ".join(f"WHEN {i} THEN {r[0]}" for i, r in enumerate(N.WINDOWS_EVENTS)) + " ELSE 9999 END"


def windows_line():
    return js(
        EventID=F.expr(_WIN_ID),
        System=F.struct(F.struct(F.concat(ISO(), F.lit("Z")).alias("SystemTime")).alias("TimeCreated"), F.col("hostname").alias("Computer")),
        EventData=F.struct(
            F.when(F.col("k") % 2 == 0, F.concat(F.lit("u"), "event_id")).alias("TargetUserName"), F.concat(F.lit("s"), "event_id").alias("SubjectUserName"),
            F.when(F.col("k") % 3 == 0, F.col("src_ip")).alias("IpAddress"),
        ),
    )


@SUITE.query(
    "normalize_windows",
    SEC + f", w AS (SELECT *, {_WIN_ID} AS wid, CASE WHEN k % 2 = 0 THEN 'u' ELSE 's' END || event_id AS usr, coalesce(hostname, 'unknown') AS hst, CASE k % 12 "
    + " ".join(f"WHEN {i} THEN '{r[1]}'" for i, r in enumerate(N.WINDOWS_EVENTS)) + " ELSE 'unknown' END AS et, CASE k % 12 "
    + " ".join(f"WHEN {i} THEN '{r[2]}/{r[3]}/{r[4]}'" for i, r in enumerate(N.WINDOWS_EVENTS)) + " ELSE 'unknown/unknown/info' END AS aos FROM sec) SELECT usr AS source_entity, "
    "epoch_us(timestamp) AS us, CAST(wid AS VARCHAR) AS signature_id, et AS event_type, aos, 'Event ' || wid || ': ' || et || ' by ' || usr || ' on ' || hst AS message, CASE WHEN k % "
    f"3 = 0 THEN src_ip END AS src_ip FROM w WHERE {GOOD}",
)
def _(spark, sf_dir):
    f = flat(N.normalize_windows(raw(spark, sf_dir, windows_line())))
    return f.select("source_entity", "us", "signature_id", "event_type", F.concat_ws("/", "action", "outcome", "severity").alias("aos"), "message", "src_ip")


def crowd_line():
    taken = F.expr("CASE k % 4 WHEN 0 THEN 'Process Blocked' WHEN 1 THEN 'killed' WHEN 2 THEN 'Quarantined' ELSE 'none' END")
    return js(
        event_simpleName=F.when(F.col("k") % 3 == 0, F.lit("ProcessRollup2")), EventType=F.col("event_type"), timestamp=F.concat(ISO(), F.lit("Z")),
        SeverityName=F.when(F.col("severity") == "info", "Informational").otherwise(F.initcap("severity")), ActionTaken=taken, ComputerName=F.col("hostname"),
        SensorId=F.when(F.col("k") % 2 == 0, F.concat(F.lit("s"), "event_id")), DetectDescription=F.col("message"), TechniqueId=F.concat(F.lit("T"), "event_id"),
        Tactic=F.col("tactic"),
    )


@SUITE.query(
    "normalize_crowdstrike",
    SEC + " SELECT 'T' || event_id AS signature_id, epoch_us(timestamp) AS us, CASE WHEN k % 3 = 0 THEN 'ProcessRollup2' ELSE event_type END AS event_type, CASE WHEN k % 4 < 3 THEN "
    "'block' ELSE 'alert' END AS action, CASE WHEN k % 4 < 3 THEN 'success' ELSE 'unknown' END AS outcome, severity, message, CASE WHEN k % 2 = 0 THEN 's' || event_id ELSE hostname "
    f"END AS source_entity FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    f = flat(N.normalize_crowdstrike(raw(spark, sf_dir, crowd_line())))
    return f.select("signature_id", "us", "event_type", "action", "outcome", "severity", "message", "source_entity")


_IPS = "'connection from ' || src_ip || ' to ' || dst_ip || ' id ' || event_id"


def two_ips():
    return F.concat(F.lit("connection from "), "src_ip", F.lit(" to "), "dst_ip", F.lit(" id "), "event_id")


@SUITE.query(
    "normalize_syslog_generic",
    SEC + f", m AS (SELECT *, {_IPS} AS msg FROM sec) SELECT msg AS message, CASE WHEN k % 3 = 0 THEN 'generic' ELSE event_type END AS event_category, CASE WHEN k % 3 = 0 THEN 'info' "
    "ELSE ['critical','critical','critical','high','medium','low','info','info','info'][k % 9 + 1] END AS severity, src_ip, dst_ip FROM m",
)
def _(spark, sf_dir):
    line = F.when(F.col("k") % 3 == 0, two_ips()).otherwise(js(severity=F.col("k") % 9, facility=F.col("event_type"), message=two_ips()))
    f = flat(N.normalize_syslog_generic(raw(spark, sf_dir, line, broken=False)))
    return f.select("message", "event_category", "severity", "src_ip", "dst_ip")


@SUITE.query(
    "normalize_syslog_rfc",
    SEC + f", m AS (SELECT *, {_IPS} AS msg FROM sec) SELECT msg AS message, 'app' || (k % 5) AS event_type, 'h' || user_id AS source_entity, ['critical','critical','critical','high',"
    "'medium','low','info','info'][k % 8 + 1] AS severity, CASE WHEN k % 8 <= 4 THEN 'alert' ELSE 'unknown' END AS action, src_ip FROM m WHERE " + GOOD,
)
def _(spark, sf_dir):
    line = F.concat(
        F.lit("<"), (F.col("k") % 8 + 32).cast("string"), F.lit(">1 "), ISO(), F.lit(" h"), "user_id", F.lit(" app"), (F.col("k") % 5).cast("string"),
        F.lit(" 12 ID47 [x y=\"1\"] "), two_ips(),
    )
    f = flat(N.normalize_syslog_rfc(raw(spark, sf_dir, line)))
    return f.select("message", "event_type", "source_entity", "severity", "action", "src_ip")


@SUITE.query(
    "normalize_ms_sentinel",
    SEC + " SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(timestamp) AS us, message, CASE severity WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' ELSE 'medium' END AS severity, "
    f"src_ip, CASE WHEN k % 2 = 0 THEN dst_ip END AS dst_ip, coalesce(hostname, src_ip) AS source_entity FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    def e(kind, **f):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("Type"), *[f.get(n, none).alias(n) for n in ("Address", "HostName", "Name")])

    ents = F.array(
        e("ip", Address=F.col("src_ip")), e("Host", HostName=F.col("hostname")), e("account", Name=F.lit("bob")), e("other", Name=F.lit("x")),
        F.when(F.col("k") % 2 == 0, e("IP", Address=F.col("dst_ip"))).otherwise(e("other", Name=F.lit("y"))),
    )
    line = js(SystemAlertId=F.col("event_id"), AlertDisplayName=F.col("message"), TimeGenerated=F.concat(ISO(), F.lit("Z")), Severity=F.initcap("severity"), Entities=ents)
    f = flat(N.normalize_ms_sentinel(raw(spark, sf_dir, line)))
    return f.select("event_id", "us", "message", "severity", "src_ip", "dst_ip", "source_entity")


@SUITE.query(
    "normalize_splunk_hec",
    SEC + " SELECT epoch_us(timestamp) AS us, 'st' || (k % 3) AS source_type, 'low' AS severity, CASE WHEN k % 2 = 0 THEN message ELSE 'text ' || event_id END AS message, CASE WHEN k "
    f"% 2 = 0 THEN 'h' || event_id ELSE 'env' END AS source_entity, CASE WHEN k % 2 = 0 THEN src_ip END AS src_ip FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    tail = [(F.unix_micros("timestamp") / 1e6).alias("time"), F.lit("env").alias("host"), F.concat(F.lit("st"), (F.col("k") % 3).cast("string")).alias("sourcetype")]
    obj = F.to_json(F.struct(F.struct(F.col("src_ip").alias("src"), F.concat(F.lit("h"), "event_id").alias("host"), F.col("message").alias("msg")).alias("event"), *tail))
    txt = F.to_json(F.struct(F.concat(F.lit("text "), "event_id").alias("event"), *tail))
    f = flat(N.normalize_splunk_hec(raw(spark, sf_dir, F.when(F.col("k") % 2 == 0, obj).otherwise(txt))))
    return f.select("us", "source_type", "severity", "message", "source_entity", "src_ip")


@SUITE.query(
    "explode_hec_batch",
    SEC + " SELECT coalesce(s, 'splunk_hec') AS source_type, 'info' AS severity, m AS message, host FROM (SELECT CASE WHEN k % 2 = 0 THEN event_type END AS s, message AS m, 'h' || event_id AS "
    "host FROM sec UNION ALL SELECT 'second', 'again', 'h' || event_id FROM sec)",
)
def _(spark, sf_dir):
    one = js(event=F.col("message"), host=F.concat(F.lit("h"), "event_id"), sourcetype=F.when(F.col("k") % 2 == 0, F.col("event_type")))
    two = js(event=F.lit("again"), host=F.concat(F.lit("h"), "event_id"), sourcetype=F.lit("second"))
    body = F.when(F.col("k") % 3 == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))).otherwise(F.concat(one, F.lit("\n\n"), two, F.lit("\n")))
    return N.explode_hec_batch(raw(spark, sf_dir, body, broken=False)).select("source_type", "severity", "message", "host")


@SUITE.query(
    "normalize_cloudtrail",
    SEC + " SELECT 'user' || event_id AS source_entity, CASE k % 4 WHEN 0 THEN 'ConsoleLogin' WHEN 1 THEN 'StopLogging' WHEN 2 THEN 'CreateUser' ELSE 'GetObject' END AS event_type, CASE k % 4 WHEN "
    "0 THEN 'medium' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'info' END AS severity, CASE k % 4 WHEN 0 THEN 'authenticate' ELSE 'execute' END AS action, CASE WHEN k % 3 = 0 THEN 'failure' "
    f"ELSE 'success' END AS outcome, src_ip FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    name = F.expr("CASE k % 4 WHEN 0 THEN 'ConsoleLogin' WHEN 1 THEN 'StopLogging' WHEN 2 THEN 'CreateUser' ELSE 'GetObject' END")
    line = js(
        eventName=name, eventSource=F.lit("iam"), sourceIPAddress=F.col("src_ip"), errorCode=F.when(F.col("k") % 3 == 0, F.lit("AccessDenied")),
        userIdentity=F.struct(F.concat(F.lit("user"), "event_id").alias("userName")),
    )
    f = flat(N.normalize_cloudtrail(raw(spark, sf_dir, line)))
    return f.select("source_entity", "event_type", "severity", "action", "outcome", "src_ip")


@SUITE.query(
    "normalize_gcp_audit",
    SEC + " SELECT 'p' || event_id AS source_entity, CASE WHEN k % 2 = 0 THEN 'storage.buckets.delete' ELSE 'storage.get' END AS event_type, CASE WHEN k % 2 = 0 THEN 'critical' ELSE 'info' END AS "
    f"severity, CASE WHEN k % 3 = 0 THEN 'failure' ELSE 'success' END AS outcome, src_ip FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    body = F.struct(
        F.when(F.col("k") % 2 == 0, "storage.buckets.delete").otherwise("storage.get").alias("methodName"), F.lit("storage").alias("serviceName"),
        F.struct(F.col("src_ip").alias("callerIp")).alias("requestMetadata"), F.struct(F.concat(F.lit("p"), "event_id").alias("principalEmail")).alias("authenticationInfo"),
        F.struct(F.when(F.col("k") % 3 == 0, 7).otherwise(0).alias("code")).alias("status"),
    )
    line = F.when(F.col("k") % 5 < 3, F.to_json(F.struct(body.alias("protoPayload")))).otherwise(F.to_json(body))
    f = flat(N.normalize_gcp_audit(raw(spark, sf_dir, line)))
    return f.select("source_entity", "event_type", "severity", "outcome", "src_ip")


_TOPIC = "CASE event_type WHEN 'error' THEN 'logs.suricata' WHEN 'click' THEN 'logs.zeek' WHEN 'view' THEN 'logs.palo_alto' WHEN 'signup' THEN 'logs.windows' ELSE 'logs.nowhere' END"


def routed(spark, sf_dir):
    line = (
        F.when(F.col("event_type") == "error", suricata_line()).when(F.col("event_type") == "click", zeek_line())
        .when(F.col("event_type") == "view", palo_line()).otherwise(windows_line())
    )
    return N.route_and_normalize(raw(spark, sf_dir, line, topic=F.expr(_TOPIC)))


@SUITE.query(
    "route_and_normalize",
    SEC + f" SELECT source_type, tenant_id, count(*) AS events FROM sec WHERE event_type <> 'purchase' AND {GOOD} GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return flat(routed(spark, sf_dir)).groupBy("source_type", "tenant_id").agg(F.count("*").alias("events"))


@SUITE.query(
    "route_dead_letters",
    SEC + " SELECT CASE WHEN event_type = 'purchase' THEN 'logs.nowhere' ELSE source_type END AS original_topic, CASE WHEN event_type = 'purchase' THEN 'no_parser_registered' ELSE 'invalid_json' "
    "END AS error_reason, count(*) AS letters FROM sec WHERE event_type = 'purchase' OR event_id % 16 = 5 GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return routed(spark, sf_dir).dead_letters.groupBy("original_topic", "error_reason").agg(F.count("*").alias("letters"))


@SUITE.query(
    "validate_events",
    SEC + ", v AS (SELECT concat_ws(',', CASE WHEN k % 10 = 1 THEN 'severity' END, CASE WHEN value > 150 THEN 'source_entity.asset_criticality' END) AS errors FROM sec WHERE "
    + GOOD + ") SELECT errors, count(*) AS events FROM v GROUP BY 1",
)
def _(spark, sf_dir):
    ev = N.normalize_suricata(raw(spark, sf_dir, suricata_line())).events
    # break some rows through their own fields
    src = sec_events(spark, sf_dir).select(F.col("event_id").cast("string").alias("signature_id"), "k", "value")
    ev = ev.join(src, "signature_id").withColumns(
        {
            "severity": F.when(F.col("k") % 10 == 1, "severe").otherwise(F.col("severity")),
            "source_entity": F.col("source_entity").withField("asset_criticality", F.when(F.col("value") > 150, 1.5).otherwise(0.5)),
        }
    ).drop("k", "value")
    ok, bad = validate_events(ev, F.lit("tenant-x"))
    both = ok.select(F.lit("").alias("errors")).unionByName(bad.select(F.array_join("errors", ",").alias("errors")))
    return both.groupBy("errors").agg(F.count("*").alias("events"))


# ---- OCSF ----


def _ocsf(name, sql_cols, build, cols, where=""):
    @SUITE.query(name, SEC + f" SELECT {sql_cols} FROM sec {where}")
    def _(spark, sf_dir):
        return build(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in cols.items()])


def _flat_fields(spark, sf_dir, **fields):
    return sec_events(spark, sf_dir).select(*[c.alias(n) for n, c in fields.items()])


_ocsf(
    "ocsf_authentication",
    "3002 AS class_uid, event_id::VARCHAR AS raw_data, CASE WHEN k % 2 = 0 THEN 'u' || user_id ELSE 'Unknown' END AS user_name, src_ip, 0 AS activity_id, outcome AS status, 1 AS severity_id",
    lambda s, d: O.ocsf_authentication(
        _flat_fields(s, d, raw_log=F.col("event_id").cast("string"), user=F.when(F.col("k") % 2 == 0, F.concat(F.lit("u"), "user_id")), source_ip=F.col("src_ip"), status=F.col("outcome"))
    ),
    {"class_uid": "ocsf.class_uid", "raw_data": "ocsf.raw_data", "user_name": "ocsf.user.name", "src_ip": "ocsf.src_endpoint.ip", "activity_id": "ocsf.activity_id", "status": "ocsf.status", "severity_id": "ocsf.severity_id"},
)
_ocsf(
    "ocsf_network",
    "4001 AS class_uid, event_id::VARCHAR AS raw_data, src_ip, src_port, dst_ip, dst_port, protocol, message",
    lambda s, d: O.ocsf_network(
        _flat_fields(s, d, raw_log=F.col("event_id").cast("string"), source_ip=F.col("src_ip"), source_port=F.col("src_port"), destination_ip=F.col("dst_ip"), destination_port=F.col("dst_port"), protocol=F.col("protocol"), message=F.col("message"))
    ),
    {"class_uid": "ocsf.class_uid", "raw_data": "ocsf.raw_data", "src_ip": "ocsf.src_endpoint.ip", "src_port": "ocsf.src_endpoint.port", "dst_ip": "ocsf.dst_endpoint.ip", "dst_port": "ocsf.dst_endpoint.port", "protocol": "ocsf.connection_info.protocol_name", "message": "ocsf.message"},
)
_ocsf(
    "ocsf_finding",
    "2001 AS class_uid, event_id::VARCHAR AS uid, coalesce(signature_name, 'Unknown Finding') AS title, 'Security Alert' AS message, 1 AS state_id",
    lambda s, d: O.ocsf_finding(_flat_fields(s, d, signature_id=F.col("event_id").cast("string"), signature=F.col("signature_name"))),
    {"class_uid": "ocsf.class_uid", "uid": "ocsf.finding.uid", "title": "ocsf.finding.title", "message": "ocsf.message", "state_id": "ocsf.state_id"},
)
_ocsf(
    "ocsf_process",
    "1007 AS class_uid, event_id::VARCHAR AS pid, process_name AS name, command_line AS cmd, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS hashes, 'Unknown' AS actor",
    lambda s, d: O.ocsf_process(_flat_fields(s, d, process_id=F.col("event_id"), process_name=F.col("process_name"), command_line=F.col("command_line"), hash=F.when(F.col("k") % 2 == 0, F.lit("ab")))),
    {"class_uid": "ocsf.class_uid", "pid": "ocsf.process.pid", "name": "ocsf.process.name", "cmd": "ocsf.process.cmd_line", "hashes": "size(ocsf.process.file.hashes)", "actor": "ocsf.actor.user.name"},
)
_ocsf(
    "ocsf_file",
    "1001 AS class_uid, event_id::VARCHAR AS path, process_name AS process, CASE WHEN k % 2 = 0 THEN 'ab' END AS sha, hostname AS device",
    lambda s, d: O.ocsf_file(_flat_fields(s, d, file_path=F.col("event_id"), process_name=F.col("process_name"), hash=F.when(F.col("k") % 2 == 0, F.lit("ab")), hostname=F.col("hostname"))),
    {"class_uid": "ocsf.class_uid", "path": "ocsf.file.path", "process": "ocsf.actor.process.name", "sha": "get(ocsf.file.hashes, 0).value", "device": "ocsf.device.hostname"},
)
_ocsf(
    "ocsf_dns",
    "4003 AS class_uid, event_id::VARCHAR AS raw_data, CASE WHEN k % 3 > 0 THEN 'q' || k END AS query, 'A' AS type, CASE WHEN k % 3 > 0 THEN 1 ELSE 2 END AS activity_id, CASE WHEN k % 2 = 0 THEN 'Success' ELSE 'Failure' END AS status, 1 AS answers",
    lambda s, d: O.ocsf_dns(_flat_fields(s, d, raw_log=F.col("event_id"), query=F.when(F.col("k") % 3 > 0, F.concat(F.lit("q"), "k")), rcode=F.col("k") % 2, answers=F.array("dst_ip"))),
    {"class_uid": "ocsf.class_uid", "raw_data": "ocsf.raw_data", "query": "ocsf.query.hostname", "type": "ocsf.query.type", "activity_id": "ocsf.activity_id", "status": "ocsf.status", "answers": "size(ocsf.answers)"},
)
_ocsf(
    "ocsf_http",
    "4002 AS class_uid, event_id::VARCHAR AS raw_data, 'GET' AS method, coalesce(CASE WHEN k % 2 = 0 THEN url END, '/') AS path, 200 AS code, CASE WHEN k % 5 = 0 THEN dst_port ELSE 80 END AS port",
    lambda s, d: O.ocsf_http(_flat_fields(s, d, raw_log=F.col("event_id"), url=F.when(F.col("k") % 2 == 0, F.col("url")), destination_port=F.when(F.col("k") % 5 == 0, F.col("dst_port")))),
    {"class_uid": "ocsf.class_uid", "raw_data": "ocsf.raw_data", "method": "ocsf.http_request.http_method", "path": "ocsf.http_request.url.path", "code": "ocsf.http_response.code", "port": "ocsf.dst_endpoint.port"},
)


@SUITE.query(
    "ocsf_from_syslog",
    SEC + " SELECT CASE WHEN k % 3 < 2 THEN 3002 ELSE 4001 END AS class_uid, event_id::VARCHAR AS id, CASE WHEN k % 3 < 2 THEN CASE WHEN k % 2 = 0 THEN 'Failure' ELSE 'Success' END END AS status, "
    "CASE WHEN k % 3 < 2 THEN 'root' || event_id END AS usr, CASE WHEN k % 3 < 2 THEN src_ip END AS ip, CASE WHEN k % 3 < 2 AND k % 2 = 0 THEN 3 ELSE 1 END AS severity_id FROM sec WHERE " + GOOD,
)
def _(spark, sf_dir):
    app = F.expr("CASE k % 3 WHEN 0 THEN 'sshd[77]' WHEN 1 THEN 'SUDO' ELSE 'cron' END")
    word = F.when(F.col("k") % 2 == 0, "Failed").otherwise("Accepted")
    line = F.concat(F.lit("<34>Oct 11 22:14:15 mach "), app, F.lit(": "), word, F.lit(" password for root"), "event_id", F.lit(" from "), "src_ip", F.lit(" port 22"))
    auth, net = O.ocsf_from_syslog(raw(spark, sf_dir, line))
    num = lambda: F.regexp_extract("ocsf.message", r"root(\d+)", 1).alias("id")
    a = auth.select("ocsf.class_uid", num(), "ocsf.status", F.col("ocsf.user.name").alias("usr"), F.col("ocsf.src_endpoint.ip").alias("ip"), "ocsf.severity_id")
    none = F.lit(None).cast("string")
    n = net.select("ocsf.class_uid", num(), none.alias("status"), none.alias("usr"), F.col("ocsf.src_endpoint.ip").alias("ip"), "ocsf.severity_id")
    return a.unionByName(n)


@SUITE.query(
    "ocsf_from_guardduty",
    SEC + f" SELECT event_id::VARCHAR AS uid, CASE WHEN k % 11 >= 9 THEN 5 WHEN k % 11 >= 7 THEN 4 WHEN k % 11 >= 4 THEN 3 WHEN k % 11 >= 1 THEN 2 ELSE 1 END AS severity_id, message FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    line = js(id=F.col("event_id"), type=F.col("tactic"), title=F.col("message"), createdAt=ISO(), severity=F.col("k") % 11)
    return O.ocsf_from_guardduty(raw(spark, sf_dir, line)).select(F.col("ocsf.finding.uid").alias("uid"), "ocsf.severity_id", "ocsf.message")


@SUITE.query(
    "ocsf_from_azure_ad",
    SEC + " SELECT 'u' || event_id AS usr, 'Sign-in to Portal - Code ' || (k % 3) AS message, CASE WHEN k % 3 = 0 THEN 'Success' ELSE 'Failure' END AS status, CASE WHEN k % 3 = 0 THEN 1 ELSE 3 END AS "
    f"severity_id FROM sec WHERE {GOOD}",
)
def _(spark, sf_dir):
    line = js(createdDateTime=ISO(), userPrincipalName=F.concat(F.lit("u"), "event_id"), appDisplayName=F.lit("Portal"), ipAddress=F.col("src_ip"), status=F.struct((F.col("k") % 3).alias("errorCode")))
    return O.ocsf_from_azure_ad(raw(spark, sf_dir, line)).select(F.col("ocsf.user.name").alias("usr"), "ocsf.message", "ocsf.status", "ocsf.severity_id")


_SEV = "CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 ELSE 1 END"


@SUITE.query("ocsf_from_defender", SEC + f" SELECT event_id::VARCHAR AS uid, message AS title, {_SEV} AS severity_id FROM sec WHERE {GOOD}")
def _(spark, sf_dir):
    line = js(id=F.col("event_id"), title=F.col("message"), severity=F.initcap("severity"), alertCreationTime=ISO())
    return O.ocsf_from_defender(raw(spark, sf_dir, line)).select(F.col("ocsf.finding.uid").alias("uid"), F.col("ocsf.finding.title").alias("title"), "ocsf.severity_id")


@SUITE.query("ocsf_from_ms_sentinel", SEC + f" SELECT event_id::VARCHAR AS uid, {_SEV} AS severity_id, hostname, src_ip AS ip FROM sec WHERE {GOOD}")
def _(spark, sf_dir):
    e = F.array(
        F.struct(F.lit("host").alias("kind"), F.col("hostname").alias("hostName"), F.lit(None).cast("string").alias("address")),
        F.struct(F.lit("ip").alias("kind"), F.lit(None).cast("string").alias("hostName"), F.col("src_ip").alias("address")),
    )
    body = F.struct(F.col("event_id").alias("id"), F.col("message").alias("name"), F.upper("severity").alias("severity"), e.alias("entities"))
    line = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(body.alias("properties"), ISO().alias("timeGenerated")))).otherwise(F.to_json(body))
    return O.ocsf_from_ms_sentinel(raw(spark, sf_dir, line)).select(F.col("ocsf.finding.uid").alias("uid"), "ocsf.severity_id", "hostname", "ip")


@SUITE.query(
    "ocsf_from_cloudtrail",
    SEC + " SELECT 'arn' || event_id AS usr, CASE WHEN k % 3 = 0 THEN 'Failure' ELSE 'Success' END AS status, CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END AS severity_id, event_type AS operation FROM sec WHERE " + GOOD,
)
def _(spark, sf_dir):
    line = js(
        eventTime=ISO(), eventName=F.col("event_type"), eventSource=F.lit("s3"), errorCode=F.when(F.col("k") % 3 == 0, F.lit("Denied")),
        userIdentity=F.struct(F.concat(F.lit("arn"), "event_id").alias("arn")),
    )
    return O.ocsf_from_cloudtrail(raw(spark, sf_dir, line)).select(F.col("ocsf.actor.user.name").alias("usr"), "ocsf.status", "ocsf.severity_id", F.col("ocsf.api.operation").alias("operation"))


@SUITE.query(
    "ocsf_from_gcp",
    SEC + " SELECT 'p' || event_id AS usr, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'Failure' ELSE 'Success' END AS status, 'proj' AS account FROM sec WHERE " + GOOD,
)
def _(spark, sf_dir):
    line = js(
        timestamp=ISO(), severity=F.when(F.col("k") % 5 == 0, "ERROR").otherwise("NOTICE"), resource=F.struct(F.struct(F.lit("proj").alias("project_id")).alias("labels")),
        protoPayload=F.struct(
            F.col("event_type").alias("methodName"), F.struct(F.concat(F.lit("p"), "event_id").alias("principalEmail")).alias("authenticationInfo"),
            F.struct(F.when(F.col("k") % 3 == 0, 5).otherwise(0).alias("code")).alias("status"),
        ),
    )
    return O.ocsf_from_gcp(raw(spark, sf_dir, line)).select(F.col("ocsf.actor.user.name").alias("usr"), "ocsf.status", F.col("ocsf.actor.user.account").alias("account"))


_LOST = "SELECT substr({line}, 1, 12) AS raw_log, '{reason}' AS error_reason, count(*) AS letters FROM sec WHERE event_id % 16 = 5 GROUP BY 1"


def _letters(df):
    return df.groupBy("raw_log", "error_reason").agg(F.count("*").alias("letters"))


def _lost(source, line, head, reason="invalid_json"):
    """One in sixteen lines is cut after twelve characters; all of them must come back as dead letters."""

    @SUITE.query(f"ocsf_dead_letters_{source}", SEC + " " + _LOST.format(line="'" + head + "'", reason=reason))
    def _(spark, sf_dir):
        return _letters(O.ocsf_dead_letters(raw(spark, sf_dir, line()), source))


_lost("syslog", lambda: F.concat(F.lit("<34>Oct 11 22:14:15 mach sshd: x"), "event_id"), "<34>Oct 11 22:14:15", "invalid_syslog")
_lost("azure_ad", lambda: js(createdDateTime=ISO()), '{"createdDateTime"')
_lost("defender", lambda: js(identity=F.col("event_id")), '{"identity":1')
_lost("ms_sentinel", lambda: js(identity=F.col("event_id")), '{"identity":1')
_lost("cloudtrail", lambda: js(eventTime=ISO()), '{"eventTime":"2')
_lost("gcp_audit", lambda: js(timestamp=ISO()), '{"timestamp":"2')


@SUITE.query(
    "ocsf_dead_letters_guardduty",
    SEC + " SELECT CASE WHEN event_id % 16 = 5 THEN 'invalid_json' ELSE 'invalid_severity' END AS error_reason, count(*) AS letters FROM sec WHERE event_id % 16 = 5 OR k % 11 = 0 GROUP BY 1",
)
def _(spark, sf_dir):
    line = js(identity=F.col("event_id"), severity=F.when(F.col("k") % 11 == 0, "high").otherwise("5"))
    return O.ocsf_dead_letters(raw(spark, sf_dir, line), "guardduty").groupBy("error_reason").agg(F.count("*").alias("letters"))


def _lost_pages(feed, page):
    @SUITE.query(
        f"feed_dead_letters_{feed}",
        SEC + " SELECT CASE WHEN event_id % 16 = 5 THEN 'invalid_json' ELSE 'missing_list' END AS error_reason, count(*) AS letters FROM sec WHERE event_id % 16 = 5 OR k % 7 = 0 GROUP BY 1",
    )
    def _(spark, sf_dir):
        line = F.when(F.col("k") % 7 == 0, js(nothing_here=F.col("event_id"))).otherwise(page())
        return feeds.feed_dead_letters(raw(spark, sf_dir, line), feed).groupBy("error_reason").agg(F.count("*").alias("letters"))


_lost_pages("otx", lambda: js(results=F.array(F.struct(F.col("tactic").alias("name")))))
_lost_pages("misp", lambda: F.to_json(F.struct(F.struct(F.array(F.struct(F.col("dst_ip").alias("value"))).alias("Attribute")).alias("response"))))
_lost_pages("nvd", lambda: js(vulnerabilities=F.array(F.struct(F.struct(F.col("tactic").alias("id")).alias("cve")))))


# ---- feeds ----


@SUITE.query("iocs_from_feodo", SEC + " SELECT dst_ip AS indicator, 'ip' AS itype, 'c2' AS threat_type, tactic AS threat_name, 0.85::DOUBLE AS confidence, 'feodo' AS source FROM sec WHERE k % 4 > 0")
def _(spark, sf_dir):
    rows = sec_events(spark, sf_dir).select(F.when(F.col("k") % 4 > 0, F.col("dst_ip")).otherwise("").alias("ip_address"), F.col("tactic").alias("malware"))
    return feeds.iocs_from_feodo(rows)


@SUITE.query("iocs_from_urlhaus", SEC + " SELECT url AS indicator, 'url' AS itype, 'malware' AS threat_type, tactic AS threat_name, 0.8::DOUBLE AS confidence, 'urlhaus' AS source FROM sec WHERE k % 4 > 0")
def _(spark, sf_dir):
    rows = sec_events(spark, sf_dir).select(F.when(F.col("k") % 4 > 0, F.col("url")).alias("url"), F.col("tactic").alias("threat"))
    return feeds.iocs_from_urlhaus(rows)


@SUITE.query(
    "iocs_from_otx",
    SEC + " SELECT dst_ip AS indicator, 'ip' AS itype, tactic AS threat_name, 0.75::DOUBLE AS confidence FROM sec UNION ALL SELECT 'd' || event_id, 'domain', tactic, 0.75 FROM sec UNION ALL SELECT 'f' || "
    "event_id, 'hash', tactic, 0.75 FROM sec WHERE k % 2 = 0",
)
def _(spark, sf_dir):
    s = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("indicator"))
    kind = F.when(F.col("k") % 2 == 0, "FileHash-SHA256").otherwise("Mutex")
    page = js(results=F.array(F.struct(
        F.col("tactic").alias("name"),
        F.array(s("IPv4", F.col("dst_ip")), s("hostname", F.concat(F.lit("d"), "event_id")), F.struct(kind.alias("type"), F.concat(F.lit("f"), "event_id").alias("indicator"))).alias("indicators"),
    )))
    return feeds.iocs_from_otx(raw(spark, sf_dir, page, broken=False)).select("indicator", "itype", "threat_name", "confidence")


@SUITE.query("iocs_from_misp", SEC + " SELECT dst_ip AS indicator, 'ip' AS itype FROM sec UNION ALL SELECT 'h' || event_id, 'hash' FROM sec WHERE k % 2 = 0")
def _(spark, sf_dir):
    attr = F.array(
        F.struct(F.lit("ip-dst").alias("type"), F.col("dst_ip").alias("value")),
        F.struct(F.when(F.col("k") % 2 == 0, "md5").otherwise("comment").alias("type"), F.concat(F.lit("h"), "event_id").alias("value")),
    )
    page = F.to_json(F.struct(F.struct(attr.alias("Attribute")).alias("response")))
    return feeds.iocs_from_misp(raw(spark, sf_dir, page, broken=False)).select("indicator", "itype")


def stix(spark, sf_dir):
    kind = F.expr("CASE k % 3 WHEN 0 THEN '[ipv4-addr:value = ' WHEN 1 THEN '[domain-name:value = ' ELSE '[mutex:value = ' END")
    s = lambda c: F.lit(None).cast("string") if c is None else c

    def obj(**f):
        names = ["type", "id", "name", "description", "created", "modified", "pattern", "source_ref", "target_ref", "relationship_type"]
        return F.struct(*[s(f.get(n)).cast("string").alias(n) for n in names])

    ind = obj(type=F.lit("indicator"), id=F.concat(F.lit("indicator--"), "user_id"), name=F.col("message"), modified=ISO(), pattern=F.concat(kind, F.lit("'"), F.col("dst_ip"), F.lit("']")))
    actor = obj(type=F.lit("threat-actor"), id=F.concat(F.lit("actor--"), F.col("k")), name=F.col("tactic"), modified=ISO())
    rel = obj(type=F.lit("relationship"), source_ref=F.concat(F.lit("indicator--"), "user_id"), target_ref=F.concat(F.lit("actor--"), F.col("k")), relationship_type=F.lit("indicates"), modified=ISO())
    return G.stix_objects(raw(spark, sf_dir, js(objects=F.array(ind, actor, rel)), broken=False))


@SUITE.query("iocs_from_stix", SEC + " SELECT dst_ip AS indicator, CASE k % 3 WHEN 0 THEN 'ip' ELSE 'domain' END AS itype, 'TAXII Collection: c1' AS threat_name FROM sec WHERE k % 3 < 2")
def _(spark, sf_dir):
    return feeds.iocs_from_stix(stix(spark, sf_dir), "c1").select("indicator", "itype", "threat_name")


@SUITE.query(
    "nodes_from_stix",
    SEC + " SELECT 'indicator--' || user_id AS id, 'Indicator' AS label, arg_max(message, epoch_us(timestamp)) AS name FROM sec GROUP BY user_id UNION ALL SELECT 'actor--' || k, 'ThreatActor', "
    "arg_max(tactic, epoch_us(timestamp)) FROM sec GROUP BY k",
)
def _(spark, sf_dir):
    return G.nodes_from_stix(stix(spark, sf_dir)).select("id", "label", "name")


@SUITE.query("edges_from_stix", SEC + " SELECT DISTINCT 'indicator--' || user_id AS src, 'actor--' || k AS dst, 'indicates' AS type FROM sec")
def _(spark, sf_dir):
    return G.upsert_latest(G.edges_from_stix(stix(spark, sf_dir)), ["src", "dst", "type"], F.col("modified")).drop("modified")


@SUITE.query(
    "cve_dim_from_nvd",
    SEC + " SELECT 'CVE-2024-' || (1000 + event_id) AS cve_id, CASE WHEN k % 3 < 2 THEN (k % 10)::DOUBLE END AS cvss_score, 'acme/tool' || event_id || ',acme/other' AS products, '2024-01-05' AS "
    "published_date, 'en text ' || event_id AS description FROM sec",
)
def _(spark, sf_dir):
    m = F.array(F.struct(F.struct((F.col("k") % 10).cast("double").alias("baseScore"), F.lit("HIGH").alias("baseSeverity")).alias("cvssData")))
    cpe = lambda c: F.struct(F.concat(F.lit("cpe:2.3:a:acme:"), c, F.lit(":1.0")).alias("criteria"))
    cve = F.struct(
        F.concat(F.lit("CVE-2024-"), F.col("event_id") + 1000).alias("id"), F.lit("2024-01-05T10:00:00").alias("published"),
        F.struct(F.when(F.col("k") % 3 == 0, m).alias("cvssMetricV31"), F.when(F.col("k") % 3 == 1, m).alias("cvssMetricV2")).alias("metrics"),
        F.array(
            F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), F.concat(F.lit("en text "), "event_id").alias("value"))
        ).alias("descriptions"),
        F.array(F.struct(F.array(F.struct(F.array(cpe(F.concat(F.lit("tool"), "event_id")), cpe(F.lit("other"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    page = F.to_json(F.struct(F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities")))
    d = feeds.cve_dim_from_nvd(raw(spark, sf_dir, page, broken=False), limits=(3, 5, 5, 10), text_chars=500)
    return d.select("cve_id", "cvss_score", F.array_join("affected_products", ",").alias("products"), "published_date", "description")


def flows(spark, sf_dir):
    """Flow rows under messy headers, made of the events."""
    return sec_events(spark, sf_dir).select(
        F.col("src_port").cast("string").alias(" Source Port"), F.col("dst_port").cast("string").alias("Dst Port"),
        F.expr("CASE k % 5 WHEN 0 THEN 'Infinity' WHEN 1 THEN 'NaN' WHEN 2 THEN 'x' ELSE CAST(value AS STRING) END").alias(" Flow Bytes/s"),
        F.col("event_id").cast("string").alias("Total Fwd Packets "),
        F.expr("CASE k % 4 WHEN 0 THEN 'DoS Hulk' WHEN 1 THEN 'PortScan' WHEN 2 THEN 'BENIGN' ELSE 'new kind' END").alias(" Label"),
    )


@SUITE.query(
    "flow_features76",
    SEC + " SELECT event_id::DOUBLE AS packets, src_port::DOUBLE AS f0, dst_port::DOUBLE AS f1, CASE WHEN k % 5 > 2 THEN value ELSE 0 END AS f8, 76 AS dim, CASE k % 4 WHEN 0 THEN 'dos' WHEN 1 THEN 'port_scan' "
    "ELSE 'benign' END AS attack_class FROM sec",
)
def _(spark, sf_dir):
    c = feeds.clean_flows(flows(spark, sf_dir))
    v = c.select(feeds.flow_features76(c).alias("f"), feeds.flow_class(F.col("Label")).alias("attack_class"))
    return v.select(F.col("f")[4].alias("packets"), F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1"), F.col("f")[8].alias("f8"), F.size("f").alias("dim"), "attack_class")


# ---- tables ----


_EVENT_COLUMNS = ["event_id", "tenant_id", "timestamp", "source_type", "severity", "action", "src_ip", "dst_ip", "meta_score", "message"]


def stored_events(spark, sf_dir):
    """Path of an event table written in two batches below the shared folder."""
    path = shared_folder(spark, "events")
    ev = sec_events(spark, sf_dir).select(*_EVENT_COLUMNS)
    for half in (0, 1):
        TB.write_events(ev.where(F.col("event_id") % 2 == half), path)
    return path


@SUITE.query(
    "write_events",
    SEC + " SELECT event_id, severity, message, epoch_us(timestamp) AS us, strftime(timestamp, '%Y%m')::INT AS month FROM sec",
)
def _(spark, sf_dir):
    back = TB.read_events(spark, stored_events(spark, sf_dir))
    return back.select("event_id", "severity", "message", F.unix_micros("timestamp").alias("us"), F.col("month").cast("int").alias("month"))


@SUITE.query(
    "read_events",
    SEC + " SELECT event_id, severity FROM sec WHERE tenant_id = 'tenant-2' AND timestamp >= TIMESTAMP '2024-01-20 00:00:00' AND timestamp < TIMESTAMP '2024-01-25 00:00:00'",
)
def _(spark, sf_dir):
    return TB.read_events(spark, stored_events(spark, sf_dir), "tenant-2", "2024-01-20", "2024-01-25").select("event_id", "severity")


@SUITE.query(
    "current_table",
    SEC + " SELECT tenant_id, src_ip, arg_max(event_id, (epoch_us(timestamp), event_id)) AS event_id, arg_max(severity, (epoch_us(timestamp), event_id)) AS severity FROM sec GROUP BY 1, 2",
)
def _(spark, sf_dir):
    """Three batches that touch the same keys are merged, the second one twice."""
    table = CurrentTable(
        spark, shared_folder(spark, "current"), "tenant_id string, src_ip string, event_id bigint, timestamp timestamp, severity string", ["tenant_id", "src_ip"], ["timestamp", "event_id"]
    )
    ev = sec_events(spark, sf_dir)
    for batch in (1, 2, 2, 3):
        table.merge(ev.where(F.col("event_id") % 3 == batch - 1), batch)
    return table.read().select("tenant_id", "src_ip", "event_id", "severity")


@SUITE.query(
    "read_flow_csv",
    SEC + " SELECT event_id::DOUBLE AS packets, src_port::DOUBLE AS f0, dst_port::DOUBLE AS f1, CASE WHEN k % 5 > 2 THEN value ELSE 0 END AS f8, 76 AS dim, CASE k % 4 WHEN 0 THEN 'dos' WHEN 1 THEN 'port_scan' "
    "ELSE 'benign' END AS attack_class FROM sec",
)
def _(spark, sf_dir):
    """Two day files with differing headers, written and read as CSV."""
    path, rows = shared_folder(spark, "flows"), flows(spark, sf_dir)
    halves = [rows.where(F.col("`Total Fwd Packets `").cast("long") % 2 == half) for half in (0, 1)]
    halves[1] = halves[1].toDF(*[c.strip() for c in rows.columns])
    paths = [f"{path}/day{i}" for i in (0, 1)]
    for half, to in zip(halves, paths):
        half.write.csv(to, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    v = feeds.read_flow_csv(spark, paths)
    f = F.col("features")
    return v.select(f[4].alias("packets"), f[0].alias("f0"), f[1].alias("f1"), f[8].alias("f8"), F.size(f).alias("dim"), "attack_class")


@SUITE.query("apply_retention", SEC + f" SELECT event_id FROM sec WHERE timestamp >= {NOW} - INTERVAL 10 DAY")
def _(spark, sf_dir):
    return TB.apply_retention(sec_events(spark, sf_dir), F.expr(NOW), 10).select("event_id")


@SUITE.query(
    "purge_audit",
    SEC + ", " + AUDIT_SQL + f" SELECT category, tenant_id, count(*) AS kept FROM (SELECT category, tenant_id FROM aud WHERE NOT (timestamp < {NOW} - INTERVAL 10 DAY AND category <> 'retention') UNION ALL "
    "SELECT 'retention', 'system') GROUP BY 1, 2",
)
def _(spark, sf_dir):
    kept, _n = TB.purge_audit(audit(spark, sf_dir), F.expr(NOW), 10)
    return kept.groupBy("category", "tenant_id").agg(F.count("*").alias("kept"))


@SUITE.query("purge_audit_count", SEC + ", " + AUDIT_SQL + f" SELECT count(*) AS purged FROM aud WHERE timestamp < {NOW} - INTERVAL 10 DAY AND category <> 'retention'")
def _(spark, sf_dir):
    return TB.purge_audit(audit(spark, sf_dir), F.expr(NOW), 10)[1]


@SUITE.query("write_report_csv", SEC + " SELECT event_id, source_type, severity, action, message, meta_score FROM sec ORDER BY timestamp DESC, event_id DESC LIMIT 200")
def _(spark, sf_dir):
    path = shared_folder(spark, "report")
    TB.write_report_csv(sec_events(spark, sf_dir), path, 200)
    back = spark.read.csv(path, header=True)
    return back.select(F.col("event_id").cast("long").alias("event_id"), "source_type", "severity", "action", "message", F.col("meta_score").cast("double").alias("meta_score"))
