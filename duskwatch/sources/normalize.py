"""Vendor logs → canonical events, with dead letters.

Every source is ``normalize_<src>(raw) -> (events, dead_letters)`` where ``raw`` has a text column
``value`` and optionally ``received_at`` and ``tenant_id``. JSON is read with an explicit schema of
strings, so a wrong type is found by ``try_cast`` and routed, not nulled in silence.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.plan import pin
from duskwatch.functions.text import first_ip, mask_pii
from duskwatch.schema import canonical, entity, metadata, network

DEAD_LETTER_CHARS = 10_000
ZERO_IP = "0.0.0.0"

# Severity, action and event-id maps of the sources.
SURICATA_SEVERITY = {"1": "critical", "2": "high", "3": "medium", "4": "low"}
ZEEK_STATES = {
    "SF": ("allow", "success"), "S0": ("connect", "failure"), "REJ": ("deny", "failure"), "RSTO": ("block", "failure"),
    "RSTR": ("block", "failure"), "OTH": ("unknown", "unknown"),
}
PALO_ALTO_SEVERITY = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "info"}
PALO_ALTO_ACTION = {
    "allow": "allow", "deny": "deny", "drop": "drop", "reset-client": "block", "reset-server": "block", "reset-both": "block",
}
WINDOWS_EVENTS = [
    (4624, "auth_success", "authenticate", "success", "info"),
    (4625, "auth_failure", "authenticate", "failure", "medium"),
    (4634, "logoff", "unknown", "success", "info"),
    (4648, "explicit_cred", "authenticate", "success", "medium"),
    (4688, "process_create", "execute", "success", "low"),
    (4689, "process_exit", "execute", "success", "info"),
    (4720, "user_created", "modify", "success", "high"),
    (4722, "user_enabled", "modify", "success", "medium"),
    (4732, "group_member_added", "modify", "success", "high"),
    (7045, "service_installed", "execute", "success", "high"),
    (1102, "audit_cleared", "modify", "success", "critical"),
]
CROWDSTRIKE_SEVERITY = {"Critical": "critical", "High": "high", "Medium": "medium", "Low": "low", "Informational": "info"}
SYSLOG_SEVERITY = ["critical", "critical", "critical", "high", "medium", "low", "info", "info"]
CLOUDTRAIL_SEVERITY = {
    "ConsoleLogin": "medium", "StopLogging": "critical", "DeleteTrail": "critical", "AuthorizeSecurityGroupIngress": "high",
    "RunInstances": "medium", "CreateUser": "high", "AttachUserPolicy": "high",
}
GCP_SEVERITY = {
    "compute.instances.delete": "high", "compute.firewalls.delete": "critical", "iam.serviceAccounts.create": "high",
    "storage.buckets.delete": "critical", "logging.sinks.delete": "critical",
}
MS_SENTINEL_SEVERITY = {"high": "high", "medium": "medium", "informational": "medium", "low": "low"}
# Syslog line formats. Groups: pri, time, host, app, (pid | procid, msgid), message.
RFC5424 = r"^<(\d{1,3})>\d?\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[.*?\]\s*)?(.*)$"
RFC3164 = r"^<(\d{1,3})>(\w{3}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"


class Parsed(NamedTuple):
    """Events, and the rejected lines as (original_topic, value, error_reason)."""

    events: DataFrame
    rejected: DataFrame

    @property
    def dead_letters(self) -> DataFrame:
        """Letters of the length the format allows. Masked first: a cut through an address would leave half of it in clear."""
        return self.letters(DEAD_LETTER_CHARS)

    def letters(self, chars: int | None = None) -> DataFrame:
        """Masked dead letters, whole or cut to ``chars`` characters."""
        masked = mask_pii(F.col("value"))
        return self.rejected.select("original_topic", (masked if chars is None else F.substring(masked, 1, chars)).alias("raw_log"), "error_reason")


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    value = m[F.coalesce(key, F.lit(""))]
    return value if default is None else F.coalesce(value, F.lit(default))


def text(col: Column) -> Column:
    """Null for an empty string."""
    return F.when(col != "", col)


def as_int(col: Column) -> Column:
    return col.try_cast("bigint")


def bad_int(col: Column) -> Column:
    return col.isNotNull() & as_int(col).isNull()


def with_defaults(raw: DataFrame) -> DataFrame:
    if "received_at" not in raw.columns:
        raw = raw.withColumn("received_at", F.current_timestamp())
    if "tenant_id" not in raw.columns:
        raw = raw.withColumn("tenant_id", F.lit("default"))
    return raw


def parse_json(raw: DataFrame, ddl: str) -> DataFrame:
    """Add ``j`` (parsed fields) and ``bad`` (not a JSON object)."""
    parsed = F.from_json("value", f"{ddl}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    out = pin(with_defaults(raw), "j", parsed)
    bad = F.col("j").isNull() | F.col("j._corrupt").isNotNull() | ~F.ltrim(F.col("value")).startswith("{")
    return out.withColumn("bad", F.coalesce(bad, F.lit(True)))


def event_id(df: DataFrame, source: str) -> Column:
    """Hash of source, tenant, place and text. The place is partition and offset, or file and row, where the
    raw table has them: equal lines are then different events."""
    place = [F.col(c).cast("string") for c in ("partition", "offset", "file", "row") if c in df.columns]
    return F.sha2(F.concat_ws("|", F.lit(source), "tenant_id", *place, "value"), 256)


def reject(df: DataFrame, topic: str | Column, reason: Column) -> DataFrame:
    name = F.lit(topic) if isinstance(topic, str) else topic
    return df.select(name.alias("original_topic"), "value", reason.alias("error_reason"))


def finish(df: DataFrame, source: str, fields: dict[str, Column], extra: Column | None = None, parser: str | None = None,
           connector: Column | None = None, invalid: str = "invalid_json") -> Parsed:
    """Split into canonical events and dead letters. ``extra`` is a reason beyond malformed input."""
    reason = F.when(F.col("bad"), F.lit(invalid))
    if extra is not None:
        reason = F.coalesce(reason, extra)
    judged = df.withColumn("_reason", reason)
    good = judged.where("_reason IS NULL")
    fields = {
        "event_id": event_id(df, source),
        "source_type": F.lit(source),
        "metadata": metadata(parser or source, F.col("value"), F.col("tenant_id"), connector),
        **fields,
    }
    return Parsed(canonical(good, fields), reject(judged.where("_reason IS NOT NULL"), source, F.col("_reason")))


def iso_time(col: Column) -> Column:
    return F.try_to_timestamp(col)


def normalize_suricata(raw: DataFrame) -> Parsed:
    df = parse_json(
        raw,
        "timestamp string, event_type string, src_ip string, src_port string, dest_ip string, dest_port string, proto string, "
        "in_iface string, alert struct<action:string,severity:string,signature:string,signature_id:string,category:string>",
    )
    j, a = F.col("j"), F.col("j.alert")
    action = F.when(a["action"] == "blocked", "block").otherwise("alert")
    when = iso_time(j["timestamp"])
    src, dst = j["src_ip"], j["dest_ip"]
    extra = (
        F.when(j["timestamp"].isNotNull() & when.isNull(), "invalid_timestamp")
        .when(bad_int(j["src_port"]) | bad_int(j["dest_port"]), "invalid_port")
    )
    fields = {
        "timestamp": F.coalesce(when, "received_at"),
        "event_category": F.coalesce(j["event_type"], F.lit("unknown")),
        "event_type": a["category"],
        "action": action,
        "outcome": F.when(action == "block", "success").otherwise("unknown"),
        "severity": lookup(F.coalesce(a["severity"], F.lit("4")), SURICATA_SEVERITY, "info"),
        "message": F.coalesce(a["signature"], j["event_type"]),
        "signature_id": F.coalesce(a["signature_id"], F.lit("")),
        "signature_name": a["signature"],
        "source_entity": entity("ip", F.coalesce(src, F.lit(ZERO_IP))),
        "destination_entity": entity("ip", F.coalesce(dst, F.lit(ZERO_IP))),
        "network": network(src_ip=src, src_port=as_int(j["src_port"]), dst_ip=dst, dst_port=as_int(j["dest_port"]), protocol=j["proto"]),
    }
    return finish(df, "suricata", fields, extra, connector=j["in_iface"])


def normalize_zeek(raw: DataFrame) -> Parsed:
    df = parse_json(
        raw,
        "ts string, conn_state string, service string, proto string, `id.orig_h` string, `id.orig_p` string, `id.resp_h` string, "
        "`id.resp_p` string, orig_bytes string, resp_bytes string, orig_pkts string, resp_pkts string",
    )
    j = F.col("j")
    oh, op, rh, rp = (j[c] for c in ("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p"))
    epoch = j["ts"].try_cast("double")
    missing = j["ts"].isNull() | (epoch == 0)
    numbers = [op, rp, j["orig_bytes"], j["resp_bytes"], j["orig_pkts"], j["resp_pkts"]]
    wrong = F.lit(False)
    for c in numbers:
        wrong = wrong | bad_int(c)
    extra = F.when(j["ts"].isNotNull() & epoch.isNull(), "invalid_timestamp").when(wrong, "invalid_number")
    state = F.coalesce(j["conn_state"], F.lit("OTH"))
    hole = F.lit("?")
    fields = {
        "timestamp": F.when(missing, F.col("received_at")).otherwise(F.timestamp_micros(F.round(epoch * 1e6).cast("bigint"))),
        "event_category": F.lit("conn"),
        "event_type": j["service"],
        "action": lookup(state, {k: v[0] for k, v in ZEEK_STATES.items()}, "unknown"),
        "outcome": lookup(state, {k: v[1] for k, v in ZEEK_STATES.items()}, "unknown"),
        "severity": F.lit("info"),
        "message": F.concat(F.lit("Zeek conn: "), F.coalesce(oh, hole), F.lit(" → "), F.coalesce(rh, hole), F.lit(":"), F.coalesce(rp, hole)),
        "source_entity": entity("ip", F.coalesce(oh, F.lit(ZERO_IP))),
        "destination_entity": entity("ip", F.coalesce(rh, F.lit(ZERO_IP))),
        "network": network(
            src_ip=oh, src_port=as_int(op), dst_ip=rh, dst_port=as_int(rp), protocol=j["proto"], bytes_in=as_int(j["resp_bytes"]),
            bytes_out=as_int(j["orig_bytes"]), packets_in=as_int(j["resp_pkts"]), packets_out=as_int(j["orig_pkts"]),
        ),
    }
    return finish(df, "zeek", fields, extra)


def normalize_palo_alto(raw: DataFrame) -> Parsed:
    names = (
        "type subtype time_generated receive_time severity action src dst source_ip destination_ip sport dport proto bytes_received "
        "bytes_sent packets_received packets_sent threat_id threat_name app serial_number"
    ).split()
    df = parse_json(raw, ", ".join(f"{n} string" for n in names))
    j = F.col("j")
    numbers = ["sport", "dport", "bytes_received", "bytes_sent", "packets_received", "packets_sent"]
    wrong = F.lit(False)
    for n in numbers:
        wrong = wrong | bad_int(text(j[n]) if n.endswith("port") else j[n])
    kind = F.lower(F.coalesce(j["type"], F.lit("traffic")))
    action = lookup(F.lower(F.coalesce(j["action"], F.lit("allow"))), PALO_ALTO_ACTION, "unknown")
    src = F.coalesce(text(j["src"]), text(j["source_ip"]), F.lit(ZERO_IP))
    dst = F.coalesce(text(j["dst"]), text(j["destination_ip"]), F.lit(ZERO_IP))
    port = lambda c: F.when(as_int(j[c]) != 0, as_int(j[c]))
    fields = {
        "timestamp": F.coalesce(iso_time(F.coalesce(text(j["time_generated"]), text(j["receive_time"]))), "received_at"),
        "event_category": kind,
        "event_type": F.coalesce(j["subtype"], kind),
        "action": action,
        "outcome": F.when(action == "allow", "success").otherwise("failure"),
        "severity": lookup(F.lower(F.coalesce(j["severity"], F.lit("informational"))), PALO_ALTO_SEVERITY, "info"),
        "message": F.coalesce(text(j["threat_name"]), text(j["app"]), kind),
        "signature_id": F.coalesce(j["threat_id"], F.lit("")),
        "signature_name": j["threat_name"],
        "source_entity": entity("ip", src),
        "destination_entity": entity("ip", dst),
        "network": network(
            src_ip=src, src_port=port("sport"), dst_ip=dst, dst_port=port("dport"), protocol=F.coalesce(j["proto"], F.lit("tcp")),
            bytes_in=as_int(j["bytes_received"]), bytes_out=as_int(j["bytes_sent"]), packets_in=as_int(j["packets_received"]),
            packets_out=as_int(j["packets_sent"]),
        ),
    }
    return finish(df, "palo_alto", fields, F.when(wrong, "invalid_number"), connector=j["serial_number"])


def normalize_windows(raw: DataFrame) -> Parsed:
    schema = (
        "EventID string, System struct<TimeCreated:struct<SystemTime:string>,Computer:string>, "
        "EventData struct<TargetUserName:string,SubjectUserName:string,IpAddress:string>"
    )
    df = parse_json(raw, schema)
    j = F.col("j")
    number = F.coalesce(j["EventID"], F.lit("0"))
    by = lambda i: {str(r[0]): r[i] for r in WINDOWS_EVENTS}
    kind = lookup(number, by(1), "unknown")
    stamp = j["System"]["TimeCreated"]["SystemTime"]
    user = F.coalesce(text(j["EventData"]["TargetUserName"]), j["EventData"]["SubjectUserName"], F.lit("SYSTEM"))
    host = F.coalesce(j["System"]["Computer"], F.lit("unknown"))
    ip = text(j["EventData"]["IpAddress"])
    when = iso_time(text(stamp))
    fields = {
        "timestamp": F.coalesce(when, "received_at"),
        "event_category": F.lit("security"),
        "event_type": kind,
        "action": lookup(number, by(2), "unknown"),
        "outcome": lookup(number, by(3), "unknown"),
        "severity": lookup(number, by(4), "info"),
        "message": F.format_string("Event %s: %s by %s on %s", number, kind, user, host),
        "signature_id": number,
        "source_entity": entity("user", user, host),
        "destination_entity": entity("host", host),
        "network": F.when(ip.isNotNull(), network(src_ip=ip)),
    }
    extra = F.when(text(stamp).isNotNull() & when.isNull(), "invalid_timestamp")
    return finish(df, "windows", fields, extra, parser="windows_event")


def normalize_crowdstrike(raw: DataFrame) -> Parsed:
    names = (
        "event_simpleName EventType timestamp ProcessStartTime SeverityName ActionTaken ComputerName hostname SensorId aid "
        "DetectDescription Objective TacticId TechniqueId Tactic"
    ).split()
    df = parse_json(raw, ", ".join(f"{n} string" for n in names))
    j = F.col("j")
    kind = F.coalesce(text(j["event_simpleName"]), text(j["EventType"]), F.lit("DetectionSummaryEvent"))
    stopped = F.coalesce(F.lower(j["ActionTaken"]).rlike("block|kill|quarantine"), F.lit(False))
    host = F.coalesce(text(j["ComputerName"]), j["hostname"])
    sensor = F.coalesce(text(j["SensorId"]), j["aid"])
    who = F.coalesce(text(sensor), text(host))
    fields = {
        "timestamp": F.coalesce(iso_time(F.coalesce(text(j["timestamp"]), text(j["ProcessStartTime"]))), "received_at"),
        "event_category": F.lit("edr"),
        "event_type": kind,
        "action": F.when(stopped, "block").otherwise("alert"),
        "outcome": F.when(stopped, "success").otherwise("unknown"),
        "severity": lookup(j["SeverityName"], CROWDSTRIKE_SEVERITY, "info"),
        "message": F.coalesce(text(j["DetectDescription"]), text(j["Objective"]), kind),
        "signature_id": F.coalesce(text(j["TacticId"]), j["TechniqueId"]),
        "signature_name": j["Tactic"],
        "source_entity": F.when(who.isNotNull(), entity("host", who, host)),
    }
    return finish(df, "crowdstrike", fields, connector=sensor)


def syslog_severity(number: Column) -> Column:
    levels = F.array(*[F.lit(s) for s in SYSLOG_SEVERITY])
    return F.coalesce(F.get(levels, number.cast("int")), F.lit("info"))


def normalize_syslog_generic(raw: DataFrame, chars: int | None = None) -> Parsed:
    """JSON when it parses, else the line itself, whole or cut to ``chars``; the first two addresses become source and target."""
    df = parse_json(raw, "severity string, level string, message string, facility string, program string, hostname string")
    j, line = F.col("j"), ~F.col("bad")
    number = F.coalesce(j["severity"], j["level"], F.lit("6"))
    body = F.when(line, F.coalesce(j["message"], F.lit(""))).otherwise(F.col("value"))
    src, dst = first_ip(body, 0), first_ip(body, 1)
    short = F.col("value") if chars is None else F.substring("value", 1, chars)
    fields = {
        "timestamp": F.col("received_at"),
        "event_category": F.when(line, F.coalesce(j["facility"], F.lit("generic"))).otherwise("generic"),
        "event_type": F.when(line, j["program"]),
        "severity": F.when(line, syslog_severity(as_int(number))).otherwise("info"),
        "message": F.when(line, F.coalesce(j["message"], short)).otherwise(short),
        "source_entity": F.when(src.isNotNull(), entity("ip", src)),
        "network": F.when(src.isNotNull() | F.col("bad"), network(src_ip=src, dst_ip=dst)),
    }
    judged = df.withColumn("_wrong", line & bad_int(number))
    judged = judged.withColumn("_reason", F.when(F.col("_wrong"), "invalid_severity").when(F.col("value").isNull(), "empty"))
    good = judged.where("_reason IS NULL")
    base = {
        "event_id": event_id(df, "syslog"), "source_type": F.lit("syslog"),
        "metadata": metadata("generic_syslog", F.col("value"), F.col("tenant_id")),
    }
    return Parsed(canonical(good, {**base, **fields}), reject(judged.where("_reason IS NOT NULL"), "syslog", F.col("_reason")))


def normalize_syslog_rfc(raw: DataFrame) -> Parsed:
    """RFC 5424 first, else RFC 3164; anything else is a dead letter."""
    df = with_defaults(raw)
    v = F.col("value")
    new = v.rlike(RFC5424)
    old = v.rlike(RFC3164)

    def part(i_new: int, i_old: int) -> Column:
        return F.when(new, F.regexp_extract(v, RFC5424, i_new)).when(old, F.regexp_extract(v, RFC3164, i_old))

    df = df.withColumns(
        {
            "bad": ~F.coalesce(new | old, F.lit(False)), "pri": part(1, 1).try_cast("int"), "host": part(3, 3), "app": part(4, 4),
            "msg": part(7, 6),
        }
    )
    sev = F.col("pri").bitwiseAND(7)
    src, dst = first_ip(F.col("msg"), 0), first_ip(F.col("msg"), 1)
    fields = {
        "timestamp": F.col("received_at"),
        "event_category": F.lit("syslog"),
        "event_type": F.col("app"),
        "severity": syslog_severity(sev),
        "action": F.when(sev <= 4, "alert").otherwise("unknown"),
        "message": F.col("msg"),
        "network": F.when(src.isNotNull(), network(src_ip=src, dst_ip=dst)),
        "source_entity": entity("host", F.col("host")),
    }
    return finish(df, "syslog", fields, invalid="unparseable_syslog")


def normalize_ms_sentinel(raw: DataFrame) -> Parsed:
    """Alert with an entity list: first address is the source, the last further one the target."""
    schema = (
        "SystemAlertId string, id string, AlertDisplayName string, title string, TimeGenerated string, Severity string, "
        "CallerIpAddress string, UserPrincipalName string, NetworkProtocol string, "
        "Entities array<struct<Type:string,Address:string,HostName:string,Name:string>>"
    )
    df = parse_json(raw, schema)
    j = F.col("j")

    def of(kind: str, name: str) -> Column:
        hit = F.filter(j["Entities"], lambda e: F.lower(e["Type"]) == kind)
        return F.filter(F.transform(hit, lambda e: e[name]), lambda x: x.isNotNull())

    ips = of("ip", "Address")
    src = F.coalesce(F.get(ips, F.lit(0)), j["CallerIpAddress"])
    dst = F.when(F.size(ips) > 1, F.try_element_at(ips, F.lit(-1)))
    host = F.try_element_at(of("host", "HostName"), F.lit(-1))
    user = F.coalesce(F.try_element_at(of("account", "Name"), F.lit(-1)), j["UserPrincipalName"])
    kind = F.when(text(host).isNotNull(), "host").when(text(user).isNotNull(), "user").otherwise("ip")
    fields = {
        "timestamp": F.coalesce(iso_time(j["TimeGenerated"]), "received_at"),
        "severity": lookup(F.lower(F.coalesce(j["Severity"], F.lit("Medium"))), MS_SENTINEL_SEVERITY, "medium"),
        "message": F.coalesce(j["AlertDisplayName"], j["title"], F.lit("Microsoft Sentinel Alert")),
        "source_entity": entity(kind, F.coalesce(text(host), text(src), text(user), F.lit("unknown")), host),
        "network": F.when(
            F.coalesce(src, dst).isNotNull(), network(src_ip=src, dst_ip=dst, protocol=F.lower(F.coalesce(j["NetworkProtocol"], F.lit("tcp"))))
        ),
    }
    alert_id = F.coalesce(j["SystemAlertId"], j["id"])
    fields["event_id"] = F.coalesce(alert_id, event_id(df, "ms_sentinel"))
    return finish(df, "ms_sentinel", fields)


HEC_EVENT = "src_ip string, src string, dest_ip string, dest string, host string, message string, msg string"


def normalize_splunk_hec(raw: DataFrame, chars: int | None = None) -> Parsed:
    """Envelope with an object or a string as event; without an event the envelope is the event. The message is whole or cut to ``chars``."""
    df = parse_json(raw, f"time string, event string, sourcetype string, {HEC_EVENT}")
    j = F.col("j")
    inner = F.from_json(j["event"], HEC_EVENT)
    is_obj = F.ltrim(j["event"]).startswith("{")
    df = df.withColumn("e", F.when(j["event"].isNull(), F.struct(*[j[c.split()[0]].alias(c.split()[0]) for c in HEC_EVENT.split(", ")])).when(is_obj, inner))
    e = F.col("e")
    src = F.coalesce(e["src_ip"], e["src"])
    dst = F.coalesce(e["dest_ip"], e["dest"])
    host = F.coalesce(e["host"], j["host"], F.lit("unknown"))
    body = F.when(e.isNotNull(), F.coalesce(e["message"], e["msg"], F.lit("Splunk HEC Event"))).otherwise(j["event"])
    epoch = j["time"].try_cast("double")
    fields = {
        "timestamp": F.coalesce(F.when(epoch != 0, F.timestamp_micros(F.round(epoch * 1e6).cast("bigint"))), "received_at"),
        "source_type": F.coalesce(j["sourcetype"], F.lit("splunk_hec")),
        "severity": F.lit("low"),
        "message": body if chars is None else F.substring(body, 1, chars),
        "source_entity": entity("host", host),
        "network": F.when(F.coalesce(text(src), text(dst)).isNotNull(), network(src_ip=src, dst_ip=dst)),
    }
    return finish(df, "splunk_hec", fields)


def explode_hec_batch(bodies: DataFrame) -> DataFrame:
    """Request bodies (NDJSON or a JSON array) → one envelope row each; blank lines are dropped."""
    item = "struct<time:string,event:string,host:string,sourcetype:string>"
    listed = F.from_json("value", f"array<{item}>")
    lines = F.transform(
        F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != ""),
        lambda s: F.from_json(s, "time string, event string, host string, sourcetype string"),
    )
    is_list = F.ltrim(F.col("value")).startswith("[")
    rows = bodies.select(F.explode(F.when(is_list, listed).otherwise(lines)).alias("e")).where("e IS NOT NULL")
    return rows.select(
        F.coalesce("e.sourcetype", F.lit("splunk_hec")).alias("source_type"), F.lit("log").alias("event_category"),
        F.lit("splunk_event").alias("event_type"), F.lit("info").alias("severity"),
        F.coalesce("e.event", F.lit("{}")).alias("message"), F.coalesce("e.host", F.lit("unknown")).alias("host"),
    )


def normalize_cloudtrail(raw: DataFrame) -> Parsed:
    schema = (
        "eventName string, eventSource string, sourceIPAddress string, errorCode string, userIdentity struct<userName:string,arn:string>"
    )
    df = parse_json(raw, schema)
    j = F.col("j")
    name = F.coalesce(j["eventName"], F.lit("Unknown"))
    service = F.coalesce(j["eventSource"], F.lit("aws"))
    user = F.coalesce(text(j["userIdentity"]["userName"]), j["userIdentity"]["arn"], F.lit("unknown"))
    ip = text(j["sourceIPAddress"])
    fields = {
        "timestamp": F.col("received_at"), "event_category": F.lit("cloud"), "event_type": name,
        "severity": lookup(name, CLOUDTRAIL_SEVERITY, "info"),
        "action": F.when(name.contains("Login"), "authenticate").otherwise("execute"),
        "outcome": F.when(text(j["errorCode"]).isNotNull(), "failure").otherwise("success"),
        "message": F.concat(name, F.lit(" by "), user, F.lit(" via "), service),
        "signature_id": name, "signature_name": service,
        "network": F.when(ip.isNotNull(), network(src_ip=ip)), "source_entity": entity("user", user),
    }
    return finish(df, "aws_cloudtrail", fields)


GCP_FIELDS = (
    "methodName string, serviceName string, requestMetadata struct<callerIp:string>, "
    "authenticationInfo struct<principalEmail:string>, status struct<code:string,message:string>"
)


def normalize_gcp_audit(raw: DataFrame) -> Parsed:
    """The audit payload, wrapped in protoPayload or not."""
    schema = f"protoPayload struct<{GCP_FIELDS.replace(' string', ':string').replace(' struct', ':struct')}>, {GCP_FIELDS}"
    df = parse_json(raw, schema)
    root = F.struct(*[F.col(f"j.{n}").alias(n) for n in ("methodName", "serviceName", "requestMetadata", "authenticationInfo", "status")])
    df = df.withColumn("p", F.coalesce(F.col("j.protoPayload"), root))
    p = F.col("p")
    name = F.coalesce(p["methodName"], F.lit("unknown"))
    service = F.coalesce(p["serviceName"], F.lit("gcp"))
    who = F.coalesce(p["authenticationInfo"]["principalEmail"], F.lit("unknown"))
    ip = text(p["requestMetadata"]["callerIp"])
    failed = F.coalesce(p["status"]["code"], F.lit("0")) != "0"
    fields = {
        "timestamp": F.col("received_at"), "event_category": F.lit("cloud"), "event_type": name,
        "severity": lookup(name, GCP_SEVERITY, "info"), "action": F.lit("execute"),
        "outcome": F.when(failed, "failure").otherwise("success"),
        "message": F.concat(name, F.lit(" by "), who, F.lit(" on "), service),
        "signature_id": name, "signature_name": service,
        "network": F.when(ip.isNotNull(), network(src_ip=ip)), "source_entity": entity("user", who),
    }
    return finish(df, "gcp_audit", fields)


PARSERS: dict[str, Callable[[DataFrame], Parsed]] = {
    "suricata": normalize_suricata,
    "zeek": normalize_zeek,
    "windows": normalize_windows,
    "syslog": normalize_syslog_generic,
    "palo_alto": normalize_palo_alto,
    "crowdstrike": normalize_crowdstrike,
    "ms_sentinel": normalize_ms_sentinel,
    "splunk_hec": normalize_splunk_hec,
}


def route_and_normalize(raw: DataFrame) -> Parsed:
    """Parse each row by the last part of its ``topic``; unknown topics are dead letters.

    Each parser filters its own topic, so with raw data partitioned by topic no file is read twice.
    """
    name = F.substring_index("topic", ".", -1)
    events, lost = None, reject(raw.where(F.coalesce(~name.isin(list(PARSERS)), F.lit(True))), F.col("topic"), F.lit("no_parser_registered"))
    for source, parser in PARSERS.items():
        got = parser(raw.where(name == source))
        events = got.events if events is None else events.unionByName(got.events)
        lost = lost.unionByName(got.rejected)
    return Parsed(events, lost)
