"""Projection into OCSF classes.

Class functions take a frame of flat fields (missing columns count as absent) and return it with an
``ocsf`` struct. ``ocsf_from_*`` parse a vendor format first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.sources.normalize import DEAD_LETTER_CHARS, Parsed, lookup, parse_json, reject, with_defaults

# Class id → (class name, category id, category name).
CLASSES = {
    3002: ("Authentication", 3, "Identity & Access Management"),
    4001: ("Network Activity", 4, "Network Activity"),
    2001: ("Security Finding", 2, "Findings"),
    1007: ("Process Activity", 1, "System Activity"),
    1001: ("File Activity", 1, "System Activity"),
    4003: ("DNS Activity", 4, "Network Activity"),
    4002: ("HTTP Activity", 4, "Network Activity"),
    6003: ("API Activity", 6, "Application Activity"),
}
SEVERITY_IDS = {"Informational": "1", "Low": "2", "Medium": "3", "High": "4", "Critical": "5"}
AUTH_APPS = ["sshd", "su", "sudo", "auth"]
RFC3164_LINE = (
    r"^<(\d+)>([A-Z][a-z]{2}\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+([a-zA-Z0-9_\-]+)(?:\[(\d+)\])?:\s+(.*)"
)
USER_RX = r"(?i)(?:for|user)\s+(invalid user\s+)?([a-zA-Z0-9_\-]+)"
FROM_RX = r"from\s+(\d+\.\d+\.\d+\.\d+)"


class Fields:
    """Optional columns of a frame, with a default and a type."""

    def __init__(self, df: DataFrame) -> None:
        self.names = set(df.columns)

    def __call__(self, name: str, default=None, dtype: str = "string") -> Column:
        col = F.col(name).cast(dtype) if name in self.names else F.lit(None).cast(dtype)
        return col if default is None else F.coalesce(col, F.lit(default).cast(dtype))


def _envelope(f: Fields, class_uid: int, message: str, **parts: Column) -> Column:
    name, cat, cat_name = CLASSES[class_uid]
    head = {
        "metadata": F.struct(F.lit("1.0.0").alias("version")),
        "class_uid": F.lit(class_uid),
        "class_name": F.lit(name),
        "category_uid": F.lit(cat),
        "category_name": F.lit(cat_name),
        "time": F.coalesce(f("timestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")),
        "message": f("message", message),
        "raw_data": f("raw_log"),
        "severity_id": f("severity", 1, "int"),
    }
    return F.struct(*[c.alias(n) for n, c in {**head, **parts}.items()])


def _ends(f: Fields, dst_port: int | None = None) -> dict[str, Column]:
    return {
        "src_endpoint": F.struct(f("source_ip").alias("ip"), f("source_port", dtype="int").alias("port")),
        "dst_endpoint": F.struct(f("destination_ip").alias("ip"), f("destination_port", dst_port, "int").alias("port")),
    }


def _hashes(f: Fields) -> Column:
    h = f("hash")
    empty = F.array().cast("array<struct<algorithm:string,value:string>>")
    return F.when(h != "", F.array(F.struct(F.lit("SHA-256").alias("algorithm"), h.alias("value")))).otherwise(empty)


def ocsf_authentication(df: DataFrame) -> DataFrame:
    f = Fields(df)
    return df.withColumn(
        "ocsf",
        _envelope(
            f, 3002, "", user=F.struct(f("user", "Unknown").alias("name"), f("domain").alias("domain")),
            src_endpoint=F.struct(f("source_ip").alias("ip")), activity_id=f("activity_id", 0, "int"), status=f("status", "Unknown"),
        ),
    )


def ocsf_network(df: DataFrame) -> DataFrame:
    f = Fields(df)
    info = F.struct(f("protocol").alias("protocol_name"))
    return df.withColumn("ocsf", _envelope(f, 4001, "", **_ends(f), connection_info=info))


def ocsf_finding(df: DataFrame) -> DataFrame:
    f = Fields(df)
    finding = F.struct(
        F.coalesce(f("rule_name"), f("signature"), F.lit("Unknown Finding")).alias("title"),
        F.coalesce(f("rule_id"), f("signature_id")).alias("uid"), f("description").alias("desc"),
    )
    return df.withColumn("ocsf", _envelope(f, 2001, "Security Alert", finding=finding, **_ends(f), state_id=F.lit(1)))


def ocsf_process(df: DataFrame) -> DataFrame:
    f = Fields(df)
    process = F.struct(
        f("process_name").alias("name"), f("process_id").alias("pid"), f("command_line").alias("cmd_line"),
        F.struct(f("process_path").alias("path"), _hashes(f).alias("hashes")).alias("file"),
    )
    return df.withColumn(
        "ocsf",
        _envelope(
            f, 1007, "Process Event", process=process, actor=F.struct(F.struct(f("user", "Unknown").alias("name")).alias("user")),
            device=F.struct(f("hostname").alias("hostname")), activity_id=f("activity_id", 1, "int"),
        ),
    )


def ocsf_file(df: DataFrame) -> DataFrame:
    f = Fields(df)
    actor = F.struct(
        F.struct(f("user", "Unknown").alias("name")).alias("user"),
        F.struct(f("process_name").alias("name"), f("process_id").alias("pid")).alias("process"),
    )
    file = F.struct(f("file_name").alias("name"), f("file_path").alias("path"), _hashes(f).alias("hashes"))
    return df.withColumn(
        "ocsf",
        _envelope(f, 1001, "File Event", file=file, actor=actor, device=F.struct(f("hostname").alias("hostname")), activity_id=f("activity_id", 1, "int")),
    )


def ocsf_dns(df: DataFrame) -> DataFrame:
    """``answers`` is array<string>; activity 1 when a query name is present, else 2."""
    f = Fields(df)
    answers = F.col("answers") if "answers" in df.columns else F.array().cast("array<string>")
    listed = F.transform(F.coalesce(answers, F.array().cast("array<string>")), lambda a: F.struct(a.alias("data")))
    return df.withColumn(
        "ocsf",
        _envelope(
            f, 4003, "DNS Query", query=F.struct(f("query").alias("hostname"), f("query_type", "A").alias("type")), answers=listed,
            src_endpoint=F.struct(f("source_ip").alias("ip")), dst_endpoint=F.struct(f("destination_ip").alias("ip")),
            activity_id=F.when(f("query") != "", 1).otherwise(2),
            status=F.when(f("rcode", 0, "int") == 0, "Success").otherwise("Failure"),
        ),
    )


def ocsf_http(df: DataFrame) -> DataFrame:
    f = Fields(df)
    request = F.struct(
        f("http_method", "GET").alias("http_method"), F.struct(f("url", "/").alias("path"), f("hostname").alias("hostname")).alias("url"),
        f("user_agent").alias("user_agent"),
    )
    return df.withColumn(
        "ocsf",
        _envelope(
            f, 4002, "HTTP Request", http_request=request, http_response=F.struct(f("status_code", 200, "int").alias("code")),
            src_endpoint=F.struct(f("source_ip").alias("ip")),
            dst_endpoint=F.struct(f("destination_ip").alias("ip"), f("destination_port", 80, "int").alias("port")),
        ),
    )


def ocsf_api(df: DataFrame) -> DataFrame:
    f = Fields(df)
    return df.withColumn(
        "ocsf",
        _envelope(
            f, 6003, "API Call", api=F.struct(f("event_name").alias("operation"), F.struct(f("service").alias("name")).alias("service")),
            actor=F.struct(F.struct(f("user", "Unknown").alias("name"), f("account_id").alias("account")).alias("user")),
            src_endpoint=F.struct(f("source_ip").alias("ip")), status=f("status", "Unknown"),
            error=F.struct(f("error_code").alias("code"), f("error_message").alias("message")),
        ),
    )


def ocsf_from_syslog(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authentication rows, network rows) of RFC 3164 lines; other lines match neither."""
    line = F.trim("value")
    df = with_defaults(raw).where(line.rlike(RFC3164_LINE))
    df = df.withColumns(
        {
            "hostname": F.regexp_extract(line, RFC3164_LINE, 3), "app_name": F.regexp_extract(line, RFC3164_LINE, 4),
            "message": F.regexp_extract(line, RFC3164_LINE, 6), "raw_log": F.col("value"),
            "timestamp": F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
        }
    )
    is_auth = F.lower("app_name").isin(AUTH_APPS)
    failed = F.col("message").contains("Failed") | F.col("message").contains("Invalid")
    found = lambda rx, i: F.when(F.col("message").rlike(rx), F.regexp_extract("message", rx, i))
    auth = df.where(is_auth).withColumns(
        {
            "status": F.when(failed, "Failure").otherwise("Success"), "severity": F.when(failed, 3).otherwise(1), "activity_id": F.lit(1),
            "user": found(USER_RX, 2), "source_ip": found(FROM_RX, 1),
        }
    )
    return ocsf_authentication(auth), ocsf_network(df.where(~is_auth))


def guardduty_severity(value: Column) -> Column:
    return F.when(value >= 9, 5).when(value >= 7, 4).when(value >= 4, 3).when(value >= 1, 2).otherwise(1)


def ocsf_from_guardduty(raw: DataFrame) -> DataFrame:
    df = parse_json(raw, "id string, type string, title string, description string, createdAt string, severity string").where("NOT bad")
    j = F.col("j")
    sev = j["severity"].try_cast("double")
    return ocsf_finding(
        df.where(sev.isNotNull()).select(
            "value", j["createdAt"].alias("timestamp"), j["title"].alias("message"), j["type"].alias("rule_name"), j["id"].alias("rule_id"),
            j["description"].alias("description"), guardduty_severity(sev).alias("severity"), F.col("value").alias("raw_log"),
        )
    )


def ocsf_from_azure_ad(raw: DataFrame) -> DataFrame:
    df = parse_json(
        raw,
        "createdDateTime string, userPrincipalName string, appDisplayName string, ipAddress string, status struct<errorCode:string>",
    ).where("NOT bad")
    j = F.col("j")
    code = F.coalesce(j["status"]["errorCode"], F.lit("0"))
    return ocsf_authentication(
        df.select(
            "value", j["createdDateTime"].alias("timestamp"), F.format_string("Sign-in to %s - Code %s", j["appDisplayName"], code).alias("message"),
            j["userPrincipalName"].alias("user"), j["ipAddress"].alias("source_ip"), F.lit(1).alias("activity_id"),
            F.when(code == "0", "Success").otherwise("Failure").alias("status"), F.when(code == "0", 1).otherwise(3).alias("severity"),
            F.col("value").alias("raw_log"),
        )
    )


def ocsf_from_defender(raw: DataFrame) -> DataFrame:
    df = parse_json(
        raw, "id string, title string, description string, severity string, alertCreationTime string, computerDnsName string"
    ).where("NOT bad")
    j = F.col("j")
    return ocsf_finding(
        df.select(
            "value", j["alertCreationTime"].alias("timestamp"), j["title"].alias("message"), j["title"].alias("rule_name"), j["id"].alias("rule_id"),
            j["description"].alias("description"), j["computerDnsName"].alias("hostname"),
            lookup(j["severity"], SEVERITY_IDS, "1").cast("int").alias("severity"), F.col("value").alias("raw_log"),
        )
    )


_ALERT = "id string, name string, description string, severity string, timeGenerated string, providerAlertId string, entities array<struct<kind:string,Type:string,hostName:string,name:string,address:string>>"


def ocsf_from_ms_sentinel(raw: DataFrame) -> DataFrame:
    """Alert at the root or under ``properties``; first host, user and address entity."""
    nested = _ALERT.replace(" array", ":array").replace(" string", ":string")
    df = parse_json(raw, f"properties struct<{nested}>, {_ALERT}").where("NOT bad")
    root = F.struct(*[F.col(f"j.{n}").alias(n) for n in ("id", "name", "description", "severity", "timeGenerated", "providerAlertId", "entities")])
    df = df.withColumn("a", F.coalesce("j.properties", root))
    a = F.col("a")

    def first(kinds: list[str], field: str) -> Column:
        return F.get(F.filter(a["entities"], lambda e: F.lower(F.coalesce(e["kind"], e["Type"], F.lit(""))).isin(kinds)), F.lit(0))[field]

    key = F.when(a["severity"] != "", F.initcap(a["severity"])).otherwise("Low")
    return ocsf_finding(
        df.select(
            "value", F.coalesce(a["timeGenerated"], F.col("j.timeGenerated"), F.lit("")).alias("timestamp"), a["name"].alias("message"),
            a["name"].alias("rule_name"), F.coalesce(F.when(a["providerAlertId"] != "", a["providerAlertId"]), a["id"]).alias("rule_id"),
            a["description"].alias("description"), lookup(key, SEVERITY_IDS, "1").cast("int").alias("severity"),
            first(["host", "hostname"], "hostName").alias("hostname"), first(["account", "user"], "name").alias("user"),
            first(["ip"], "address").alias("ip"), F.col("value").alias("raw_log"),
        )
    )


def _outcome(failed: Column) -> list[Column]:
    return [F.when(failed, "Failure").otherwise("Success").alias("status"), F.when(failed, 3).otherwise(1).alias("severity")]


def ocsf_from_cloudtrail(raw: DataFrame) -> DataFrame:
    df = parse_json(
        raw,
        "eventTime string, eventName string, eventSource string, sourceIPAddress string, errorCode string, errorMessage string, "
        "recipientAccountId string, userIdentity struct<arn:string,userName:string>",
    ).where("NOT bad")
    j = F.col("j")
    return ocsf_api(
        df.select(
            "value", j["eventTime"].alias("timestamp"), j["eventName"].alias("event_name"), j["eventSource"].alias("service"),
            j["sourceIPAddress"].alias("source_ip"), j["errorCode"].alias("error_code"), j["errorMessage"].alias("error_message"),
            F.coalesce(F.when(j["userIdentity"]["arn"] != "Unknown", j["userIdentity"]["arn"]), j["userIdentity"]["userName"]).alias("user"),
            j["recipientAccountId"].alias("account_id"), *_outcome(F.coalesce(j["errorCode"] != "", F.lit(False))), F.col("value").alias("raw_log"),
        )
    )


def ocsf_from_gcp(raw: DataFrame) -> DataFrame:
    df = parse_json(
        raw,
        "timestamp string, receiveTimestamp string, severity string, resource struct<labels:struct<project_id:string>>, protoPayload "
        "struct<methodName:string,serviceName:string,authenticationInfo:struct<principalEmail:string>,requestMetadata:struct<callerIp:string>,"
        "status:struct<code:string,message:string>>",
    ).where("NOT bad")
    j, p = F.col("j"), F.col("j.protoPayload")
    severe = F.coalesce(j["severity"].isin("ERROR", "CRITICAL"), F.lit(False))
    code = F.when(severe, j["severity"]).otherwise(F.when(p["status"]["code"] != "0", p["status"]["code"]))
    failed = code.isNotNull() | F.coalesce(p["status"]["message"] != "", F.lit(False))
    return ocsf_api(
        df.select(
            "value", F.coalesce(j["timestamp"], j["receiveTimestamp"]).alias("timestamp"), p["methodName"].alias("event_name"),
            p["serviceName"].alias("service"), p["authenticationInfo"]["principalEmail"].alias("user"),
            p["requestMetadata"]["callerIp"].alias("source_ip"), code.alias("error_code"), p["status"]["message"].alias("error_message"),
            j["resource"]["labels"]["project_id"].alias("account_id"), *_outcome(failed), F.col("value").alias("raw_log"),
        )
    )


#: Sources of the OCSF mappers by their name in dead letters: mapper, and a test beyond malformed JSON with its reason.
OCSF_SOURCES = {
    "guardduty": ("severity string", lambda j: F.when(j["severity"].try_cast("double").isNull(), "invalid_severity")),
    "azure_ad": ("createdDateTime string", None),
    "defender": ("id string", None),
    "ms_sentinel": ("id string", None),
    "cloudtrail": ("eventTime string", None),
    "gcp_audit": ("timestamp string", None),
}


def ocsf_dead_letters(raw: DataFrame, source: str, chars: int | None = DEAD_LETTER_CHARS) -> DataFrame:
    """What ``ocsf_from_<source>`` leaves out: original_topic, masked raw_log, error_reason. Syslog lines that are none count as well."""
    if source == "syslog":
        line = F.trim("value")
        lost = reject(with_defaults(raw).where(~F.coalesce(line.rlike(RFC3164_LINE), F.lit(False))), source, F.lit("invalid_syslog"))
    else:
        ddl, test = OCSF_SOURCES[source]
        df = parse_json(raw, ddl)
        reason = F.when(F.col("bad"), "invalid_json")
        if test is not None:
            reason = F.coalesce(reason, test(F.col("j")))
        lost = reject(df.withColumn("_reason", reason).where("_reason IS NOT NULL"), source, F.col("_reason"))
    return Parsed(raw.limit(0), lost).letters(chars)
