"""Registry and the view that turns the test ``events`` table into security events.

The view is a list of SQL expressions that mean the same to Spark and to DuckDB, so one text feeds
both the DataFrame and the check query.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TACTICS = [
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence",
    "privilege-escalation", "defense-evasion", "credential-access", "discovery",
    "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
]
CLASSES = [
    "benign", "dos", "ddos", "brute_force", "web_attack", "infiltration", "botnet", "port_scan",
    "sql_injection", "fuzzers", "backdoors", "exploits", "reconnaissance",
]
MESSAGES = [
    "ET MALWARE CobaltStrike Beacon Activity", "Nmap port scan detected",
    "SQL injection attempt: UNION SELECT", "mimikatz lsass access",
    "query for evil-c2.example.com", "CVE-2021-44228 jndi:ldap probe",
    "Failed password for root", "System health check completed", "ransom note dropped",
    "user login ok",
]


def case_of(expr: str, values: list[str]) -> str:
    """CASE that picks ``values[expr]`` (last value is the ELSE)."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {whens} ELSE '{values[-1]}' END"


BASE_COLUMNS = {
    "event_id": "event_id",
    "timestamp": "ts",
    "user_id": "user_id",
    "event_type": "event_type",
    "value": "value",
    "k": "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)",
}

SEC_COLUMNS = {
    "event_id": "event_id",
    "timestamp": "timestamp",
    "user_id": "user_id",
    "value": "value",
    "k": "k",
    "tenant_id": "CONCAT('tenant-', CAST(user_id % 3 AS STRING))",
    "source_type": "CASE event_type WHEN 'signup' THEN 'windows' WHEN 'error' THEN 'suricata' "
    "WHEN 'click' THEN 'zeek' WHEN 'view' THEN 'palo_alto' ELSE 'crowdstrike' END",
    "event_type": "event_type",
    "action": "CASE event_type WHEN 'signup' THEN 'authenticate' WHEN 'error' THEN 'alert' "
    "WHEN 'click' THEN 'connect' WHEN 'view' THEN 'allow' ELSE 'execute' END",
    "outcome": "CASE WHEN value < 40 THEN 'success' WHEN value < 80 THEN 'failure' ELSE 'unknown' END",
    "severity": "CASE WHEN value < 25 THEN 'info' WHEN value < 50 THEN 'low' WHEN value < 100 THEN "
    "'medium' WHEN value < 200 THEN 'high' ELSE 'critical' END",
    "src_ip": "CONCAT('10.0.', CAST(CAST(floor(user_id / 256) AS INT) AS STRING), '.', "
    "CAST(user_id % 256 AS STRING))",
    "dst_ip": "CASE k % 3 WHEN 0 THEN CONCAT('10.1.0.', CAST(k AS STRING)) WHEN 1 THEN "
    "CONCAT('198.51.100.', CAST(k AS STRING)) ELSE CONCAT('203.0.113.', CAST(k AS STRING)) END",
    "src_port": "CAST(1024 + event_id % 40000 AS INT)",
    "dst_port": "CASE k % 8 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 445 WHEN 4 "
    "THEN 3389 WHEN 5 THEN 8080 WHEN 6 THEN 53 ELSE 8443 END",
    "protocol": case_of("k % 3", ["tcp", "udp", "icmp"]),
    "bytes_out": "CAST(round(value * 100) AS BIGINT) * 1000",
    "bytes_in": "CAST(k AS BIGINT) * 100",
    "packets_in": "CAST(k AS BIGINT)",
    "packets_out": "CAST(event_id % 50 AS BIGINT)",
    "tactic": case_of("k % 14", TACTICS),
    "technique_id": "CASE WHEN k % 14 = 8 THEN 'T1046' ELSE "
    "CONCAT('T1', CAST(100 + k % 14 AS STRING)) END",
    "message": case_of("k % 10", MESSAGES),
    "raw_log": "CONCAT('raw record ', CAST(event_id AS STRING), CASE WHEN k % 10 IN (5, 8) THEN "
    "' mentions CVE-2021-44228 and CVE-2014-0160' ELSE '' END)",
    "signature_id": "CASE WHEN k % 10 < 4 THEN CONCAT('sig-', CAST(k % 10 AS STRING)) END",
    "signature_name": "CASE k % 10 WHEN 0 THEN 'Ransomware File Extension Observed' WHEN 1 THEN "
    "'Known Malicious IP Connection' END",
    "hostname": "CASE WHEN k % 4 <> 1 THEN CONCAT('host-', CAST(user_id % 40 AS STRING)) END",
    "geo_country": case_of("k % 5", ["US", "DE", "US", "BR", "CN"]),
    "meta_score": "CASE WHEN value / 200 > 1 THEN CAST(1 AS DOUBLE) ELSE value / 200 END",
    "temporal_score": "CASE WHEN value / 150 > 1 THEN CAST(1 AS DOUBLE) ELSE value / 150 END",
    "ensemble_label": case_of("k % 13", CLASSES),
    "campaign_id": "CASE WHEN value >= 100 THEN CONCAT('camp-', CAST(user_id % 7 AS STRING)) END",
    "cep_sequence_id": "CASE WHEN k % 4 = 0 THEN CONCAT('seq-', CAST(user_id % 25 AS STRING)) END",
    "is_synthetic": "k % 11 = 0",
    "process_name": case_of(
        "k % 6", ["schtasks.exe", "powershell.exe", "cmd.exe", "procdump.exe", "outlook.exe", "svchost.exe"]
    ),
    "command_line": "CASE WHEN k % 7 = 0 THEN CONCAT('Register-ScheduledTask -n t', "
    "CAST(user_id % 9 AS STRING)) WHEN k % 7 = 1 THEN 'procdump lsass.exe' ELSE 'run' END",
    "target_process": "CASE WHEN k % 10 = 3 THEN 'lsass.exe' END",
    "url": "CONCAT('http://site-', CAST(k AS STRING), '.example.com/')",
    "http_referrer": "CASE k % 9 WHEN 0 THEN 'https://mail.example.com/' WHEN 1 THEN "
    "'https://OUTLOOK.example.com/' ELSE 'https://www.example.com/' END",
}

_base_sql = ", ".join(f"{e} AS {n}" for n, e in BASE_COLUMNS.items())
_sec_sql = ", ".join(f"{e} AS {n}" for n, e in SEC_COLUMNS.items())
#: prefix of every check query over security events
SEC = f"WITH b AS (SELECT {_base_sql} FROM events), sec AS (SELECT {_sec_sql} FROM b)"

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sec_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Security-event view of the test table; unused columns are pruned down to the scan. The table's rows are dealt out to ``parts`` if given."""
    base = table(spark, sf_dir, "events")
    base = (base if parts is None else base.repartition(parts)).withColumn("ts", F.col("ts").cast("timestamp"))
    base = base.selectExpr(*[f"{e} AS {n}" for n, e in BASE_COLUMNS.items()])
    return base.selectExpr(*[f"{e} AS {n}" for n, e in SEC_COLUMNS.items()])


Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    """Queries of one theme; ``sql`` is the DuckDB twin, left out where SQL cannot say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return register
