"""The 76-value feature vector as array Columns.

State columns (``before_*``) are those of ``entity_state_before``: what was known before the event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.plan import pin

# Numeric codes of categorical fields (default code last).
ENTITY_CODES = {"ip": 0.0, "user": 0.2, "host": 0.4, "domain": 0.6, "process": 0.8, "file": 1.0}
SEVERITY_CODES = {"info": 0.0, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
ACTION_CODES = {"allow": 0.0, "alert": 0.5, "block": 0.75, "drop": 0.85, "deny": 1.0}
SOURCE_CODES = {"suricata": 0.0, "zeek": 0.2, "palo_alto": 0.4, "windows": 0.6, "crowdstrike": 0.8, "syslog": 1.0}
REMOTE_PORTS = [22, 23, 3389, 5900]
DIM = 76

NETWORK_COLUMNS = ["src_port", "dst_port", "bytes_in", "bytes_out", "packets_in", "packets_out"]


def code(col: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default)


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def zeros(n: int) -> list[Column]:
    return [F.lit(0.0)] * n


def num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def share(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, a / (a + b)).otherwise(0.5)


def network_block() -> Column:
    sp, dp, bi, bo, pi, po = (num(c) for c in NETWORK_COLUMNS)
    proto = F.lower(F.coalesce("protocol", F.lit("")))
    values = F.array(
        sp, dp, bi, bo, pi, po, per(bi, pi), per(bo, po), bi + bo, pi + po, share(bi, bo), share(pi, po),
        flag(proto == "tcp"), flag(proto == "udp"), flag(dp < 1024), flag(dp.isin(REMOTE_PORTS)),
    )
    present = F.coalesce("src_ip", "dst_ip").isNotNull()
    return F.when(present, values).otherwise(F.array(*zeros(16)))


def entity_block() -> Column:
    abroad = [F.coalesce(F.col(c) != "US", F.lit(False)) & (F.col(c) != "") for c in ("src_country", "dst_country")]
    return F.array(
        F.coalesce("src_criticality", F.lit(0.5)), F.coalesce("dst_criticality", F.lit(0.5)),
        *[num(c) for c in ("p_recon", "p_cred_stuffing", "p_lateral", "p_exfil", "p_persistence")],
        num("before_event_count"),
        *[flag(F.coalesce(a, F.lit(False))) for a in abroad],
        code(F.coalesce("src_entity_type", F.lit("ip")), ENTITY_CODES, 0.0),
        code(F.coalesce("dst_entity_type", F.lit("ip")), ENTITY_CODES, 0.0),
        *zeros(4),
    )


def temporal_block() -> Column:
    hour = F.hour("timestamp")
    gap = F.greatest(
        F.lit(0.0), F.coalesce((F.unix_micros("timestamp") - F.col("before_last_seen_us")) / 1e6, F.lit(0.0))
    )
    recent = [F.when(gap <= 300, num("before_events_5m")).otherwise(0.0)] + [
        F.when(gap <= 3600, num(c)).otherwise(0.0)
        for c in ("before_events_1h", "before_unique_dst_ips", "before_unique_dst_ports")
    ]
    return F.array(
        hour.cast("double"), flag((hour < 6) | (hour > 22)), flag(F.weekday("timestamp") >= 5), gap, *recent, *zeros(8)
    )


def payload_block() -> Column:
    return F.array(
        flag(F.coalesce("signature_id", F.lit("")) != ""),
        code(F.col("severity"), SEVERITY_CODES, 0.0), code(F.col("action"), ACTION_CODES, 0.25),
        num("uri_entropy"), num("payload_entropy"), num("request_cadence_ms"),
        flag(F.coalesce("ja3_hash", F.lit("")) != ""),
        F.length(F.coalesce("message", F.lit(""))) / 500.0,
        *zeros(8),
    )


def context_block() -> Column:
    return F.array(
        code(F.col("source_type"), SOURCE_CODES, 0.5), flag(F.coalesce("campaign_id", F.lit("")) != ""),
        num("posture_delta"), *zeros(9),
    )


def features76() -> Column:
    return F.concat(network_block(), entity_block(), temporal_block(), payload_block(), context_block())


def with_features76(df: DataFrame, name: str = "features") -> DataFrame:
    """Add ``features76`` block by block: one expression for all 76 values makes a method too long for the JVM to compile."""
    blocks = {"_net": network_block, "_ent": entity_block, "_tmp": temporal_block, "_pay": payload_block, "_ctx": context_block}
    for column, block in blocks.items():
        df = pin(df, column, block())
    return df.withColumn(name, F.concat(*blocks)).drop(*blocks)


def dna128(features: Column) -> Column:
    return F.concat(features, F.array_repeat(F.lit(0.0), 128 - DIM))


#: optional inputs and their type; absent ones are added as nulls before the vector is built
OPTIONAL = {
    "src_criticality": "double", "dst_criticality": "double", "p_recon": "double", "p_cred_stuffing": "double",
    "p_lateral": "double", "p_exfil": "double", "p_persistence": "double", "src_country": "string", "dst_country": "string",
    "src_entity_type": "string", "dst_entity_type": "string", "uri_entropy": "double", "payload_entropy": "double",
    "request_cadence_ms": "double", "ja3_hash": "string", "posture_delta": "double", "before_event_count": "long",
    "before_last_seen_us": "long", "before_events_5m": "long", "before_events_1h": "long",
    "before_unique_dst_ips": "long", "before_unique_dst_ports": "long",
}


def with_optional(df):
    return df.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns})
