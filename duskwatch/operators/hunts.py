"""Hunt templates and the hunt predicates.

Templates take ``now`` so that a run can be repeated. Every key holds the tenant: equal private addresses or
user ids of two tenants are two entities. Lists that could grow with a hot key (all users
behind one address) are returned as rows, not as an array.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import is_internal
from duskwatch.functions.vectors import similar_vectors
from duskwatch.operators.sequence import Pattern, Stage, match_sequence

LOGINS = ["login", "authenticate"]

# Id, name, technique, confidence, lookback hours of each template.
TEMPLATES = [
    ("HUNT-001", "Impossible Travel (T1078)", "T1078", "medium", 12),
    ("HUNT-002", "Brute Force Progression (T1110)", "T1110", "high", 6),
    ("HUNT-003", "Lateral Movement via SMB (T1021.002)", "T1021.002", "medium", 6),
    ("HUNT-004", "Exfiltration via HTTP (T1041)", "T1041", "medium", 24),
    ("HUNT-005", "C2 Beaconing Pattern (T1071.001)", "T1071.001", "medium", 6),
    ("HUNT-006", "Credential Dumping (T1003)", "T1003", "high", 24),
    ("HUNT-007", "Scheduled Task Persistence (T1053)", "T1053", "medium", 12),
    ("HUNT-008", "Phishing Link Click (T1566)", "T1566", "medium", 24),
]


def within(df: DataFrame, now: Column, hours: int) -> DataFrame:
    """Rolling lookback as a plain comparison on the time column, so it reaches the scan."""
    return df.where(F.col("timestamp") >= now - F.make_interval(hours=F.lit(hours)))


def hunt_001(df: DataFrame, now: Column, hours: int = 12, max_span_hours: int = 2) -> DataFrame:
    """Successful logins of one user from several countries inside the span.

    Aggregated per (user, country) first; what is collected per user is at most one entry per country.
    """
    rows = within(df, now, hours).where(F.col("action").isin(LOGINS) & (F.col("outcome") == "success"))
    by_country = rows.groupBy("tenant_id", "user_id", "geo_country").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    out = by_country.groupBy("tenant_id", "user_id").agg(
        F.count("geo_country").alias("unique_countries"),
        F.array_sort(F.collect_list(F.struct("geo_country", "n"))).alias("countries"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
    )
    hours_apart = F.timestamp_diff("HOUR", F.date_trunc("hour", "first_seen"), F.date_trunc("hour", "last_seen"))
    return out.where((F.col("unique_countries") > 1) & (hours_apart <= max_span_hours))


def hunt_002(df: DataFrame, now: Column, hours: int = 6, failures: int = 5) -> DataFrame:
    """Addresses with more than ``failures`` failed logins and at least one success."""
    rows = within(df, now, hours).where(F.col("action").isin(LOGINS))
    return (
        rows.groupBy("tenant_id", "src_ip")
        .agg(
            F.count_if(F.col("outcome") == "failure").alias("failures"),
            F.count_if(F.col("outcome") == "success").alias("successes"),
            F.count_distinct(F.when(F.col("outcome") == "success", F.col("user_id"))).alias("compromised_users"),
        )
        .where((F.col("failures") > failures) & (F.col("successes") > 0))
    )


def hunt_002_users(df: DataFrame, now: Column, hours: int = 6, failures: int = 5) -> DataFrame:
    """The users behind hunt_002, one row per address and user with the number of successes."""
    ok = within(df, now, hours).where(F.col("action").isin(LOGINS) & (F.col("outcome") == "success"))
    users = ok.groupBy("tenant_id", "src_ip", "user_id").agg(F.count("*").alias("successes"))
    return users.join(hunt_002(df, now, hours, failures).select("tenant_id", "src_ip"), ["tenant_id", "src_ip"], "left_semi")


def hunt_003(df: DataFrame, now: Column, hours: int = 6, fan_out: int = 5) -> DataFrame:
    rows = within(df, now, hours).where(
        (F.col("dst_port") == 445) & is_internal(F.col("src_ip")) & is_internal(F.col("dst_ip"))
    )
    return (
        rows.groupBy("tenant_id", "src_ip")
        .agg(F.count_distinct("dst_ip").alias("unique_destinations"), F.sum("bytes_out").alias("total_bytes"))
        .where(F.col("unique_destinations") >= fan_out)
    )


def _outbound_web(df: DataFrame, now: Column, hours: int) -> DataFrame:
    return within(df, now, hours).where(
        F.col("dst_port").isin(80, 443) & is_internal(F.col("src_ip")) & ~is_internal(F.col("dst_ip"))
    )


def hunt_004(df: DataFrame, now: Column, hours: int = 24, min_bytes: int = 10_485_760) -> DataFrame:
    return (
        _outbound_web(df, now, hours)
        .groupBy("tenant_id", "src_ip", "dst_ip")
        .agg(F.sum("bytes_out").alias("total_outbound_bytes"))
        .where(F.col("total_outbound_bytes") > min_bytes)
    )


def hunt_005(df: DataFrame, now: Column, hours: int = 6, min_count: int = 50) -> DataFrame:
    """Beaconing pairs with the mean age in seconds and the true mean interval.

    The sum of successive gaps telescopes to last minus first, so no ordering is needed.
    """
    age = F.unix_seconds(F.date_trunc("second", now)) - F.unix_seconds(F.date_trunc("second", F.col("timestamp")))
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return (
        _outbound_web(df, now, hours)
        .groupBy("tenant_id", "src_ip", "dst_ip")
        .agg(
            F.count("*").alias("connection_count"),
            F.avg(age).alias("avg_age_sec"),
            (span / F.when(F.count("*") > 1, F.count("*") - 1)).alias("avg_interval_sec"),
        )
        .where(F.col("connection_count") > min_count)
    )


def hunt_006(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    rows = within(df, now, hours).where(
        (F.col("action") == "process_access") & (F.col("target_process") == "lsass.exe")
    )
    return rows.groupBy("tenant_id", "hostname", "process_name").agg(F.count("*").alias("access_count"))


def hunt_007(df: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    rows = within(df, now, hours).where(
        (F.col("action") == "process_creation")
        & (F.col("process_name").ilike("%schtasks.exe%") | F.col("command_line").ilike("%Register-ScheduledTask%"))
    )
    return rows.select("tenant_id", "hostname", "process_name", "command_line").distinct()


def hunt_008(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    rows = within(df, now, hours).where(
        F.col("http_referrer").ilike("%mail%") | F.col("http_referrer").ilike("%outlook%")
    )
    return rows.groupBy("tenant_id", "src_ip", "url", "http_referrer").agg(F.count("*").alias("clicks"))


HUNTS = {
    "HUNT-001": hunt_001, "HUNT-002": hunt_002, "HUNT-003": hunt_003, "HUNT-004": hunt_004,
    "HUNT-005": hunt_005, "HUNT-006": hunt_006, "HUNT-007": hunt_007, "HUNT-008": hunt_008,
}


def _hits(df: DataFrame, now: Column, hours: int | None) -> DataFrame:
    """One row per event and template it can count for: template, tenant_id, entity, two further keys, a value to count, and measures."""
    src, dst = is_internal(F.col("src_ip")), is_internal(F.col("dst_ip"))
    login = F.col("action").isin(LOGINS)
    web = F.col("dst_port").isin(80, 443) & src & ~dst
    task = F.col("process_name").ilike("%schtasks.exe%") | F.col("command_line").ilike("%Register-ScheduledTask%")
    mail = F.col("http_referrer").ilike("%mail%") | F.col("http_referrer").ilike("%outlook%")
    none = F.lit(None)
    # condition, entity, further keys, value whose distinct number counts
    shapes = {
        "HUNT-001": (login & (F.col("outcome") == "success"), "user_id", (none, none), F.col("geo_country")),
        "HUNT-002": (login, "src_ip", (none, none), none),
        "HUNT-003": ((F.col("dst_port") == 445) & src & dst, "src_ip", (none, none), F.col("dst_ip")),
        "HUNT-004": (web, "src_ip", (F.col("dst_ip"), none), none),
        "HUNT-005": (web, "src_ip", (F.col("dst_ip"), none), none),
        "HUNT-006": ((F.col("action") == "process_access") & (F.col("target_process") == "lsass.exe"), "hostname", (F.col("process_name"), none), none),
        "HUNT-007": ((F.col("action") == "process_creation") & task, "hostname", (F.col("process_name"), F.col("command_line")), none),
        "HUNT-008": (mail, "src_ip", (F.col("url"), F.col("http_referrer")), none),
    }
    entries = []
    for hid, *_, lookback in TEMPLATES:
        cond, entity, (k2, k3), value = shapes[hid]
        recent = F.col("timestamp") >= now - F.make_interval(hours=F.lit(hours or lookback))
        fields = [F.col(entity).alias("entity"), k2.alias("k2"), k3.alias("k3"), value.alias("value")]
        entries.append(F.when(cond & recent, F.struct(F.lit(hid).alias("template"), *[f.cast("string") for f in fields])))
    longest = hours or max(t[-1] for t in TEMPLATES)
    named = ["template", "entity", "k2", "k3", "value"]
    found = F.array_compact(F.array(*[e.cast("struct<" + ",".join(f"{n}:string" for n in named) + ">") for e in entries]))
    measures = ["tenant_id", "timestamp", "bytes_out", "outcome"]
    return within(df, now, longest).select(*measures, F.explode(found).alias("h")).select(*measures, "h.*")


def run_hunts(df: DataFrame, now: Column, hours: int | None = None, **overrides: dict) -> DataFrame:
    """All templates as decision rows, one per hit, from one scan of the events.

    Events are counted per template, tenant, keys and value first, which combines before the shuffle; the values are
    counted after it. ``overrides`` change the thresholds of a template by its function's argument names.
    """
    keys = ["template", "tenant_id", "entity", "k2", "k3"]
    first = _hits(df, now, hours).groupBy(*keys, "value").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("bad"), F.count_if(F.col("outcome") == "success").alias("good"),
        F.sum("bytes_out").alias("bytes"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
    )
    group = first.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("value").alias("values"), F.sum("bytes").alias("bytes"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    arg = lambda hid, name, default: overrides.get(hid.replace("-", "_").lower(), {}).get(name, default)
    hours_apart = F.timestamp_diff("HOUR", F.date_trunc("hour", "lo"), F.date_trunc("hour", "hi"))
    limits = {
        "HUNT-001": (F.col("values") > 1) & (hours_apart <= arg("HUNT-001", "max_span_hours", 2)),
        "HUNT-002": (F.col("bad") > arg("HUNT-002", "failures", 5)) & (F.col("good") > 0),
        "HUNT-003": F.col("values") >= arg("HUNT-003", "fan_out", 5),
        "HUNT-004": F.col("bytes") > arg("HUNT-004", "min_bytes", 10_485_760),
        "HUNT-005": F.col("n") > arg("HUNT-005", "min_count", 50),
    }
    kept = F.lit(True)
    for hid, test in limits.items():
        kept = F.when(F.col("template") == hid, test).otherwise(kept)
    dim = {hid: (name, tactic, "approve" if confidence == "high" else "pending") for hid, name, tactic, confidence, _ in TEMPLATES}
    of = lambda i: F.create_map(*[F.lit(x) for hid, t in dim.items() for x in (hid, t[i])])[F.col("template")]
    return group.where(kept).select(
        "tenant_id", F.coalesce(F.when(F.col("entity") != "", F.col("entity")), F.lit("unknown")).alias("entity"), "template", of(1).alias("tactic"), of(2).alias("decision"),
        F.concat(F.lit("Hunt Match ["), of(1), F.lit("]: "), of(0), F.lit(". Entity: "), F.coalesce("entity", F.lit("unknown"))).alias("comment"),
    )


# ---- predicates ------------------------------------------------------------------------------

# Field aliases a hunt may filter on.
FIELD_ALIASES = {
    "source_type": "source_type",
    "severity": "severity",
    "source_ip": "src_ip",
    "src_ip": "src_ip",
    "tenant_id": "tenant_id",
    "action": "action",
    "message": "message",
    "event_id": "event_id",
    "campaign_id": "campaign_id",
}


def _compare(col: Column, cmp: str, value) -> Column:
    ops = {
        ">": col > value, "<": col < value, ">=": col >= value,
        "<=": col <= value, "=": col == value, "!=": col != value,
    }
    if cmp not in ops:
        raise ValueError(f"unknown comparison {cmp!r}")
    return ops[cmp]


def p_ml(cmp: str, x: float) -> Column:
    return _compare(F.col("meta_score"), cmp, x)


def p_tactic(tactic: str) -> Column:
    return F.exists(F.col("mitre_predictions"), lambda p: p["tactic"] == tactic.lower())


def p_source(source: str) -> Column:
    return F.col("source_type") == source


def p_field(name: str, cmp: str, value) -> Column:
    if name not in FIELD_ALIASES:
        raise ValueError(f"field {name!r} cannot be hunted on")
    return _compare(F.col(FIELD_ALIASES[name]), cmp, value)


# Seconds of the duration units.
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def span_seconds(text: str) -> int:
    """``90s``, ``15m``, ``2h`` or ``1d`` in seconds."""
    amount, unit = text[:-1], text[-1:]
    if not amount.isdigit() or unit not in DURATION_UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return int(amount) * DURATION_UNITS[unit]


def p_similar(vectors: DataFrame, query: Sequence[float], threshold: float = 0.75, k: int = 20, column: str = "embedding", tenant: str | None = None) -> DataFrame:
    """The ``k`` rows of ``vectors`` most like the query vector, at least ``threshold`` alike, with their score: the similarity part of a hunt."""
    return similar_vectors(vectors, query, k, threshold, tenant, column)


def hunt_with_similar(hits: DataFrame, similar: DataFrame, key: str = "event_id") -> DataFrame:
    """Hits of a hunt and of its similarity part counted together: kind, id, score."""
    row = lambda df, kind, score: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(score).alias("score"))
    return row(hits, "event", "meta_score").unionByName(row(similar, "similar", "score"))


def p_sequence(events: DataFrame, stages: Sequence[Column], entity: str = "src_ip", span: str = "900s") -> DataFrame:
    """(tenant_id, entity column, triggering_event_id, span_seconds) wherever rows of one entity meet the
    predicates in order, the last at most ``span`` after the first. Rows without the entity are skipped."""
    pattern = Pattern("p_sequence", "p_sequence", tuple(Stage(f"stage{i}", predicate=p) for i, p in enumerate(stages)), span_seconds(span))
    rows = events.where(F.col(entity) != "").withColumns({"entity": F.col(entity), "meta_score": F.coalesce("meta_score", F.lit(0.0))})
    found = match_sequence(rows, [pattern])
    return found.select("tenant_id", F.col("entity_key").alias(entity), "triggering_event_id", "span_seconds")


def hunt(events: DataFrame, tenant: str, predicates: Sequence[Column], limit: int = 100) -> DataFrame:
    """Tenant AND predicates, newest first; limit 1..1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be in 1..1000")
    out = events.where(F.col("tenant_id") == tenant)
    for p in predicates:
        out = out.where(p)
    return out.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)
