"""Multi-stage attack sequences per entity."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.folds import final_states, ordered_fold
from duskwatch.operators.segments import MAX_ROWS_PER_KEY


@dataclass(frozen=True)
class Stage:
    name: str
    tactic: str | None = None
    min_score: float = 0.0
    technique_prefix: str | None = None
    predicate: Column | None = field(default=None, compare=False)

    def test(self) -> Column:
        """Score gate AND tactic among the predictions AND technique prefix AND extra predicate."""
        out = F.coalesce(F.col("meta_score") >= self.min_score, F.lit(False))
        if self.tactic:
            tactics = F.transform(F.col("mitre_predictions"), lambda p: F.lower(p["tactic"]))
            out = out & F.coalesce(F.array_contains(tactics, self.tactic.lower()), F.lit(False))
        if self.technique_prefix:
            prefix = self.technique_prefix
            out = out & F.coalesce(
                F.exists(F.col("mitre_predictions"), lambda p: p["technique_id"].startswith(prefix)), F.lit(False)
            )
        if self.predicate is not None:
            out = out & F.coalesce(self.predicate, F.lit(False))
        return out


@dataclass(frozen=True)
class Pattern:
    id: str
    name: str
    stages: tuple[Stage, ...]
    max_span_seconds: int
    severity: str = "HIGH"
    mitre_tactic: str = ""


# The five built-in attack patterns (stages: name, tactic, minimum score, technique).
ATTACK_PATTERNS = [
    Pattern(
        "lateral-movement-classic", "Classic Lateral Movement Kill Chain",
        (Stage("discovery", "discovery", 0.5), Stage("credential_dump", "credential-access", 0.6),
         Stage("lateral_move", "lateral-movement", 0.65)),
        600, "CRITICAL", "TA0008",
    ),
    Pattern(
        "initial-access-to-persistence", "Initial Access → Execution → Persistence",
        (Stage("initial_access", "initial-access", 0.55), Stage("execution", "execution", 0.6),
         Stage("persistence", "persistence", 0.55)),
        1800, "HIGH", "TA0003",
    ),
    Pattern(
        "scan-exploit-c2", "Scan → Exploit → Command & Control",
        (Stage("network_scan", "discovery", 0.4, "T1046"), Stage("exploit", "initial-access", 0.65),
         Stage("c2_beacon", "command-and-control", 0.6)),
        900, "CRITICAL", "TA0011",
    ),
    Pattern(
        "defense-evasion-to-exfil", "Privilege Escalation → Defense Evasion → Exfiltration",
        (Stage("priv_esc", "privilege-escalation", 0.6), Stage("defense_evasion", "defense-evasion", 0.55),
         Stage("exfiltration", "exfiltration", 0.65)),
        3600, "CRITICAL", "TA0010",
    ),
    Pattern(
        "recon-to-impact", "Reconnaissance → Resource Development → Impact",
        (Stage("recon", "reconnaissance", 0.45), Stage("resource_dev", "resource-development", 0.5),
         Stage("impact", "impact", 0.7)),
        86400, "HIGH", "TA0040",
    ),
]

KEYS = ["tenant_id", "entity_key", "pattern_id"]
ORDER = ["us", "event_id"]


def hit_structs(patterns: Sequence[Pattern], own: dict[str, Sequence[Pattern]] | None = None) -> Column:
    """array<struct<pattern_id, mask, stages, span_us>> of the patterns an event fits a stage of, with a bit per fitting stage."""
    own = own or {}
    entries = []
    todo = [(p, ~F.col("tenant_id").isin(sorted(own)) if own else F.lit(True)) for p in patterns]
    todo += [(p, F.col("tenant_id") == t) for t, ps in own.items() for p in ps]
    for p, applies in todo:
        bits = [F.when(s.test(), 1 << i).otherwise(0) for i, s in enumerate(p.stages)]
        mask = reduce(lambda a, b: a + b, bits)
        entries.append(
            F.when(
                applies,
                F.struct(
                    F.lit(p.id).alias("pattern_id"), mask.cast("int").alias("mask"), F.lit(len(p.stages)).alias("stages"),
                    F.lit(p.max_span_seconds * 1_000_000).cast("long").alias("span_us"),
                ),
            )
        )
    return F.filter(F.array(*entries), lambda e: e.isNotNull() & (e["mask"] > 0))


def stage_hits(
    events: DataFrame, patterns: Sequence[Pattern], own: dict[str, Sequence[Pattern]] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per (event, pattern) that fits at least one stage, with a bit per fitting stage.

    Everything else is dropped before the shuffle. ``own`` holds the active patterns of tenants that
    have their own; those tenants do not use the defaults. ``carry`` names further columns to keep.
    """
    return events.select(
        "tenant_id", F.coalesce("entity", "tenant_id").alias("entity_key"), F.unix_micros("timestamp").alias("us"), "event_id",
        "meta_score", *carry, F.explode(hit_structs(patterns, own)).alias("h"),
    ).select("tenant_id", "entity_key", "us", "event_id", "meta_score", *carry, "h.*")


def advance(state: tuple, cols: dict[str, np.ndarray]) -> tuple[tuple, list[int], list[tuple]]:
    """Walk one key's hits: only the next stage advances, the span is measured from stage one."""
    n, t0 = state
    at, values = [], []
    rows = zip(cols["us"].tolist(), cols["mask"].tolist(), cols["stages"].tolist(), cols["span_us"].tolist())
    for i, (us, mask, stages, span) in enumerate(rows):
        if n and us - t0 > span:
            n = 0
        if mask >> n & 1:
            if n == 0:
                t0 = us
            n += 1
            if n == stages:
                at.append(i)
                values.append((us - t0,))
                n = 0
    return (n, t0 if n else 0), at, values


FOLD_COLS = ["us", "mask", "stages", "span_us"]


def pattern_table(spark, patterns: Sequence[Pattern]) -> DataFrame:
    rows = [(p.id, p.name, p.severity, p.mitre_tactic, len(p.stages), p.max_span_seconds) for p in patterns]
    return spark.createDataFrame(
        rows, "pattern_id string, pattern_name string, severity string, mitre_tactic string, stage_count int, span_seconds int"
    )


def match_sequence(
    events: DataFrame, patterns: Sequence[Pattern] = tuple(ATTACK_PATTERNS), own: dict[str, Sequence[Pattern]] | None = None,
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Alerts of fired patterns. ``events`` needs entity, timestamp, meta_score, mitre_predictions."""
    hits = stage_hits(events, patterns, own)
    fired = ordered_fold(hits, KEYS, ORDER, FOLD_COLS, (0, 0), advance, "span_us bigint", max_rows)
    every = list(patterns) + [p for ps in (own or {}).values() for p in ps]
    dim = pattern_table(events.sparkSession, list({p.id: p for p in every}.values()))
    return (
        fired.join(dim.drop("span_seconds"), "pattern_id")
        .withColumn("span_seconds", F.round(F.col("span_us") / 1e6, 1))
        .withColumnRenamed("event_id", "triggering_event_id")
        .drop("span_us")
    )


def sequence_progress(
    events: DataFrame, now: Column, patterns: Sequence[Pattern] = tuple(ATTACK_PATTERNS), max_rows: int = MAX_ROWS_PER_KEY
) -> DataFrame:
    """Patterns under way at ``now``: some but not all stages done, the first one inside the span."""
    hits = stage_hits(events.where(F.col("timestamp") <= now), patterns)
    state = final_states(hits, KEYS, ORDER, FOLD_COLS, (0, 0), advance, "done int, t0 bigint", max_rows)
    dim = pattern_table(events.sparkSession, patterns)
    live = (F.col("done") > 0) & (F.unix_micros(now) - F.col("t0") <= F.col("span_seconds").cast("long") * 1_000_000)
    return state.join(dim, "pattern_id").where(live).select(
        "tenant_id", "entity_key", "pattern_id", "severity", "done", F.col("stage_count").alias("total_stages"),
        F.round(F.col("done") / F.col("stage_count") * 100).cast("int").alias("progress_pct"),
    )


def tenant_patterns(rules: DataFrame, tenants: DataFrame, defaults: Sequence[str]) -> DataFrame:
    """Pattern ids each tenant runs: its active rules, or the defaults when it has none active."""
    active = rules.where("is_active").select("tenant_id", "id")
    without = tenants.join(active.select("tenant_id").distinct(), "tenant_id", "left_anti")
    fallback = without.select("tenant_id", F.explode(F.array(*[F.lit(d) for d in defaults])).alias("id"))
    return active.unionByName(fallback)


STAGE_COLUMNS = "tenant_id string, pattern_id string, pattern_name string, severity string, mitre_tactic string, stages int, span_us bigint, at int, tactic string, technique_prefix string, min_score double"


def pattern_stages(rules: DataFrame, defaults: Sequence[Pattern] = tuple(ATTACK_PATTERNS)) -> DataFrame:
    """A row per stage of all active tenant rules, and of the default patterns under a null tenant. Any number of rules.

    ``rules`` holds id, tenant_id, name, stages (array of name, tactic, technique_prefix, min_ml_score),
    max_span_seconds, severity, mitre_tactic and is_active; rules without a tenant or stages are ignored.
    """
    own = rules.where("is_active AND tenant_id IS NOT NULL AND size(stages) > 0").select(
        "tenant_id", F.col("id").alias("pattern_id"), F.col("name").alias("pattern_name"), "severity", "mitre_tactic", F.size("stages").alias("stages"),
        (F.col("max_span_seconds").cast("long") * 1_000_000).alias("span_us"), F.posexplode("stages").alias("at", "s"),
    )
    none = lambda c: F.when(F.col(c) != "", F.col(c))
    own = own.select(
        "tenant_id", "pattern_id", "pattern_name", "severity", "mitre_tactic", "stages", "span_us", "at", F.lower(none("s.tactic")).alias("tactic"),
        none("s.technique_prefix").alias("technique_prefix"), F.coalesce(F.col("s.min_ml_score").cast("double"), F.lit(0.0)).alias("min_score"),
    )
    rows = [
        (None, p.id, p.name, p.severity, p.mitre_tactic, len(p.stages), p.max_span_seconds * 1_000_000, i, s.tactic and s.tactic.lower(), s.technique_prefix, float(s.min_score))
        for p in defaults for i, s in enumerate(p.stages)
    ]
    return own.unionByName(rules.sparkSession.createDataFrame(rows, STAGE_COLUMNS))


def table_hits(events: DataFrame, stages: DataFrame) -> DataFrame:
    """What ``stage_hits`` gives, for patterns that are rows: events meet the stages of their tenant with one of their tactics.

    Tenants with rules of their own do not use the defaults. Threshold and technique are tested after the join; the
    planner broadcasts the stage table while it is small. Equal rows of an event count once.
    """
    scope = F.coalesce(F.concat(F.lit("t:"), F.col("tenant_id")), F.lit("default"))
    table = stages.select(
        scope.alias("_scope"), F.coalesce("tactic", F.lit("")).alias("_tactic"), "pattern_id", "stages", "span_us", "at", "technique_prefix", "min_score"
    )
    own = stages.where("tenant_id IS NOT NULL").select("tenant_id").distinct().withColumn("_own", F.lit(True))
    named = F.filter(F.transform("mitre_predictions", lambda p: F.lower(p["tactic"])), lambda t: t.isNotNull() & (t != ""))
    # a stage without a tactic stands under the empty one, which every event has
    tactics = F.array_distinct(F.concat(F.coalesce(named, F.array().cast("array<string>")), F.array(F.lit(""))))
    rows = events.where("meta_score IS NOT NULL").join(own, "tenant_id", "left").select(
        "tenant_id", F.coalesce("entity", "tenant_id").alias("entity_key"), F.unix_micros("timestamp").alias("us"), "event_id", "meta_score",
        F.col("mitre_predictions.technique_id").alias("_techniques"), F.when(F.col("_own"), scope).otherwise("default").alias("_scope"), F.explode(tactics).alias("_tactic"),
    )
    prefix = F.col("technique_prefix").isNull() | F.coalesce(F.exists("_techniques", lambda t: F.startswith(t, F.col("technique_prefix"))), F.lit(False))
    hit = rows.join(table, ["_scope", "_tactic"]).where((F.col("meta_score") >= F.col("min_score")) & prefix)
    return hit.groupBy("tenant_id", "entity_key", "us", "event_id", "pattern_id").agg(
        F.max("meta_score").alias("meta_score"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at"))).alias("mask"), F.max("stages").alias("stages"), F.max("span_us").alias("span_us")
    )


def match_sequence_rules(events: DataFrame, stages: DataFrame, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """``match_sequence`` for patterns given as rows, see ``pattern_stages``."""
    fired = ordered_fold(table_hits(events, stages), KEYS, ORDER, FOLD_COLS, (0, 0), advance, "span_us bigint", max_rows)
    own = F.coalesce(F.concat(F.lit("t:"), F.col("tenant_id")), F.lit("default"))
    dim = stages.where("at = 0").select(own.alias("_scope"), "pattern_id", "pattern_name", "severity", "mitre_tactic", F.col("stages").alias("stage_count"))
    mine = stages.where("tenant_id IS NOT NULL").select("tenant_id").distinct().withColumn("_own", F.lit(True))
    named = fired.join(mine, "tenant_id", "left").withColumn("_scope", F.when(F.col("_own"), own).otherwise("default"))
    return (
        named.join(dim, ["_scope", "pattern_id"]).withColumn("span_seconds", F.round(F.col("span_us") / 1e6, 1))
        .withColumnRenamed("event_id", "triggering_event_id").drop("span_us", "_scope", "_own")
    )


def publish_sequences(alerts: DataFrame) -> DataFrame:
    """Alert rows as JSON text for a stream sink, keyed by entity."""
    return alerts.select(
        F.col("entity_key").alias("key"),
        F.to_json(F.struct(F.lit("sequence_alert").alias("alert_type"), *alerts.columns)).alias("value"),
    )
