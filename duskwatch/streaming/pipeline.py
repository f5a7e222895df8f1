"""The scoring path as one streaming query with three chained keyed operators, and its sinks.

Events enter with a watermark. The entity state is read and updated, features and the five streams are fused, rules
and indicators are matched, sequences advance, the tenant's posture moves; the watermark passes through
all of it. Every micro-batch then goes to the sinks: event table, alerts, sequence alerts, campaign state and the current row
of each entity. A replayed batch replaces its own output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.operators import assess as A
from duskwatch.operators import intel, rules
from duskwatch.operators.sequence import ATTACK_PATTERNS, Pattern
from duskwatch.sources.current import CurrentTable
from duskwatch.sources.tables import month_of
from duskwatch.streaming.campaigns import CampaignState
from duskwatch.streaming.processors import INHERITED, with_entity_state, with_posture, with_sequences

ENTITY_ROW = (
    "tenant_id string, entity string, event_id string, timestamp timestamp, event_count bigint, events_5m bigint, events_1h bigint, "
    "unique_dst_ips bigint, unique_dst_ports bigint, sticky_campaign string, meta_score double"
)


@dataclass
class Start:
    """State the stream starts from: ``entities`` as ``final_entity_state`` gives it, ``postures`` as (tenant_id, score)."""

    entities: DataFrame | None = None
    postures: DataFrame | None = None


@dataclass
class Tables:
    """Side tables of the enrichment; each may be missing."""

    aliases: DataFrame | None = None
    registry: DataFrame | None = None
    cmdb: DataFrame | None = None
    cves: DataFrame | None = None
    exposures: DataFrame | None = None
    leases: DataFrame | None = None
    user: str = "user_name"


def enrich(events: DataFrame, tables: Tables) -> DataFrame:
    """What the scores need, as joins of the stream with side tables."""
    if tables.aliases is not None:
        events = intel.resolve_user_alias(events, tables.aliases, tables.user)
    if tables.registry is not None and tables.cmdb is not None:
        events = intel.enrich_asset_criticality(events, tables.registry, tables.cmdb, "entity")
        events = events.withColumn("src_criticality", F.col("asset_criticality"))
    return events


def enrich_batch(events: DataFrame, tables: Tables) -> DataFrame:
    """Context that needs more than a plain join; nothing in the scores depends on it."""
    if tables.leases is not None:
        events = intel.resolve_dhcp(events, tables.leases)
    if tables.cves is not None:
        events = intel.enrich_cve(events, tables.cves)
    if tables.exposures is not None:
        events = intel.enrich_exposure(events, tables.exposures)
    return events


def scored_stream(
    events: DataFrame, lateness: str = "10 minutes", patterns: list[Pattern] = ATTACK_PATTERNS, classifier: A.Scorer | None = None,
    tables: Tables | None = None, start: Start | None = None,
) -> DataFrame:
    """Every event of the stream with its state, scores, matches, completed ``sequences``, risk, response and ``posture``.

    ``events`` are flat events with an ``entity``. Null entities share one state. Rows older than ``lateness`` are dropped.
    """
    start = start or Start()
    timed = enrich(events, tables or Tables()).withWatermark("timestamp", lateness)
    state = with_entity_state(timed, start.entities, INHERITED).drop("events_before")
    matched = A.match(A.fuse(A.with_features(state), classifier))
    return A.conclude(with_posture(with_sequences(matched, patterns), initial=start.postures))


@dataclass
class Sinks:
    """Folders of the outputs; state of campaigns and current entity rows below ``path``."""

    path: str
    tables: Tables = field(default_factory=Tables)
    min_score: float = 0.3
    seed_score: float = 0.6
    buckets: int = 32

    def campaigns(self, spark) -> CampaignState:
        return CampaignState(spark, f"{self.path}/campaigns", self.buckets, self.min_score, self.seed_score)

    def entities(self, spark) -> CurrentTable:
        return CurrentTable(spark, f"{self.path}/entities", ENTITY_ROW, ["tenant_id", "entity"], ["timestamp", "event_id"], self.buckets)

    def events(self, spark) -> DataFrame:
        """All written events, with the campaign their source belongs to now."""
        rows = spark.read.parquet(f"{self.path}/events").drop("batch")
        members = self.campaigns(spark).members().select("tenant_id", F.col("node").alias("src_ip"), F.col("campaign_id").alias("_campaign"))
        suspicious = F.col("meta_score") >= self.min_score
        return rows.join(members, ["tenant_id", "src_ip"], "left").withColumn("campaign_id", F.when(suspicious, F.col("_campaign"))).drop("_campaign")

    def write(self, scored: DataFrame, batch_id: int) -> None:
        spark = scored.sparkSession
        # what the streaming operators gave is needed by five writers
        scored = scored.persist()
        try:
            rows = enrich_batch(scored, self.tables)
            put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
            put(rows.drop("features", "times_us").withColumn("month", month_of()), "events")
            put(rules.alert_candidates(rows).select("tenant_id", "event_id", "timestamp", "severity", "meta_score", "colour", "narrative"), "alerts")
            fired = scored.select("tenant_id", F.col("entity").alias("entity_key"), F.col("event_id").alias("triggering_event_id"), "timestamp", F.explode("sequences").alias("s"))
            put(fired.select("tenant_id", "entity_key", "triggering_event_id", "timestamp", "s.pattern_id", F.round(F.col("s.span_us") / 1e6, 1).alias("span_seconds")), "sequences")
            self.campaigns(spark).add(scored, batch_id + 1)
            self.entities(spark).merge(scored.withColumn("event_id", F.col("event_id").cast("string")), batch_id + 1)
        finally:
            scored.unpersist()


def start_pipeline(scored: DataFrame, sinks: Sinks, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query over ``scored_stream``; ``trigger`` is passed to Structured Streaming."""
    writer = scored.writeStream.foreachBatch(sinks.write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
