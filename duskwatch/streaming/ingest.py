"""The whole path as one streaming query: raw topics → scored events, alerts and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.functions import scoring
from duskwatch.functions.text import canonical_identifier, mask_pii
from duskwatch.operators import intel, narrative, rules
from duskwatch.schema import flatten_events
from duskwatch.sources.normalize import route_and_normalize
from duskwatch.sources.tables import month_of


def with_canonical_source(events: DataFrame) -> DataFrame:
    """The source entity under its canonical name, by its own type."""
    name, kind = F.col("source_entity.identifier"), F.coalesce("source_entity.entity_type", F.lit("host"))
    return events.withColumn(
        "source_entity", F.when(F.col("source_entity").isNotNull(), F.col("source_entity").withField("identifier", canonical_identifier(name, kind)))
    )


def events_from_raw(raw: DataFrame) -> DataFrame:
    """Raw topics, a table or a stream, → flat events with their ``entity`` and feature inputs, as ``assess`` and ``scored_stream`` take them."""
    flat = flatten_events(with_canonical_source(route_and_normalize(raw).events), feature_inputs=True)
    return flat.withColumns({"entity": F.coalesce("source_entity", F.lit("unknown")), "asset_criticality": F.col("src_criticality")})


def score_events(events: DataFrame) -> DataFrame:
    """Events → rules, indicators, fused score, tags, response and narrative, without state: the scores are those that came with
    the event. ``streaming.pipeline.scored_stream`` over ``events_from_raw`` scores them itself.

    Entities are canonicalised by their own type. Rules and indicators read the text as it came; it is
    masked after them, before the narrative quotes it and before anything is written.
    """
    flat = flatten_events(with_canonical_source(events))
    flat = rules.match_rules(flat, mask="rule_mask").withColumn("ioc_matches", intel.ioc_match_array())
    streams = [F.col(c) for c in ("ensemble_score", "vae_anomaly_score", "hst_anomaly_score", "temporal_score", "adversarial_score")]
    flat = flat.withColumns({"meta_score": scoring.meta_score(streams), "mitre_predictions": rules.to_mitre()})
    flat = flat.withColumn("compliance_tags", rules.compliance_tags(mask="rule_mask"))
    flat = rules.recommend_response(flat, mask="rule_mask").drop("rule_mask")
    masked = flat.withColumns({c: mask_pii(F.col(c)) for c in ("message", "raw_log")})
    return masked.withColumn("narrative", narrative.narrative())


def write_batch(paths: dict[str, str]):
    """A foreachBatch writer. Output folders carry the batch id and are overwritten, so a replayed
    batch replaces its own files instead of adding to them."""

    def write(raw: DataFrame, batch_id: int) -> None:
        raw = raw.persist()
        try:
            parsed = route_and_normalize(raw)
            scored = score_events(parsed.events).withColumn("month", month_of())
            out = {"events": scored, "alerts": rules.alert_candidates(scored), "dead_letters": parsed.dead_letters}
            for name, df in out.items():
                if name in paths:
                    df.write.mode("overwrite").parquet(f"{paths[name]}/batch={batch_id}")
        finally:
            raw.unpersist()

    return write


def start_ingest(raw: DataFrame, paths: dict[str, str], checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream. ``raw`` has topic and value; ``trigger`` is passed to Structured Streaming."""
    writer = raw.writeStream.foreachBatch(write_batch(paths)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
