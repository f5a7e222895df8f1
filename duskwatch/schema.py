"""The canonical event, its flat table form, and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

STR, DBL, INT, LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
BOOL, TIME = T.BooleanType(), T.TimestampType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ENTITY = record(
    entity_type=STR, identifier=STR, hostname=STR, mac_address=STR, geo_country=STR, geo_city=STR, asset_criticality=DBL
)
NETWORK = record(
    src_ip=STR, src_port=INT, dst_ip=STR, dst_port=INT, protocol=STR, bytes_in=LONG, bytes_out=LONG, packets_in=LONG,
    packets_out=LONG,
)
PREDICTION = record(technique_id=STR, technique_name=STR, tactic=STR, confidence=DBL)
EVENT_SCHEMA = record(
    event_id=STR, timestamp=TIME, source_type=STR, event_category=STR, event_type=STR, action=STR, outcome=STR, severity=STR,
    message=STR, signature_id=STR, signature_name=STR,
    source_entity=ENTITY, destination_entity=ENTITY, network=NETWORK,
    behavioral_dna=record(
        ja3_hash=STR, ja3s_hash=STR, user_agent=STR, uri_entropy=DBL, request_cadence_ms=DBL, payload_entropy=DBL
    ),
    ml_scores=record(
        ensemble_score=DBL, ensemble_label=STR, vae_anomaly_score=DBL, hst_anomaly_score=DBL, temporal_score=DBL,
        adversarial_score=DBL, adversarial_timing_cov=DBL, meta_score=DBL, mitre_predictions=T.ArrayType(PREDICTION),
        shap_top_features=T.MapType(STR, DBL),
    ),
    cep_sequence_id=STR, tactic=STR, technique=STR, campaign_id=STR, posture_delta=DBL, compliance_tags=T.ArrayType(STR),
    metadata=record(
        schema_version=STR, ingest_timestamp=TIME, pipeline_duration_ms=DBL, tenant_id=STR, connector_id=STR, raw_log=STR,
        parser_name=STR, is_synthetic=BOOL,
    ),
    is_synthetic=BOOL,
)

# Closed vocabularies of the schema.
ENTITY_TYPES = ["ip", "user", "host", "domain", "process", "file", "unknown"]
ACTIONS = ["allow", "block", "drop", "alert", "deny", "authenticate", "execute", "connect", "modify", "unknown"]
OUTCOMES = ["success", "failure", "unknown"]
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def entity(kind: str | Column, identifier: Column, hostname: Column | None = None, criticality: float = 0.5) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("entity_type"), identifier.cast("string").alias("identifier"),
        (none if hostname is None else hostname).alias("hostname"), none.alias("mac_address"), none.alias("geo_country"),
        none.alias("geo_city"), F.lit(criticality).alias("asset_criticality"),
    )


def network(**fields: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    out = []
    for f in NETWORK.fields:
        value = fields.get(f.name, F.lit(None))
        if f.name.startswith(("bytes", "packets")):
            value = F.coalesce(value.cast("bigint"), zero)
        out.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*out)


def metadata(parser: str, raw: Column, tenant: Column, connector: Column | None = None) -> Column:
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("ingest_timestamp"),
        F.lit(0.0).alias("pipeline_duration_ms"), tenant.alias("tenant_id"),
        (F.lit(None).cast("string") if connector is None else connector).alias("connector_id"), raw.alias("raw_log"),
        F.lit(parser).alias("parser_name"), F.lit(False).alias("is_synthetic"),
    )


def canonical(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Project to EVENT_SCHEMA; fields not given are null, enums get their defaults."""
    default = {
        "action": F.lit("unknown"), "outcome": F.lit("unknown"), "severity": F.lit("info"), "posture_delta": F.lit(0.0),
        "is_synthetic": F.lit(False),
    }
    cols = []
    for f in EVENT_SCHEMA.fields:
        value = fields.get(f.name, default.get(f.name, F.lit(None)))
        cols.append(value.cast(f.dataType).alias(f.name))
    return df.select(*cols)


#: What the feature vector reads beyond the flat table, by its place in the nested event.
FEATURE_INPUTS = {
    "src_criticality": "source_entity.asset_criticality", "dst_criticality": "destination_entity.asset_criticality", "src_country": "source_entity.geo_country",
    "dst_country": "destination_entity.geo_country", "src_entity_type": "source_entity.entity_type", "dst_entity_type": "destination_entity.entity_type",
    "uri_entropy": "behavioral_dna.uri_entropy", "payload_entropy": "behavioral_dna.payload_entropy", "request_cadence_ms": "behavioral_dna.request_cadence_ms",
    "ja3_hash": "behavioral_dna.ja3_hash",
}


def flatten_events(events: DataFrame, feature_inputs: bool = False) -> DataFrame:
    """Nested event → flat analytical row; a missing network means null addresses and zero counters. ``feature_inputs`` adds ``FEATURE_INPUTS``."""
    zero = F.lit(0)
    num = lambda c: F.coalesce(F.col(c), zero)
    score = lambda c: F.coalesce(F.col(f"ml_scores.{c}"), F.lit(0.0)).alias(c)
    return events.select(
        "event_id", "timestamp", F.coalesce("metadata.tenant_id", F.lit("default")).alias("tenant_id"), "source_type",
        "event_category", "event_type", "action", "outcome", "severity", "message", "signature_id", "signature_name",
        F.col("source_entity.identifier").alias("source_entity"), F.col("destination_entity.identifier").alias("destination_entity"),
        F.col("source_entity.hostname").alias("hostname"),
        F.col("network.src_ip").alias("src_ip"), F.col("network.src_port").alias("src_port"),
        F.col("network.dst_ip").alias("dst_ip"), F.col("network.dst_port").alias("dst_port"),
        F.col("network.protocol").alias("protocol"),
        *[num(f"network.{c}").alias(c) for c in ("bytes_in", "bytes_out", "packets_in", "packets_out")],
        *[score(c) for c in ("ensemble_score", "vae_anomaly_score", "hst_anomaly_score", "temporal_score", "adversarial_score", "meta_score")],
        F.col("ml_scores.ensemble_label").alias("ensemble_label"),
        F.col("ml_scores.mitre_predictions").alias("mitre_predictions"),
        "cep_sequence_id", "tactic", "technique", "campaign_id", "posture_delta", "compliance_tags",
        F.col("metadata.raw_log").alias("raw_log"), F.col("metadata.parser_name").alias("parser_name"), "is_synthetic",
        *([F.col(path).alias(name) for name, path in FEATURE_INPUTS.items()] if feature_inputs else []),
    )


def validation_errors() -> Column:
    """Names of the rules an event breaks."""

    def unit(path: str) -> Column:
        c = F.col(path)
        return c.isNotNull() & ((c < 0) | (c > 1) | F.isnan(c))

    checks = {
        "timestamp": F.col("timestamp").isNull(),
        "source_type": F.coalesce("source_type", F.lit("")) == "",
        "action": ~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)),
        "outcome": ~F.coalesce(F.col("outcome").isin(OUTCOMES), F.lit(False)),
        "severity": ~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)),
    }
    for side in ("source_entity", "destination_entity"):
        kind = F.col(f"{side}.entity_type")
        checks[f"{side}.entity_type"] = F.col(side).isNotNull() & ~F.coalesce(kind.isin(ENTITY_TYPES), F.lit(False))
        checks[f"{side}.asset_criticality"] = unit(f"{side}.asset_criticality")
    for s in ("ensemble_score", "vae_anomaly_score", "hst_anomaly_score", "temporal_score", "adversarial_score", "meta_score"):
        checks[f"ml_scores.{s}"] = unit(f"ml_scores.{s}")
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def validate_events(events: DataFrame, tenant: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with ``errors``); ``tenant`` overrides the tenant inside the payload."""
    if tenant is not None:
        events = events.withColumn("metadata", F.col("metadata").withField("tenant_id", tenant))
    checked = events.withColumn("errors", validation_errors())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
