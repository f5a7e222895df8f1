"""Campaign correlation: connected components over suspicious source–destination links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import severity_rank
from duskwatch.session import ensure_checkpoint_dir

# Kill chain order.
KILL_CHAIN = [
    "reconnaissance", "resource_development", "initial_access", "execution", "persistence",
    "privilege_escalation", "defense_evasion", "credential_access", "discovery", "lateral_movement",
    "collection", "command_and_control", "exfiltration", "impact",
]


def connected_components(edges: DataFrame) -> DataFrame:
    """(tenant_id, node, component) with the smallest node name of the component.

    Alternating large-star and small-star rounds: each hooks neighbours onto the smallest neighbour,
    so long chains collapse in a logarithmic number of rounds. Minima are combined before the
    shuffle and a hub is only ever joined back as one minimum per node; AQE splits its skewed join.
    Each round is checkpointed, and the loop runs until nothing changes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pair = edges.where("a <> b").select(
        "tenant_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct().checkpoint()
    mark = _fingerprint(pair)
    while True:
        # large star: every larger neighbour of a node hooks onto the node's minimum
        both = pair.select("tenant_id", "u", "v").unionByName(
            pair.select("tenant_id", F.col("v").alias("u"), F.col("u").alias("v"))
        )
        low = both.groupBy("tenant_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, ["tenant_id", "u"]).where("v > u").select("tenant_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node and its smaller neighbours hook onto the smallest of them
        low = large.groupBy("tenant_id", "u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, ["tenant_id", "u"]).where("v <> m").select("tenant_id", F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("tenant_id", "u", F.col("m").alias("v")))
            .distinct()
            .checkpoint()
        )
        now = _fingerprint(small)
        pair = small
        if now == mark:
            break
        mark = now
    roots = pair.select("tenant_id", F.col("v").alias("node")).distinct().select("tenant_id", "node", F.col("node").alias("component"))
    leaves = pair.select("tenant_id", F.col("u").alias("node"), F.col("v").alias("component"))
    loops = edges.where("a = b").select("tenant_id", F.col("a").alias("node")).distinct()
    joined = leaves.unionByName(roots)
    alone = loops.join(joined, ["tenant_id", "node"], "left_anti").withColumn("component", F.col("node"))
    return joined.unionByName(alone)


def _fingerprint(pair: DataFrame) -> tuple:
    h = F.xxhash64("tenant_id", "u", "v")
    r = pair.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return tuple(r)


def correlate_campaigns(events: DataFrame, min_score: float = 0.3, seed_score: float = 0.6) -> DataFrame:
    """Events that belong to a campaign. A component counts once one of its events reaches the seed score."""
    linked = events.where((F.col("meta_score") >= min_score) & F.col("src_ip").isNotNull())
    edges = linked.select("tenant_id", F.col("src_ip").alias("a"), F.coalesce("dst_ip", "src_ip").alias("b")).distinct()
    nodes = connected_components(edges).withColumnRenamed("node", "src_ip")
    tagged = linked.drop("campaign_id").join(nodes, ["tenant_id", "src_ip"])
    seeded = tagged.groupBy("tenant_id", "component").agg(F.max("meta_score").alias("_top")).where(F.col("_top") >= seed_score)
    return tagged.join(seeded.drop("_top"), ["tenant_id", "component"], "left_semi").withColumn(
        "campaign_id", F.concat(F.lit("campaign-"), "component")
    ).drop("component")


def stage_index(tactic: Column) -> Column:
    name = F.translate(F.lower(tactic), "- ", "__")
    at = F.array_position(F.array(*[F.lit(k) for k in KILL_CHAIN]), name)
    return F.when(at > 0, at - 1)


def campaign_rollup(events: DataFrame) -> DataFrame:
    """One row per campaign: furthest stage, top score, escalated severity, techniques, affected assets.

    ``mitre_predictions`` gives the tactic of the most confident prediction. Sets are built from
    distinct rows, so no group is collected; technique ids per campaign are bounded by the matrix.
    """
    top = F.reduce(
        "mitre_predictions", F.lit(None).cast("struct<confidence:double,tactic:string>"),
        lambda a, p: F.when(
            a.isNull() | (p["confidence"] > a["confidence"]),
            F.struct(p["confidence"].alias("confidence"), p["tactic"].alias("tactic")),
        ).otherwise(a),
    )
    rows = events.withColumn("_stage", stage_index(top["tactic"]))
    main = rows.groupBy("tenant_id", "campaign_id").agg(
        F.max("meta_score").alias("meta_score"),
        F.max("_stage").alias("_stage"),
        F.min_by("severity", F.struct("timestamp", "event_id")).alias("_seed_severity"),
        F.count("*").alias("events"),
        F.min("timestamp").alias("created_at"),
        F.max("timestamp").alias("updated_at"),
    )
    tech = (
        rows.select("tenant_id", "campaign_id", F.explode("mitre_predictions.technique_id").alias("t")).distinct()
        .groupBy("tenant_id", "campaign_id").agg(F.array_sort(F.collect_list("t")).alias("technique_ids"))
    )
    assets = rows.select("tenant_id", "campaign_id", F.explode(F.array("src_ip", "dst_ip")).alias("e")).groupBy(
        "tenant_id", "campaign_id"
    ).agg(F.count_distinct("e").alias("affected_assets"))
    seed = F.col("_seed_severity")
    severity = (
        F.when(F.col("meta_score") >= 0.9, "critical")
        .when((F.col("meta_score") >= 0.75) & (severity_rank(seed) < 3), "high").otherwise(seed)
    )
    stages = F.array(*[F.lit(k) for k in KILL_CHAIN])
    # without any known tactic the stage is initial_access
    stage = F.element_at(stages, (F.coalesce("_stage", F.lit(2)) + 1).cast("int"))
    return (
        main.join(tech, ["tenant_id", "campaign_id"], "left").join(assets, ["tenant_id", "campaign_id"], "left")
        .withColumn("severity", severity).withColumn("stage", stage).drop("_stage", "_seed_severity")
    )
