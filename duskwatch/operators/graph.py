"""Entity edges, paths and neighbourhoods as joins over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_from_events(events: DataFrame) -> DataFrame:
    """source → target rows with relationship, campaign and first/last sight."""
    return (
        events.where("src_ip IS NOT NULL AND dst_ip IS NOT NULL")
        .groupBy("tenant_id", F.col("src_ip").alias("source_entity"), F.col("dst_ip").alias("target_entity"),
                 F.col("action").alias("relationship_type"))
        .agg(
            F.max_by("campaign_id", F.when(F.col("campaign_id").isNotNull(), F.struct("timestamp", "event_id"))).alias("campaign_id"),
            F.max("meta_score").alias("confidence"),
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        )
    )


def upsert_latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last write wins per key. ``max_by`` combines before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def merge_edges(edges: DataFrame, order: Column) -> DataFrame:
    """Unique (tenant, src, dst, type) with the properties written last."""
    return upsert_latest(edges, ["tenant_id", "src", "dst", "type"], order)


def entity_paths(edges: DataFrame, tenant: str, start: str, max_depth: int = 3) -> DataFrame:
    """Simple directed paths from ``start``, depth ascending. One join per hop on the frontier's end."""
    hop = edges.where(F.col("tenant_id") == tenant).select("source_entity", "target_entity").distinct()
    frontier = hop.where(F.col("source_entity") == start).select(
        F.array("source_entity", "target_entity").alias("path"), F.col("target_entity").alias("end"), F.lit(1).alias("depth")
    ).where("path[0] <> path[1]")
    out = frontier
    for depth in range(2, max_depth + 1):
        step = frontier.join(hop, F.col("end") == F.col("source_entity")).where(
            ~F.array_contains(F.col("path"), F.col("target_entity"))
        )
        frontier = step.select(
            F.concat("path", F.array("target_entity")).alias("path"), F.col("target_entity").alias("end"), F.lit(depth).alias("depth")
        )
        out = out.unionByName(frontier)
    return out


def neighborhood(nodes: DataFrame, edges: DataFrame, tenant: str, node_id: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one tenant within ``depth`` undirected hops; each round joins only the newly reached ids."""
    if not 1 <= depth <= 5:
        raise ValueError("depth must be in 1..5")
    nodes, edges = (df.where(F.col("tenant_id") == tenant) for df in (nodes, edges))
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    ).distinct()
    seen = nodes.where(F.col("id") == node_id).select("id").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("a")).join(both, "a").select(F.col("b").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(d))
        seen = seen.unionByName(frontier)
    inner = seen.where(F.col("hops") < depth).select("id")
    ends = edges.select("*", F.explode(F.array("src", "dst")).alias("id"))
    kept = ends.join(inner, "id", "left_semi").drop("id").distinct()
    return nodes.join(seen, "id"), kept


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In plus out edges per tenant and node; isolated nodes count zero."""
    ends = edges.select("tenant_id", F.explode(F.array("src", "dst")).alias("id"))
    deg = ends.groupBy("tenant_id", "id").agg(F.count("*").alias("degree"))
    return nodes.join(deg, ["tenant_id", "id"], "left").fillna(0, ["degree"])


STIX_OBJECT = (
    "type string, id string, name string, description string, created string, modified string, pattern string, "
    "source_ref string, target_ref string, relationship_type string"
)


def stix_objects(bundles: DataFrame) -> DataFrame:
    """Objects of STIX bundles given as JSON text in ``value``."""
    parsed = F.from_json("value", f"objects array<struct<{STIX_OBJECT.replace(' string', ':string')}>>")
    return bundles.select(F.explode(parsed["objects"]).alias("o")).select("o.*")


def nodes_from_stix(objects: DataFrame) -> DataFrame:
    """Graph nodes: label is the type in title case without dashes; pattern is kept for indicators."""
    label = F.replace(F.initcap(F.replace("type", F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))
    rows = objects.where("type IS NOT NULL AND id IS NOT NULL AND type <> '' AND id <> ''").select(
        "id", label.alias("label"), "name", "description", "created", "modified",
        F.when(F.col("type") == "indicator", F.col("pattern")).alias("pattern"),
    )
    return upsert_latest(rows, ["id"], F.struct(F.coalesce("modified", F.lit("")), F.coalesce("created", F.lit(""))))


def edges_from_stix(objects: DataFrame) -> DataFrame:
    return objects.where("source_ref IS NOT NULL AND target_ref IS NOT NULL").select(
        F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"),
        F.coalesce("relationship_type", F.lit("related-to")).alias("type"), "modified",
    )
