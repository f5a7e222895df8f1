"""Campaigns as a stream: connected components that grow with every micro-batch.

Two current tables hold the state. ``nodes`` keeps the component each address had when it was first seen, with its
top score; ``merged`` says into which component an older one has gone. A batch reads the components of its own
addresses, joins them over its own links, and writes only what changed, so its work follows the batch and the number
of merges, not the table. A component is named after its smallest address, as in the batch operator; any order of
batches ends in the same components.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators.campaigns import connected_components
from duskwatch.session import ensure_checkpoint_dir
from duskwatch.sources.current import CurrentTable


@dataclass
class CampaignState:
    spark: SparkSession
    path: str
    buckets: int = 32
    min_score: float = 0.3
    seed_score: float = 0.6

    @property
    def nodes(self) -> CurrentTable:
        return CurrentTable(
            self.spark, f"{self.path}/nodes", "tenant_id string, node string, root string, top double, version bigint", ["tenant_id", "node"], ["version"], self.buckets
        )

    @property
    def merged(self) -> CurrentTable:
        return CurrentTable(
            self.spark, f"{self.path}/merged", "tenant_id string, root string, component string, version bigint", ["tenant_id", "root"], ["version"], self.buckets
        )

    def _components(self, before: int | None) -> DataFrame:
        """tenant_id, node, top, first (component at first sight), component (now)."""
        nodes = self.nodes.read(before).withColumnRenamed("root", "first")
        into = self.merged.read(before).select("tenant_id", F.col("root").alias("first"), F.col("component").alias("_into"))
        return nodes.join(into, ["tenant_id", "first"], "left").withColumn("component", F.coalesce("_into", "first")).drop("_into", "version")

    def add(self, events: DataFrame, batch: int) -> None:
        """Take in one micro-batch: tenant_id, src_ip, dst_ip, meta_score."""
        ensure_checkpoint_dir(self.spark)
        linked = events.where((F.col("meta_score") >= self.min_score) & F.col("src_ip").isNotNull()).select(
            F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), F.col("src_ip").alias("a"), F.coalesce("dst_ip", "src_ip").alias("b"), "meta_score"
        )
        links = linked.groupBy("tenant_id", "a", "b").agg(F.max("meta_score").alias("top")).checkpoint()
        # the score belongs to the source: the batch operator counts an event to its source's component
        seen = links.select("tenant_id", F.col("a").alias("node"), "top").unionByName(links.select("tenant_id", F.col("b").alias("node"), F.lit(None).cast("double").alias("top")))
        seen = seen.groupBy("tenant_id", "node").agg(F.max("top").alias("_top"))
        here = seen.join(self._components(batch), ["tenant_id", "node"], "left").checkpoint()
        at = here.select("tenant_id", "node", F.coalesce("component", "node").alias("_root"))
        ends = links.select("tenant_id", "a", "b").join(at.withColumnsRenamed({"node": "a", "_root": "_a"}), ["tenant_id", "a"])
        ends = ends.join(at.withColumnsRenamed({"node": "b", "_root": "_b"}), ["tenant_id", "b"])
        found = connected_components(ends.select("tenant_id", F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()).checkpoint()
        named = at.join(found.select("tenant_id", F.col("node").alias("_root"), F.col("component").alias("_now")), ["tenant_id", "_root"])
        rows = here.join(named.select("tenant_id", "node", "_now"), ["tenant_id", "node"]).select(
            "tenant_id", "node", F.coalesce("first", "_now").alias("root"), F.greatest("top", "_top").alias("top"), F.lit(batch).cast("long").alias("version")
        )
        known = here.where("component IS NOT NULL").select("tenant_id", F.col("component").alias("root")).distinct()
        moved = known.join(found.withColumnRenamed("node", "root"), ["tenant_id", "root"]).where("root <> component").checkpoint()
        # components that had gone into a moved one go on with it
        old = self.merged.read(batch).select("tenant_id", "root", F.col("component").alias("_old"))
        onward = old.join(moved.select("tenant_id", F.col("root").alias("_old"), "component"), ["tenant_id", "_old"]).select("tenant_id", "root", "component")
        merges = moved.select("tenant_id", "root", "component").unionByName(onward).withColumn("version", F.lit(batch).cast("long"))
        self.merged.merge(merges, batch)
        self.nodes.merge(rows, batch)

    def members(self, before: int | None = None) -> DataFrame:
        """tenant_id, node, campaign_id of every address in a campaign: a component one of whose events reached the seed score."""
        all_ = self._components(before)
        top = all_.groupBy("tenant_id", "component").agg(F.max("top").alias("_top")).where(F.col("_top") >= self.seed_score)
        return all_.join(top, ["tenant_id", "component"]).select("tenant_id", "node", F.concat(F.lit("campaign-"), "component").alias("campaign_id"))

    def tag(self, events: DataFrame) -> DataFrame:
        """Suspicious events with the campaign their source belongs to now, as ``correlate_campaigns`` gives them."""
        linked = events.where((F.col("meta_score") >= self.min_score) & F.col("src_ip").isNotNull()).drop("campaign_id")
        return linked.join(self.members().withColumnRenamed("node", "src_ip"), ["tenant_id", "src_ip"])


def campaign_stream(events: DataFrame, state: CampaignState, checkpoint: str, **trigger):
    """Start a query that keeps ``state`` up to date with a stream of scored events."""
    writer = events.select("tenant_id", "src_ip", "dst_ip", "meta_score").writeStream.foreachBatch(lambda df, batch: state.add(df, batch + 1))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
