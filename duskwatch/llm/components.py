"""Connected components over integer nodes, and the shared-folder checkpoint every operator uses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.session import ensure_checkpoint_dir


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names: cuts lineage, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges that one task has seen: hook roots, then shortcut."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(left):
        x, y = root[left], root[right]
        open_ = x != y
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached. ``edges`` has long columns a and b.

    Large-star and small-star rounds. Minima are combined before the shuffle, a hub meets only one
    row per node in the join back, and each round is checkpointed; rounds go on until nothing changes. Nodes whose only edge is a loop
    are their own component; null ends are ignored.
    """
    pair = settle(
        edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    loops = pair.where("u = v").select(F.col("u").alias("node"))
    pair = pair.where("u <> v")
    mark = _mark(pair)
    while mark[0]:
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = settle(
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = _mark(small)
        pair = small
        if now == mark:
            break
        mark = now
    found = pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pair.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    all_ = found.unionByName(roots)
    return all_.unionByName(loops.join(all_.select("node"), "node", "left_anti").withColumn("component", F.col("node")))


def _mark(pair: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(pair.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32))).first())
