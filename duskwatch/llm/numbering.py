"""Global row numbers in a stated order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.components import settle


def number_rows(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with 0, 1, 2, … in ``order``, and the row count.

    Rows are range-partitioned and sorted; a row's number is the count of earlier partitions plus its
    place in its own. The sorted rows are checkpointed, so counts and rows come from the same
    ranges. Only one row per partition is summed in one task. Rows equal in ``order`` are numbered
    in any order.
    """
    keys = [f"_order{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    at = F.monotonically_increasing_id()
    placed = settle(placed.withColumn("_part", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", "_n", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    before = settle(before)
    total = before.agg(F.sum("_n")).first()[0] or 0
    return placed.join(F.broadcast(before.drop("_n")), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before"), total
