"""Mixing sources to target weights by hash-threshold histograms; Columns only.

Every row has a 60-bit hash of its id and text. Words are summed by source and the first bits of the
hash; running sums show in which bucket a source's budget ends. Only rows of those buckets
are summed again by the next bits, and last by the whole hash. The result is one threshold
per source and pass: a row is taken once for each pass whose threshold is above its hash.
Thresholds of later passes lie below earlier ones, so the passes are nested. Nothing is sorted
but the histograms, and the same input gives the same mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.numbering import number_rows

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVELS = (12, 16, 32)
#: Sources up to which their table is broadcast; beyond it Spark joins by shuffle and splits the hot source.
BROADCAST_ROWS = 100_000


def row_hash() -> Column:
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    return F.conv(F.substring(F.md5(F.concat_ws("|", ident, F.coalesce(F.md5("text"), F.lit("none")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds weight and target to (source, source_size): shares by weight, cut at ``cap`` times the size, the excess shared again."""
    ranked, _ = number_rows(sources, [F.col("source").isNull(), F.col("source")], "number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    ranked = settle(ranked.withColumn("weight", weight))
    most = cap * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = most < level * F.col("weight")
        fixed, free, count = ranked.agg(
            F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)
        ).first()
        if count == full or not free:
            break
        full, level = count, max(level, (total - fixed) / free)
    return ranked.withColumn("target", F.round(F.least(most, F.lit(level) * F.col("weight")), 6))


def _boundary(histogram: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows of the bucket in which the rest of the budget ends; ``rest`` becomes what is left for that bucket."""
    upto = F.sum("words").over(Window.partitionBy(*keys).orderBy(bucket))
    run = histogram.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("words"))
    return run.where("_before < rest AND rest <= _upto").withColumn("rest", F.col("rest") - F.col("_before")).drop("_upto", "_before")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, keep: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, times, taken.

    Size counts words; null and empty texts have 0. Sources are ordered by code point, null last and
    a source of its own; weights repeat along that order. ``taken`` = size x times. Rows equal
    in id and text have one hash and are taken together. A source without words has target 0
    and is not taken. ``keep`` names further columns to carry along.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), row_hash().alias("_hash"), *(keep or []))
    narrow = settle(rows.select("doc_id", "source", "size", "_hash")) if not keep else None
    base = narrow if narrow is not None else rows
    slim = narrow if narrow is not None else settle(rows.select("source", "size", "_hash"))
    sources = settle(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    small = sources.count() <= BROADCAST_ROWS

    def join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, on)

    def tag(df: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return df.join(F.broadcast(right) if small else right, df["source"].eqNullSafe(F.col("_source"))).drop("_source")

    passes = [(p, F.least(F.greatest(F.col("target") - p * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double"))) for p in range(math.ceil(cap))]
    budgets = sources.select("number", "source_size", F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), b.alias("rest")) for p, b in passes])).alias("_b"))
    budgets = budgets.select("number", "source_size", "_b.*")
    open_ = budgets.where("rest > 0 AND rest < source_size").drop("source_size")

    tagged = tag(slim, sources.select("source", "number")).select("number", "size", "_hash")
    a, b, _ = LEVELS
    first, second = F.shiftright("_hash", HASH_BITS - a), F.shiftright("_hash", HASH_BITS - a - b)
    one = settle(_boundary(join(tagged.groupBy("number", first.alias("b")).agg(F.sum("size").alias("words")), open_, ["number"]), ["number", "pass"], "b").drop("words"))
    inside = join(tagged.withColumn("b", first), one, ["number", "b"])
    two = inside.groupBy("number", "pass", "rest", second.alias("b")).agg(F.sum("size").alias("words"))
    two = settle(_boundary(two, ["number", "pass"], "b").drop("words"))
    inside = join(tagged.withColumn("b", second), two, ["number", "b"])
    three = inside.groupBy("number", "pass", "rest", F.col("_hash").alias("b")).agg(F.sum("size").alias("words"))
    last = _boundary(three, ["number", "pass"], "b")
    # the last row is taken if that brings the sum nearer to the budget
    cut = last.select("number", "pass", F.when(F.col("words") - F.col("rest") <= F.col("rest"), F.col("b") + 1).otherwise(F.col("b")).alias("cut"))
    edge = budgets.join(cut, ["number", "pass"], "left").withColumn(
        "cut", F.when(F.col("rest") <= 0, 0).when(F.col("rest") >= F.col("source_size"), 1 << HASH_BITS).otherwise(F.col("cut"))
    )
    cuts = edge.groupBy("number").agg(*[F.max(F.when(F.col("pass") == p, F.col("cut"))).alias(f"_cut{p}") for p, _ in passes])
    limits = settle(sources.join(cuts, "number").select("source", "source_size", "target", *[f"_cut{p}" for p, _ in passes]))
    times = sum((F.when(F.col("_hash") < F.col(f"_cut{p}"), 1).otherwise(0) for p, _ in passes), F.lit(0))
    done = tag(base, limits).withColumn("times", times.cast("int"))
    return done.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), *(keep or []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as it is taken."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    taken = mix_sources(packed, keep=["_row"], **options).where("times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")
