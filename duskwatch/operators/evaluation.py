"""Model evaluation and analyst feedback."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.operators.segments import KEY, SEG, segmented

# Minimum F1 per class for release.
EXIT_F1 = {"sql_injection": 0.55, "infiltration": 0.55, "exploits": 0.50, "ddos": 0.60}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from (label, prediction).

    The confusion table is at most classes² rows; every count is combined before the shuffle.
    """
    confusion = pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    cells = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("tp")),
            )
        ).alias("c")
    ).select("c.*")
    s = cells.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return s.withColumn("f1", ratio(2 * p * r, p + r)).select("class", "precision", "recall", "f1", "support")


def weighted_metrics(per_class: DataFrame) -> DataFrame:
    total = F.sum("support")
    return per_class.agg(
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )


def exit_criteria(per_class: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """PASS / FAIL / NO_DATA for each gated class."""
    t = thresholds or EXIT_F1
    dim = per_class.sparkSession.createDataFrame(list(t.items()), "class string, threshold double")
    out = dim.join(per_class, "class", "left")
    status = (
        F.when(F.coalesce("support", F.lit(0)) == 0, "NO_DATA").when(F.col("f1") >= F.col("threshold"), "PASS").otherwise("FAIL")
    )
    return out.select("class", "threshold", F.coalesce("f1", F.lit(0.0)).alias("f1"), status.alias("status"))


def benign_fpr(pred: DataFrame, benign: str = "benign") -> DataFrame:
    """Share of benign rows predicted as an attack."""
    truth = F.col("label") == benign
    fp = F.count_if(truth & (F.col("prediction") != benign))
    return pred.agg(ratio(fp, F.count_if(truth)).alias("fpr"))


def weighted_auc(scored: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """One-vs-rest AUC per class by rank sums, and the class count; rows are (label, probs map).

    Scores are first counted per (class, score, truth), so ties become one row and the running sum
    runs over distinct scores only, split over segments when a class has very many of them.
    """
    long = scored.select("label", F.explode("probs").alias("class", "p"))
    counts = long.groupBy("class", F.col("p").alias("score")).agg(
        F.count_if(F.col("label") == F.col("class")).alias("pos"), F.count_if(F.col("label") != F.col("class")).alias("neg")
    )
    seg = segmented(counts, ["class"], ["score"], max_rows).running(sums={"neg_cum": F.col("neg")})
    below = F.col("neg_cum") - F.col("neg")
    agg = seg.df.groupBy("class").agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return agg.where("pos > 0 AND neg > 0").select("class", (F.col("u") / (F.col("pos") * F.col("neg"))).alias("auc"), "pos")


def auc_summary(per_class: DataFrame) -> DataFrame:
    return per_class.agg((F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("weighted_auc"))


def time_split(buffer: DataFrame, train_share: float = 0.8, max_rows: int = 2_000_000) -> DataFrame:
    """Buffered rows marked train or holdout by time order within the tenant.

    The tenant's size comes along with its running count, so a tenant's rows stay spread over their segments.
    """
    seg = segmented(buffer.withColumn("us", F.unix_micros("created_at")), ["tenant_id"], ["us", "id"], max_rows)
    seg = seg.running(sums={"_pos": F.lit(1)}, totals={"_n": F.lit(1)})
    cut = F.floor(F.col("_n") * train_share)
    return seg.rows.withColumn("part", F.when(F.col("_pos") <= cut, "train").otherwise("holdout")).drop("_pos", "_n", "us")


def verdict_from_action(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Analyst action on an event finding → verdict with the entity it concerns."""
    verdict = (
        F.when(F.col("decision") == "approve", "true_positive").when(F.col("decision") == "dismiss", "false_positive")
        .otherwise("escalated")
    )
    keyed = actions.withColumn("event_id", F.regexp_replace("finding_id", "^FE-", ""))
    ev = events.select(
        F.col("event_id").cast("string").alias("event_id"), "tenant_id",
        F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("src_ip", "hostname", "dst_ip")]).alias("entity_value"),
    )
    return keyed.join(ev, ["event_id", "tenant_id"], "left").select("finding_id", "tenant_id", verdict.alias("verdict"), "entity_value")


# ---- training-set preparation ----------------------------------------------------------------


#: bits of a double looked at per pass
LEVEL_BITS = 12


def order_statistics(df: DataFrame, wanted: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at the given 0-based ranks of each column's non-zero magnitudes, exactly; nulls and NaN count as absent.

    The bits of a non-negative double are ordered like the number. Each pass counts the rows that share the leading
    bits found so far by their next ``LEVEL_BITS`` bits, adds the counts up by shuffle and goes on in the bucket that holds the
    rank. Tasks and driver see counts, never values.
    """
    names = list(wanted)
    state = {(i, r): (0, r) for i, c in enumerate(names) for r in wanted[c]}
    shift = 64
    while shift > 0:
        width = min(LEVEL_BITS, shift)
        shift -= width
        open_ = {i: sorted({p for (j, _), (p, _) in state.items() if j == i}) for i in range(len(names))}

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, width: int = width, open_: dict = open_) -> Iterator[pa.RecordBatch]:
            totals = {(i, p): np.zeros(1 << width, np.int64) for i, ps in open_.items() for p in ps}
            for batch in batches:
                for i, ps in open_.items():
                    x = np.abs(batch.column(i).fill_null(0.0).to_numpy(zero_copy_only=False).astype(float))
                    bits = x[x > 0].view(np.uint64)
                    lead = bits >> np.uint64(min(shift + width, 63)) if shift + width < 64 else np.zeros(len(bits), np.uint64)
                    for p in ps:
                        part = (bits[lead == np.uint64(p)] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                        totals[i, p] += np.bincount(part.astype(np.int64), minlength=1 << width)
            for (i, p), t in totals.items():
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(np.full(len(at), p, np.int64)), pa.array(at), pa.array(t[at])], ["i", "p", "b", "n"])

        numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
        rows = numbers.mapInArrow(count, "i long, p long, b long, n long").groupBy("i", "p", "b").agg(F.sum("n").alias("n")).collect()
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in rows:
            counts.setdefault((r["i"], r["p"]), []).append((r["b"], r["n"]))
        for key, (p, rest) in state.items():
            for b, n in sorted(counts[key[0], p]):
                if rest < n:
                    state[key] = ((p << width) | b, rest)
                    break
                rest -= n
    value = lambda bits: float(np.array([bits], np.uint64).view(np.float64)[0])
    return {c: {r: value(state[i, r][0]) for r in wanted[c]} for i, c in enumerate(names)}


def clip_p99(df: DataFrame, cols: list[str], factor: float = 10.0) -> DataFrame:
    """Clip each column to ± factor × p99 of its non-zero magnitudes, the exact interpolated percentile."""
    magnitude = lambda c: F.abs(F.col(c).cast("double"))
    sizes = df.agg(*[F.count_if((magnitude(c) > 0) & ~F.isnan(magnitude(c))).alias(c) for c in cols]).first()
    at = {c: 0.99 * (sizes[c] - 1) for c in cols if sizes[c]}
    ranks = {c: sorted({math.floor(x), math.ceil(x)}) for c, x in at.items()}
    found = order_statistics(df, ranks) if ranks else {}
    out = {}
    for c, x in at.items():
        low, high = found[c][math.floor(x)], found[c][math.ceil(x)]
        b = (low + (x - math.floor(x)) * (high - low)) * factor
        out[c] = F.least(F.greatest(F.col(c).cast("double"), F.lit(-b)), F.lit(b))
    return df.withColumns(out)


def drop_all_zero(df: DataFrame, features: str) -> DataFrame:
    return df.where(F.exists(F.col(features), lambda x: x != 0))


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population deviation; undefined results become 0."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        z = (F.col(c).cast("double") - (m or 0.0)) / s if s else F.lit(0.0)
        out[c] = F.when(F.isnan(z) | z.isNull(), 0.0).otherwise(z)
    return df.withColumns(out)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42, max_rows: int = 2_000_000) -> DataFrame:
    """Exact per-class split ordered by a seeded hash of the row key."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    seg = segmented(df.withColumn("_h", h), [label], ["_h", key], max_rows).running(sums={"_pos": F.lit(1)}, totals={"_n": F.lit(1)})
    part = F.when(F.col("_pos") <= F.floor(F.col("_n") * share), "train").otherwise("test")
    return seg.rows.withColumn("part", part).drop("_h", "_pos", "_n")
