"""Per-entity state and other ordered folds, in batch form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.scoring import DEFAULT_WEIGHTS
from duskwatch.functions.vectors import padded_vectors
from duskwatch.operators.entitypass import FIVE_MIN, IDLE_TTL, ONE_HOUR, STATE, entity_pass  # noqa: F401
from duskwatch.operators.folds import ordered_fold
from duskwatch.operators.segments import MAX_ROWS_PER_KEY, segmented

DISTINCT_CAP = 100


def entity_state(events: DataFrame, max_rows: int = MAX_ROWS_PER_KEY, distinct_cap: int = DISTINCT_CAP) -> DataFrame:
    """State after each event: counters, run lengths, capped distinct destinations, campaign.

    Runs are broken by gaps (300 s, 3600 s, and 86400 s for everything); they are not sliding windows.
    The distinct sets keep at most ``distinct_cap`` values and drop the oldest, so their size is the
    smaller of that and the distinct values seen in the run. All columns of ``events`` travel along: select those needed before.
    """
    return entity_pass(events, max_rows, distinct_cap).drop("events_before")


def entity_state_before(events: DataFrame, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """State visible to each event before it is counted; empty after the idle time-out."""
    return entity_pass(events, max_rows, before=True).drop("events_before", *STATE)


def final_entity_state(events: DataFrame, now: Column, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """State of each entity after its last event, as a stream starts from it; entities idle for a day at ``now`` have none.

    The distinct values of the last hour's run are rows until the newest ``DISTINCT_CAP`` are picked, so no array outgrows the cap.
    """
    rows = entity_pass(events, max_rows, recent=30, in_run=True).withColumn("us", F.unix_micros("timestamp"))
    keys = ["tenant_id", "entity"]
    key = F.struct(*keys)
    order = F.struct("us", "event_id")
    last = rows.groupBy(key.alias("_k")).agg(F.max_by(F.struct(*STATE, "us", "event_id", "times_us"), order).alias("s"))
    last = last.where(F.unix_micros(now) - F.col("s.us") <= IDLE_TTL * 1_000_000)
    # the run of the last hour holds the newest events_1h rows
    by = Window.partitionBy("_k").orderBy(F.desc("us"), F.desc("event_id"))
    newest = rows.select(key.alias("_k"), "us", "event_id", "dst_ip", F.col("dst_port").cast("string").alias("dst_port")).join(last, "_k")
    newest = newest.withColumn("_back", F.row_number().over(by)).where(F.col("_back") <= F.col("s.events_1h"))
    out = last
    for name in ("dst_ip", "dst_port"):
        first = newest.where(F.col(name).isNotNull() & ~F.col(name).isin("", "0")).groupBy("_k", name).agg(F.max("_back").alias("_sight"))
        pick = Window.partitionBy("_k").orderBy("_sight")
        some = first.withColumn("_at", F.row_number().over(pick)).where(F.col("_at") <= DISTINCT_CAP)
        listed = some.groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("_sight", name)), asc=False), lambda x: x[name]).alias(f"{name}s"))
        out = out.join(listed, "_k", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "_k.*", *[F.col(f"s.{c}").alias(c) for c in STATE], F.col("s.us").alias("last_seen_us"), F.coalesce("dst_ips", none).alias("dst_ips"),
        F.coalesce("dst_ports", none).alias("dst_ports"), F.col("s.times_us").alias("times_us"),
    )


def entity_history(events: DataFrame, n: int = 50, width: int = 64, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Last ``n`` vectors of the entity, this event included, each cut or padded to ``width``.

    Rows travel with their vector as it is; the zeros are added where a history is read, a block of rows at a time.
    """
    seg = segmented(
        events.withColumn("us", F.unix_micros("timestamp")), ["tenant_id", "entity"], ["us", "event_id"], max_rows
    ).last_n("history", F.slice("features", 1, width), n)
    return seg.rows.drop("us").withColumn("history", padded_vectors(F.col("history"), width))


def recent_times(events: DataFrame, n: int = 30, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Last ``n`` event times (µs) of the entity, oldest first, for the timing scores."""
    return entity_pass(events, max_rows, recent=n).drop(*STATE, "events_before")


def events_before(events: DataFrame, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Number of earlier events per tenant and entity, for warm-up gates."""
    return entity_pass(events, max_rows).drop(*STATE)


# ---- order-dependent folds -------------------------------------------------------------------


def posture_running(events: DataFrame, start: float = 82.0, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Posture of the tenant after each event: minus 2.5·score above .7 (floor 0), plus .3 below .3 (cap 100).

    Two runs from different starting values meet as soon as both touch the floor or the cap, so the
    speculative segments of a large tenant settle after very few rounds.
    """
    rows = events.select("tenant_id", F.unix_micros("timestamp").alias("us"), "event_id", "meta_score")

    def run(state: tuple, cols: dict[str, np.ndarray]) -> tuple[tuple, list[int], list[tuple]]:
        (x,) = state
        out = []
        for m in cols["meta_score"].tolist():
            if m > 0.7:
                x = max(0.0, x - m * 2.5)
            elif m < 0.3:
                x = min(100.0, x + 0.3)
            out.append((x,))
        return (x,), list(range(len(out))), out

    return ordered_fold(
        rows, ["tenant_id"], ["us", "event_id"], ["meta_score"], (start,), run, "score double", max_rows
    )


def posture_minutes(running: DataFrame) -> DataFrame:
    """Last posture score per tenant and minute."""
    minute = F.date_trunc("minute", F.timestamp_micros("us"))
    return running.groupBy("tenant_id", minute.alias("minute")).agg(
        F.max_by("score", F.struct("us", "event_id")).alias("score")
    )


def weights_fold(verdicts: DataFrame, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Fusion weights after each verdict, in verdict order per tenant.

    True positives raise the weight of streams above .5 (cap .5), false positives lower it (floor
    .05), then the five weights are scaled to sum to one. ``stream_scores`` is array<double> of 5.
    """
    high = F.aggregate(
        F.transform("stream_scores", lambda s, i: F.when(s > 0.5, F.pow(F.lit(2.0), i)).otherwise(0.0)),
        F.lit(0.0), lambda a, x: a + x,
    ).cast("int")
    sign = F.when(F.col("verdict") == "true_positive", 1).when(F.col("verdict") == "false_positive", -1).otherwise(0)
    rows = verdicts.select(
        "tenant_id", F.unix_micros("created_at").alias("us"), "id", sign.alias("sign"), high.alias("high")
    )

    def run(state: tuple, cols: dict[str, np.ndarray]) -> tuple[tuple, list[int], list[tuple]]:
        w = list(state)
        out = []
        for sign_, mask in zip(cols["sign"].tolist(), cols["high"].tolist()):
            for i in range(5):
                if mask >> i & 1:
                    if sign_ > 0:
                        w[i] = min(w[i] + 0.01, 0.5)
                    elif sign_ < 0:
                        w[i] = max(w[i] - 0.01, 0.05)
            total = w[0] + w[1] + w[2] + w[3] + w[4]
            w = [x / total for x in w]
            out.append((list(w),))
        return tuple(w), list(range(len(out))), out

    return ordered_fold(
        rows, ["tenant_id"], ["us", "id"], ["sign", "high"], tuple(DEFAULT_WEIGHTS), run, "weights array<double>", max_rows
    )


def latest_weights(folded: DataFrame) -> DataFrame:
    return folded.groupBy("tenant_id").agg(F.max_by("weights", F.struct("us", "id")).alias("weights"))
