"""From an event and its entity's state to scores, matches, risk and response: the same steps for batch and stream."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import scoring as S
from duskwatch.functions.features import with_features76, with_optional
from duskwatch.functions.plan import pin
from duskwatch.functions.text import mask_pii
from duskwatch.operators import intel, narrative, rules
from duskwatch.operators.entitypass import entity_pass
from duskwatch.operators.segments import MAX_ROWS_PER_KEY
from duskwatch.operators.state import posture_running
from duskwatch.session import ensure_checkpoint_dir

RECENT = 30
SCORERS = ("vae_anomaly_score", "hst_anomaly_score", "temporal_score")
Scorer = Callable[[DataFrame], DataFrame]


def with_features(events: DataFrame) -> DataFrame:
    """The 76 values, from the state before the event; each block computed once."""
    return with_features76(with_optional(events))


def fuse(events: DataFrame, classifier: Scorer | None = None, weights: list[Column | float] | None = None) -> DataFrame:
    """The five streams and the fused score, each within [0, 1].

    ``classifier`` adds ensemble_score and ensemble_label from ``features``; without one the stub does. The
    other learned scores are taken as they come with the event, 0 if absent. The adversarial one needs ``times_us``.
    """
    if classifier is not None:
        events = classifier(events)
    else:
        events = events.withColumn("ensemble_score", S.stub_score(F.col("features")))
        events = events.withColumn("ensemble_label", S.stub_label(F.col("ensemble_score")))
    given = {c: S.clamp01(F.coalesce(F.col(c), F.lit(0.0))) if c in events.columns else F.lit(0.0) for c in SCORERS}
    events = events.withColumns({"ensemble_score": S.clamp01(F.col("ensemble_score")), **given})
    s = [F.col(c) for c in ("ensemble_score", *SCORERS)]
    seen = F.coalesce("before_event_count", F.lit(0))
    hostile = S.adversarial_composite(S.timing_cov(F.col("times_us")), S.evasion_score(s[:3], seen), S.ood_score(F.col("features")))
    events = pin(events, "adversarial_score", S.clamp01(hostile))
    args = {} if weights is None else {"weights": weights}
    return pin(events, "meta_score", S.meta_score([*s, F.col("adversarial_score")], **args))


def match(events: DataFrame) -> DataFrame:
    """Rules, technique predictions, compliance tags and embedded indicators; these read the text as it came."""
    out = rules.match_rules(events, mask="rule_mask")
    return out.withColumns(
        {"mitre_predictions": rules.to_mitre(), "compliance_tags": rules.compliance_tags(mask="rule_mask"), "ioc_matches": intel.ioc_match_array()}
    )


def conclude(events: DataFrame) -> DataFrame:
    """Risk, posture effect and response; the text is masked before the narrative quotes anything."""
    crit = F.coalesce("asset_criticality", F.lit(0.5)) if "asset_criticality" in events.columns else F.lit(0.5)
    out = events.withColumns(
        {
            "risk": S.risk_score(F.col("meta_score"), crit, F.lit(0.0), F.coalesce("before_event_count", F.lit(0))),
            "posture_delta": S.posture_delta(F.col("meta_score") * 100),
        }
    )
    out = rules.recommend_response(out, mask="rule_mask").drop("rule_mask")
    out = out.withColumns({c: mask_pii(F.col(c)) for c in ("message", "raw_log") if c in out.columns})
    return out.withColumn("narrative", narrative.narrative())


def assess(events: DataFrame, classifier: Scorer | None = None, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """The whole path over a table of enriched flat events with an ``entity``: what ``streaming.pipeline`` gives for a replay in order of time.

    Sequences and campaigns are operators of their own over the result: ``match_sequence``, ``correlate_campaigns``.
    """
    state = entity_pass(events, max_rows, before=True, recent=RECENT, in_run=True).drop("events_before")
    return conclude(match(fuse(with_features(state), classifier)))


def with_running_posture(assessed: DataFrame, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Assessed events with their tenant's posture after each. Rows equal in tenant, time and id get the last value.

    The posture counts, cuts and folds the events before they meet it, so they are kept in a checkpoint and assessed once: select
    the columns that are needed first.
    """
    ensure_checkpoint_dir(assessed.sparkSession)
    assessed = assessed.checkpoint()
    run = posture_running(assessed, max_rows=max_rows)
    key = F.struct("tenant_id", "us", "event_id")
    last = run.groupBy(key.alias("_at")).agg(F.last("score").alias("posture"))
    at = F.struct("tenant_id", F.unix_micros("timestamp").alias("us"), "event_id")
    return assessed.withColumn("_at", at).join(last, "_at", "left").drop("_at")
