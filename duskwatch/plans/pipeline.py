"""The scoring path over the security-event view: the batch twin of the stream, and the stream's campaign state merged batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import assess as A
from duskwatch.plans import behaviour as B
from duskwatch.plans.base import Suite, sec_events
from duskwatch.plans.detection import IOC, _rule_sql
from duskwatch.session import shared_folder
from duskwatch.streaming.campaigns import CampaignState

SUITE = Suite()

_FIRST = " + ".join(f"CAST({e} AS DOUBLE)" for e in B._NET)
_SQUARES = " + ".join(f"pow(CAST({e} AS DOUBLE), 2)" for e in [*B._NET, *B._ENT, *B._TMP, *B._PAY, *B._CTX])
_LEVEL = (
    "greatest(CASE WHEN meta >= 0.85 THEN 5 WHEN meta >= 0.7 THEN 4 WHEN meta >= 0.5 THEN 3 WHEN meta >= 0.3 THEN 2 ELSE 1 END, CASE WHEN ic >= 0.9 THEN 4 WHEN ic >= 0.7 THEN 3 ELSE 1 END, "
    "CASE WHEN strong >= 2 THEN 4 WHEN strong = 1 THEN 3 ELSE 1 END, CASE WHEN campaign_id IS NOT NULL THEN 3 ELSE 1 END)"
)
_RAMP = "1.5 * sqrt(76)"
_SQL = (
    B._BEFORE.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", rm AS ({_rule_sql()}), {IOC}, rc AS (SELECT event_id, count(*) AS rules, count(*) FILTER (WHERE conf >= 0.85) AS strong FROM rm GROUP BY 1), ic AS (SELECT event_id, count(*) AS iocs, "
    "max(conf) AS ic FROM im GROUP BY 1), tl AS (SELECT event_id, list(us) OVER (PARTITION BY tenant_id, source_type, gt ORDER BY us, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ts FROM "
    "st), tg AS (SELECT event_id, len(ts) AS n, list_transform(range(2, len(ts) + 1), lambda i: (ts[i] - ts[i-1]) / 1e6) AS gaps FROM tl), tm AS (SELECT *, list_sum(gaps) / (n - 1) AS mean FROM tg), "
    "tc AS (SELECT event_id, n, CASE WHEN mean = 0 THEN -1 ELSE sqrt(list_sum(list_transform(gaps, lambda x: (x - mean) * (x - mean))) / (n - 1)) / mean END AS cov FROM tm), "
    "ti AS (SELECT event_id, CASE WHEN n < 10 THEN 0 WHEN cov = -1 THEN 1 WHEN cov < 0.15 THEN least(1, 1 - cov / 0.15) ELSE 0 END::DOUBLE AS timing FROM tc), "
    f"pf AS (SELECT bf.*, timing, least(({_FIRST}) / 100000, 1) AS ens, sqrt(({_SQUARES}) / 0.1) AS dist FROM bf JOIN ti USING (event_id)), "
    f"pg AS (SELECT *, greatest(timing, CASE WHEN dist <= {_RAMP} THEN 0 ELSE least(1, (dist - {_RAMP}) / sqrt(76)) END)::DOUBLE AS adv FROM pf), "
    "ph AS (SELECT *, 0.55::DOUBLE * ens + 0.05::DOUBLE * temporal_score + 0.05::DOUBLE * adv AS base FROM pg), "
    "pm AS (SELECT *, least(greatest(CASE WHEN base > 0.3 THEN pow(base, 0.85) ELSE base END, 0), 1) AS meta FROM ph), "
    "po AS (SELECT tenant_id, event_id, meta, row_number() OVER (PARTITION BY tenant_id ORDER BY us, event_id) AS rn FROM pm), "
    "pp AS (SELECT tenant_id, event_id, rn, CASE WHEN meta > 0.7 THEN greatest(0, 82 - meta * 2.5) WHEN meta < 0.3 THEN 82.3 ELSE 82 END::DOUBLE AS posture FROM po WHERE rn = 1 UNION ALL SELECT "
    "po.tenant_id, po.event_id, po.rn, CASE WHEN meta > 0.7 THEN greatest(0, posture - meta * 2.5) WHEN meta < 0.3 THEN least(100, posture + 0.3) ELSE posture END::DOUBLE FROM pp JOIN po ON "
    "po.tenant_id = pp.tenant_id AND po.rn = pp.rn + 1)"
)


@SUITE.query(
    "pipeline_stream",
    _SQL + " SELECT pm.event_id, round(ens, 6) AS ensemble, round(adv, 6) AS adversarial, round(meta + 1e-10, 6) AS meta, coalesce(rules, 0) AS rules, coalesce(iocs, 0) AS iocs, "
    "round(least(greatest(meta * 0.75 * (1 - 1 / (1 + exp(-0.01 * (coalesce(before_event_count, 0) - 500)))) * 100, 0), 100), 4) AS risk, "
    "round(CASE WHEN meta * 100 < 10 THEN 0 ELSE greatest(-5, -2 * meta) END, 6) AS delta, round(posture, 5) AS posture, "
    f"['LOG', 'MONITOR', 'INVESTIGATE', 'BLOCK', 'ISOLATE'][{_LEVEL}] AS action FROM pm JOIN pp USING (tenant_id, event_id) LEFT JOIN rc USING (event_id) LEFT JOIN ic USING (event_id)",
)
def _(spark, sf_dir):
    """What the chained stream gives for a replay in order of time; the tests replay it and compare."""
    ev = B._vector_inputs(B.entities(spark, sf_dir).select(*B.VECTOR_INPUT, "raw_log", "signature_name", "outcome"))
    shown = A.assess(ev).select(
        "tenant_id", "timestamp", "event_id", "meta_score", F.round("ensemble_score", 6).alias("ensemble"), F.round("adversarial_score", 6).alias("adversarial"),
        F.round(F.col("meta_score") + 1e-10, 6).alias("meta"), F.size("rule_matches").cast("long").alias("rules"), F.size("ioc_matches").cast("long").alias("iocs"),
        F.round("risk", 4).alias("risk"), F.round("posture_delta", 6).alias("delta"), F.col("recommendation.action").alias("action"),
    )
    return A.with_running_posture(shown).select(
        "event_id", "ensemble", "adversarial", "meta", "rules", "iocs", "risk", "delta", F.round("posture", 5).alias("posture"), "action"
    )


@SUITE.query("correlate_campaigns_batches", B._CC + " SELECT event_id, tenant_id, campaign_id FROM cc")
def _(spark, sf_dir):
    """The streaming form: three micro-batches that interleave in time are merged one by one."""
    ev = sec_events(spark, sf_dir)
    state = CampaignState(spark, shared_folder(spark, "campaigns"), 8, 0.9, 0.95)
    for batch in (1, 2, 3):
        state.add(ev.where(F.col("event_id") % 3 == batch % 3), batch)
    return state.tag(ev).select("event_id", "tenant_id", "campaign_id")
