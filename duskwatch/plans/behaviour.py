"""State, features, scores, sequences, campaigns and folds over the security-event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions import features as FE
from duskwatch.functions import scoring as S
from duskwatch.functions.vectors import measured_vectors
from duskwatch.operators import baseline as BL
from duskwatch.operators import campaigns as C
from duskwatch.operators import sequence as Q
from duskwatch.operators import state as ST
from duskwatch.plans.base import NOW, SEC, Suite, sec_events
from duskwatch.plans.side import RANK_SQL, VERDICT

SUITE = Suite()


def entities(spark, sf_dir):
    """Security events with the log source as entity, which gives dense histories."""
    return sec_events(spark, sf_dir).withColumn("entity", F.col("source_type"))


#: what the entity state reads, and what the feature vector reads beside it
STATE_INPUT = ["tenant_id", "entity", "timestamp", "event_id", "dst_ip", "dst_port", "campaign_id"]
VECTOR_INPUT = [
    *STATE_INPUT, "src_ip", "src_port", "bytes_in", "bytes_out", "packets_in", "packets_out", "protocol", "geo_country", "hostname", "meta_score",
    "temporal_score", "signature_id", "severity", "action", "message", "source_type",
]

# ---- entity state ----

_W = "PARTITION BY tenant_id, source_type ORDER BY timestamp, event_id"
_STATE = (
    SEC + f", s AS (SELECT *, epoch_us(timestamp) AS us, lag(epoch_us(timestamp)) OVER ({_W}) AS prev FROM sec), f AS (SELECT *, "
    "CASE WHEN prev IS NULL OR us - prev > CAST(86400 AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS rt, CASE WHEN prev IS NULL OR us - prev > "
    "CAST(3600 AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS r1, CASE WHEN prev IS NULL OR us - prev > 300 * 1000000 THEN 1 ELSE 0 END AS r5 "
    f"FROM s), r AS (SELECT *, sum(rt) OVER ({_W}) AS gt, sum(r1) OVER ({_W}) AS g1, sum(r5) OVER ({_W}) AS g5 FROM f), st AS (SELECT r.*, "
    "row_number() OVER (PARTITION BY tenant_id, source_type, gt ORDER BY us, event_id) AS event_count, row_number() OVER (PARTITION BY "
    "tenant_id, source_type, g5 ORDER BY us, event_id) AS events_5m, row_number() OVER (PARTITION BY tenant_id, source_type, g1 ORDER BY us, "
    "event_id) AS events_1h, least(count(DISTINCT dst_ip) OVER (PARTITION BY tenant_id, source_type, g1 ORDER BY us, event_id ROWS UNBOUNDED "
    "PRECEDING), 100) AS unique_dst_ips, least(count(DISTINCT dst_port) OVER (PARTITION BY tenant_id, source_type, g1 ORDER BY us, event_id "
    "ROWS UNBOUNDED PRECEDING), 100) AS unique_dst_ports, last_value(campaign_id IGNORE NULLS) OVER (PARTITION BY tenant_id, source_type, gt "
    "ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sticky_campaign FROM r)"
)
_COLS = "event_count, events_5m, events_1h, unique_dst_ips, unique_dst_ports, sticky_campaign"


@SUITE.query("entity_state", _STATE + f" SELECT event_id, {_COLS} FROM st")
def _(spark, sf_dir):
    return ST.entity_state(entities(spark, sf_dir).select(*STATE_INPUT)).select("event_id", *ST.STATE)


_BEFORE = _STATE + ", bf AS (SELECT st.*, " + ", ".join(
    f"CASE WHEN rt = 0 THEN lag({c}) OVER ({_W}) END AS before_{c}" for c in ST.STATE
) + ", CASE WHEN rt = 0 THEN prev END AS before_last_seen_us FROM st)"


@SUITE.query(
    "entity_state_before",
    _BEFORE + " SELECT event_id, before_last_seen_us, " + ", ".join(f"before_{c}" for c in ST.STATE) + " FROM bf",
)
def _(spark, sf_dir):
    b = ST.entity_state_before(entities(spark, sf_dir).select(*STATE_INPUT))
    return b.select("event_id", "before_last_seen_us", *[f"before_{c}" for c in ST.STATE])


@SUITE.query(
    "entity_history",
    SEC + f", x AS (SELECT event_id, least(row_number() OVER ({_W}), 50) AS n, sum(meta_score) OVER ({_W} ROWS BETWEEN 49 PRECEDING AND CURRENT "
    "ROW) AS total FROM sec) SELECT event_id, n AS vectors, 64 AS width, round(total, 6) AS total FROM x",
)
def _(spark, sf_dir):
    ev = entities(spark, sf_dir).select("tenant_id", "entity", "timestamp", "event_id", F.array("meta_score").alias("features"))
    h = ST.entity_history(ev).select("event_id", measured_vectors(F.col("history")).alias("h"))
    return h.select("event_id", "h.vectors", "h.width", F.round("h.total", 6).alias("total"))


_TIMES = (
    SEC + f", t AS (SELECT event_id, list(epoch_us(timestamp)) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ts FROM sec), g AS "
    "(SELECT event_id, len(ts) AS n, list_transform(range(2, len(ts) + 1), lambda i: (ts[i] - ts[i-1]) / 1e6) AS gaps FROM t), m AS (SELECT *, "
    "list_sum(gaps) / (n - 1) AS mean FROM g), v AS (SELECT *, CASE WHEN n < 10 THEN 0 WHEN mean = 0 THEN -1 ELSE sqrt(list_sum(list_transform("
    "gaps, lambda x: (x - mean) * (x - mean))) / (n - 1)) / mean END AS cov FROM m)"
)


@SUITE.query(
    "timing_regularity",
    _TIMES + " SELECT event_id, round(CASE WHEN n < 10 THEN 0 WHEN cov = -1 THEN 1 WHEN cov < 0.9 THEN least(1, 1 - cov / 0.9) ELSE 0 END, 6) AS "
    "score FROM v",
)
def _(spark, sf_dir):
    t = ST.recent_times(entities(spark, sf_dir).select("tenant_id", "entity", "timestamp", "event_id"))
    # test gaps are near-exponential; the threshold is widened so that some scores are non-zero
    return t.select("event_id", F.round(S.timing_cov(F.col("times_us"), 10, 0.9), 6).alias("score"))


@SUITE.query("timing_regularity_ks")
def _(spark, sf_dir):
    t = ST.recent_times(entities(spark, sf_dir).select("tenant_id", "entity", "timestamp", "event_id"))
    return t.select("event_id", S.timing_ks(F.col("times_us")).alias("score"))


# ---- features ----


_NET = [
    "src_port", "dst_port", "bytes_in", "bytes_out", "packets_in", "packets_out", "CASE WHEN packets_in > 0 THEN bytes_in / packets_in ELSE 0 END",
    "CASE WHEN packets_out > 0 THEN bytes_out / packets_out ELSE 0 END", "bytes_in + bytes_out", "packets_in + packets_out",
    "CASE WHEN bytes_in + bytes_out > 0 THEN bytes_in / (bytes_in + bytes_out) ELSE 0.5 END",
    "CASE WHEN packets_in + packets_out > 0 THEN packets_in / (packets_in + packets_out) ELSE 0.5 END", "protocol = 'tcp'", "protocol = 'udp'",
    "dst_port < 1024", "dst_port IN (22, 23, 3389, 5900)",
]
_ENT = [
    "meta_score", "0.5", "0", "0", "0", "0", "0", "coalesce(before_event_count, 0)", "geo_country <> 'US'", "0",
    "CASE WHEN hostname IS NULL THEN 0 ELSE 0.4 END", "0", "0", "0", "0", "0",
]
_GAP = "coalesce((us - before_last_seen_us) / 1e6, 0)"
_TMP = [
    "hour(timestamp)", "hour(timestamp) < 6 OR hour(timestamp) > 22", "isodow(timestamp) >= 6", _GAP,
    f"CASE WHEN {_GAP} <= 300 THEN coalesce(before_events_5m, 0) ELSE 0 END",
    *[f"CASE WHEN {_GAP} <= 3600 THEN coalesce(before_{c}, 0) ELSE 0 END" for c in ("events_1h", "unique_dst_ips", "unique_dst_ports")],
    *["0"] * 8,
]
_PAY = [
    "signature_id IS NOT NULL", f"{RANK_SQL} * 0.25::DOUBLE", "CASE action WHEN 'allow' THEN 0 WHEN 'alert' THEN 0.5 ELSE 0.25 END", "temporal_score",
    "0", "0", "0", "length(message) / 500.0::DOUBLE", *["0"] * 8,
]
_CTX = [
    "CASE source_type WHEN 'suricata' THEN 0 WHEN 'zeek' THEN 0.2 WHEN 'palo_alto' THEN 0.4 WHEN 'windows' THEN 0.6 ELSE 0.8 END",
    "campaign_id IS NOT NULL", *["0"] * 10,
]


def vectors(spark, sf_dir):
    return _vector_inputs(ST.entity_state_before(entities(spark, sf_dir).select(*VECTOR_INPUT)))


def _vector_inputs(ev):
    ev = ev.withColumns(
        {
            "src_criticality": F.col("meta_score"), "src_country": F.col("geo_country"),
            "src_entity_type": F.when(F.col("hostname").isNull(), "ip").otherwise("host"), "uri_entropy": F.col("temporal_score"),
        }
    )
    return FE.with_optional(ev)


def _block(name, start, exprs, block, with_state):
    cols = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS f{start + i}" for i, e in enumerate(exprs))
    sql = (_BEFORE + f" SELECT event_id, {cols} FROM bf") if with_state else (SEC + f" SELECT event_id, {cols} FROM sec")

    @SUITE.query(name, sql)
    def _(spark, sf_dir):
        ev = vectors(spark, sf_dir) if with_state else _vector_inputs(sec_events(spark, sf_dir))
        b = ev.select("event_id", block().alias("b"))
        return b.select("event_id", *[F.round(F.get("b", F.lit(i)), 6).alias(f"f{start + i}") for i in range(len(exprs))])


_block("feat_network", 0, _NET, FE.network_block, False)
_block("feat_entity", 16, _ENT, FE.entity_block, True)
_block("feat_temporal", 32, _TMP, FE.temporal_block, True)
_block("feat_payload", 48, _PAY, FE.payload_block, False)
_block("feat_context", 64, _CTX, FE.context_block, False)

_ALL = [f"CAST({e} AS DOUBLE)" for e in [*_NET, *_ENT, *_TMP, *_PAY, *_CTX]]


@SUITE.query(
    "features76",
    _BEFORE + " SELECT event_id, 76 AS dim, round(" + " + ".join(_ALL) + ", 3) AS total, round("
    + " + ".join(f"{i % 7} * {e}" for i, e in enumerate(_ALL)) + ", 3) AS weighted FROM bf",
)
def _(spark, sf_dir):
    v = vectors(spark, sf_dir).select("event_id", FE.features76().alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("f", lambda x, i: x * (i % 7)), F.lit(0.0), lambda a, x: a + x)
    return v.select("event_id", F.size("f").alias("dim"), F.round(total, 3).alias("total"), F.round(weighted, 3).alias("weighted"))


@SUITE.query("dna128", SEC + " SELECT event_id, 128 AS dim, round(" + " + ".join(f"CAST({e} AS DOUBLE)" for e in _NET) + ", 3) AS net FROM sec")
def _(spark, sf_dir):
    v = _vector_inputs(sec_events(spark, sf_dir)).select("event_id", FE.dna128(FE.features76()).alias("v"))
    net = F.aggregate(F.slice("v", 1, 16), F.lit(0.0), lambda a, x: a + x)
    return v.select("event_id", F.size("v").alias("dim"), F.round(net, 3).alias("net"))


# ---- scores ----


def _streams():
    """Five stream scores made of event columns."""
    k = F.col("k")
    return [F.col("meta_score"), k % 10 / 10.0, k % 7 / 7.0, F.col("temporal_score"), k % 3 / 3.0]


_ST5 = "meta_score AS s1, k % 10 / 10.0::DOUBLE AS s2, k % 7 / 7.0::DOUBLE AS s3, temporal_score AS s4, k % 3 / 3.0::DOUBLE AS s5"
_SC = SEC + f", sc AS (SELECT *, {_ST5} FROM sec)"
_BASE = "0.55::DOUBLE*s1 + 0.05::DOUBLE*s2 + 0.3::DOUBLE*s3 + 0.05::DOUBLE*s4 + 0.05::DOUBLE*s5"


@SUITE.query(
    "meta_score",
    _SC + f", bb AS (SELECT event_id, {_BASE} AS base, least({_BASE} + CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 6 THEN 0.05 ELSE 0 "
    "END + CASE WHEN k / 100.0::DOUBLE > 0.5 THEN 0.03 * (k / 100.0::DOUBLE - 0.5) ELSE 0 END, 1) AS boosted FROM sc) SELECT event_id, "
    "round(least(greatest(CASE WHEN base > 0.3 THEN pow(base, 0.85) ELSE base END, 0), 1) + 1e-10, 6) AS plain, round(least(greatest(CASE WHEN boosted > "
    "0.3 THEN pow(boosted, 0.85) ELSE boosted END, 0), 1) + 1e-10, 6) AS with_context FROM bb",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    return ev.select(
        "event_id", F.round(S.meta_score(_streams()) + 1e-10, 6).alias("plain"),
        F.round(S.meta_score(_streams(), hour=F.hour("timestamp"), criticality=F.col("k") / 100.0) + 1e-10, 6).alias("with_context"),
    )


@SUITE.query(
    "risk_score",
    SEC + " SELECT event_id, round(least(greatest((meta_score * (0.5 + (k % 10 / 10.0::DOUBLE) * 0.5) + (k % 4 / 4.0::DOUBLE) * 0.3) * (1 - 1 / (1 "
    "+ exp(-0.01 * (event_id % 900 - 500)))) * 100, 0), 100), 6) AS risk FROM sec",
)
def _(spark, sf_dir):
    r = S.risk_score(F.col("meta_score"), F.col("k") % 10 / 10.0, F.col("k") % 4 / 4.0, F.col("event_id") % 900)
    return sec_events(spark, sf_dir).select("event_id", F.round(r, 6).alias("risk"))


@SUITE.query(
    "posture_delta",
    SEC + " SELECT event_id, CASE WHEN meta_score * 100 < 10 THEN 0 ELSE greatest(-5, -2 * (meta_score * 100 / 100)) END::DOUBLE AS delta FROM sec",
)
def _(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_id", S.posture_delta(F.col("meta_score") * 100).alias("delta"))


@SUITE.query("clamp_scores", SEC + " SELECT event_id, least(greatest(value / 50 - 1, 0), 1)::DOUBLE AS score FROM sec")
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir).select("event_id", (F.col("value") / 50 - 1).alias("score"))
    return S.clamp_scores(ev, ["score"])


@SUITE.query(
    "stub_score",
    SEC + ", x AS (SELECT event_id, least((" + " + ".join(f"CAST({e} AS DOUBLE)" for e in _NET) + ") / 100000, 1) AS sc FROM sec) SELECT event_id, "
    "round(sc, 6) AS score, CASE WHEN sc < 0.5 THEN 'benign' ELSE 'port_scan' END AS label FROM x",
)
def _(spark, sf_dir):
    v = _vector_inputs(sec_events(spark, sf_dir)).select("event_id", S.stub_score(FE.network_block()).alias("sc"))
    return v.select("event_id", F.round("sc", 6).alias("score"), S.stub_label(F.col("sc")).alias("label"))


_EVA = (
    _SC + f", n AS (SELECT *, row_number() OVER ({_W}) - 1 AS seen, (CASE WHEN s1 BETWEEN 0.35 AND 0.5 THEN 1 ELSE 0 END) + (CASE WHEN s2 BETWEEN "
    "0.35 AND 0.5 THEN 1 ELSE 0 END) + (CASE WHEN s3 BETWEEN 0.35 AND 0.5 THEN 1 ELSE 0 END) AS inside FROM sc), e AS (SELECT *, CASE WHEN seen < "
    "50 THEN 0 WHEN inside >= 3 THEN 0.9 WHEN inside = 2 THEN 0.5 ELSE 0 END::DOUBLE AS evasion FROM n)"
)


@SUITE.query("evasion_score", _EVA + " SELECT event_id, evasion FROM e")
def _(spark, sf_dir):
    ev = ST.events_before(entities(spark, sf_dir).select("tenant_id", "entity", "timestamp", "event_id", "k", "meta_score", "temporal_score"))
    return ev.select("event_id", S.evasion_score(_streams()[:3], F.col("events_before")).alias("evasion"))


_OOD_D = "sqrt((s1*s1 + s2*s2 + s3*s3 + s4*s4 + s5*s5) / 0.1)"
_OOD = f"CASE WHEN {_OOD_D} <= 1.5 * sqrt(5) THEN 0 ELSE least(1, ({_OOD_D} - 1.5 * sqrt(5)) / sqrt(5)) END::DOUBLE"


@SUITE.query("ood_score", _SC + f" SELECT event_id, round({_OOD}, 6) AS ood FROM sc")
def _(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_id", F.round(S.ood_score(F.array(*_streams())), 6).alias("ood"))


_MV = (
    _SC + ", m AS (SELECT avg(s1) AS m1, avg(s2) AS m2, var_samp(s1) AS v11, var_samp(s2) AS v22, covar_samp(s1, s2) AS v12 FROM sc), d AS (SELECT event_id, sqrt((v22 * (s1 - m1) * (s1 - m1) - 2 * "
    "v12 * (s1 - m1) * (s2 - m2) + v11 * (s2 - m2) * (s2 - m2)) / (v11 * v22 - v12 * v12)) AS dist FROM sc, m)"
)


@SUITE.query("ood_mahalanobis", _MV + " SELECT event_id, round(least(1, greatest(0, (dist - 1.5 * sqrt(3)) / sqrt(3))), 6) AS ood FROM d")
def _(spark, sf_dir):
    """Two correlated scores and a constant third dimension, which makes the covariance singular."""
    ev = sec_events(spark, sf_dir).select("event_id", F.array(*_streams()[:2], F.lit(0.25)).alias("features"))
    baseline = BL.fit_baseline(ev)
    return ev.select("event_id", F.round(BL.ood_score(F.col("features"), baseline), 6).alias("ood"))


@SUITE.query("adversarial_composite", _EVA + f" SELECT event_id, round(greatest(temporal_score, evasion, {_OOD}), 6) AS score FROM e")
def _(spark, sf_dir):
    ev = ST.events_before(entities(spark, sf_dir).select("tenant_id", "entity", "timestamp", "event_id", "k", "meta_score", "temporal_score"))
    s = S.adversarial_composite(
        F.col("temporal_score"), S.evasion_score(_streams()[:3], F.col("events_before")), S.ood_score(F.array(*_streams()))
    )
    return ev.select("event_id", F.round(s, 6).alias("score"))


@SUITE.query(
    "top_features",
    SEC + ", x AS (SELECT event_id, unnest([" + ", ".join(f"round(abs(CAST({e} AS DOUBLE)) * {1 / (i + 1)!r}::DOUBLE, 6)" for i, e in enumerate(_NET))
    + "]) AS w, unnest(range(16)) AS i FROM sec), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY w DESC, 'network[' || i || ']') AS rn "
    "FROM x) SELECT event_id, 'network[' || i || ']' AS name, w AS weight FROM r WHERE rn <= 5",
)
def _(spark, sf_dir):
    v = _vector_inputs(sec_events(spark, sf_dir)).select("event_id", FE.network_block().alias("f"))
    # importances fall off with the position; the other blocks carry no weight here
    full = F.concat("f", F.array_repeat(F.lit(0.0), FE.DIM - 16))
    top = S.top_features(full, [1 / (i + 1) for i in range(16)] + [0.0] * (FE.DIM - 16))
    return v.select("event_id", F.explode(top).alias("t")).select("event_id", "t.*")


# ---- sequences ----

#: spans widened to ten days and score gates lowered: test entities have hours between events
PATTERNS = [
    Q.Pattern(
        p.id, p.name, tuple(Q.Stage(s.name, s.tactic, round(s.min_score * 0.3, 3), s.technique_prefix) for s in p.stages),
        864_000, p.severity, p.mitre_tactic,
    )
    for p in Q.ATTACK_PATTERNS
]


def sequence_events(spark, sf_dir):
    pred = F.array(F.struct("technique_id", "tactic", F.col("meta_score").alias("confidence")))
    return sec_events(spark, sf_dir).withColumns({"entity": F.col("src_ip"), "mitre_predictions": pred})


def _stage_sql(s: Q.Stage) -> str:
    out = f"meta_score >= {s.min_score}::DOUBLE AND tactic = '{s.tactic}'"
    return out + (f" AND starts_with(technique_id, '{s.technique_prefix}')" if s.technique_prefix else "")


_HITS = " UNION ALL ".join(
    f"SELECT tenant_id, src_ip AS entity_key, '{p.id}' AS pattern_id, epoch_us(timestamp) AS us, event_id, "
    + " + ".join(f"(CASE WHEN {_stage_sql(s)} THEN {1 << i} ELSE 0 END)" for i, s in enumerate(p.stages)) + " AS mask FROM sec"
    for p in PATTERNS
)
_SPAN = 864_000 * 1_000_000
_SEQ = (
    SEC.replace("WITH ", "WITH RECURSIVE ", 1) + f", h AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, entity_key, pattern_id ORDER BY us, event_id) AS "
    f"rn FROM ({_HITS}) WHERE mask > 0), w AS (SELECT tenant_id, entity_key, pattern_id, rn, us, event_id, CASE WHEN mask & 1 > 0 THEN 1 ELSE 0 END "
    "AS n, us AS t0, false AS fired, CAST(0 AS BIGINT) AS span FROM h WHERE rn = 1 UNION ALL SELECT tenant_id, entity_key, pattern_id, rn, us, event_id, CASE WHEN "
    "hit AND n0 = 2 THEN 0 WHEN hit THEN n0 + 1 ELSE n0 END, CASE WHEN hit AND n0 = 0 THEN us ELSE t0 END, hit AND n0 = 2, us - t0 FROM (SELECT *, "
    "(mask >> n0) & 1 = 1 AS hit FROM (SELECT h.tenant_id, h.entity_key, h.pattern_id, h.rn, h.us, h.event_id, h.mask, w.t0, CASE WHEN w.n > 0 AND h.us - "
    f"w.t0 > {_SPAN} THEN 0 ELSE w.n END AS n0 FROM w JOIN h ON h.tenant_id = w.tenant_id AND h.entity_key = w.entity_key AND h.pattern_id = "
    "w.pattern_id AND h.rn = w.rn + 1)))"
)


@SUITE.query(
    "match_sequence",
    _SEQ + " SELECT tenant_id, entity_key, pattern_id, event_id AS triggering_event_id, round(span / 1e6, 1) AS span_seconds, 3 AS stage_count FROM w "
    "WHERE fired",
)
def _(spark, sf_dir):
    m = Q.match_sequence(sequence_events(spark, sf_dir), PATTERNS)
    return m.select("tenant_id", "entity_key", "pattern_id", "triggering_event_id", "span_seconds", "stage_count")


def sequence_rules(spark, sf_dir):
    """The patterns as rows, as tenant-1's own rules; the other tenants use the defaults."""
    stage = "struct<name:string,tactic:string,technique_prefix:string,min_ml_score:double>"
    rows = [("tenant-1", p.id, p.name, [(s.name, s.tactic, s.technique_prefix or "", s.min_score) for s in p.stages], p.max_span_seconds, p.severity, p.mitre_tactic, True) for p in PATTERNS[:3]]
    rows += [("tenant-1", "off", "off", [], 1, "LOW", "", False)]
    return spark.createDataFrame(
        rows, f"tenant_id string, id string, name string, stages array<{stage}>, max_span_seconds int, severity string, mitre_tactic string, is_active boolean"
    )


@SUITE.query(
    "match_sequence_rules",
    _SEQ + " SELECT tenant_id, entity_key, pattern_id, event_id AS triggering_event_id, round(span / 1e6, 1) AS span_seconds, 3 AS stage_count FROM w "
    "WHERE fired AND (tenant_id <> 'tenant-1' OR pattern_id IN (" + ", ".join(f"'{p.id}'" for p in PATTERNS[:3]) + "))",
)
def _(spark, sf_dir):
    stages = Q.pattern_stages(sequence_rules(spark, sf_dir), PATTERNS)
    m = Q.match_sequence_rules(sequence_events(spark, sf_dir), stages)
    return m.select("tenant_id", "entity_key", "pattern_id", "triggering_event_id", "span_seconds", "stage_count")


@SUITE.query(
    "sequence_progress",
    _SEQ + f", l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_key, pattern_id ORDER BY rn DESC) = 1) SELECT tenant_id, "
    f"entity_key, pattern_id, n AS done, CAST(round(n / 3 * 100) AS INT) AS progress_pct FROM l WHERE n > 0 AND epoch_us({NOW}) - t0 <= {_SPAN}",
)
def _(spark, sf_dir):
    p = Q.sequence_progress(sequence_events(spark, sf_dir), F.expr(NOW), PATTERNS)
    return p.select("tenant_id", "entity_key", "pattern_id", "done", "progress_pct")


@SUITE.query(
    "sequence_alert_to_event",
    _SEQ + " SELECT pattern_id || '-' || event_id AS event_id, tenant_id, CASE WHEN pattern_id IN ('lateral-movement-classic','scan-exploit-c2',"
    "'defense-evasion-to-exfil') THEN 'critical' ELSE 'high' END AS severity, 0.92::DOUBLE AS ensemble_score, 0.95::DOUBLE AS meta_score, entity_key AS "
    "source_entity FROM w WHERE fired",
)
def _(spark, sf_dir):
    from duskwatch.operators.narrative import sequence_alert_to_event

    alerts = Q.match_sequence(sequence_events(spark, sf_dir), PATTERNS)
    return sequence_alert_to_event(alerts).select("event_id", "tenant_id", "severity", "ensemble_score", "meta_score", "source_entity")


@SUITE.query("publish_sequences")
def _(spark, sf_dir):
    return Q.publish_sequences(Q.match_sequence(sequence_events(spark, sf_dir), PATTERNS))


_OWN = (
    "own AS (SELECT tenant_id, 'own-' || (user_id % 4) AS id, bool_or(value > 300) AS is_active FROM sec WHERE user_id % 3 <> 2 GROUP BY 1, 2), act AS "
    "(SELECT tenant_id, id FROM own WHERE is_active)"
)


@SUITE.query(
    "tenant_patterns",
    SEC + ", " + _OWN + " SELECT * FROM act UNION ALL SELECT t.tenant_id, p.id FROM (SELECT DISTINCT tenant_id FROM sec) t, (SELECT unnest(["
    + ", ".join(f"'{p.id}'" for p in PATTERNS) + "]) AS id) p WHERE t.tenant_id NOT IN (SELECT tenant_id FROM act)",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    own = ev.where("user_id % 3 <> 2").groupBy("tenant_id", F.concat(F.lit("own-"), (F.col("user_id") % 4).cast("string")).alias("id")).agg(
        F.bool_or(F.col("value") > 300).alias("is_active")
    )
    return Q.tenant_patterns(own, ev.select("tenant_id").distinct(), [p.id for p in PATTERNS])


# ---- campaigns ----

_CC = (
    SEC.replace("WITH ", "WITH RECURSIVE ", 1) + ", e AS (SELECT DISTINCT tenant_id, src_ip AS a, dst_ip AS b FROM sec WHERE meta_score >= 0.9), ed AS (SELECT * FROM e UNION "
    "SELECT tenant_id, b, a FROM e), reach AS (SELECT tenant_id, a AS node, a AS label FROM ed UNION SELECT ed.tenant_id, ed.b, reach.label FROM reach "
    "JOIN ed ON ed.tenant_id = reach.tenant_id AND ed.a = reach.node), comp AS (SELECT tenant_id, node, min(label) AS component FROM reach GROUP BY 1, 2), "
    "tg AS (SELECT sec.* EXCLUDE (campaign_id), 'campaign-' || component AS campaign_id, component FROM sec JOIN comp ON comp.tenant_id = sec.tenant_id AND "
    "comp.node = sec.src_ip WHERE meta_score >= 0.9), cc AS (SELECT * FROM tg WHERE (tenant_id, component) IN (SELECT (tenant_id, component) FROM tg GROUP "
    "BY tenant_id, component HAVING max(meta_score) >= 0.95))"
)


def _campaign_events(spark, sf_dir):
    # at the default .3 every tenant is one component; .9 keeps several apart
    return C.correlate_campaigns(sequence_events(spark, sf_dir), 0.9, 0.95)


@SUITE.query("correlate_campaigns", _CC + " SELECT event_id, tenant_id, campaign_id FROM cc")
def _(spark, sf_dir):
    return _campaign_events(spark, sf_dir).select("event_id", "tenant_id", "campaign_id")


_CC_ALL = _CC.replace("meta_score >= 0.9)", "meta_score >= 0.3)").replace("WHERE meta_score >= 0.9", "WHERE meta_score >= 0.3").replace(">= 0.95", ">= 0.6")


@SUITE.query("correlate_campaigns_all", _CC_ALL + " SELECT event_id, tenant_id, campaign_id FROM cc")
def _(spark, sf_dir):
    """All events at the default thresholds; in the test data every tenant is one campaign."""
    return C.correlate_campaigns(sequence_events(spark, sf_dir)).select("event_id", "tenant_id", "campaign_id")


_KC = "CASE replace(tactic,'-','_') " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(C.KILL_CHAIN)) + " END"


@SUITE.query(
    "campaign_rollup",
    _CC + f", g AS (SELECT tenant_id, campaign_id, max(meta_score) AS meta_score, max({_KC}) AS st, arg_min(severity, epoch_us(timestamp)) AS seed, count(*) AS "
    "events, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS techniques FROM cc GROUP BY 1, 2), a AS (SELECT tenant_id, campaign_id, "
    "count(DISTINCT e) AS affected_assets FROM (SELECT tenant_id, campaign_id, src_ip AS e FROM cc UNION ALL SELECT tenant_id, campaign_id, dst_ip FROM cc) "
    "GROUP BY 1, 2) SELECT g.tenant_id, g.campaign_id, meta_score, CASE WHEN meta_score >= 0.9 THEN 'critical' WHEN meta_score >= 0.75 AND seed <> "
    "'critical' THEN 'high' ELSE seed END AS severity, [" + ", ".join(f"'{k}'" for k in C.KILL_CHAIN) + "][st + 1] AS stage, events, techniques, "
    "affected_assets FROM g JOIN a ON a.tenant_id = g.tenant_id AND a.campaign_id = g.campaign_id",
)
def _(spark, sf_dir):
    r = C.campaign_rollup(_campaign_events(spark, sf_dir))
    return r.select(
        "tenant_id", "campaign_id", "meta_score", "severity", "stage", "events", F.array_join("technique_ids", ",").alias("techniques"), "affected_assets"
    )


# ---- folds ----

_POST = (
    SEC.replace("WITH ", "WITH RECURSIVE ", 1) + ", o AS (SELECT tenant_id, event_id, epoch_us(timestamp) AS us, meta_score AS m, row_number() OVER (PARTITION BY tenant_id ORDER "
    "BY timestamp, event_id) AS rn FROM sec), p AS (SELECT tenant_id, event_id, us, rn, CASE WHEN m > 0.7 THEN greatest(0, 82 - m*2.5) WHEN m < 0.3 THEN "
    "least(100, 82.3) ELSE 82 END::DOUBLE AS score FROM o WHERE rn = 1 UNION ALL SELECT o.tenant_id, o.event_id, o.us, o.rn, CASE WHEN o.m > 0.7 THEN "
    "greatest(0, p.score - o.m*2.5) WHEN o.m < 0.3 THEN least(100, p.score + 0.3) ELSE p.score END::DOUBLE FROM p JOIN o ON o.tenant_id = p.tenant_id AND "
    "o.rn = p.rn + 1)"
)


@SUITE.query("posture_running", _POST + " SELECT tenant_id, event_id, round(score, 6) AS score FROM p")
def _(spark, sf_dir):
    return ST.posture_running(sec_events(spark, sf_dir)).select("tenant_id", "event_id", F.round("score", 6).alias("score"))


@SUITE.query(
    "posture_minutes",
    _POST + " SELECT tenant_id, us - us % 60000000 AS minute_us, round(arg_max(score, rn), 6) AS score FROM p GROUP BY 1, 2",
)
def _(spark, sf_dir):
    m = ST.posture_minutes(ST.posture_running(sec_events(spark, sf_dir)))
    return m.select("tenant_id", F.unix_micros("minute").alias("minute_us"), F.round("score", 6).alias("score"))


_WF = (
    _SC.replace("WITH ", "WITH RECURSIVE ", 1) + f", v AS (SELECT tenant_id, event_id AS id, [s1, s2, s3, s4, s5] AS s, CASE {VERDICT} WHEN 'true_positive' THEN 1 WHEN "
    "'false_positive' THEN -1 ELSE 0 END AS sg, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp, event_id) AS rn FROM sc WHERE value >= 60), "
    "wf AS (SELECT tenant_id, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS rn, [0.55, 0.05, 0.3, 0.05, 0.05]::DOUBLE[] AS w FROM v WHERE rn = 1 UNION ALL "
    "SELECT v.tenant_id, v.id, v.rn, list_transform(u, lambda x: x / (u[1] + u[2] + u[3] + u[4] + u[5])) FROM (SELECT v.tenant_id, v.id, v.rn, "
    "list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN v.s[i] > 0.5 AND sg > 0 THEN least(wf.w[i] + 0.01, 0.5) WHEN v.s[i] > 0.5 AND sg < 0 THEN "
    "greatest(wf.w[i] - 0.01, 0.05) ELSE wf.w[i] END::DOUBLE) AS u FROM wf JOIN v ON v.tenant_id = wf.tenant_id AND v.rn = wf.rn + 1) v)"
)


@SUITE.query(
    "weights_fold",
    _WF + " SELECT tenant_id, id, " + ", ".join(f"round(w[{i}], 6) AS w{i}" for i in range(1, 6)) + " FROM wf WHERE rn > 0",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir).where("value >= 60").select(
        "tenant_id", F.col("event_id").alias("id"), F.col("timestamp").alias("created_at"), F.expr(VERDICT).alias("verdict"),
        F.array(*_streams()).alias("stream_scores"),
    )
    w = ST.weights_fold(ev)
    return w.select("tenant_id", "id", *[F.round(F.col("weights")[i], 6).alias(f"w{i + 1}") for i in range(5)])
