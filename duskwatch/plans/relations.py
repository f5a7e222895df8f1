"""Scalars, masking, graph, vectors and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions import text as TX
from duskwatch.functions import vectors as V
from duskwatch.operators import evaluation as E
from duskwatch.operators import retraining as RT
from duskwatch.operators import similar as SI
from duskwatch.operators import graph as G
from duskwatch.operators.hunts import hunt, hunt_with_similar, p_ml, p_similar
from duskwatch.plans.base import SEC, Suite, sec_events, table
from duskwatch.plans.side import RANK_SQL
from duskwatch.session import shared_folder

SUITE = Suite()

# ---- names and masking ----


@SUITE.query(
    "norm_ip",
    SEC + " SELECT event_id, src_ip AS ip FROM sec",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    padded = F.concat(F.lit(" ::ffff:"), F.regexp_replace("src_ip", r"\.(\d+)$", r".00$1"), F.lit(" "))
    return ev.select("event_id", TX.norm_ip(padded).alias("ip"))


@SUITE.query("norm_hostname", SEC + " SELECT event_id, coalesce(hostname || '.corp.example', 'none.') AS host FROM sec")
def _(spark, sf_dir):
    raw = F.coalesce(F.concat(F.lit(" "), F.upper("hostname"), F.lit(".Corp.Example. ")), F.lit("none.."))
    return sec_events(spark, sf_dir).select("event_id", TX.norm_hostname(raw).alias("host"))


@SUITE.query(
    "norm_username",
    SEC + " SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'u' || user_id || '@corp' WHEN 1 THEN 'u' || user_id || '@x.example' ELSE 'u' || user_id END AS name FROM sec",
)
def _(spark, sf_dir):
    u = F.col("user_id").cast("string")
    raw = (
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" CORP\\U"), u)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("U"), u, F.lit("@X.example ")))
        .otherwise(F.concat(F.lit("U"), u))
    )
    return sec_events(spark, sf_dir).select("event_id", TX.norm_username(raw).alias("name"))


@SUITE.query(
    "canonicalize_entities",
    SEC + " SELECT event_id, CASE k % 5 WHEN 0 THEN src_ip WHEN 1 THEN 'host' || user_id || '.a' WHEN 2 THEN 'u' || user_id || '@d' WHEN 3 THEN 'dom.b' ELSE "
    "'proc.exe' END AS identifier FROM sec",
)
def _(spark, sf_dir):
    k, u = F.col("k") % 5, F.col("user_id").cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ip", "host", "user", "domain", "process")]), (k + 1).cast("int"))
    raw = (
        F.when(k == 0, F.concat(F.lit(" "), "src_ip")).when(k == 1, F.concat(F.lit("HOST"), u, F.lit(".a."))).when(k == 2, F.concat(F.lit("D\\U"), u))
        .when(k == 3, F.lit("Dom.B.")).otherwise(F.lit(" Proc.EXE "))
    )
    return sec_events(spark, sf_dir).select("event_id", TX.canonical_identifier(raw, kind).alias("identifier"))


@SUITE.query(
    "is_internal",
    SEC + " SELECT event_id, starts_with(dst_ip, '10.') AS internal FROM sec",
)
def _(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_id", TX.is_internal(F.col("dst_ip")).alias("internal"))


@SUITE.query("severity_rank", SEC + f" SELECT event_id, {RANK_SQL} AS rank FROM sec")
def _(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_id", TX.severity_rank(F.col("severity")).alias("rank"))


def _mask_sql(source: str, out: str) -> str:
    """The four passes: cut at matches, then put a hash of each match back in between."""
    steps, prev = [], source
    for i, (kind, rx) in enumerate(TX.PII_PATTERNS):
        rx = rx.replace("'", "''")
        gaps = f"string_split_regex(t, '{rx}')"
        hits = f"regexp_extract_all(t, '{rx}')"
        steps.append(
            f"m{i} AS (SELECT id, array_to_string(list_transform(range(1, len({gaps}) + 1), lambda j: {gaps}[j] || CASE WHEN j <= len({hits}) THEN "
            f"'[{kind}:' || substr(sha256(lower(trim({hits}[j]))), 1, 12) || ']' ELSE '' END), '') AS t FROM {prev})"
        )
        prev = f"m{i}"
    return ", ".join(steps) + f" SELECT id AS doc_id, md5(t) AS digest, length(t) AS n FROM {prev}"


@SUITE.query("mask_pii", "WITH src AS (SELECT doc_id AS id, text AS t FROM documents), " + _mask_sql("src", "t"))
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", TX.mask_pii(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@SUITE.query(
    "mask_event",
    "SELECT doc_id, '[EMAIL:' || substr(sha256(lower(lang || '@x.example')), 1, 12) || ']' AS email, '[USER:' || substr(sha256('name ' || source), 1, 12) || ']' AS "
    "full_name, 'call [PHONE:' || substr(sha256('555-123-4567'), 1, 12) || ']' AS note FROM documents",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("lang", F.lit("@x.example")).alias("email"),
        F.struct(F.concat(F.lit("Name "), "source").alias("full_name"), F.array(F.lit("call 555-123-4567")).alias("notes")).alias("person"),
    )
    m = TX.mask_event(d, ("doc_id",))
    return m.select("doc_id", "email", F.lower("person.full_name").alias("x"), F.col("person.full_name").alias("full_name"), F.col("person.notes")[0].alias("note")).drop("x")


# ---- graph ----

_EDGE = (
    SEC + ", ed AS (SELECT tenant_id, src_ip AS source_entity, dst_ip AS target_entity, action AS relationship_type, arg_max(campaign_id, epoch_us(timestamp)) FILTER "
    "(WHERE campaign_id IS NOT NULL) AS campaign_id, max(meta_score) AS confidence, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM sec GROUP BY 1, "
    "2, 3, 4)"
)


@SUITE.query(
    "edges_from_events",
    _EDGE + " SELECT tenant_id, source_entity, target_entity, relationship_type, campaign_id, confidence, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS "
    "last_us FROM ed",
)
def _(spark, sf_dir):
    e = G.edges_from_events(sec_events(spark, sf_dir))
    return e.withColumns({"first_us": F.unix_micros("first_seen"), "last_us": F.unix_micros("last_seen")}).drop("first_seen", "last_seen")


def _ring(spark, sf_dir):
    """Directed edges between users' addresses: each user points at two others. Tenant u has the same nodes and the edges of even users only."""
    users = sec_events(spark, sf_dir).select("user_id").distinct()
    users = users.withColumn("tenant_id", F.lit("t")).unionByName(users.where("user_id % 2 = 0").withColumn("tenant_id", F.lit("u")))
    ends = F.array(F.concat(F.lit("n"), F.col("user_id") + 1), F.concat(F.lit("n"), F.col("user_id") * 2))
    return users.select(
        "tenant_id", F.concat(F.lit("n"), "user_id").alias("source_entity"), F.explode(F.array_distinct(ends)).alias("target_entity")
    )


_RING = "ring AS (SELECT DISTINCT 'n' || user_id AS s, 'n' || t AS d FROM (SELECT user_id, unnest([user_id + 1, user_id * 2]) AS t FROM events))"


@SUITE.query(
    "entity_paths",
    f"WITH RECURSIVE {_RING}, p AS (SELECT [s, d] AS path, d AS e, 1 AS depth FROM ring WHERE s = 'n3' AND s <> d UNION ALL SELECT list_append(path, d), d, depth + 1 FROM p "
    "JOIN ring ON s = e WHERE depth < 3 AND NOT list_contains(path, d)) SELECT array_to_string(path, '>') AS path, depth FROM p",
)
def _(spark, sf_dir):
    p = G.entity_paths(_ring(spark, sf_dir), "t", "n3", 3)
    return p.select(F.array_join("path", ">").alias("path"), "depth")


def _graph(spark, sf_dir):
    e = _ring(spark, sf_dir).select("tenant_id", F.col("source_entity").alias("src"), F.col("target_entity").alias("dst"), F.lit("link").alias("type"))
    n = e.select("tenant_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.lit("Host"))
    return n, e


_NB = (
    f"WITH RECURSIVE {_RING}, u AS (SELECT s AS a, d AS b FROM ring UNION SELECT d, s FROM ring), r AS (SELECT 'n7' AS id, 0 AS h UNION SELECT b, h + 1 FROM r JOIN u ON a = id "
    "WHERE h < 2), n AS (SELECT id, min(h) AS hops FROM r GROUP BY 1)"
)


@SUITE.query("neighborhood_nodes", _NB + " SELECT id, hops FROM n")
def _(spark, sf_dir):
    return G.neighborhood(*_graph(spark, sf_dir), "t", "n7", 2)[0].select("id", "hops")


@SUITE.query("neighborhood_edges", _NB + " SELECT DISTINCT s AS src, d AS dst FROM ring WHERE s IN (SELECT id FROM n WHERE hops < 2) OR d IN (SELECT id FROM n WHERE hops < 2)")
def _(spark, sf_dir):
    return G.neighborhood(*_graph(spark, sf_dir), "t", "n7", 2)[1].select("src", "dst")


@SUITE.query(
    "node_degree",
    f"WITH {_RING}, r AS (SELECT 't' AS tenant_id, s, d FROM ring UNION ALL SELECT 'u', s, d FROM ring WHERE substr(s, 2)::BIGINT % 2 = 0) SELECT tenant_id, id, count(*) AS degree "
    "FROM (SELECT tenant_id, s AS id FROM r UNION ALL SELECT tenant_id, d FROM r) GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return G.node_degree(*_graph(spark, sf_dir)).select("tenant_id", "id", "degree")


@SUITE.query(
    "merge_edges",
    SEC + " SELECT tenant_id, src_ip AS src, dst_ip AS dst, action AS type, arg_max(event_id, (epoch_us(timestamp), event_id)) AS event_id, arg_max(meta_score, "
    "(epoch_us(timestamp), event_id)) AS weight FROM sec GROUP BY 1, 2, 3, 4",
)
def _(spark, sf_dir):
    e = sec_events(spark, sf_dir).select(
        "tenant_id", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("action").alias("type"), "event_id", F.col("meta_score").alias("weight"), "timestamp"
    )
    return G.merge_edges(e, F.struct("timestamp", "event_id")).drop("timestamp")


@SUITE.query(
    "upsert_latest",
    SEC + " SELECT tenant_id, src_ip, event_id, severity FROM sec QUALIFY row_number() OVER (PARTITION BY tenant_id, src_ip ORDER BY timestamp DESC, event_id DESC) = 1",
)
def _(spark, sf_dir):
    e = sec_events(spark, sf_dir).select("tenant_id", "src_ip", "timestamp", "event_id", "severity")
    return G.upsert_latest(e, ["tenant_id", "src_ip"], F.struct("timestamp", "event_id")).drop("timestamp")


# ---- vectors ----


def _query_vector(spark, sf_dir):
    """Vector of one known id: a point look-up of a single row."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


_COS = (
    "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7), c AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) / "
    "(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[]))) AS score FROM embeddings, q)"
)


@SUITE.query("similar_vectors", _COS + " SELECT vec_id, round(score, 6) AS score FROM c WHERE vec_id <> 7 AND score >= 0.1 ORDER BY c.score DESC, vec_id LIMIT 20")
def _(spark, sf_dir):
    s = V.similar_vectors(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, 0.1, exclude=F.col("vec_id") == 7)
    return s.select("vec_id", F.round("score", 6).alias("score"))


@SUITE.query("approx_similar")
def _(spark, sf_dir):
    s = V.approx_similar(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)
    return s.select("vec_id", F.round("score", 6).alias("score"))


@SUITE.query(
    "approx_similar_recall",
    "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
    "list_cosine_similarity(q.embedding, e.embedding) DESC, e.vec_id) AS rank FROM q JOIN embeddings e ON e.vec_id <> q.vec_id) SELECT count(DISTINCT query_id) AS queries, count(*) AS found, "
    "true AS recall_reached FROM s WHERE rank <= 10",
)
def _(spark, sf_dir):
    """One row in twenty asks for its ten nearest; 0.9 of the true ones must be among those found."""
    vectors = table(spark, sf_dir, "embeddings")
    got = SI.approx_similar(vectors, F.col("vec_id") % 20 == 0, 10).select("query_id", "id")
    index = SI.build(vectors)
    true = SI.search(index, SI.unit_rows(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding"), 10, exact=True).select("query_id", "id", F.lit(1).alias("hit"))
    both = got.join(true, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("found"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


@SUITE.query("hash_vector")
def _(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", V.hash_vector(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(F.array_max("v"), 6).alias("top"), F.round(F.col("v")[0], 6).alias("v0"))


@SUITE.query("p_similar")
def _(spark, sf_dir):
    """Hunt with a similarity part: event hits and similar narratives, counted together."""
    ev = sec_events(spark, sf_dir)
    hits = hunt(ev, "tenant-1", [p_ml(">", 0.5)], 50)
    notes = ev.where("tenant_id = 'tenant-1'").select("event_id", V.hash_vector(F.col("message")).alias("embedding"))
    query = ev.sparkSession.range(1).select(V.hash_vector(F.lit("mimikatz lsass access"))).first()[0]
    both = hunt_with_similar(hits, p_similar(notes, query))
    return both.withColumn("score", F.round("score", 6))


# ---- evaluation ----

_PRED_CASE = "CASE WHEN event_id % 4 = 0 THEN 'benign' WHEN event_id % 9 = 0 THEN 'ddos' ELSE ensemble_label END"
_PRED = SEC + f", pr AS (SELECT event_id, ensemble_label AS label, {_PRED_CASE} AS prediction FROM sec)"
_CM = (
    _PRED + ", cs AS (SELECT DISTINCT label AS class FROM pr UNION SELECT DISTINCT prediction FROM pr), cm AS (SELECT class, (SELECT count(*) FROM pr WHERE label = class) AS "
    "support, (SELECT count(*) FROM pr WHERE prediction = class) AS predicted, (SELECT count(*) FROM pr WHERE label = class AND prediction = class) AS tp FROM cs), mt AS "
    "(SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, support FROM cm), m AS (SELECT "
    "class, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support FROM mt)"
)


def predictions(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_id", F.col("ensemble_label").alias("label"), F.expr(_PRED_CASE).alias("prediction"))


@SUITE.query("class_metrics", _CM + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m")
def _(spark, sf_dir):
    m = E.class_metrics(predictions(spark, sf_dir))
    return m.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@SUITE.query(
    "weighted_metrics",
    _CM + " SELECT round(sum(precision*support)/sum(support), 6) AS weighted_precision, round(sum(recall*support)/sum(support), 6) AS weighted_recall, "
    "round(sum(f1*support)/sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM m",
)
def _(spark, sf_dir):
    w = E.weighted_metrics(E.class_metrics(predictions(spark, sf_dir)))
    return w.select(*[F.round(f"weighted_{c}", 6).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")], "support")


@SUITE.query(
    "exit_criteria",
    _CM + ", t AS (SELECT * FROM (VALUES ('sql_injection', 0.55::DOUBLE), ('infiltration', 0.55), ('exploits', 0.5), ('ddos', 0.6), ('unseen', 0.5)) x(class, threshold)) SELECT t.class, "
    "threshold, round(coalesce(f1, 0), 6) AS f1, CASE WHEN coalesce(support, 0) = 0 THEN 'NO_DATA' WHEN f1 >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM t LEFT "
    "JOIN m ON m.class = t.class",
)
def _(spark, sf_dir):
    out = E.exit_criteria(E.class_metrics(predictions(spark, sf_dir)), {**E.EXIT_F1, "unseen": 0.5})
    return out.withColumn("f1", F.round("f1", 6))


@SUITE.query("benign_fpr", _PRED.replace("'benign' WHEN event_id % 9", "'ddos' WHEN event_id % 9") + " SELECT round(count(*) FILTER (WHERE label = 'benign' AND prediction <> 'benign') / count(*) FILTER (WHERE label = 'benign'), 6) AS fpr FROM pr")
def _(spark, sf_dir):
    p = predictions(spark, sf_dir)
    p = p.withColumn("prediction", F.when(F.col("event_id") % 4 == 0, "ddos").otherwise(F.col("prediction")))
    return E.benign_fpr(p).select(F.round("fpr", 6).alias("fpr"))


_AUC = (
    SEC + ", sc AS (SELECT severity AS label, c.class, CASE c.class WHEN 'info' THEN 1 - temporal_score WHEN 'low' THEN k / 100.0::DOUBLE ELSE meta_score END AS p FROM sec, "
    "(SELECT unnest(['info', 'low', 'high']) AS class) c), rk AS (SELECT class, label = class AS pos, avg(rn) OVER (PARTITION BY class, p) AS rk FROM (SELECT *, "
    "row_number() OVER (PARTITION BY class ORDER BY p) AS rn FROM sc)), a AS (SELECT class, (sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER "
    "(WHERE pos) + 1) / 2) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)) AS auc, count(*) FILTER (WHERE pos) AS pos FROM rk GROUP BY 1)"
)


@SUITE.query("weighted_auc", _AUC + " SELECT class, round(auc, 6) AS auc, pos FROM a UNION ALL SELECT 'weighted', round(sum(auc*pos)/sum(pos), 6), CAST(sum(pos) AS BIGINT) FROM a")
def _(spark, sf_dir):
    probs = F.create_map(
        F.lit("info"), 1 - F.col("temporal_score"), F.lit("low"), F.col("k") / 100.0, F.lit("high"), F.col("meta_score")
    )
    a = E.weighted_auc(sec_events(spark, sf_dir).select(F.col("severity").alias("label"), probs.alias("probs")))
    total = a.agg((F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("auc"), F.sum("pos").alias("pos"))
    out = a.unionByName(total.select(F.lit("weighted").alias("class"), "auc", "pos"))
    return out.withColumn("auc", F.round("auc", 6))


def _buffer(spark, sf_dir):
    """Verdicts with the event's numbers as features; a third of the rows lacks a label or features."""
    ev = sec_events(spark, sf_dir)
    label = F.when(F.col("value") > 100, "true_positive").otherwise("false_positive")
    numbers = F.array(*[F.col(c).cast("double") for c in ("value", "k", "src_port", "dst_port", "bytes_in")])
    return ev.select(
        "tenant_id", F.col("event_id").alias("id"), F.col("timestamp").alias("created_at"), F.when(F.col("k") % 7 != 0, label).alias("label"),
        F.when(F.col("k") % 5 != 0, numbers).alias("features"),
    )


@SUITE.query(
    "retrain_gate",
    SEC + " SELECT tenant_id, count(*) AS buffered, count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 <> 0) AS valid, CAST(floor(count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 <> 0) * 0.8) AS "
    "BIGINT) AS train_rows, count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 <> 0) - CAST(floor(count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 <> 0) * 0.8) AS BIGINT) AS holdout_rows, "
    "0.0::DOUBLE AS old_f1, true AS learned, 'swap' AS decision FROM sec GROUP BY 1",
)
def _(spark, sf_dir):
    """The first version of every tenant: no model before it, so its F1 counts as 0; the new one must learn the rule behind the labels."""
    rows = RT.retrain_gate(RT.ModelStore(spark, shared_folder(spark, "models")), _buffer(spark, sf_dir), 1, trees=10, depth=5)
    return rows.select("tenant_id", "buffered", "valid", "train_rows", "holdout_rows", "old_f1", (F.col("new_f1") > 0.95).alias("learned"), "decision")


@SUITE.query(
    "retrain_split",
    SEC + ", n AS (SELECT tenant_id, event_id AS id, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp, event_id) AS rn, count(*) OVER (PARTITION BY tenant_id) "
    "AS c FROM sec) SELECT tenant_id, id, CASE WHEN rn <= floor(c * 0.8) THEN 'train' ELSE 'holdout' END AS part FROM n",
)
def _(spark, sf_dir):
    return E.time_split(_buffer(spark, sf_dir)).select("tenant_id", "id", "part")


@SUITE.query(
    "verdict_from_action",
    SEC + " SELECT 'FE-' || event_id AS finding_id, tenant_id, CASE k % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'escalated' END AS verdict, src_ip AS "
    "entity_value FROM sec",
)
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir)
    acts = ev.select(
        F.concat(F.lit("FE-"), "event_id").alias("finding_id"), "tenant_id", F.expr("CASE k % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'dismiss' ELSE 'review' END").alias("decision")
    )
    return E.verdict_from_action(acts, ev)


@SUITE.query(
    "clip_p99",
    SEC + ", q AS (SELECT 0.01 * quantile_cont(abs(value), 0.99) AS a, 0.01 * quantile_cont(CASE WHEN k <> 0 THEN abs(k)::DOUBLE END, 0.99) AS b FROM sec WHERE value <> 0) SELECT event_id, "
    "round(least(greatest(value, -a), a), 6) AS value, round(least(greatest(k, -b), b), 6) AS k FROM sec, q",
)
def _(spark, sf_dir):
    # factor 0.01 so that clipping happens on the test data
    c = E.clip_p99(sec_events(spark, sf_dir).select("event_id", "value", "k"), ["value", "k"], 0.01)
    return c.select("event_id", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


@SUITE.query("drop_all_zero", SEC + " SELECT event_id FROM sec WHERE k <> 0 OR event_id % 50 <> 0")
def _(spark, sf_dir):
    ev = sec_events(spark, sf_dir).withColumn("f", F.array(F.col("k").cast("double"), (F.col("event_id") % 50).cast("double")))
    return E.drop_all_zero(ev, "f").select("event_id")


@SUITE.query(
    "standardize",
    SEC + ", q AS (SELECT avg(value) AS m, stddev_pop(value) AS s, avg(k) AS mk, stddev_pop(k) AS sk FROM sec) SELECT event_id, round((value - m) / s, 5) AS value, round((k - mk) / sk, "
    "5) AS k FROM sec, q",
)
def _(spark, sf_dir):
    s = E.standardize(sec_events(spark, sf_dir).select("event_id", "value", "k"), ["value", "k"])
    return s.select("event_id", F.round("value", 5).alias("value"), F.round("k", 5).alias("k"))


@SUITE.query(
    "stratified_split",
    SEC + ", n AS (SELECT ensemble_label, count(*) AS c FROM sec GROUP BY 1) SELECT ensemble_label, CAST(floor(c * 0.8) AS BIGINT) AS train, CAST(c - floor(c * 0.8) AS BIGINT) AS test FROM n",
)
def _(spark, sf_dir):
    s = E.stratified_split(sec_events(spark, sf_dir).select("event_id", "ensemble_label"), "ensemble_label", "event_id")
    return s.groupBy("ensemble_label").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"))
