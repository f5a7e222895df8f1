"""Rules and indicators in numbers, and tenants that share an address."""

import random

from pyspark.sql import functions as F

from duskwatch.operators import graph, hunts, intel
from duskwatch.operators import sequence as Q



def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")

STAGE = "struct<name:string,tactic:string,technique_prefix:string,min_ml_score:double>"
RULES = f"tenant_id string, id string, name string, stages array<{STAGE}>, max_span_seconds int, severity string, mitre_tactic string, is_active boolean"


def chain(spark, rows):
    df = spark.createDataFrame(rows, "tenant_id string, entity string, event_id long, s long, tactic string, technique_id string, meta_score double")
    pred = F.when(F.col("tactic").isNotNull(), F.array(F.struct("technique_id", "tactic")))
    return df.withColumns({"timestamp": F.timestamp_seconds("s"), "mitre_predictions": pred})


def rule(tenant, rid, stages, active=True):
    return (tenant, rid, rid, stages, 600, "HIGH", "TA0001", active)


def test_rules_as_rows_equal_rules_as_literals(spark):
    rng = random.Random(1)
    tactics = ["discovery", "Credential-Access", "lateral-movement", None, "impact"]
    rows = [(rng.choice(["a", "b", "c"]), rng.choice(["x", "y", None]), i, i * 20, rng.choice(tactics), rng.choice(["T1046", "T1003.001", None]), rng.choice([0.2, 0.6, 0.9, None])) for i in range(600)]
    ev = chain(spark, rows)
    mine = [
        rule("a", "r1", [("s1", "discovery", "", 0.5), ("s2", "credential-access", "T1003", 0.0)]), rule("a", "r2", [("s1", None, "T1046", 0.1), ("s2", "", "", 0.8)]),
        rule("b", "off", [("s1", "discovery", "", 0.0)], False), rule(None, "nobody", [("s1", "discovery", "", 0.0)]), rule("c", "empty", []),
    ]
    table = spark.createDataFrame(mine, RULES)
    own = {"a": [Q.Pattern(r[1], r[2], tuple(Q.Stage(s[0], s[1] or None, s[3], s[2] or None) for s in r[3]), r[4], r[5], r[6]) for r in mine[:2]]}
    cols = ["tenant_id", "entity_key", "pattern_id", "triggering_event_id", "span_seconds", "severity", "stage_count"]
    want = sorted(map(tuple, Q.match_sequence(ev, own=own).select(*cols).collect()))
    got = sorted(map(tuple, Q.match_sequence_rules(ev, Q.pattern_stages(table)).select(*cols).collect()))
    assert got == want and {r[2] for r in want} >= {"r1", "r2", "lateral-movement-classic"}


def test_twenty_thousand_tenant_rules(spark):
    rules = spark.range(20_000).select(
        F.concat(F.lit("t"), (F.col("id") % 50).cast("string")).alias("tenant_id"), F.concat(F.lit("r"), "id").alias("id"), F.lit("n").alias("name"),
        F.array(
            F.struct(F.lit("a").alias("name"), F.lit("discovery").alias("tactic"), F.lit("").alias("technique_prefix"), (F.col("id") / 20_000).alias("min_ml_score")),
            F.struct(F.lit("b").alias("name"), F.lit("impact").alias("tactic"), F.lit("").alias("technique_prefix"), F.lit(0.0).alias("min_ml_score")),
        ).alias("stages"),
        F.lit(600).alias("max_span_seconds"), F.lit("HIGH").alias("severity"), F.lit("x").alias("mitre_tactic"), F.lit(True).alias("is_active"),
    )
    ev = chain(spark, [("t7", "e", 1, 0, "discovery", "T1", 0.1), ("t7", "e", 2, 100, "impact", "T1", 0.5), ("t8", "e", 3, 0, "impact", "T1", 0.5), ("none", "e", 4, 0, "discovery", "T1", 0.9)])
    got = Q.match_sequence_rules(ev, Q.pattern_stages(rules)).collect()
    assert len(got) == 40 and {(r.tenant_id, r.triggering_event_id, r.span_seconds) for r in got} == {("t7", 2, 100.0)}
    assert {int(r.pattern_id[1:]) for r in got} == {i for i in range(7, 2001, 50)}


def test_a_million_indicators(spark, monkeypatch):
    word = F.concat(F.sha2(F.col("id").cast("string"), 224), F.when(F.col("id") % 3 == 0, ".example.com").otherwise(""))
    iocs = spark.range(1_000_000).select(word.alias("indicator"), F.lit("hash").alias("itype"), F.lit("malware").alias("threat_type"), F.concat(F.lit("n"), "id").alias("threat_name"), F.lit(0.9).alias("confidence"))
    iocs = iocs.unionByName(spark.createDataFrame([(x, "hash", "m", x, 0.5) for x in ("é", "zz", "q-_q", "")], iocs.schema))
    picked = {r.id: r.w for r in spark.range(0, 1_000_000, 99_999).select("id", word.alias("w")).collect()}
    texts = [(i, f"seen {w} twice {w}") for i, w in picked.items()] + [(-1, "nothing"), (-2, None), (-3, "q-_q and É and zz"), (-4, "")]
    ev = spark.createDataFrame(texts, "event_id long, message string").withColumn("signature_id", F.lit(None).cast("string"))
    want = sorted([(i, f"n{i}") for i in picked] + [(-3, "é"), (-3, "zz"), (-3, "q-_q")])
    for listed in (4_000_000, 10):
        monkeypatch.setattr(intel, "LISTED_GRAMS", listed)
        assert sorted(map(tuple, intel.match_ioc_hash(ev, iocs).select("event_id", "threat_name").collect())) == want


def events(spark):
    base = {"user_id": 1, "geo_country": "US", "dst_port": 445, "bytes_out": 10, "hostname": "h", "process_name": "p.exe", "command_line": "x", "target_process": "lsass.exe", "url": "u", "http_referrer": "mail"}
    rows = []
    for tenant, count in (("a", 4), ("b", 4)):
        for i in range(count):
            rows.append({**base, "tenant_id": tenant, "event_id": len(rows), "src_ip": "10.0.0.1", "dst_ip": f"10.0.1.{i + (10 if tenant == 'b' else 0)}", "action": "connect", "outcome": "success"})
        rows.append({**base, "tenant_id": tenant, "event_id": len(rows), "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "dst_port": 443, "bytes_out": 6_000_000, "action": "authenticate", "outcome": "success", "geo_country": "US" if tenant == "a" else "DE"})
        rows += [{**base, "tenant_id": tenant, "event_id": len(rows) + j, "src_ip": "10.0.0.1", "dst_ip": "x", "dst_port": 1, "action": "login", "outcome": "failure"} for j in range(3)]
    names = sorted(rows[0])
    kinds = {"event_id": "long", "user_id": "long", "dst_port": "int", "bytes_out": "long"}
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))
    return df.withColumn("timestamp", F.lit("2024-01-30 23:00:00").cast("timestamp"))


def test_tenants_that_share_an_address_are_kept_apart(spark):
    """Together the two tenants would pass every threshold; alone none does."""
    ev = events(spark)
    merged = ev.withColumn("tenant_id", F.lit("a"))
    for hid in ("HUNT-001", "HUNT-002", "HUNT-003", "HUNT-004"):
        assert hunts.HUNTS[hid](ev, now()).count() == 0 and hunts.HUNTS[hid](merged, now()).count() == 1, hid
    assert hunts.run_hunts(ev, now()).where("template IN ('HUNT-001', 'HUNT-002', 'HUNT-003', 'HUNT-004')").count() == 0
    assert {r.template for r in hunts.run_hunts(merged, now()).collect()} >= {"HUNT-001", "HUNT-002", "HUNT-003", "HUNT-004", "HUNT-008"}
    assert {r.tenant_id for r in hunts.run_hunts(ev, now()).where("template = 'HUNT-008'").collect()} == {"a", "b"}


def test_one_scan_equals_the_single_hunts(spark):
    ev = events(spark).withColumn("action", F.when(F.col("event_id") % 5 == 0, "process_access").when(F.col("event_id") % 5 == 1, "process_creation").otherwise(F.col("action")))
    ev = ev.withColumn("process_name", F.when(F.col("event_id") % 2 == 0, "C:\\SchTasks.exe").otherwise(F.col("process_name")))
    limits = {"hunt_002": {"failures": 0}, "hunt_003": {"fan_out": 2}, "hunt_004": {"min_bytes": 100}, "hunt_005": {"min_count": 0}}
    got = {}
    for r in hunts.run_hunts(ev, now(), **limits).collect():
        got[r.template, r.tenant_id] = got.get((r.template, r.tenant_id), 0) + 1
    want = {}
    for hid, *_, hours in hunts.TEMPLATES:
        for r in hunts.HUNTS[hid](ev, now(), hours, **limits.get(hid.replace("-", "_").lower(), {})).collect():
            want[hid, r.tenant_id] = want.get((hid, r.tenant_id), 0) + 1
    assert got == want and len({k[0] for k in want}) >= 6


def test_graph_of_a_tenant(spark):
    edges = spark.createDataFrame([("a", "1", "2"), ("b", "2", "3"), ("a", "5", "6")], "tenant_id string, src string, dst string")
    nodes = spark.createDataFrame([(t, str(i)) for t in "ab" for i in range(1, 7)], "tenant_id string, id string")
    near, kept = graph.neighborhood(nodes, edges, "a", "1", 3)
    assert sorted((r.tenant_id, r.id, r.hops) for r in near.collect()) == [("a", "1", 0), ("a", "2", 1)] and kept.count() == 1
    assert {(r.tenant_id, r.id): r.degree for r in graph.node_degree(nodes, edges).collect()}["a", "2"] == 1
