"""The chained stream against its batch twin, forgetting of state, campaigns in any order, current tables."""

import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import assess as A
from duskwatch.operators import campaigns as C
from duskwatch.operators import sequence as Q
from duskwatch.operators import state as ST
from duskwatch.plans.base import sec_events
from duskwatch.sources.current import CurrentTable
from duskwatch.streaming import processors as P
from duskwatch.streaming.campaigns import CampaignState, campaign_stream
from duskwatch.streaming.pipeline import Sinks, Start, scored_stream, start_pipeline

SF = "/root/testdata/sf0.001"
PATTERN = [Q.Pattern("p", "p", (Q.Stage("a", "command-and-control", 0.0), Q.Stage("b", "initial-access", 0.0)), 864_000)]
DROP = ["ensemble_label", "meta_score", "user_id"]


def flat(spark):
    ev = sec_events(spark, SF).drop(*DROP).withColumns({"entity": F.col("source_type"), "temporal_score": F.col("temporal_score")})
    return ev.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def in_files(df, path, cuts):
    """One file per stretch of time, in order."""
    bounds = [None, *df.select(F.percentile("us", F.array(*[F.lit(c) for c in cuts]))).first()[0], None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = df if low is None else df.where(F.col("us") > low)
        part = part if high is None else part.where(F.col("us") <= high)
        part.drop("us").coalesce(1).write.parquet(f"{path}/src/{i}")


def source(spark, df, path, cuts=(0.3, 0.6)):
    timed = df.withColumn("us", F.unix_micros("timestamp").cast("double"))
    in_files(timed, path, cuts)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/src/*")


def values(rows):
    num = lambda x: round(x, 9)
    return {
        r.event_id: (
            num(r.ensemble_score), num(r.adversarial_score), num(r.meta_score), r.before_event_count, r.before_unique_dst_ips, r.event_count, num(r.risk), num(r.posture_delta),
            num(r.posture), r.recommendation.action, len(r.rule_matches), len(r.ioc_matches), r.narrative, r.timestamp,
        )
        for r in rows
    }


@pytest.fixture(scope="module")
def replayed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    events = flat(spark)
    sinks = Sinks(f"{path}/out", min_score=0.9, seed_score=0.95, buckets=3)
    query = start_pipeline(scored_stream(source(spark, events, path), "1 hour", PATTERN), sinks, f"{path}/ck", availableNow=True)
    query.awaitTermination(600)
    assert query.exception() is None
    batch = A.with_running_posture(A.assess(events)).persist()
    return events, sinks, query, batch


def test_replay_equals_batch(spark, replayed):
    events, sinks, _, batch = replayed
    got, want = values(sinks.events(spark).collect()), values(batch.collect())
    assert len(want) == events.count() and got == want
    assert len({v[9] for v in want.values()}) > 1 and max(v[8] for v in want.values()) != min(v[8] for v in want.values())


def test_sequences_and_campaigns_of_the_replay(spark, replayed):
    _, sinks, _, batch = replayed
    got = spark.read.parquet(f"{sinks.path}/sequences").select("tenant_id", "entity_key", "triggering_event_id", "pattern_id", "span_seconds").collect()
    want = Q.match_sequence(batch, PATTERN).select("tenant_id", "entity_key", "triggering_event_id", "pattern_id", "span_seconds").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    tagged = sinks.campaigns(spark).tag(batch).select("event_id", "campaign_id").collect()
    assert sorted(map(tuple, tagged)) == sorted(map(tuple, C.correlate_campaigns(batch, 0.9, 0.95).select("event_id", "campaign_id").collect()))
    written = {r.event_id: r.campaign_id for r in sinks.events(spark).where("campaign_id IS NOT NULL").collect()}
    assert written == dict(map(tuple, tagged))


def test_current_entity_rows(spark, replayed):
    _, sinks, _, batch = replayed
    got = {(r.tenant_id, r.entity): (r.event_count, r.timestamp) for r in sinks.entities(spark).read().collect()}
    last = batch.groupBy("tenant_id", "entity").agg(F.max_by(F.struct("event_count", "timestamp"), F.struct("timestamp", F.col("event_id").cast("string"))).alias("r"))
    assert got == {(r.tenant_id, r.entity): tuple(r.r) for r in last.collect()}


def test_chain_of_three_operators(spark, replayed):
    """Entity state, sequences and posture in one query; what the store holds is bounded by the keys, not by the events."""
    events, _, query, _ = replayed
    operators = query.recentProgress[-1]["stateOperators"]
    keys = events.select("tenant_id", "entity").distinct().count()
    assert len(operators) == 3 and sum(o["customMetrics"]["numDeletedTimers"] for p in query.recentProgress for o in p["stateOperators"]) > 0
    # per entity: counters, timer, at most 100 values of each kind, recent times; per pattern one entry
    assert sum(o["numRowsTotal"] for o in operators) <= keys * (2 + 200 + 1 + 4)


def test_initial_state_continues_history(spark, tmp_path):
    events = flat(spark)
    cut = events.agg(F.percentile_approx("timestamp", 0.5)).first()[0]
    old, new = events.where(F.col("timestamp") <= F.lit(cut)), events.where(F.col("timestamp") > F.lit(cut))
    start = Start(ST.final_entity_state(old, F.lit(cut)))
    stream = P.with_entity_state(source(spark, new, str(tmp_path)), start.entities, "1 hour")
    q = stream.select("event_id", *ST.STATE, "times_us").writeStream.format("memory").queryName("continued").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = ST.entity_pass(events, recent=30, in_run=True).where(F.col("timestamp") > F.lit(cut)).select("event_id", *ST.STATE, "times_us")
    got = {r.event_id: tuple(r) for r in spark.table("continued").collect()}
    # an entity idle for a day at the cut and back before the watermark knows starts anew in both
    assert got == {r.event_id: tuple(r) for r in want.collect()}


def batches_of(spark, parts, schema, path):
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("timestamp", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))
        df.coalesce(1).write.parquet(f"{path}/src/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/src/*")


def run(stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def test_idle_entities_leave_and_late_rows_are_dropped(spark, tmp_path):
    day = 86_400.0
    rows = "tenant_id string, entity string, event_id bigint, t double, dst_ip string, dst_port int, campaign_id string"
    parts = [
        [("t", f"e{i}", i, 1000.0 + i, f"ip{i}", 22, None) for i in range(20)], [("t", "late", 100, 3 * day, "ip", 22, None)], [("t", "other", 110, 3 * day + 30, "ip", 22, None)],
        [("t", "late", 101, 1005.0, "ip", 22, None), ("t", "late", 102, 3 * day + 60, "ip2", 22, None)], [("t", "e1", 103, 6 * day, "x", 1, None)],
        [("t", "e1", 104, 6 * day + 10, "y", 1, None)],
    ]
    q = run(P.entity_state_stream(batches_of(spark, parts, rows, str(tmp_path)), lateness="10 minutes"), "idle_out", tmp_path)
    got = {r.event_id: tuple(r)[3:6] for r in spark.table("idle_out").collect()}
    assert 101 not in got and got[102] == (2, 2, 2) and got[103] == (1, 1, 1) and got[104] == (2, 2, 2)
    totals = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    # all of one entity remains: its counters, timer, values and times
    assert max(totals) > 4 * totals[-1]


def test_unfinished_sequences_leave(spark, tmp_path):
    rows = "tenant_id string, entity string, event_id bigint, t double, tactic string, meta_score double"
    parts = [[("t", f"e{i}", i, 1000.0, "discovery", 0.9) for i in range(20)], [("t", "z", 50, 50_000.0, "discovery", 0.9)], [("t", "z", 51, 50_100.0, "credential-access", 0.9)],
             [("t", "z", 52, 50_200.0, "lateral-movement", 0.9), ("t", "e1", 53, 50_200.0, "credential-access", 0.9), ("t", "e1", 54, 50_201.0, "lateral-movement", 0.9)], [("t", "z", 60, 90_000.0, "x", 0.0)]]
    stream = batches_of(spark, parts, rows, str(tmp_path)).withColumn("mitre_predictions", F.array(F.struct(F.lit("T1").alias("technique_id"), "tactic")))
    q = run(P.match_sequence_stream(stream, [Q.ATTACK_PATTERNS[0]], "10 minutes"), "left_out", tmp_path)
    assert [(r.entity_key, r.triggering_event_id, r.span_seconds) for r in spark.table("left_out").collect()] == [("z", 52, 200.0)]
    totals = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert max(totals) >= 40 and totals[-1] == 0


def test_silence_of_a_connector(spark, tmp_path):
    parts = [[("a", 1000.0), ("b", 1001.0)], [("b", 1100.0), ("a", 1050.0)], [("b", 1200.0)], [("b", 1300.0), ("a", 1400.0)], [("b", 1405.0)], [("b", 1410.0)]]
    run(P.liveness_stream(batches_of(spark, parts, "connector_id string, t double", str(tmp_path))), "alive_out", tmp_path)
    got = [(r.connector_id, r.status, r.at.timestamp()) for r in spark.table("alive_out").collect()]
    assert sorted(got) == [("a", "alive", 1000.0), ("a", "alive", 1400.0), ("a", "dead", 1170.0), ("b", "alive", 1001.0)]


def test_silence_without_any_input(spark, tmp_path):
    import time

    src = batches_of(spark, [[("a", 1000.0)]], "connector_id string, t double", str(tmp_path))
    q = P.liveness_stream(src, silence=2, clock=True).writeStream.format("memory").queryName("clock_out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    for _ in range(60):
        time.sleep(1)
        if spark.table("clock_out").count() == 2:
            break
    q.stop()
    assert [r.status for r in spark.table("clock_out").collect()] == ["alive", "dead"]


@pytest.mark.parametrize("seed", [1, 2])
def test_campaigns_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"t{rng.randrange(2)}", i, f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}" if rng.random() < 0.9 else None, rng.choice([0.1, 0.35, 0.5, 0.55, 0.7])) for i in range(70)]
    schema = "tenant_id string, event_id long, src_ip string, dst_ip string, meta_score double"
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, C.correlate_campaigns(whole).select("event_id", "campaign_id").collect()))
    rng.shuffle(rows)
    state = CampaignState(spark, f"{tmp_path}/state", buckets=2)
    for batch, at in enumerate(range(0, len(rows), 24), 1):
        state.add(spark.createDataFrame(rows[at : at + 24], schema), batch)
    assert sorted(map(tuple, state.tag(whole).select("event_id", "campaign_id").collect())) == want
    # the last batch again changes nothing
    state.add(spark.createDataFrame(rows[at : at + 24], schema), batch)
    assert sorted(map(tuple, state.tag(whole).select("event_id", "campaign_id").collect())) == want


def test_campaign_stream(spark, tmp_path):
    schema = "tenant_id string, src_ip string, dst_ip string, meta_score double"
    parts = [[("t", "c", "d", 0.4)], [("t", "a", "b", 0.4)], [("t", "d", "a", 0.7), ("t", "x", "y", 0.5)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/src/{i}")
    state = CampaignState(spark, f"{tmp_path}/state", buckets=2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
    q = campaign_stream(stream, state, f"{tmp_path}/ck", availableNow=True)
    q.awaitTermination(300)
    assert q.exception() is None
    assert sorted((r.node, r.campaign_id) for r in state.members().collect()) == [(n, "campaign-a") for n in "abcd"]


def test_current_table(spark, tmp_path):
    t = CurrentTable(spark, str(tmp_path), "k string, v long, at long", ["k"], ["at"], buckets=4)
    assert t.read().collect() == []
    put = lambda rows, batch: t.merge(spark.createDataFrame(rows, "k string, v long, at long"), batch)
    put([("a", 1, 1), ("b", 1, 1), ("a", 2, 2), (None, 5, 1)], 1)
    put([("a", 3, 1), ("b", 2, 1), ("c", 1, 1)], 2)
    want = {("a", 2, 2), ("b", 2, 1), ("c", 1, 1), (None, 5, 1)}
    assert {tuple(r) for r in t.read().collect()} == want
    put([("a", 3, 1), ("b", 2, 1), ("c", 1, 1)], 2)
    assert {tuple(r) for r in t.read().collect()} == want
    put([], 3)
    put([("c", 9, 9)], 4)
    assert {tuple(r) for r in t.read().collect()} == want - {("c", 1, 1)} | {("c", 9, 9)}
    assert {tuple(r) for r in t.read(before=2).collect()} == {("a", 2, 2), ("b", 1, 1), (None, 5, 1)}


def test_raw_topics_through_the_whole_chain(spark, tmp_path):
    import json

    from duskwatch.streaming.ingest import events_from_raw

    at = lambda i: f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00"
    sig = ["ET MALWARE CobaltStrike Beacon", "Nmap port scan", "ordinary"]
    lines = [("logs.suricata", json.dumps({"timestamp": at(i), "src_ip": f"10.0.0.{i % 3}", "src_port": "1000", "dest_ip": "198.51.100.22", "dest_port": str(20 + i % 5), "proto": "TCP", "event_type": "alert", "alert": {"signature": sig[i % 3], "severity": str(1 + i % 4)}})) for i in range(60)]
    lines += [("logs.zeek", json.dumps({"ts": 1704067200 + 60 * i + 30, "id.orig_h": "10.0.0.1", "id.orig_p": "5", "id.resp_h": "9.9.9.9", "id.resp_p": "53", "conn_state": "SF"})) for i in range(60)]
    lines += [("logs.zeek", "{broken"), ("logs.nowhere", "x")]
    rows = [(t, v, i // 61) for i, (t, v) in enumerate(sorted(lines[:120], key=lambda x: json.loads(x[1]).get("timestamp") or at((json.loads(x[1])["ts"] - 1704067200) // 60) + "x") + lines[120:])]
    for part in (0, 1):
        spark.createDataFrame([r[:2] for r in rows if r[2] == part], "topic string, value string").coalesce(1).write.parquet(f"{tmp_path}/raw/{part}")
    raw = spark.readStream.schema("topic string, value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/raw/*")
    sinks = Sinks(f"{tmp_path}/out", buckets=2)
    query = start_pipeline(scored_stream(events_from_raw(raw), "1 hour"), sinks, f"{tmp_path}/ck", availableNow=True)
    query.awaitTermination(600)
    assert query.exception() is None
    batch = A.with_running_posture(A.assess(events_from_raw(spark.read.schema("topic string, value string").parquet(f"{tmp_path}/raw/*"))))
    want = values(batch.collect())
    assert values(sinks.events(spark).collect()) == want and len(want) == 120
    assert {v[5] for v in want.values()} >= {1, 40} and spark.read.parquet(f"{sinks.path}/alerts").count() > 0
