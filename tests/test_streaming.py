"""Streaming twins replay a file source and must equal the batch operators."""

import json

from pyspark.sql import functions as F

from duskwatch.operators import sequence as Q, state as ST
from duskwatch.streaming import ingest, processors as P
from test_ordered import CHAIN, STATE, brute_state, random_chain, seq  # noqa: F401


def replay(spark, df, path):
    """Two files, read one per micro-batch, in time order."""
    cut = df.agg(F.expr("percentile_approx(timestamp, 0.5)").alias("c")).first().c
    df.where(F.col("timestamp") <= F.lit(cut)).coalesce(1).write.parquet(f"{path}/src")
    df.where(F.col("timestamp") > F.lit(cut)).coalesce(1).write.mode("append").parquet(f"{path}/src")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/src")


def drain(spark, stream, path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_entity_state_stream(spark, tmp_path):
    rows = [("t", f"e{i % 3}", i, float(i * 120 + (4000 if i > 40 else 0)), f"ip{i % 7}", 22 + i % 2, "c" if i == 5 else None) for i in range(80)]
    df = spark.createDataFrame(rows, STATE).withColumn("timestamp", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    got = drain(spark, P.entity_state_stream(replay(spark, df, tmp_path)), tmp_path, "entity_state_out")
    assert {r.event_id: tuple(r)[3:] for r in got} == brute_state(rows)


def test_sequence_stream(spark, tmp_path):
    df = seq(spark, random_chain(400))
    p = [Q.ATTACK_PATTERNS[0]]
    want = sorted((r.entity_key, r.triggering_event_id, r.span_seconds) for r in Q.match_sequence(df, p).collect())
    got = drain(spark, P.match_sequence_stream(replay(spark, df, tmp_path), p), tmp_path, "sequence_out")
    assert sorted((r.entity_key, r.triggering_event_id, r.span_seconds) for r in got) == want and want


def test_throughput_drops_late_rows(spark, tmp_path):
    cols = "event_id bigint, timestamp string, source_type string, severity string"
    # lateness is judged by the watermark of the batch before the previous one, hence three batches
    first = [(1, "2024-01-01 00:10:00", "z", "low"), (2, "2024-01-01 05:00:00", "z", "low")]
    between = [(5, "2024-01-01 06:00:00", "z", "low")]
    late = [(3, "2024-01-01 00:20:00", "z", "low"), (4, "2024-01-01 09:00:00", "z", "low")]
    for i, part in enumerate((first, between, late)):
        df = spark.createDataFrame(part, cols).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"src/{i}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src/*"))
    got = drain(spark, P.throughput_stream(src), tmp_path, "throughput_out")
    counts = {r.w.start.hour: r.events for r in got}
    assert counts.get(0) == 1


def test_ingest_stream_writes_all_sinks(spark, tmp_path):
    line = json.dumps({"timestamp": "2024-01-01T00:00:00", "src_ip": "198.51.100.22", "alert": {"signature": "mimikatz", "severity": 1}})
    raw = [("logs.suricata", line), ("logs.zeek", "{broken"), ("logs.other", "x bob@example.com")]
    spark.createDataFrame(raw, "topic string, value string").coalesce(1).write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema("topic string, value string").parquet(str(tmp_path / "raw"))
    paths = {n: str(tmp_path / n) for n in ("events", "alerts", "dead_letters")}
    q = ingest.start_ingest(stream, paths, str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    ev = spark.read.parquet(paths["events"]).collect()
    assert len(ev) == 1 and ev[0].recommendation.action == "BLOCK" and ev[0].ioc_matches[0].threat_type == "c2"
    assert spark.read.parquet(paths["alerts"]).count() == 1
    dead = {r.error_reason: r.raw_log for r in spark.read.parquet(paths["dead_letters"]).collect()}
    assert set(dead) == {"invalid_json", "no_parser_registered"} and "bob@" not in dead["no_parser_registered"]
