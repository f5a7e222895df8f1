import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from duskwatch.functions import text as TX
from duskwatch.functions.scoring import timing_cov, timing_ks
from duskwatch.schema import validate_events
from duskwatch.sources import feeds, normalize as N, tables as TB

TEXTS = [
    "mail bob.x@example.com or Bob@Ex.org, call 555-123-4567", "ssn 123-45-6789 card 4111 1111 1111 1111", "1700000000000 epoch", "", "none",
    "+1 (555) 123-4567 x a@b.c. end 12-3456", "x" * 12_000 + " z@q.io 5551234",
]


def mask(text):
    for kind, rx in TX.PII_PATTERNS:
        text = re.sub(rx, lambda m: f"[{kind}:{hashlib.sha256(m.group().strip().lower().encode()).hexdigest()[:12]}]", text)
    return text


def test_mask_equals_regex_substitution(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", TX.mask_pii(F.col("t")).alias("m")).collect()}
    assert got == {i: mask(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("raw,want", [(" 010.001.002.003 ", "10.1.2.3"), ("::ffff:1.2.3.4", "1.2.3.4"), ("0.0.0.0", "0.0.0.0"), ("a.01", "a.01"), ("fe80::1", "fe80::1")])
def test_norm_ip(spark, raw, want):
    assert spark.range(1).select(TX.norm_ip(F.lit(raw))).first()[0] == want


def test_username(spark):
    got = spark.createDataFrame([("DOM\\Al",), ("A@X.COM",), (" Bob ",)], "u string").select(TX.norm_username(F.col("u"))).collect()
    assert [r[0] for r in got] == ["al@dom", "a@x.com", "bob"]


def run(parser, *lines):
    df = pytest.spark.createDataFrame([(x,) for x in lines], "value string")
    p = parser(df)
    return p.events.collect(), p.dead_letters.collect()


@pytest.fixture(autouse=True)
def _spark(spark):
    pytest.spark = spark


@pytest.mark.parametrize("name", [n for n in N.PARSERS if n != "syslog"] + ["cloudtrail", "gcp_audit"])
def test_bad_input_becomes_dead_letter(name):
    parser = N.PARSERS.get(name) or getattr(N, f"normalize_{name}")
    ok, dead = run(parser, '{"a": 1', "", "[1,2]", "{}")
    assert len(ok) == 1 and len(dead) == 3


def test_wrong_port_and_time():
    good = {"timestamp": "2024-01-01T00:00:00+00:00", "src_ip": "1.2.3.4", "src_port": "99", "dest_port": 80, "alert": {"severity": 1, "action": "blocked"}}
    ok, dead = run(N.normalize_suricata, json.dumps(good), json.dumps({**good, "src_port": "x"}), json.dumps({**good, "timestamp": "soon"}))
    assert len(ok) == 1 and ok[0].severity == "critical" and ok[0].action == "block" and ok[0].network.src_port == 99
    assert sorted(d.error_reason for d in dead) == ["invalid_port", "invalid_timestamp"]


def test_syslog_lines():
    ok, dead = run(N.normalize_syslog_rfc, "<34>Oct 11 22:14:15 box su: hi", "<165>1 2024-01-01T00:00:00Z host app 1 ID [a b=\"c\"] from 10.0.0.1", "nope")
    assert len(dead) == 1 and {e.severity for e in ok} == {"critical", "low"}
    free, none = run(N.normalize_syslog_generic, "plain 1.1.1.1 then 2.2.2.2", '{"severity": "abc"}', '{"severity": 3, "message": "m"}')
    assert len(free) == 2 and none[0].error_reason == "invalid_severity"


def test_validation_bounds(spark):
    ok, _ = (N.normalize_suricata(spark.createDataFrame([('{"src_ip":"1.1.1.1"}',)], "value string")).events, None)
    bad = ok.withColumn("source_entity", F.col("source_entity").withField("asset_criticality", F.lit(1.5)))
    assert validate_events(ok)[0].count() == 1
    assert validate_events(bad)[1].first().errors == ["source_entity.asset_criticality"]


def test_event_table_roundtrip_prunes_months(spark, tmp_path):
    rows = [(i, f"t{i % 2}", f"2024-0{1 + i % 3}-10 00:00:00", "zeek") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id bigint, tenant_id string, ts string, source_type string")
    df = df.withColumn("timestamp", F.col("ts").cast("timestamp"))
    TB.write_events(df, str(tmp_path / "ev"))
    got = TB.read_events(spark, str(tmp_path / "ev"), "t1", since="2024-02-01", until="2024-03-01")
    assert {r.event_id for r in got.collect()} == {r[0] for r in rows if r[1] == "t1" and r[2].startswith("2024-02")}
    assert "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().toString()


def test_flow_csv_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Source Port,Dst Port, Label\n1,80,DoS Hulk\nInfinity,,BENIGN\n,,BENIGN\n")
    (tmp_path / "b.csv").write_text("source port,Flow Duration,Label\n5,7,Weird\n")
    got = feeds.read_flow_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert sorted((r.attack_class, r.features[0], r.features[1], r.features[6]) for r in got) == [("benign", 5.0, 0.0, 7.0), ("dos", 1.0, 80.0, 0.0)]


def test_report_csv(spark, tmp_path):
    df = spark.range(5).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS timestamp", "'z' AS source_type", "'low' AS severity", "'a' AS action", "'1' AS src_ip", "'2' AS dst_ip",
        "0.5D AS meta_score", "'m' AS message",
    )
    TB.write_report_csv(df, str(tmp_path / "r"), 2)
    lines = next((tmp_path / "r").glob("part-*.csv")).read_text().splitlines()
    assert lines[0].startswith("timestamp,event_id") and [x.split(",")[1] for x in lines[1:]] == ["4", "3"]


def test_timing_scores(spark):
    steady = [i * 1_000_000 for i in range(12)]
    df = spark.createDataFrame([(1, steady), (2, steady[:9]), (3, [5] * 10)], "i int, t array<bigint>")
    got = {r.i: (r.c, r.k) for r in df.select("i", timing_cov(F.col("t")).alias("c"), timing_ks(F.col("t")).alias("k")).collect()}
    assert got[1][0] == 1.0 and got[1][1] > 0.5 and got[2] == (0.0, 0.0) and got[3] == (1.0, 1.0)
