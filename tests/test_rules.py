import pytest
from pyspark.sql import functions as F

from duskwatch.operators import intel, rules

COLS = "event_id int, message string, action string, outcome string, severity string, dst_port int, bytes_out bigint"
CASES = [
    (1, "ET MALWARE CobaltStrike Beacon Activity detected", "alert", "unknown", "critical", None, 0, "sigma-001"),
    (2, "Nmap port scan detected from external network", "alert", "unknown", "medium", None, 0, "sigma-003"),
    (3, "SQL injection attempt: UNION SELECT * FROM users", "alert", "unknown", "high", None, 0, "sigma-004"),
    (4, None, "connect", "unknown", "low", 445, 0, "sigma-005"),
    (5, None, "authenticate", "failure", "low", None, 0, "sigma-002"),
    (6, "big", "allow", "success", "info", None, 1_000_000, "sigma-008"),
]


def test_expected_rules(spark):
    df = spark.createDataFrame([c[:7] for c in CASES], COLS)
    got = {r.event_id: [m.rule_id for m in r.rule_matches] for r in rules.match_rules(df).collect()}
    for c in CASES:
        assert c[7] in got[c[0]]


def test_thresholds_and_benign(spark):
    rows = [(1, "x", "allow", "success", "info", None, 999_999), (2, "System health check completed successfully", "allow", "success", "info", 80, 0)]
    got = {r.event_id: [m.rule_id for m in r.rule_matches] for r in rules.match_rules(spark.createDataFrame(rows, COLS)).collect()}
    assert got[1] == [] and len(got[2]) <= 1


def test_more_rules_than_one_mask(spark):
    many = [(f"r{i}", f"n{i}", "", "", "", {"dst_port": i}, 0.5) for i in range(130)]
    df = spark.createDataFrame([(1, "m", "a", "o", "s", 125, 0), (2, "m", "a", "o", "s", 3, 0)], COLS)
    got = {r.event_id: [m.rule_id for m in r.rule_matches] for r in rules.match_rules(df, many).collect()}
    assert got == {1: ["r125"], 2: ["r3"]}


def test_compliance_by_rule_id(spark):
    one = [("recon_port_scan", "plain", "", "", "", {"dst_port": 1}, 0.5)]
    df = spark.createDataFrame([(1, "m", "a", "o", "s", 1, 60_000_000)], COLS).withColumn("temporal_score", F.lit(0.1))
    tags = rules.match_rules(df, one).select(rules.compliance_tags().alias("t")).first().t
    assert tags == sorted(set(rules.COMPLIANCE_BY_RULE["recon_port_scan"]) | set(rules.COMPLIANCE_EXFIL))


@pytest.mark.parametrize("score,action", [(0.85, "ISOLATE"), (0.70, "BLOCK"), (0.50, "INVESTIGATE"), (0.30, "MONITOR"), (0.29, "LOG")])
def test_response_ladder(spark, score, action):
    df = spark.range(1).select(
        F.lit(score).alias("meta_score"), F.lit(None).cast("string").alias("campaign_id"),
        F.array().cast("array<struct<rule_name:string,confidence:double>>").alias("rule_matches"),
        F.array().cast("array<struct<threat_name:string,confidence:double>>").alias("ioc_matches"),
    )
    assert rules.recommend_response(df).first().recommendation.action == action


def test_detection_modifiers(spark):
    df = spark.createDataFrame([("Net.WebClient DownloadString", "10.1.1.1"), ("Net.WebClient", "8.8.8.8"), (None, None)], "cmd string, ip string")
    fields = {c: F.col(c) for c in df.columns}

    def hits(detection, strict=True):
        return [bool(r[0]) for r in df.select(rules.detection_predicate(detection, fields, strict)).collect()]

    both = {"selection": {"cmd|contains|all": ["net.webclient", "DownloadString"]}}
    assert hits(both) == [True, False, False]
    assert hits(both, strict=False) == [True, True, False]
    assert hits({"selection": {"not ip|startswith": ["10."]}}) == [False, True, False]
    assert hits({"a": {"ip|re": r"^\d"}, "b": {"ip|startswith": "8."}, "condition": "a and not b"}) == [True, False, False]
    assert hits({"a": {"missing": 1}, "condition": "not a"}) == [True, True, True]


def test_contains_join_large_dimension_equals_small(spark, monkeypatch):
    needles = ["evil.example.com", "ab", "xyz", "evil", "dom.example.org", "b"]
    texts = ["see EVIL.example.com now", "ab", "", "xyzxyz", "nothing here", "dom.example.orgab", None]
    ev = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id int, message string")
    dim = spark.createDataFrame([(n,) for n in needles], "indicator string")
    want = {(i, n) for i, t in enumerate(texts) for n in needles if t and n in t.lower()}
    for limit in (1000, 2):
        monkeypatch.setattr(intel, "LITERAL_LIMIT", limit)
        got = intel.contains_join(ev, F.lower("message"), dim).select("event_id", "indicator").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_dimensions_with_repeated_keys_keep_rows(spark):
    ev = spark.createDataFrame([("t", 1, "h", "10.9.9.9", "CVE-2024-1234 seen", None)] * 3, "tenant_id string, event_id long, u string, src_ip string, message string, raw_log string")
    ev = ev.withColumns({"hostname": F.lit(None).cast("string"), "dst_ip": F.lit(""), "timestamp": F.timestamp_seconds(F.lit(100))})
    alias = spark.createDataFrame([("t", "H", "a"), ("t", "h", "b")], "tenant_id string, alias string, canonical string")
    assert intel.resolve_user_alias(ev, alias, "u").count() == 3
    leases = spark.createDataFrame([("t", "10.9.9.9", 50, "box")], "tenant_id string, ip string, s long, host string").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.hostname for r in intel.resolve_dhcp(ev, leases).collect()] == ["box"] * 3
    cves = spark.createDataFrame([("CVE-2024-1234", 9.0), ("CVE-2024-1234", 9.0)], "cve_id string, cvss_score double")
    assert [len(r.cve_context) for r in intel.enrich_cve(ev, cves).collect()] == [1] * 3
    seen = spark.createDataFrame([("10.9.9.9", "22"), ("10.9.9.9", "80")], "ip string, ports string")
    assert intel.enrich_exposure(ev, seen).count() == 3


def test_empty_needles_match_nothing_at_any_size(spark, monkeypatch):
    ev = spark.createDataFrame([(1, "abc"), (2, "xyz")], "event_id long, message string")
    dim = spark.createDataFrame([("",), ("ab",), ("zz",), (None,)], "indicator string")
    found = []
    for limit in (1000, 0):
        monkeypatch.setattr(intel, "LITERAL_LIMIT", limit)
        found.append(sorted(map(tuple, intel.contains_join(ev, F.lower("message"), dim).select("event_id", "indicator").collect())))
    assert found == [[(1, "ab")], [(1, "ab")]]


def test_every_vulnerability_of_a_page_is_read(spark):
    from duskwatch.sources.feeds import cve_dim_from_nvd

    page = '{"vulnerabilities": [{"cve": {"id": "CVE-1"}}, {"cve": {"id": "CVE-2"}}]}'
    raw = spark.createDataFrame([(page,)], "value string")
    assert sorted(r.cve_id for r in cve_dim_from_nvd(raw).collect()) == ["CVE-1", "CVE-2"]


def test_p_sequence(spark):
    from duskwatch.operators.hunts import p_sequence, span_seconds

    assert [span_seconds(x) for x in ("90s", "15m", "2h", "1d")] == [90, 900, 7200, 86400]
    rows = [("t", "a", 0, 1, "x"), ("t", "a", 900, 2, "y"), ("t", "b", 0, 3, "x"), ("t", "b", 901, 4, "y"), ("t", "c", 5, 5, "y"), ("t", "c", 6, 6, "x"), ("u", "c", 7, 7, "y"), ("t", None, 0, 8, "x"), ("t", None, 1, 9, "y")]
    ev = spark.createDataFrame(rows, "tenant_id string, src_ip string, s long, event_id long, kind string").withColumns(
        {"timestamp": F.timestamp_seconds("s"), "meta_score": F.lit(None).cast("double"), "mitre_predictions": F.lit(None).cast("array<struct<technique_id:string,tactic:string>>")}
    )
    got = p_sequence(ev, [F.col("kind") == "x", F.col("kind") == "y"]).collect()
    assert [tuple(r) for r in got] == [("t", "a", 2, 900.0)]
