"""Ordered operators: boundaries, and hot keys split over segments give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import campaigns, intel, sequence as Q, state as ST
from duskwatch.operators.evaluation import stratified_split, weighted_auc

STATE = "tenant_id string, entity string, event_id bigint, t double, dst_ip string, dst_port int, campaign_id string"


def events(spark, rows):
    return spark.createDataFrame(rows, STATE).withColumn("timestamp", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))


def brute_state(rows):
    """Plain reading of the state rules, one entity at a time."""
    out, states = {}, {}
    for tenant, ent, eid, t, ip, port, camp in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        s = states.get((tenant, ent))
        gap = 0 if s is None else t - s["last"]
        if s is None or gap > 86400:
            s = dict(n=0, m5=0, h1=0, ips=[], ports=[], camp=None)
        if gap > 3600:
            s.update(h1=0, ips=[], ports=[])
        if gap > 300:
            s["m5"] = 0
        s["n"] += 1
        s["m5"] += 1
        s["h1"] += 1
        for k, v in (("ips", ip), ("ports", port)):
            if v and v not in s[k]:
                s[k] = (s[k] + [v])[-100:]
        s["camp"] = camp or s["camp"]
        s["last"] = t
        states[(tenant, ent)] = s
        out[eid] = (s["n"], s["m5"], s["h1"], len(s["ips"]), len(s["ports"]), s["camp"])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, clock = [], {"hot": 0.0, "a": 0.0, "b": 0.0}
    for i in range(1500):
        ent = rng.choice(["hot"] * 6 + ["a", "b"])
        clock[ent] += rng.choice([1, 20, 300, 301, 3600, 3601, 90_000] if rng.random() < 0.2 else [1, 2, 3])
        out.append(("t", ent, i, clock[ent], f"ip{rng.randrange(300)}", rng.choice([22, 80, None]), rng.choice([None] * 9 + ["c1", "c2"])))
    return out


@pytest.mark.parametrize("limit", [10**6, 100])
def test_entity_state_matches_brute_force(spark, rows, limit):
    got = ST.entity_state(events(spark, rows), limit).select("event_id", *ST.STATE).collect()
    assert {r.event_id: tuple(r)[1:] for r in got} == brute_state(rows)


def test_entity_state_boundaries(spark):
    r = [("t", "e", i, float(t), None, None, None) for i, t in enumerate([0, 300, 601, 4201, 7802])]
    got = {x.event_id: (x.events_5m, x.events_1h) for x in ST.entity_state(events(spark, r)).collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (1, 3), 3: (1, 4), 4: (1, 1)}


def test_distinct_cap(spark):
    r = [("t", "e", i, float(i), f"ip{i}", None, None) for i in range(101)]
    got = {x.event_id: x.unique_dst_ips for x in ST.entity_state(events(spark, r)).collect()}
    assert got[99] == 100 and got[100] == 100


def test_state_before_split_equals_whole(spark, rows):
    cols = ["event_id", "before_last_seen_us", *[f"before_{c}" for c in ST.STATE]]
    whole, split = (sorted(map(tuple, ST.entity_state_before(events(spark, rows), n).select(*cols).collect()), key=str) for n in (10**6, 100))
    assert whole == split


def test_last_n_split_equals_whole(spark, rows):
    whole, split = (
        {r.event_id: r.times_us for r in ST.recent_times(events(spark, rows), 30, n).collect()} for n in (10**6, 100)
    )
    assert whole == split and max(len(v) for v in whole.values()) == 30


def scored(spark, n=1200):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", "b"]), i, float(i // 2), rng.random()) for i in range(n)]
    df = spark.createDataFrame(data, "tenant_id string, event_id bigint, t double, meta_score double")
    return df.withColumn("timestamp", F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))), data


def test_posture_split_equals_fold(spark):
    df, data = scored(spark)
    want, x = {}, {}
    for tenant, eid, t, m in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        v = x.get(tenant, 82.0)
        v = max(0.0, v - 2.5 * m) if m > 0.7 else min(100.0, v + 0.3) if m < 0.3 else v
        x[tenant] = want[eid] = v
    for limit in (10**6, 50):
        got = {r.event_id: r.score for r in ST.posture_running(df, max_rows=limit).collect()}
        assert got == pytest.approx(want)


def test_weights_split_equals_whole(spark):
    df, _ = scored(spark, 600)
    v = df.select(
        "tenant_id", F.col("event_id").alias("id"), F.col("timestamp").alias("created_at"),
        F.when(F.col("meta_score") > 0.5, "true_positive").otherwise("false_positive").alias("verdict"),
        F.array(*[F.col("meta_score") * (i + 1) % 1 for i in range(5)]).alias("stream_scores"),
    )
    whole, split = ({r.id: r.weights for r in ST.weights_fold(v, n).collect()} for n in (10**6, 50))
    assert whole == split and all(abs(sum(w) - 1) < 1e-9 for w in whole.values())


SEQ = "tenant_id string, entity string, event_id bigint, t double, tactic string, meta_score double"


def seq(spark, rows):
    return spark.createDataFrame(rows, SEQ).withColumns(
        {
            "timestamp": F.timestamp_micros((F.col("t") * 1e6).cast("bigint")),
            "mitre_predictions": F.array(F.struct(F.lit("T1").alias("technique_id"), F.col("tactic").alias("tactic"))),
        }
    )


CHAIN = ["discovery", "credential-access", "lateral-movement"]


@pytest.mark.parametrize(
    "times,tactics,tenants,fires",
    [
        ([0, 300, 600], CHAIN, ["t"] * 3, 1),
        ([0, 300, 601], CHAIN, ["t"] * 3, 0),
        ([0, 300, 600], [CHAIN[1], CHAIN[0], CHAIN[2]], ["t"] * 3, 0),
        ([0, 300, 600], CHAIN, ["t", "t", "u"], 0),
    ],
)
def test_sequence_cases(spark, times, tactics, tenants, fires):
    rows = [(tenants[i], "e", i, float(times[i]), tactics[i], s) for i, s in enumerate([0.5, 0.6, 0.65])]
    got = Q.match_sequence(seq(spark, rows), [Q.ATTACK_PATTERNS[0]]).collect()
    assert len(got) == fires
    if fires:
        assert got[0].span_seconds == 600.0 and got[0].triggering_event_id == 2


def random_chain(n=2000):
    rng = random.Random(11)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([1, 5, 60, 250])
        out.append(("t", rng.choice(["hot"] * 8 + ["x"]), i, t, rng.choice(CHAIN + ["impact"]), rng.random()))
    return out


def test_sequence_split_equals_whole(spark):
    df = seq(spark, random_chain())
    p = [Q.ATTACK_PATTERNS[0]]
    whole, split = (sorted((r.entity_key, r.triggering_event_id, r.span_seconds) for r in Q.match_sequence(df, p, max_rows=n).collect()) for n in (10**6, 40))
    assert whole == split and len(whole) >= 20
    now = F.lit("1971-01-01").cast("timestamp")
    done = [sorted(map(tuple, Q.sequence_progress(df, now, p, n).collect())) for n in (10**6, 40)]
    assert done[0] == done[1]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [("t", f"p{i:03}", f"p{i + 1:03}") for i in range(60)]  # a long path
    edges += [("t", "hub", f"s{i:03}") for i in range(80)]  # a star
    edges += [("u", f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for t, a, b in edges:
        ra, rb = find((t, a)), find((t, b))
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x)[1] for x in list(parent)}
    got = campaigns.connected_components(spark.createDataFrame(edges, "tenant_id string, a string, b string")).collect()
    assert {(r.tenant_id, r.node): r.component for r in got} == want and len(got) == len(want)


def test_dhcp_as_of_split(spark):
    ev = spark.createDataFrame([("t", "10.0.0.1", i, float(i), None) for i in range(0, 300)], "tenant_id string, src_ip string, event_id bigint, t double, hostname string")
    ev = ev.withColumn("timestamp", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    le = spark.createDataFrame([("t", "010.0.0.001", "H1.", 10.0), ("t", "10.0.0.1", "h2", 200.0)], "tenant_id string, ip string, host string, t double")
    le = le.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    for limit in (10**6, 20):
        got = {r.event_id: r.hostname for r in intel.resolve_dhcp(ev, le, limit).collect()}
        assert got[9] is None and got[10] == "h1" and got[199] == "h1" and got[200] == "h2"


def test_auc_and_split_exact(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), round(rng.random(), 1)) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, label string, p double")
    pos = [p for _, lab, p in data if lab == "a"]
    neg = [p for _, lab, p in data if lab != "a"]
    want = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))
    s = df.select("label", F.create_map(F.lit("a"), F.col("p")).alias("probs"))
    for limit in (10**6, 3):
        assert weighted_auc(s, limit).first().auc == pytest.approx(want)
    parts = [sorted(map(tuple, stratified_split(df, "label", "id", max_rows=n).select("id", "part").collect())) for n in (10**6, 30)]
    assert parts[0] == parts[1]


def test_null_keys_are_keys_at_any_segment_size(spark):
    rows = [(None if i % 3 else f"t{i % 2}", None if i % 2 else "e", i * 1000 % 977, i, f"10.0.0.{i % 7}", i % 5, f"c{i}" if i % 9 == 0 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "tenant_id string, entity string, s long, event_id long, dst_ip string, dst_port int, campaign_id string").withColumn(
        "timestamp", F.timestamp_seconds("s")
    )
    names = [*ST.STATE, "tenant_id", "entity", "event_id"]
    whole, split = (sorted(map(str, ST.entity_state(df, max_rows=n).select(*names).collect())) for n in (10**6, 7))
    assert whole == split and len(whole) == 120
    seen = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        seen.setdefault(r[:2], []).append(r[4])
    nobody = ST.entity_state(df, max_rows=7).where("tenant_id IS NULL AND entity IS NULL")
    assert nobody.agg(F.max("unique_dst_ips")).first()[0] == len(set(seen[(None, None)]))


def test_split_plan_stays_small(spark):
    df = spark.createDataFrame([("t", "e", 1, 1, "10.0.0.1", 5, None)], "tenant_id string, entity string, s long, event_id long, dst_ip string, dst_port int, campaign_id string").withColumn(
        "timestamp", F.timestamp_seconds("s")
    )
    plan = ST.entity_state_before(df, max_rows=1)._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert plan <= 8


def test_splits_keep_rows_without_label(spark):
    from duskwatch.operators.evaluation import stratified_split, time_split

    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"l{i % 3}") for i in range(40)], "id long, label string")
    assert stratified_split(df, "label", "id", max_rows=6).count() == 40
    late = df.select("id", F.col("label").alias("tenant_id"), F.timestamp_seconds("id").alias("created_at"))
    assert time_split(late, max_rows=6).count() == 40


def test_history_travels_as_it_came(spark, monkeypatch):
    """Vectors are padded where a history is read, not before rows are shuffled and kept."""
    from duskwatch.operators import segments, state

    seen, own = [], segments.Segments.last_n

    def last_n(self, name, col, n):
        seen.append(self.df.select(F.max(F.size(col))).first()[0])
        return own(self, name, col, n)

    monkeypatch.setattr(segments.Segments, "last_n", last_n)
    rows = [("t", "e", i, [float(i), 1.0]) for i in range(7)] + [("t", "f", 9, [float(i) for i in range(9)])]
    ev = spark.createDataFrame(rows, "tenant_id string, entity string, event_id long, features array<double>").withColumn("timestamp", F.timestamp_seconds("event_id"))
    got = {r.event_id: r.history for r in state.entity_history(ev, 3, 4).collect()}
    assert got[6] == [[4.0, 1.0, 0.0, 0.0], [5.0, 1.0, 0.0, 0.0], [6.0, 1.0, 0.0, 0.0]] and got[0] == [[0.0, 1.0, 0.0, 0.0]] and got[9] == [[0.0, 1.0, 2.0, 3.0]]
    assert seen == [4] and state.entity_history(ev.where("entity = 'e'"), 3, 64).count() == 7 and seen[1] == 2


def test_histories_are_padded_and_measured_in_one_python_pass(spark):
    """No lambda walks the 50 x 64 entries of a row, and lists do not go back and forth between JVM and Python."""
    from duskwatch.functions.vectors import measured_vectors
    from duskwatch.operators import state

    rows = [("t", "e" if i % 3 else "f", i, [float(i), 0.5]) for i in range(700)]
    ev = spark.createDataFrame(rows, "tenant_id string, entity string, event_id long, features array<double>").withColumn("timestamp", F.timestamp_seconds("event_id"))
    h = state.entity_history(ev, max_rows=200)
    out = h.select("event_id", measured_vectors(F.col("history")).alias("h")).select("event_id", "h.*")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("ArrowEvalPython [") == 1
    got = {r.event_id: (r.vectors, r.width, r.total) for r in out.collect()}
    seen, want, whole = {}, {}, {}
    for _, e, i, v in rows:
        last = seen.setdefault(e, [])
        last.append(v)
        want[i] = (len(last[-50:]), 64, pytest.approx(sum(sum(x) for x in last[-50:])))
        whole[i] = [[*x, *[0.0] * 62] for x in last[-50:]]
    assert got == want and {r.event_id: r.history for r in h.where("event_id % 7 = 0").collect()} == {i: w for i, w in whole.items() if i % 7 == 0}


def test_padded_and_measured_vectors_of_odd_lists(spark):
    from duskwatch.functions.vectors import measured_vectors, padded_vectors

    lists = [[[1.0, 2.0], [3.0]], [[]], [], None, [[1.0, None], None, [2.0]], [[1.0, 2.0, 3.0, 4.0]], [[float("inf"), -1.0, 9.0]], [None, [1.0]]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, v array<array<double>>").coalesce(1)
    pad = lambda v: None if v is None else (v + [0.0] * 3)[:3]
    got = {r.id: r.p for r in df.select("id", padded_vectors(F.col("v"), 3).alias("p")).collect()}
    assert got == {i: None if v is None else [pad(x) for x in v] for i, v in enumerate(lists)}
    m = {r.id: tuple(r.m) for r in df.select("id", measured_vectors(F.col("v")).alias("m")).collect()}
    assert m == {
        0: (2, 2, 6.0), 1: (1, 0, 0.0), 2: (0, None, 0.0), 3: (None, None, None), 4: (3, 2, None), 5: (1, 4, 10.0), 6: (1, 3, float("inf")), 7: (2, None, None),
    }
    assert df.limit(0).select(padded_vectors(F.col("v"), 3)).count() == 0


@pytest.mark.parametrize("max_rows", [10**6, 300, 7])
def test_last_values_of_keys_over_segments_and_blocks(spark, max_rows):
    """Null keys are keys, null values are left out, and nothing but the range partitioning shuffles."""
    from duskwatch.operators.segments import segmented

    count = 2600 if max_rows > 100 else 120
    rows = [(None if i % 9 == 0 else "t", None if i % 5 == 0 else "e" if i % 11 else "f", (i * 7919) % 1009, i, None if i % 13 == 0 else i) for i in range(count)]
    df = spark.createDataFrame(rows, "tenant_id string, entity string, us long, event_id long, v long").repartition(3)
    want, seen = {}, {}
    for t, e, us, i, v in sorted(rows, key=lambda r: (r[2], r[3])):
        last = seen.setdefault((t, e), [])
        last.append(v)
        want[i] = [x for x in last[-4:] if x is not None]
    seg = segmented(df, ["tenant_id", "entity"], ["us", "event_id"], max_rows)
    near = seg.last_n("near", F.col("v"), 4)
    assert "Exchange" not in near.rows._jdf.queryExecution().executedPlan().toString()
    assert {r.event_id: r.near for r in near.rows.collect()} == want and set(near.rows.columns) == {*df.columns, "near"}
    again = seg.running(sums={"total": F.col("v")}).last_n("near", F.col("v"), 4).rows
    assert {r.event_id: r.near for r in again.collect()} == want
    assert [r.one for r in seg.last_n("one", F.col("event_id"), 1).rows.where("event_id = 5").collect()] == [[5]]


def test_posture_assesses_every_event_once(spark):
    from duskwatch.operators.assess import with_running_posture

    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(i):
        met.add(1)
        return (i * 7 % 10) / 10

    ev = spark.range(200).select(F.concat(F.lit("t"), F.col("id") % 2).alias("tenant_id"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("event_id"))
    assessed = ev.withColumn("meta_score", scored.asNondeterministic()("event_id"))
    got = {r.event_id: round(r.posture, 6) for r in with_running_posture(assessed, max_rows=30).collect()}
    want, at = {}, {}
    for i in range(200):
        m, x = (i * 7 % 10) / 10, at.get(i % 2, 82.0)
        at[i % 2] = max(0.0, x - m * 2.5) if m > 0.7 else min(100.0, x + 0.3) if m < 0.3 else x
        want[i] = round(at[i % 2], 6)
    assert got == want and met.value == 200
