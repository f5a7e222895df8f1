"""Baselines, half-space windows, retraining, order statistics and latency sketches against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.functions import features as FE
from duskwatch.functions import scoring as S
from duskwatch.operators import baseline as BL
from duskwatch.operators import evaluation as E
from duskwatch.operators import ml as M
from duskwatch.operators import reports as R
from duskwatch.operators import retraining as RT
from duskwatch.plans.base import sec_events
from duskwatch.plans.behaviour import _vector_inputs
from duskwatch.plans.learning import labelled


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "event_id long, features array<double>")


@pytest.mark.parametrize("singular", [False, True])
def test_ood_equals_mahalanobis(spark, singular):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 50
    if singular:
        x[:, 5] = x[:, 4] * 2 + 1
        x[:, 3] = 7.0
    base = BL.fit_baseline(vectors(spark, x).repartition(5))
    cov = np.cov(x.T)
    inv = np.linalg.pinv(cov, hermitian=True) if singular else np.linalg.inv(cov)
    probe = np.vstack([x[:20], x[:20] + rng.normal(size=(20, 6)) * 30])
    d = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", probe - x.mean(0), inv, probe - x.mean(0)), 0))
    want = np.clip((d - 1.5 * np.sqrt(6)) / np.sqrt(6), 0, 1)
    got = vectors(spark, probe).select("event_id", BL.ood_score(F.col("features"), base).alias("s")).orderBy("event_id").collect()
    assert np.allclose([r.s for r in got], want, atol=1e-6) and 0 < (want > 0).sum() < 40


def test_ood_odd_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, None]), (2, [3.0]), (3, None), (4, []), (5, [1.0, 2.0, 9.0])], "event_id long, features array<double>")
    base = BL.fit_baseline(df, dim=2)
    assert base.n == 5 and np.allclose(base.mean, np.mean([[1, 2], [2, 0], [3, 0], [0, 0], [1, 2]], axis=0))
    assert all(0 <= r.s <= 1 for r in df.select(BL.ood_score(F.col("features"), base).alias("s")).collect())
    empty = BL.fit_baseline(df.limit(0))
    assert empty.n == 0 and empty.dim == 0
    assert [r.s for r in df.select(BL.ood_score(F.col("features"), empty).alias("s")).collect()] == [0.0] * 6


@pytest.mark.parametrize("max_rows", [10**6, 90])
def test_halfspace_windows_equal_a_plain_fold(spark, max_rows):
    rng = random.Random(2)
    rows = [(rng.choice(["t", "t", "u", None]), i, float(rng.randrange(5000)), [rng.gauss(0, 1) + (8 if rng.random() < 0.02 else 0) for _ in range(4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "tenant_id string, event_id long, t double, features array<double>").withColumn("timestamp", F.timestamp_seconds(F.col("t").cast("long")))
    low, high = M.feature_ranges(df)
    trees, height = 5, 4
    leaf = M.halfspace_leaves(F.col("features"), low, high, trees, height, 42)
    leaves = {r.event_id: r.l for r in df.select("event_id", leaf.alias("l")).collect()}
    want = {}
    for tenant in ("t", "u", None):
        line = sorted((r for r in rows if r[0] == tenant), key=lambda r: (int(r[2]), r[1]))
        for at in range(0, len(line), 40):
            past = line[max(at - 40, 0) : at]
            for r in line[at : at + 40]:
                if not past:
                    want[r[1]] = 0.0
                    continue
                mass = [sum(leaves[p[1]][t] == leaves[r[1]][t] for p in past) for t in range(trees)]
                want[r[1]] = np.mean([1 / (1 + m * 16 / len(past) / 8) for m in mass]) * min(len(past) / 30, 1)
    scored = M.halfspace_anomaly(df, low, high, window=40, trees=trees, height=height, cold_start=30, max_rows=max_rows)
    got = {r.event_id: r.hst_anomaly_score for r in scored.collect()}
    assert got == pytest.approx(want) and scored.columns == [*df.columns, "hst_anomaly_score"]


def buffer(spark, n, rule, tenant="t", seed=0, missing=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random() for _ in range(3)]
        rows.append((tenant, i, i, "true_positive" if rule(x) else "false_positive", x))
    rows += [(tenant, n + i, n + i, None, [0.0]) for i in range(missing)]
    return spark.createDataFrame(rows, "tenant_id string, id long, s long, label string, features array<double>").withColumn("created_at", F.timestamp_seconds("s"))


def test_retraining_swaps_keeps_and_skips(spark, tmp_path):
    store = RT.ModelStore(spark, str(tmp_path))
    small = dict(trees=5, depth=4)
    good = buffer(spark, 300, lambda x: x[0] > 0.5)
    both = good.unionByName(buffer(spark, 60, lambda x: x[0] > 0.5, "few")).unionByName(buffer(spark, 30, lambda x: x[0] > 0.5, "thin", missing=100)).unionByName(buffer(spark, 150, lambda x: True, "one"))
    first = {r.tenant_id: r for r in RT.retrain_gate(store, both, 1, **small).collect()}
    assert {t: r.decision for t, r in first.items()} == {"t": "swap", "few": "skip_few_rows", "thin": "skip_few_valid", "one": "skip_one_class"}
    assert first["t"].old_f1 == 0 and first["t"].new_f1 > 0.9 and (first["t"].train_rows, first["t"].holdout_rows) == (240, 60)
    # planted drift: the older part teaches the opposite of what the newer part holds
    drifted = good.withColumn("label", F.when(F.col("id") < 240, F.when(F.col("label") == "true_positive", "false_positive").otherwise("true_positive")).otherwise(F.col("label")))
    worse = RT.retrain_gate(store, drifted, 2, **small).first()
    assert worse.decision == "keep" and worse.new_f1 < 0.2 and worse.old_f1 > 0.9
    assert RT.weighted_f1(store.current("t"), good.withColumn("label", F.when(F.col("label") == "true_positive", RT.ATTACK).otherwise(RT.BENIGN))) > 0.9
    # the rule has changed for good: the model in use fails on the newer part, the new one learns it
    changed = buffer(spark, 300, lambda x: x[1] > 0.5, seed=4)
    better = RT.retrain_gate(store, changed, 3, **small).first()
    assert better.decision == "swap" and better.old_f1 < 0.7 < better.new_f1
    assert [(r.version, r.decision) for r in store.versions().where("tenant_id = 't'").orderBy("version").collect()] == [(1, "swap"), (2, "keep"), (3, "swap")]


def test_splits_leave_a_large_tenant_spread(spark):
    rows = spark.range(0, 4000, 1, 4).select("id", F.lit(None).cast("string").alias("tenant_id"), F.timestamp_seconds("id").alias("created_at"))
    few = spark.createDataFrame([(9000, "u", 7), (9001, "u", 7), (9001, "u", 7)], "id long, tenant_id string, s long").select("id", "tenant_id", F.timestamp_seconds("s").alias("created_at"))
    both = rows.unionByName(few)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        splits = [E.time_split(both), E.stratified_split(both, "tenant_id", "id")]
        held = [{r.p for r in s.where("tenant_id IS NULL").select(F.spark_partition_id().alias("p")).distinct().collect()} for s in splits]
        counts = [{(r.tenant_id, r.part): r["count"] for r in s.groupBy("tenant_id", "part").count().collect()} for s in splits]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert all(len(h) > 1 for h in held)
    for other, c in zip(("holdout", "test"), counts, strict=True):
        assert c == {(None, "train"): 3200, (None, other): 800, ("u", "train"): 2, ("u", other): 1}


def test_clip_at_the_exact_percentile(spark):
    rng = np.random.default_rng(3)
    cols = {"a": rng.lognormal(0, 3, 500), "b": np.where(rng.random(500) < 0.5, 0, -rng.integers(1, 9, 500)).astype(float), "c": np.zeros(500), "d": rng.normal(size=500) * 1e-300}
    rows = [tuple(float(cols[c][i]) for c in cols) for i in range(500)] + [(None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    got = E.order_statistics(df, {"a": [0, 17, 499], "b": [3]})
    assert got["a"] == {r: sorted(np.abs(cols["a"]))[r] for r in (0, 17, 499)} and got["b"][3] == sorted(np.abs(cols["b"][cols["b"] != 0]))[3]
    out = E.clip_p99(df, list(cols), 0.5).toPandas()
    for c in ("a", "b", "d"):
        bound = 0.5 * np.percentile(np.abs(cols[c][cols[c] != 0]), 99)
        assert np.isclose(np.nanmax(np.abs(out[c])), bound, rtol=1e-12)
    assert np.nanmax(np.abs(out["c"])) == 0


def test_sketches_roll_up(spark):
    rng = random.Random(5)
    rows = [(i, 60 * rng.randrange(600), rng.choice("ab"), rng.lognormvariate(0, 2)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, s long, step string, duration_ms double").withColumn("timestamp", F.timestamp_seconds("s")).repartition(6)
    minutes = R.latency_minutes(df, ["step"])
    for width, slide in (("1 hour", None), ("2 hours", "1 hour")):
        for r in R.latency_rollup(minutes, ["step"], width, slide).collect():
            low, high = r.w.start.timestamp(), r.w.end.timestamp()
            x = np.sort([v for _, s, step, v in rows if step == r.step and low <= s < high])
            assert r.events == len(x) and r.longest == x[-1] and r["mean"] == pytest.approx(x.mean())
            for p in (95, 99):
                assert abs(np.searchsorted(x, r[f"p{p}"], "right") / len(x) - p / 100) <= 1.65 / R.SKETCH_K + 1 / len(x)


def test_top_features_round_and_sort_few_values(spark):
    rng = random.Random(11)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0, 4.9e-7, 5e-7, 1.5e-6, 1.0000004, 1.0000005, -3.0, 2.5, 1e12]
    rows = [(i, [rng.choice(odd) if i % 2 else rng.choice([1.0, 1.0000004, 2.0]) for _ in range(rng.choice([76, 76, 3, 0]))]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "event_id long, features array<double>")
    weights = [1 / (i % 7 + 1) for i in range(76)]
    top = S.top_features(F.col("features"), weights)
    labels = [f"{b}[{i}]" for b, n in (("network", 16), ("entity", 16), ("temporal", 16), ("payload", 16), ("context", 12)) for i in range(n)]
    plain = F.zip_with(
        F.zip_with("features", F.array(*[F.lit(w) for w in weights]), lambda x, w: F.round(F.abs(x) * w, 6)), F.array(*[F.lit(x) for x in labels]),
        lambda v, name: F.struct((-v).alias("neg"), name.alias("name")),
    )
    want = F.transform(F.slice(F.array_sort(plain), 1, 5), lambda p: F.struct(p["name"].alias("name"), (-p["neg"]).alias("weight")))
    assert df.select(top.alias("got"), want.alias("want")).where("NOT (got <=> want)").count() == 0
    # what is rounded and sorted is made from the few places near the top, not from all
    plan = df.select(top)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" in plan and "array_sort" not in plan


def test_features_block_by_block(spark):
    ev = FE.with_optional(_vector_inputs(sec_events(spark, "/root/testdata/sf0.001")))
    got = FE.with_features76(ev).select("event_id", "features")
    assert sorted(got.collect()) == sorted(ev.select("event_id", FE.features76().alias("features")).collect())
    # blocks are generated one by one, so that no method of generated code holds all 76 values
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 5


def test_reconstruction_projects_batches(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 3
    x[0, 0], x[1, 1] = 1e6, np.inf
    model = M.fit_reconstruction(vectors(spark, x[2:]), 3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, [None, 1.0, 2.0, 3.0, 4.0, 5.0]), (301, [float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "event_id long, features array<double>").repartition(3)
    scored = M.reconstruction_anomaly(model, df)
    v = np.vstack([x, [[-100, 1, 2, 3, 4, 5], [100, 1, 2, 3, 4, 5]]]).clip(-100, 100)
    axes = model.pc.toArray()
    error = ((v - v @ axes @ axes.T) ** 2).mean(axis=1)
    got = {r.event_id: r.vae_anomaly_score for r in scored.collect()}
    assert got == pytest.approx(dict(enumerate(np.minimum(error / 0.5, 1))), abs=1e-6) and scored.columns == [*df.columns, "vae_anomaly_score"]
    # no lambda walks a vector entry by entry
    assert "ArrowEvalPython" in scored._jdf.queryExecution().optimizedPlan().toString() and "lambda" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_benign_rows_are_found_by_one_parse(spark):
    plan = labelled(spark, "/root/testdata/sf0.001").where("label = 'benign'").select("event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_train_classifier_query_grows_the_whole_forest_on_all_rows(spark, tmp_path, monkeypatch):
    import inspect

    from duskwatch.plans import learning

    rows = [(i, i * 60, i % 17, ["signup", "error", "click", "view", "x"][i % 5], float(i % 230), f'{{"k": {i % 97}}}') for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen, own = [], M.train_classifier

    def train(*args, **options):
        asked = inspect.signature(own).bind(*args, **options)
        asked.apply_defaults()
        seen.append((asked.arguments["trees"], asked.arguments["depth"], asked.arguments["df"].count(), asked.arguments["df"].rdd.getNumPartitions()))
        return own(asked.arguments["df"], trees=3, depth=3)

    monkeypatch.setattr(M, "train_classifier", train)
    top = learning.SUITE.queries["train_classifier"](spark, str(tmp_path))
    assert top.select("event_id").distinct().count() == 300
    assert seen == [(100, 12, 300, spark.sparkContext.defaultParallelism)]
