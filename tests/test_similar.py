"""The inverted file against brute force, and rules by mask against rules by list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import intel, rules
from duskwatch.operators import similar as S
from duskwatch.plans.base import sec_events


def table(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(x, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = u @ u[i]
        s[i] = -9
        out[i] = sorted(range(len(x)), key=lambda j: (-round(s[j], 12), j))[:k]
    return out


@pytest.mark.parametrize("part", [50_000, 40])
def test_inverted_file(spark, monkeypatch, part):
    monkeypatch.setattr(S, "CELL_ROWS", part)
    monkeypatch.setattr(S, "LOT", 30)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(15, 12))[rng.integers(0, 15, 1500)] * 2 + rng.normal(size=(1500, 12))
    odd = [(5000, None), (5001, [0.0] * 12), (None, [1.0] * 12)]
    df = table(spark, x, odd).repartition(4)
    index = S.build(df, cells=20)
    asked = S.unit_rows(df.where("vec_id % 25 = 0"), "vec_id", "embedding")
    want = brute(x, range(0, 1500, 25), 10)
    got = {}
    for r in S.search(index, asked, 10, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    assert S.recall(index, asked, 10, 20) > 0.99
    few = S.probes_for(index, 10, 0.9)
    assert few < 20 and S.recall(index, asked, 10, few) > 0.85


def test_small_tables(spark):
    one = table(spark, [[1.0, 0.0]])
    assert S.approx_similar(one, F.lit(True)).collect() == [] and S.approx_similar(one.limit(0), F.lit(True)).collect() == []
    two = table(spark, [[1.0, 0.0], [1.0, 1.0], [0.0, 3.0]])
    assert [(r.query_id, r.rank, r.id) for r in S.approx_similar(two, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_mask_equals_matches(spark):
    many = [*rules.RULES, *[(f"x-{i}", f"Ransomware login {i}" if i % 2 else "other", "T1", "t", "impact", {"dst_port": 22 + i}, 0.5 + i % 5 / 10) for i in range(60)]]
    for rule_list in (rules.RULES, many):
        ev = rules.match_rules(sec_events(spark, "/root/testdata/sf0.001"), rule_list, mask="m").withColumn("ioc_matches", intel.ioc_match_array())
        by_list = rules.recommend_response(ev.withColumn("tags", rules.compliance_tags())).select("event_id", "tags", "recommendation").orderBy("event_id").collect()
        by_mask = rules.recommend_response(ev.withColumn("tags", rules.compliance_tags(mask="m", rules=rule_list)), mask="m", rules=rule_list).select("event_id", "tags", "recommendation").orderBy("event_id").collect()
        assert by_list == by_mask and len({r.recommendation.action for r in by_mask}) > 2


def test_copies_and_rows_of_a_search(spark, monkeypatch):
    """Of many equal rows those with the smallest ids are found, and a shelf gives no more than its best rows."""
    monkeypatch.setattr(S, "SHELVES", 4)
    monkeypatch.setattr(S, "SHELF_ROWS", 50)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=8), (400, 1)), rng.normal(size=(200, 8))])[rng.permutation(600)]
    df = table(spark, x)
    index = S.build(df, cells=6)
    asked = S.unit_rows(df.where("vec_id % 10 = 0"), "vec_id", "embedding")
    want = brute(x, range(0, 600, 10), 5)
    for options in ({"exact": True}, {"probes": 6}):
        got = {}
        found = S.search(index, asked, 5, **options)
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert all(got[q] == want[q] for q in got if (x == x[q]).all(1).sum() > 1) and len(got) == 60
        # scores are taken where rows meet: vectors are not joined to pairs
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_and_cosines_by_batch(spark):
    """Scores equal the plain sums, odd vectors have none, and nothing is computed by a lambda per entry."""
    import hashlib

    from duskwatch.functions import vectors as V

    text = spark.createDataFrame([("mimikatz",), ("",), (None,)], "t string").select(V.hash_vector(F.col("t")).alias("v"))
    raw = np.frombuffer(hashlib.sha512(b"mimikatz").digest()[:48], np.uint8) / 127.5 - 1.0
    got = [r.v for r in text.collect()]
    assert got[0] == list(np.tile(raw / np.abs(raw).max(), 8)) and len(got[1]) == 384 and got[2] == [None] * 384
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(50, 7)).astype(np.float32), [float(v) for v in rng.normal(size=7)]
    odd = [(100, None), (101, []), (102, [1.0] * 6), (103, [0.0] * 7), (104, [None] + [1.0] * 6), (105, [1.0] * 8)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd, "vec_id long, embedding array<float>")
    plain = df.select("vec_id", V.cosine(F.col("embedding"), V.query_literal(q)).alias("s"))
    want = {r.vec_id: r.s for r in plain.collect() if r.s is not None}
    found = V.similar_vectors(df, q, 100, -2.0)
    score = {r.vec_id: r.score for r in found.collect()}
    assert score.keys() == want.keys() == set(range(50)) and all(abs(score[i] - want[i]) < 1e-15 for i in want)
    assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString()
