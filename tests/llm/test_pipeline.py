import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngram_join import grams

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def words(text):
    return [w.strip("*%&$#!|.,") for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage got and gave, written and read again in between."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        given = spark.read.parquet(path)
        out.append((name, docs, given))
        docs = given
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(steps, spark):
    assert list(steps) == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in steps.items() if name != "sharding")


def test_one_of_each_near_copy_stays(steps):
    before, after = (x.collect() for x in steps["ngram_jaccard_join"])
    sets = {r.doc_id: grams(r.text, 5) for r in before}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in after) == [d for d in ids if find(d) == d]


def test_only_texts_with_a_passage_go(steps, spark):
    before, after = (x.collect() for x in steps["decontamination"])
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if any(i in " ".join(words(r.text)) for i in items)}


def test_toxic_stage_keeps_clean_documents(steps, spark):
    before, after = steps["toxicity"]
    clean = before.join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"), "doc_id")
    assert clean.join(after, "doc_id", "left_semi").count() >= 0.97 * clean.count()


def test_mix_and_shards(steps):
    before, after = steps["mixing"]
    count = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert count(after) == pytest.approx(1.5 * count(before), rel=0.1)
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    rows = steps["sharding"][1].collect()
    per = np.bincount([r.shard for r in rows], minlength=8)
    assert len(rows) == after.count() and per.max() - per.min() <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(per[s])) for s in range(8))


def test_odd_and_empty_tables(odd, none, spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0, name
