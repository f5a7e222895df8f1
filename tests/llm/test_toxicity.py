import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm.toxicity import Chain, score_toxicity, without_toxic


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    count = np.array([3, 0, 1, 7])
    emission, move = rng.normal(0, 2, 11), rng.normal(0, 1, (2, 2))
    p, moves = Chain(count).marginals(emission, move)
    want_moves, at = np.zeros((2, 2)), 0
    for n in count:
        total, hit, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            step = [(a, b) for a, b in zip((0, *path), path)]
            weight = np.exp(sum(emission[at + i] * s for i, s in enumerate(path)) + sum(move[s] for s in step))
            total += weight
            hit += weight * np.array(path, float)
            for s in step:
                seen[s] += weight
        assert p[at : at + n] == pytest.approx(hit / total)
        want_moves += seen / total
        at += n
    assert moves == pytest.approx(want_moves)


def test_marginals_over_row_borders():
    rng = np.random.default_rng(1)
    n = 150
    emission, move = rng.normal(0, 3, n), rng.normal(0, 1, (2, 2))
    p, _ = Chain(np.array([n])).marginals(emission, move)
    a, e = np.exp(move), np.exp(emission)
    f, b = np.zeros((n + 1, 2)), np.ones((n + 1, 2))
    f[0] = 1, 0
    for t in range(n):
        f[t + 1] = (f[t] @ a) * [1, e[t]]
        f[t + 1] /= f[t + 1].sum()
    for t in range(n - 1, -1, -1):
        b[t] = a @ (b[t + 1] * [1, e[t]])
        b[t] /= b[t].sum()
    want = f[1:] * b[1:]
    assert p == pytest.approx(want[:, 1] / want.sum(1))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["Zorgle", "zorglix", "quumby", "quumbor"]))
        rows.append((i, " ".join(words), "en", "x"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_spans(corpus):
    docs, labels = corpus
    rows = score_toxicity(docs, labels).join(labels, "doc_id").join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    for r in rows:
        for s in r.spans:
            assert r.text[s.begin : s.end].lower().startswith(("zorg", "quumb"))


def test_odd_rows(odd, none, corpus, spark):
    _, labels = corpus
    docs, _ = corpus
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = score_toxicity(both.withColumn("score", F.lit("clash")), labels).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    kept = without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() > 0
    assert score_toxicity(none, labels).collect() == []
    assert without_toxic(odd, labels.limit(0)).count() == odd.count()
