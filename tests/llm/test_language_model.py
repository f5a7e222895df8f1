import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm import language_model as lm

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SF = "/root/testdata/sf0.01"


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def base(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for r in rows if not out(r.doc_id) for t in words(r.text))
    n, v = sum(c.values()), len(c)
    return sorted(
        ((str(r.doc_id), out(r.doc_id), len(words(r.text)), sum(c[t] > 0 for t in words(r.text)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in words(r.text)), 6)) for r in rows)
    )


@pytest.mark.parametrize("size", [250_000, 20])
def test_base_equals_brute_force(odd, monkeypatch, size):
    monkeypatch.setattr(lm, "DICTIONARY", size)
    rows = lm.score_texts(odd.withColumn("row", F.lit(1)), steps=20).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == base(odd.collect())
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_table_is_normalised():
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, (lm.CLASSES + 1) ** 2 * lm.CLASSES, 500))
    table = lm.log10_table(lm.train(code, rng.integers(1, 9, len(code)).astype(float), steps=20))
    assert (10.0 ** table).sum(1) == pytest.approx(np.ones(len(table)), abs=1e-4)


def test_learns_what_follows_what():
    a, b, start = 3, 5, lm.CLASSES
    context = lambda far, near: far * (lm.CLASSES + 1) + near
    code = np.array([context(start, start) * lm.CLASSES + a, context(start, a) * lm.CLASSES + b, context(a, b) * lm.CLASSES + a, context(b, a) * lm.CLASSES + b])
    table = lm.log10_table(lm.train(np.sort(code), np.ones(4), steps=600))
    assert 10.0 ** table[context(b, a), b] > 0.8 and 10.0 ** table[context(a, b), a] > 0.8


def test_words_of_a_class_sum_to_one(odd):
    """Over all training words and one unseen word per class, the probabilities in one context sum to one."""
    spark = odd.sparkSession
    docs = odd.select("doc_id", F.substring("text", 1, 400).alias("text"))
    known = {t for r in docs.collect() if not (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for t in words(r.text)} - {None}
    probe = [*sorted(known), ""]
    # ids over 10**6 whose remainder keeps them out of training; each text is one word
    ids = [i for i in range(10**6, 10**6 + 20 * len(probe)) if zlib.crc32(str(i).encode()) % 7 == 2][: len(probe)]
    both = docs.unionByName(spark.createDataFrame(list(zip(ids, probe)), "doc_id long, text string"))
    got = {r.doc_id: r.score for r in lm.score_texts(both, steps=50).where(F.col("doc_id") >= 10**6).collect()}
    # P(word, end) summed over words is at most 1 and leaves the share of unseen words and longer texts
    assert 0 < sum(10.0 ** s for s in got.values()) <= 1


def test_better_than_unigram_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = lm.score_texts(docs, steps=600).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_empty_table(none):
    assert lm.score_texts(none, steps=5).collect() == []


def outcomes(n=6):
    """The first words are classes of their own, the next ``n`` lie in shared class 2, as does its rest."""
    shared = np.full(lm.OUTCOMES, -1)
    shared[lm.VECTORS :] = np.arange(lm.TAIL)
    shared[lm.OWN : lm.OWN + n] = 2
    return shared


def test_words_within_a_class_are_normalised_and_learned():
    shared = outcomes()
    a, b, rest = lm.OWN, lm.OWN + 1, lm.VECTORS + 2
    pairs = np.array([0 * lm.OUTCOMES + a, 1 * lm.OUTCOMES + b, a * lm.OUTCOMES + rest, b * lm.OUTCOMES + 5])
    order = np.argsort(pairs)
    table = lm.log10_words(lm.train_words(shared, pairs[order], np.array([40.0, 40.0, 20.0, 9.0])[order], steps=400), shared)
    inside = np.flatnonzero(shared == 2)
    assert (10.0 ** table[:, inside].astype(float)).sum(1) == pytest.approx(np.ones(len(table)), abs=1e-4)
    assert 10.0 ** table[0, a] > 0.8 and 10.0 ** table[1, b] > 0.8 and 10.0 ** table[a, rest] > 0.7
    assert (table[:, : lm.OWN] == 0).all() and 10.0 ** table[3, lm.VECTORS + 7] == pytest.approx(1)


def test_word_vectors_help_on_held_out_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with_vectors = lm.score_texts(docs, steps=600).where("held_out").agg(F.sum("score")).first()[0]
    # without them a word has its add-one share of the class, whatever stands before it
    monkeypatch.setattr(lm, "train_words", lambda shared, pair, count, **k: {"r": np.zeros((lm.OUTCOMES + 1, 1)), "q": np.zeros((lm.OUTCOMES, 1)), "b": np.log(np.bincount(pair % lm.OUTCOMES, count, lm.OUTCOMES) + 1.0)})
    words_only = lm.score_texts(docs, steps=600).where("held_out").agg(F.sum("score")).first()[0]
    assert with_vectors > words_only
