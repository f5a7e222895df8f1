import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from duskwatch.llm.quality import Forest, calibrate, quality_report, quality_rules, rule_statistics, text_counts


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines), len(re.findall("[A-Z]", text)), len(set(w))


def test_counts(odd):
    rows = rule_statistics(odd).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in odd.collect()), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want


def test_counts_of_repeats(spark):
    texts = ["a b c d e f a b c d e x", "p q\np q\n\n\np q \np q", "a a a a a a a", "a b c d e a b c d e f", "é é é # <b> |&%$*", "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in rule_statistics(df).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2000, 3))
    f = Forest(x)
    assert f.score(np.array([[8.0, 8, 8]]))[0] > np.quantile(f.score(x), 0.99)
    assert (Forest(x[:0]).score(x[:3]) == 0.5).all()


def test_calibrate():
    assert calibrate([(100, 5, 0), (90, 5, 1), (50, 0, 99)], 0.01) == 90 / 2000
    assert calibrate([(100, 0, 9)], 0.01) > 1


def test_verdicts(odd, none, spark):
    labels = odd.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    rows = quality_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.anomaly < r.anomaly_limit) and 0 <= r.anomaly <= 1
    assert quality_rules(none, labels).collect() == []
    assert len(quality_rules(odd, labels.limit(0)).collect()) == odd.count()


def path_length(tree, row):
    """Splits passed by one row, step by step, and what the leaf adds for the rows left in it."""
    column, value, child, leaf = tree
    at = 0
    while column[at] >= 0:
        at = child[at] + int(row[column[at]] >= value[at])
    return leaf[at]


def test_scores_equal_path_lengths():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (300, 4)), 1)
    f = Forest(x, trees=20, sample=32)
    mean = [np.mean([path_length(t, row) for t in f.trees]) for row in x[:60]]
    harmonic = sum(1 / i for i in range(1, 32))
    # the usual estimate of the average path of an unsuccessful search among 32 rows
    usual = 2 * (np.log(31) + np.euler_gamma) - 2 * 31 / 32
    assert abs(2 * harmonic - 2 * 31 / 32 - usual) < 0.05
    assert np.allclose(f.score(x[:60]), 2.0 ** (-np.array(mean) / usual))
    for column, value, child, leaf in f.trees:
        inner = np.flatnonzero(column >= 0)
        assert sorted(np.concatenate([child[inner], child[inner] + 1])) == list(range(1, len(column)))


def test_further_counts():
    import pyarrow as pa

    texts = ["a bb ccc! d--e 12 3", "", "\u00e9t\u00e9 ## x#y#", "aaaa"]
    got = text_counts(pa.array(texts))
    for i, text in enumerate(texts):
        w = [x.encode() for x in text.split()]
        other = [sum(not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in x) for x in w]
        b = np.array(list(text.encode()))
        share = np.unique(b, return_counts=True)[1] / max(len(b), 1)
        want = (sum(map(len, w)) - sum(other), sum(map(len, w)), sum(len(x) < 3 for x in w), sum(o == len(x) for o, x in zip(other, w)), sum(o > 1 for o in other))
        assert tuple(int(got[c][i]) for c in ("n_letters", "n_solid", "n_short", "n_letterless", "n_mixed")) == want
        assert np.isclose(got["entropy"][i], -(share * np.log2(share)).sum() if len(b) else 0)


def test_held_out_recall(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality_report(docs, labels).first()
    assert r.bad_rows > 10 and r.bad_base + r.bad_forest >= 0.8 * r.bad_rows and r.good_forest <= 0.03 * r.good_rows
