import re

import numpy as np
import pytest

from duskwatch.llm import ngram_join
from duskwatch.llm.ngram_join import keep_one, ngram_jaccard_join

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def grams(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, percent):
    sets = [grams(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    brute.classes = sum(root[i] == i and bool(s) for i, s in enumerate(sets))
    return sorted(((r.doc_id, len(sets[i]), least[find(i)], links[i]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("percent", [85, 60])
def test_equals_brute_force(odd, percent):
    got = ngram_jaccard_join(odd, percent=percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(odd.collect(), percent)


def test_blocks_find_the_same(odd, monkeypatch):
    want = brute(odd.collect(), 85)
    monkeypatch.setattr(ngram_join, "CELL", 60)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    got = ngram_jaccard_join(odd).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.mark.parametrize("size, percent, shingles", [(4, 85, 6), (5, 80, 4)])
def test_smallest_sets_that_link(spark, size, percent, shingles):
    words = [f"w{i}" for i in range(shingles + size)]
    rows = [(1, " ".join(words[:-1])), (2, " ".join(words)), (3, "something else " + " ".join(words[: size + 1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(docs, size, percent).collect()}
    assert got[1] == (shingles, 1, 1) and got[2] == (shingles + 1, 1, 1) and got[3][1:] == (3, 0)
    assert sorted(r.doc_id for r in keep_one(docs, size, percent).collect()) == [1, 3]


@pytest.mark.parametrize("percent", [20, 33, 50, 60, 80, 85, 95])
def test_no_set_that_could_link_is_too_small(percent):
    linked = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1) or percent < 50 and n == 1)
    assert ngram_join._least(percent) <= linked


def test_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        for _ in range(40):
            base = rng.integers(0, 1 << 63, n + 8, dtype=np.uint64) * np.uint64(2)
            common = base[: n - n // 12] if n > 11 else base[:n]
            a = np.concatenate([common, base[n : n + rng.integers(0, 3)]])
            b = np.concatenate([common, base[n + 4 : n + 4 + rng.integers(0, 3)]])
            both = len(np.intersect1d(a, b))
            if len(a) == len(b) == both or 100 * both < 85 * (len(a) + len(b) - both):
                continue
            value = np.concatenate([np.sort(a), np.sort(b)])
            doc, sig = ngram_join._signatures(value, np.array([0, len(a), len(a) + len(b)]), 85)
            assert set(sig[doc == 0]) & set(sig[doc == 1])


def test_keeps_one_of_each_class(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    brute(odd.collect(), 85)
    rows = kept.collect()
    named = [grams(r.text) for r in rows if grams(r.text)]
    assert len(named) == brute.classes
    assert not any(100 * len(a & b) >= 85 * len(a | b) for i, a in enumerate(named) for b in named[:i])
    assert sum(not grams(r.text) for r in rows) == sum(not grams(r.text) for r in odd.collect())


def test_empty_table(none):
    assert ngram_jaccard_join(none).collect() == []
    assert keep_one(none).collect() == []
