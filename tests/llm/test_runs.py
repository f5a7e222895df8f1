import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from duskwatch.llm.runs import find_runs, periodic_runs


def brute_runs(w):
    """All runs by definition: for each period, the maximal stretches whose words repeat at that distance."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(text)
    )


def code_of(lists):
    ids = {}
    code = np.array([ids.setdefault((d, x), len(ids)) for d, w in enumerate(lists) for x in w], np.int64)
    return code, np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)


def split_by_text(code, first):
    start, length, period = find_runs(code, first)
    at = np.searchsorted(first, start, "right") - 1
    out = [[] for _ in first[:-1]]
    for d, s, n, p in zip(at, start, length, period):
        out[d].append((int(s - first[d]), int(n), int(p)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(150):
        w = []
        while len(w) < rng.choice([0, 3, 8, 40, 150]):
            piece = [rng.choice("abc" if rng.random() < 0.5 else "abcdefghij") for _ in range(rng.randint(1, 9))]
            w += piece * rng.choice([1, 1, 2, 4, 5, 9])
        lists.append(w)
    found = split_by_text(*code_of(lists))
    assert [sorted(x) for x in found] == [brute_runs(w) for w in lists]


def test_runs_of_known_words():
    fib, old = "a", "b"
    for _ in range(13):
        fib, old = fib + old, fib
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    lists = [list(fib), list(thue), ["x"] * 5, ["x"] * 6, ["x"] * 3000, list("ab" * 500 + "c" + "ba" * 4), list("abcabcabcabc"), list("abcabcabcab")]
    found = split_by_text(*code_of(lists))
    assert [sorted(x) for x in found] == [brute_runs(w) for w in lists]
    assert found[2] == [] and found[3] == [(0, 6, 1)] and found[6] == [(0, 12, 3)] and found[7] == []


def test_rows(odd, none, spark):
    rows = periodic_runs(odd, planted=True).collect()
    want = sorted((brute(r.doc_id, r.text) for r in odd.collect()), key=str)
    assert sorted((tuple(r)[:8] for r in rows), key=str) == want
    for r in rows:
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs
    assert periodic_runs(none).collect() == []


def test_text_without_repeats(spark):
    texts = ["é ü é ü é ü é ü é ü z", "A a A a A a A a", "go go go go go go\nstop\tstop stop", None, " \n", "b " * 50_000 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert [rows[i].collapsed for i in range(6)] == ["é ü z", "A a", "go stop stop stop", "", "", "b c"]
    assert rows[5].length == 50_000 and rows[5].period == 1 and rows[3].length is None and rows[0].exponent_milli == 5000
    assert periodic_runs(df, texts=False).columns[-1] == "collapsed_sha256"


def test_planted_tail(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0] + [1, 2, 3]
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(40)) for _ in range(rng.choice([1, 7, 60, 300])))) for i in ids], "doc_id long, text string")
    want = sorted(brute(r.doc_id, r.text) for r in df.collect())
    assert sorted(tuple(r) for r in periodic_runs(df, planted=True, texts=False).collect()) == want
    assert sum(r[1] for r in want) > 10
