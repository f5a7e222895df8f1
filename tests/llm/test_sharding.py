import zlib

import numpy as np

from duskwatch.llm.sharding import permute, row_at, shuffle_into_shards


def test_permutation_and_inverse():
    for n in (1, 2, 5, 64, 1000, 65537):
        p = permute(np.arange(n), n, 7)
        assert sorted(p) == list(range(n))
        assert (permute(p, n, 7, inverse=True) == np.arange(n)).all()
    assert row_at(3, 2, 1000, 8, 7) == int(permute(np.arange(1000), 1000, 7, inverse=True)[19])


def test_shards(odd):
    rows = shuffle_into_shards(odd).collect()
    assert len(rows) == odd.count()
    counts = np.bincount([r.shard for r in rows], minlength=8)
    assert counts.max() - counts.min() <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, None if r.text is None else zlib.crc32(r.text.encode())) for r in odd.collect() if r.text is not None)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows if r.text_crc32 is not None) == want
    again = shuffle_into_shards(odd.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.text_crc32), r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_empty_table(none):
    assert shuffle_into_shards(none).collect() == []


def plain_place(number, n, seed=0):
    """One row at a time in whole numbers: Feistel rounds over the two halves, again and again until the value is below n."""
    k = 1
    while 1 << (2 * k) < n:
        k += 1
    mask, full = (1 << k) - 1, (1 << 64) - 1
    value = number
    while True:
        left, right = value >> k, value & mask
        for r in range(6):
            key = (seed * 1_000_003 + r * 7_919 + 1) % (1 << 61)
            h = ((right + key) * 0x9E3779B97F4A7C15) & full
            h ^= h >> 29
            h = (h * 0xBF58476D1CE4E5B9) & full
            left, right = right, left ^ ((h ^ (h >> 32)) & mask)
        value = (left << k) | right
        if value < n:
            return value


def test_every_row_equals_a_plain_permutation(odd):
    """Sort all rows, number them, permute each number by single steps, compare every row."""
    import zlib

    from pyspark.sql import functions as F

    rows = odd.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    low = lambda x: (x is not None, x if x is not None else 0)
    rows.sort(key=lambda r: (low(r.doc_id), r.h, low(crc(r.text))))
    want = []
    for i, r in enumerate(rows):
        at = plain_place(i, len(rows))
        want.append((r.doc_id, len((r.text or "").encode()) + 1, crc(r.text), "rows", at % 8, at // 8, None))
    got = [tuple(r) for r in shuffle_into_shards(odd, shards=8).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
