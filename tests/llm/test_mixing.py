import re

import pytest

from duskwatch.llm.mixing import mix_sources, mixed_rows


def fill(sizes, weights, total, cap):
    target, free = {}, dict(sizes)
    while free:
        rest = total - sum(target.values())
        w = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / w > cap * sizes[s]}
        if not over:
            target |= {s: rest * weights[s] / w for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            del free[s]
    return target


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 40)])
def test_targets_and_takes(odd, weights):
    rows = mix_sources(odd, weights=weights).collect()
    docs = odd.collect()
    assert len(rows) == len(docs)
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s], abs=1e-5)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
    again = mix_sources(odd.repartition(5), weights=weights).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_rows(odd):
    mixed = mixed_rows(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.times for r in mix_sources(odd).collect())


def test_empty_table(none):
    assert mix_sources(none).collect() == []
    assert mixed_rows(none).collect() == []
