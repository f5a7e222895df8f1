"""Periodic runs of words: maximal pairs from the LCP-interval tree of every whole text.

Suffixes of a slice of texts are sorted by prefix doubling; each doubling keeps only suffixes that are
still tied. Intervals are merged bottom up, from the longest common prefix down. A place carries the
class of its left word; two places of an interval are a maximal pair if they come from different
children and their classes differ. A pair of distance p and common length l is a repetition
of length p + l that no neighbour extends, so a distance of at most a third of l makes it a run, and no
extension is needed. Between places so close, only neighbours in text order can give the smallest
period: an occurrence between them would have a smaller one. So a place that joins an interval meets its two
neighbours there, not whole class lists.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from duskwatch.llm.tokens import BYTE_CODE, U64, Words, mix, slices

#: A run has at least this many words and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of text whose suffixes are sorted together; a longer text stands alone. About 250 bytes of memory a byte if all of it repeats.
SORT_BYTES = 1 << 19
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def suffix_levels(code: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, … items, until no two are equal. ``end``: the end of each item's text.

    Equal ranks at level k mean that the first 2**k items are equal; items past a text's end come first.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], at, 0)) if n else at
    levels, tied, step = [rank.astype(np.int32)], order, 1
    while len(tied := tied[_shared(rank[tied])]):
        after = tied + step
        second = np.where(after < end[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        at = np.arange(len(tied))
        first_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        first_new = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        rank[tied] = old + first_new - first_old
        levels.append(rank.astype(np.int32))
        step *= 2
    return levels


def _shared(ordered: np.ndarray) -> np.ndarray:
    """Items of an ordered array that equal a neighbour."""
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(ordered), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def common_prefix(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, a <> b, item by item."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < end[a]) & (y < end[b])
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        length += np.where(inside & (levels[k][x] == levels[k][y]), 1 << k, 0)
    return length


def _candidates(levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Suffixes in sorted order that can be in a pair: an equal four-word start lies within a third of the longest common prefix."""
    if len(levels) < 3:
        return np.zeros(0, np.int64)
    rank = levels[-1]
    order = np.lexsort((np.arange(len(rank)), levels[2]))
    group = levels[2][order]
    shared = _shared(group)
    order, group = order[shared], group[shared]
    if not len(order):
        return order
    far = np.iinfo(np.int64).max // 8
    gap = np.where(group[1:] == group[:-1], order[1:] - order[:-1], far)
    near = np.full(len(rank), far)
    near[order] = np.minimum(np.r_[gap, far], np.r_[far, gap])
    by_rank = order[np.argsort(rank[order], kind="stable")]
    lcp = common_prefix(levels, end, by_rank[:-1], by_rank[1:])
    longest = np.maximum(np.r_[lcp, 0], np.r_[0, lcp])
    return by_rank[(LEAST_TIMES - 1) * near[by_rank] <= longest]


def maximal_pairs(order: list[int], lcp: np.ndarray, left: list[int]) -> list[tuple[int, int, int]]:
    """(place, distance, common length) of close maximal pairs. ``order``: places by suffix, ``lcp``: with the next one, ``left``: left-word class by place.

    Intervals of the LCP-interval tree are merged from the longest prefix down, the smaller list into the larger.
    """
    found = []
    parent = list(range(len(order)))
    lists: list[list[int] | None] = [[p] for p in order]
    least = LEAST_WORDS - 1
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    for edge, length in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = edge, edge + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        small, large = lists[a], lists[b]
        if len(small) > len(large):
            a, b, small, large = b, a, large, small
        reach = length // (LEAST_TIMES - 1)
        places = []
        for x in small:
            k = bisect_left(large, x)
            places.append(k)
            if k < len(large) and (p := large[k] - x) <= reach and left[x] != left[large[k]] and p + length >= LEAST_WORDS:
                found.append((x, p, length))
            if k and (p := x - large[k - 1]) <= reach and left[x] != left[large[k - 1]] and p + length >= LEAST_WORDS:
                found.append((x - p, p, length))
        if len(small) <= 8:
            for k, x in zip(reversed(places), reversed(small), strict=True):
                large.insert(k, x)
        else:
            large += small
            large.sort()
        parent[a], lists[a] = b, None
    return found


def find_runs(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. ``code``: items, equal only within a text; ``first``: offsets of the texts."""
    n = len(code)
    end = np.repeat(first[1:], np.diff(first))
    none = np.zeros(0, np.int64)
    if n < LEAST_WORDS:
        return none, none, none
    levels = suffix_levels(code, end)
    order = _candidates(levels, end)
    if len(order) < 2:
        return none, none, none
    lcp = common_prefix(levels, end, order[:-1], order[1:])
    left = np.empty(n, np.int64)
    left[1:] = levels[0][:-1]
    begins = first[:-1][first[:-1] < n]
    left[begins] = -1 - np.arange(len(begins))
    del levels
    pairs = np.array(maximal_pairs(order.tolist(), lcp, left.tolist()), np.int64).reshape(-1, 3)
    start, period, length = pairs[:, 0], pairs[:, 1], pairs[:, 1] + pairs[:, 2]
    by = np.lexsort((period, length, start))
    start, period, length = start[by], period[by], length[by]
    # multiples of a period have the same extent; the smallest is the run's own
    own = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, period, length = start[own], period[own], length[own]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def repeat_tail(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p) if the text's words from a on are replaced by a repetition of p words, as a tenth of the ids have it."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _batch(ids: pa.Array, text: pa.Array, planted: bool) -> pa.RecordBatch:
    w = Words(text)
    ids = ids.to_pylist()
    source = np.arange(len(w))
    for d, (n, at) in enumerate(zip(w.count.tolist(), w.first.tolist(), strict=False)):
        if planted and (tail := repeat_tail(n, ids[d])):
            a, p = tail
            source[at + a : at + n] = at + a + np.arange(n - a) % p
    with np.errstate(over="ignore"):
        code = mix(w.hashes(BYTE_CODE)[source] + w.doc.astype(U64) * BYTE_CODE[3])
    first = w.first
    start, length, period = find_runs(code, first)
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    dropped = np.cumsum(cover)[:-1] > 0
    at = np.searchsorted(start, first)
    rows = []
    for d, value in enumerate(text):
        words = value.as_buffer().to_pybytes().split() if value.is_valid else []
        low, high = int(first[d]), int(first[d + 1])
        runs = [
            (s - low, n, p)
            for s, n, p in zip(start[at[d] : at[d + 1]].tolist(), length[at[d] : at[d + 1]].tolist(), period[at[d] : at[d + 1]].tolist(), strict=True)
        ]
        if runs or (source[high - 1] != high - 1 if high > low else False):
            words = [words[k - low] for k in source[low:high][~dropped[low:high]].tolist()]
        kept = b" ".join(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        rows.append(
            (
                ids[d], len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
                [{"start": s, "length": n, "period": p} for s, n, p in runs], kept,
            )
        )
    return _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    long = pa.int64()
    kinds = [long] * 6 + [pa.string(), pa.string(), pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True))
    out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
    out.append(pa.array(columns[-1], pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(out, names)


def periodic_runs(docs: DataFrame, planted: bool = False, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, the number of runs, the longest run, digests, all runs, and the text without the repeats.

    ``planted`` first puts a repetition into the tail of a tenth of the texts, by id (none where the id
    is null). Null and empty texts and texts of white space have no words, no runs and an empty collapsed text. Ties of the
    longest run go to the smallest start, then period. Repeated rows and repeated ids give a row each; other columns are ignored;
    an empty table gives no rows. ``texts`` false leaves out the runs and the collapsed text. Each text is worked on whole, in one
    task.
    """
    keep = SCHEMA if texts else SCHEMA.split(", runs array")[0]
    width = len(SCHEMA.split(", ")) if texts else len(SCHEMA.split(", ")) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            for low, high in slices(text, SORT_BYTES):
                out = _batch(ids.slice(low, high - low), text.slice(low, high - low), planted)
                yield pa.RecordBatch.from_arrays(out.columns[:width], out.schema.names[:width])

    return docs.select("doc_id", "text").mapInArrow(run, keep)
