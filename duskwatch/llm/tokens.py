"""Whole-batch tokenising of Arrow text columns in numpy: no loop over rows or words."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_ODD), -1, 1 << 64))
_local = threading.local()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with the splitmix64 constants: spreads every input bit over the output."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_fold = np.arange(256)
_fold[65:91] += 32
LOWER_CODE = BYTE_CODE[_fold]
LOWER_BYTE = _fold.astype(np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    have = getattr(_local, "powers", None)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _ODD, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size <= 4 * SLICE_BYTES:
            _local.powers = have
    return have


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text stands alone and stays whole."""
    if not len(column):
        return
    ends = np.cumsum(byte_lengths(column))
    low = 0
    while low < len(ends):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield low, high
        low = high


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(_offsets(column)) if len(column) else np.zeros(0, np.int64)


class Words:
    """Words of the texts of one slice. ``start`` and ``end`` are byte places in ``data``; ``doc`` is the row in the slice."""

    def __init__(self, column: pa.Array, outside: np.ndarray = SPACE):
        column = column.fill_null("") if column.null_count else column
        self.rows = len(column)
        offsets = _offsets(column) if self.rows else np.zeros(1, np.int64)
        raw = column.buffers()[2] if self.rows else None
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inside = ~outside[self.data]
        n = len(inside)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self._run = None

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, code: np.ndarray = LOWER_CODE) -> np.ndarray:
        """64-bit hash of each word; by default A-Z count as a-z."""
        return self.span_hashes(self.start, self.end, code)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, code: np.ndarray = LOWER_CODE) -> np.ndarray:
        """Hash of any byte spans: a polynomial modulo 2**64 over random byte codes, mixed with the length."""
        if self._run is None or self._run[0] is not code:
            up, down = _powers(len(self.data) + 1)
            run = np.zeros(len(self.data) + 1, U64)
            np.cumsum(code[self.data] * up[: len(self.data)], out=run[1:])
            self._run = code, run, down
        _, run, down = self._run
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(U64) * BYTE_CODE[7])

    def windows(self, hashes: np.ndarray, size: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, hash) of each run of ``size`` words; shorter texts give one run of all words on request."""
        here = np.arange(len(hashes))
        last = self.first[self.doc + 1]
        ok = here + size <= last
        at = here[ok]
        total = np.zeros(len(at), U64)
        for k in range(size):
            total += hashes[at + k] * BYTE_CODE[11 + k]
        doc, out = self.doc[at], mix(total)
        if whole_if_short:
            short = np.flatnonzero((self.count > 0) & (self.count < size))
            more = np.zeros(len(short), U64)
            for k in range(size - 1):
                has = self.count[short] > k
                more[has] += hashes[self.first[short[has]] + k] * BYTE_CODE[11 + k]
            more = mix(more + self.count[short].astype(U64) * BYTE_CODE[9])
            doc, at, out = np.concatenate([doc, short]), np.concatenate([at, self.first[short]]), np.concatenate([out, more])
        return doc, at, out


def distinct(doc: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values per document, and the offset of each document's first."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))])


def list_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """List column of 64-bit values cut at ``offsets``."""
    flat = values.view(np.int64) if values.dtype == U64 else values
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
