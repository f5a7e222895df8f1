"""Order-dependent folds over sorted keys, split over tasks when a key is hot.

``ordered_fold`` sorts rows by (key, order) inside partitions and lets a small function walk each
key's rows with a state. Rows are range-partitioned, so a hot key lies in several consecutive
partitions. Every partition is first folded from a guessed entry state; where the true exit of the partition before differs, only
the partitions that depend on it are folded again. The loop ends when all entries are confirmed,
so the result is exact, and folds that forget their past (resets, clamps) confirm in a few rounds.
"""

from __future__ import annotations

import json
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.operators.segments import MAX_ROWS_PER_KEY, SEG, range_segments

Run = Callable[[tuple, dict[str, np.ndarray]], tuple[tuple, list[int], list[tuple]]]


def _walk(
    batches: Iterator[pd.DataFrame], keys: list[str], cols: list[str], initial: tuple, run: Run, entries: dict[int, tuple]
) -> Iterator[tuple]:
    """Yield (key, piece, emitted positions, emitted values, state) per batch and key, in order."""
    current, state = None, initial
    for pdf in batches:
        if pdf.empty:
            continue
        marks = np.zeros(len(pdf), dtype=bool)
        marks[0] = True
        for k in keys:
            v, gone = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
            marks[1:] |= (v[1:] != v[:-1]) & ~(gone[1:] & gone[:-1])
        starts = np.flatnonzero(marks).tolist() + [len(pdf)]
        arrays = {c: pdf[c].to_numpy() for c in cols}
        key_arrays = [pdf[k].to_numpy() for k in keys]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(None if pd.isna(a[lo]) else a[lo] for a in key_arrays)
            if key != current:
                first = current is None
                current = key
                state = entries.get(int(pdf[SEG].iloc[0]), initial) if first and entries else initial
            piece = {c: a[lo:hi] for c, a in arrays.items()}
            state, at, values = run(state, piece)
            yield key, pdf, lo, hi, at, values, state


def _settle(
    seg: DataFrame, keys: list[str], cols: list[str], initial: tuple, run: Run
) -> tuple[dict[int, tuple], set[int]]:
    """Entry state of every segment whose first key began earlier, and segments whose last key goes on.

    The driver sees one row per segment: its first and last key and its exit state.
    """
    key = F.struct(*keys)
    bounds = sorted(
        (r[SEG], tuple(r["lo"]), tuple(r["hi"]))
        for r in seg.groupBy(SEG).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    )
    before = {b[0]: a[0] for a, b in zip(bounds, bounds[1:]) if a[2] == b[1]}
    goes_on = set(before.values())
    single = {s for s, lo, hi in bounds if lo == hi}
    entries = {s: initial for s in before}
    exits: dict[int, tuple] = {}
    todo = set(goes_on)
    while todo:
        held = dict(entries)

        def exit_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = None
            for _, pdf, _, _, _, _, state in _walk(batches, keys, cols, initial, run, held):
                last = (int(pdf[SEG].iloc[0]), json.dumps(state))
            if last is not None:
                yield pd.DataFrame([last], columns=["seg", "state"])

        picked = seg.where(F.col(SEG).isin(sorted(todo)))
        for r in picked.mapInPandas(exit_states, "seg int, state string").collect():
            exits[r["seg"]] = tuple(json.loads(r["state"]))
        todo = set()
        for s, prev in before.items():
            if exits[prev] != entries[s]:
                entries[s] = exits[prev]
                if s in goes_on and s in single:
                    todo.add(s)
    return entries, goes_on


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], initial: tuple, run: Run,
    out: str, max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """keys + order + the values ``run`` emits, one row per emitted position."""
    keys, order, cols = list(keys), list(order), list(cols)
    rows = df.select(*dict.fromkeys([*keys, *order, *cols]))
    seg = range_segments(rows, keys, order, max_rows)
    entries = _settle(seg, keys, cols, initial, run)[0]
    extra = T.StructType.fromDDL(out)
    schema = T.StructType([seg.schema[c] for c in [*keys, *order]] + extra.fields)
    names = [f.name for f in extra.fields]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, at_all, values_all = None, [], []

        def flush():
            if batch is None or not at_all:
                return None
            got = batch.iloc[at_all][[*keys, *order]].reset_index(drop=True)
            for i, n in enumerate(names):
                got[n] = [v[i] for v in values_all]
            return got

        for _, pdf, lo, _, at, values, _ in _walk(batches, keys, cols, initial, run, entries):
            if pdf is not batch:
                done = flush()
                if done is not None:
                    yield done
                batch, at_all, values_all = pdf, [], []
            at_all += [lo + i for i in at]
            values_all += values
        done = flush()
        if done is not None:
            yield done

    return seg.mapInPandas(emit, schema)


def final_states(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], initial: tuple, run: Run,
    out: str, max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """keys + state after the key's last row; ``out`` names the state's fields."""
    keys, order, cols = list(keys), list(order), list(cols)
    rows = df.select(*dict.fromkeys([*keys, *order, *cols]))
    seg = range_segments(rows, keys, order, max_rows)
    entries, goes_on = _settle(seg, keys, cols, initial, run)
    extra = T.StructType.fromDDL(out)
    schema = T.StructType([seg.schema[c] for c in keys] + extra.fields)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sid, pending = None, None, []
        for key, pdf, _, _, _, _, state in _walk(batches, keys, cols, initial, run, entries):
            if sid is None:
                sid = int(pdf[SEG].iloc[0])
            if last is not None and last[0] != key:
                pending.append((*last[0], *last[1]))
                if len(pending) >= 10_000:
                    yield pd.DataFrame(pending, columns=schema.names)
                    pending = []
            last = (key, state)
        if last is not None and sid not in goes_on:
            pending.append((*last[0], *last[1]))
        if pending:
            yield pd.DataFrame(pending, columns=schema.names)

    return seg.mapInPandas(emit, schema)
