"""Entity state in one ordered pass over range segments.

Rows lie sorted by (tenant, entity, time, id) in segments, see ``range_segments``. A task walks its
segment in Arrow batches and works on a batch as a whole in numpy. What the first key of a segment
brings along from earlier segments is composed on the driver from one small row per segment: run lengths
add up unless a gap breaks them, and a distinct set needs at most ``cap`` values, because only the smaller
of its size and the cap is ever given. So a hot entity costs two passes over its rows, however
many segments it covers, and nothing is joined or shuffled again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from duskwatch.operators.segments import MAX_ROWS_PER_KEY, SEG, range_segments

SEC_US = 1_000_000
FIVE_MIN, ONE_HOUR, IDLE_TTL = 300, 3600, 86400
SETS = ("ip", "port")
KEYS = ["tenant_id", "entity"]


@dataclass
class Tail:
    """What is known of a key after some of its rows. ``broke_*``: a run began anew inside them."""

    first: int | None = None
    last: int | None = None
    total: int = 0
    n: int = 0
    m5: int = 0
    h1: int = 0
    broke_n: bool = False
    broke_5: bool = False
    broke_1: bool = False
    ip: list[str] = field(default_factory=list)
    port: list[str] = field(default_factory=list)
    campaign: str | None = None
    times: list[int] = field(default_factory=list)
    run_times: int = 0

    def then(self, more: "Tail", cap: int, recent: int) -> "Tail":
        """This key's state after further rows that were walked without knowing of these."""
        if self.last is None:
            return more
        gap = more.first - self.last
        idle, hour, five = (gap > limit * SEC_US for limit in (IDLE_TTL, ONE_HOUR, FIVE_MIN))
        add = lambda mine, theirs, broke, cut: theirs if broke or cut else mine + theirs
        out = Tail(
            self.first, more.last, self.total + more.total, add(self.n, more.n, more.broke_n, idle), add(self.m5, more.m5, more.broke_5, five),
            add(self.h1, more.h1, more.broke_1, hour), self.broke_n or more.broke_n or idle, self.broke_5 or more.broke_5 or five,
            self.broke_1 or more.broke_1 or hour,
        )
        for name in SETS:
            mine, theirs = getattr(self, name), getattr(more, name)
            known = [] if more.broke_1 or hour else mine
            setattr(out, name, (known + [v for v in theirs if v not in set(known)])[:cap])
        out.campaign = more.campaign if more.campaign is not None or more.broke_n or idle else self.campaign
        out.times = (self.times + more.times)[-recent:] if recent else []
        out.run_times = min(len(out.times), add(self.run_times, more.run_times, more.broke_n, idle))
        return out


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _run_length(start: np.ndarray, before: int) -> np.ndarray:
    at = np.arange(len(start))
    last = np.maximum.accumulate(np.where(start, at, -1))
    return np.where(last >= 0, at - last + 1, before + at + 1)


class Walk:
    """One segment, batch by batch. ``tail`` is the state of the key walked last."""

    def __init__(self, entry: Tail, cap: int, recent: int, in_run: bool):
        self.tail, self.cap, self.recent, self.in_run = entry, cap, recent, in_run
        self.key: tuple | None = None
        self.first_key: tuple | None = None

    def step(self, batch: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
        """Columns of the batch's rows: state after them, state before them, earlier rows, recent times."""
        n = len(batch)
        us = batch.column("us").to_numpy()
        tenant, entity = _ids(batch, "tenant_id"), _ids(batch, "entity")
        new = np.ones(n, bool)
        new[1:] = (tenant[1:] != tenant[:-1]) | (entity[1:] != entity[:-1])
        first = tuple(batch.column(k)[0].as_py() for k in KEYS)
        if self.key is None:
            self.first_key = first
        old = self.tail
        if self.key is not None and self.key != first:
            old = Tail()
        new[0] = old.last is None
        gap = np.zeros(n, np.int64)
        gap[1:] = us[1:] - us[:-1]
        gap[0] = 0 if new[0] else us[0] - old.last
        idle = new | (gap > IDLE_TTL * SEC_US)
        hour = new | (gap > ONE_HOUR * SEC_US)
        five = new | (gap > FIVE_MIN * SEC_US)
        out = {
            "event_count": _run_length(idle, old.n), "events_5m": _run_length(five, old.m5), "events_1h": _run_length(hour, old.h1),
            "events_before": _run_length(new, old.total) - 1,
        }
        sights = {}
        for name in SETS:
            out[f"unique_dst_{name}s"], sights[name] = self._distinct(batch.column(f"_{name}"), hour, getattr(old, name))
        camp = batch.column("_camp")
        out["sticky_campaign"] = self._sticky(camp, idle, old.campaign)
        out["_new"], out["_idle"] = new, idle
        before = np.r_[us[0] if new[0] else old.last, us[:-1]]
        out["before_last_seen_us"] = pa.array(before, mask=idle)
        spans = self._recent(us, new, idle, old) if self.recent else None
        if spans is not None:
            out["times_us"] = spans
        self._keep(batch, us, new, idle, hour, five, out, sights, old)
        return out

    def _distinct(self, column: pa.Array, start: np.ndarray, known: list[str]) -> tuple[np.ndarray, dict]:
        coded = pc.dictionary_encode(column)
        words = coded.dictionary.to_pylist()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        run = np.cumsum(start)
        rows = np.flatnonzero(code >= 0)
        pair = run[rows] * (len(words) + 1) + code[rows]
        fresh = np.zeros(len(code), bool)
        fresh[rows[np.unique(pair, return_index=True)[1]]] = True
        if known:
            have = set(known)
            old = np.flatnonzero(fresh & (run == 0))
            fresh[old[[words[c] in have for c in code[old].tolist()]]] = False
        total = np.cumsum(fresh)
        at = np.maximum.accumulate(np.where(start, np.arange(len(start)), -1))
        base = np.where(at >= 0, total[np.maximum(at, 0)] - fresh[np.maximum(at, 0)], -len(known))
        last = fresh & (run == run[-1])
        return np.minimum(total - base, self.cap), [words[c] for c in code[last].tolist()]

    @staticmethod
    def _sticky(camp: pa.Array, idle: np.ndarray, old: str | None) -> pa.Array:
        at = np.arange(len(idle))
        given = np.maximum.accumulate(np.where(np.array(camp.is_valid()), at, -1))
        began = np.maximum.accumulate(np.where(idle, at, -1))
        mine = (given >= 0) & (given >= began)
        taken = camp.take(pa.array(np.maximum(given, 0), mask=~mine))
        return taken if old is None else pc.if_else(pa.array((given < 0) & (began < 0)), pa.scalar(old, camp.type), taken)

    def _recent(self, us: np.ndarray, new: np.ndarray, idle: np.ndarray, old: Tail) -> pa.Array:
        """The last times of the key, or with ``in_run`` of its current run of activity, this row's included."""
        line = np.concatenate([np.array(old.times, np.int64), us])
        shift, at = len(old.times), np.arange(len(us)) + len(old.times)
        cuts, carried = (idle, old.run_times) if self.in_run else (new, shift)
        began = np.maximum.accumulate(np.where(cuts, at, shift - carried))
        low = np.maximum(at - self.recent + 1, began)
        size = at - low + 1
        ends = np.cumsum(size)
        flat = np.repeat(low - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(line[flat]))

    def _keep(self, batch, us, new, idle, hour, five, out, sights, old: Tail) -> None:
        last_new = np.flatnonzero(new)
        begin = int(last_new[-1]) if len(last_new) else 0
        fresh = bool(len(last_new))
        own = slice(begin, None)
        breaks = lambda flag: bool(flag[begin + 1 :].any() or (not fresh and flag[begin]))
        tail = Tail(
            int(us[begin]) if fresh else old.first, int(us[-1]), int(out["events_before"][-1]) + 1, int(out["event_count"][-1]), int(out["events_5m"][-1]),
            int(out["events_1h"][-1]),
        )
        tail.broke_n, tail.broke_5, tail.broke_1 = (
            breaks(flag) or (not fresh and was) for flag, was in ((idle, old.broke_n), (five, old.broke_5), (hour, old.broke_1))
        )
        for name in SETS:
            carried = [] if hour.any() else getattr(old, name)
            setattr(tail, name, (carried + sights[name])[: self.cap])
        tail.campaign = out["sticky_campaign"][len(us) - 1].as_py()
        if self.recent:
            tail.times = (([] if fresh else old.times) + us[own].tolist())[-self.recent :]
            tail.run_times = min(len(tail.times), tail.n)
        self.tail = tail
        self.key = tuple(batch.column(k)[len(us) - 1].as_py() for k in KEYS)


STATE = ["event_count", "events_5m", "events_1h", "unique_dst_ips", "unique_dst_ports", "sticky_campaign"]


def _prepared(events: DataFrame, max_rows: int) -> DataFrame:
    blank = F.lit(None).cast("string")
    named = {"_ip": "dst_ip", "_port": "dst_port"}
    rows = events.withColumn("us", F.unix_micros("timestamp"))
    for to, source in named.items():
        value = F.col(source).cast("string") if source in events.columns else blank
        rows = rows.withColumn(to, F.when(~value.isin("", "0"), value))
    camp = F.col("campaign_id").cast("string") if "campaign_id" in events.columns else blank
    rows = rows.withColumn("_camp", F.when(camp != "", camp))
    return range_segments(rows, KEYS, ["us", "event_id"], max_rows)


def _entries(seg: DataFrame, cap: int, recent: int, in_run: bool) -> dict[int, Tail]:
    """State that the first key of each segment brings along; the driver sees one small row per segment."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, sid = Walk(Tail(), cap, recent, in_run), None
        for batch in batches:
            if not len(batch):
                continue
            sid = batch.column(SEG)[0].as_py()
            walk.step(batch)
        if sid is not None:
            row = {"seg": sid, "lo": walk.first_key, "hi": walk.key, "tail": asdict(walk.tail)}
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(row)])], ["row"])

    need = [*KEYS, "us", "_ip", "_port", "_camp", SEG]
    rows = sorted((json.loads(r["row"]) for r in seg.select(*need).mapInArrow(ends, "row string").collect()), key=lambda r: r["seg"])
    out, carried, key = {}, Tail(), None
    for r in rows:
        entry = carried if key == r["lo"] else Tail()
        out[r["seg"]] = entry
        own = Tail(**r["tail"])
        carried = entry.then(own, cap, recent) if r["lo"] == r["hi"] else own
        key = r["hi"]
    return out


def entity_pass(
    events: DataFrame, max_rows: int = MAX_ROWS_PER_KEY, cap: int = 100, recent: int = 0, before: bool = False, in_run: bool = False
) -> DataFrame:
    """All columns of ``events`` with ``STATE`` after each row and ``events_before``; on request ``before_*`` and ``times_us``.

    ``events`` needs tenant_id, entity, event_id and timestamp; dst_ip, dst_port and campaign_id count where they are given. Null
    keys are keys like any other. ``recent`` times are kept per key, or per run of activity with ``in_run``.
    """
    seg = _prepared(events, max_rows)
    entries = _entries(seg, cap, recent, in_run)
    added = [T.StructField(c, T.LongType()) for c in STATE[:-1]] + [T.StructField(STATE[-1], T.StringType()), T.StructField("events_before", T.LongType())]
    if before:
        added += [T.StructField(f"before_{f.name}", f.dataType) for f in added[: len(STATE)]] + [T.StructField("before_last_seen_us", T.LongType())]
    if recent:
        added.append(T.StructField("times_us", T.ArrayType(T.LongType())))
    own = {f.name for f in added}
    kept = [f for f in events.schema.fields if f.name not in own]
    schema = T.StructType([*kept, *added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            if walk is None:
                walk = Walk(entries[batch.column(SEG)[0].as_py()], cap, recent, in_run)
                last = _last_state(walk.tail)
            given = walk.step(batch)
            if before:
                idle = given["_idle"]
                for c in STATE:
                    col = given[c] if isinstance(given[c], pa.Array) else pa.array(given[c])
                    moved = pa.concat_arrays([pa.array([last[c]], col.type), col.slice(0, len(col) - 1)])
                    given[f"before_{c}"] = pc.if_else(pa.array(idle), pa.scalar(None, col.type), moved)
            last = {c: given[c][len(batch) - 1].as_py() if isinstance(given[c], pa.Array) else int(given[c][-1]) for c in STATE}
            columns = [batch.column(f.name) for f in kept]
            columns += [given[f.name] if isinstance(given[f.name], pa.Array) else pa.array(given[f.name].astype(np.int64)) for f in added]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return seg.mapInArrow(run, schema)


def _last_state(t: Tail) -> dict:
    values = (t.n, t.m5, t.h1, len(t.ip), len(t.port), t.campaign)
    return dict(zip(STATE, values, strict=True)) if t.last is not None else dict.fromkeys(STATE)
