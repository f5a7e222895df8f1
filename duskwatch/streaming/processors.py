"""Keyed state for Structured Streaming: entity state, sequences, posture and connector liveness.

Operators work in event time: rows older than the watermark are dropped by the engine, and a timer at the
end of a state's life removes it, so the store holds only keys seen lately. Each micro-batch hands a key's
new rows to one call, which orders them by event time; a batch is bounded by the source's rate
limit. State is typed: counters in a value, distinct values in a map, recent times in a list.

Operators that pass events on keep ``timestamp``, so the watermark reaches the next operator of the
same query. What they do not look at travels as one text column, see ``pack`` and ``unpack``.
"""

from __future__ import annotations

from typing import Any, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from duskwatch.operators.sequence import ATTACK_PATTERNS, FOLD_COLS, Pattern, advance, hit_structs, pattern_table, stage_hits
from duskwatch.operators.state import DISTINCT_CAP, FIVE_MIN, IDLE_TTL, ONE_HOUR, STATE

SEC_US = 1_000_000
#: How late a row may be, if the caller does not say.
LATENESS = "10 minutes"
#: A lateness that stands for the watermark the input already has, and hands it on to the next operator.
INHERITED = "inherited"
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Event times kept per entity for the timing scores.
RECENT = 30


def ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    pdf = pd.concat(list(rows), ignore_index=True)
    return pdf.sort_values(["us", "event_id"], kind="stable", ignore_index=True)


def pack(df: DataFrame, keep: list[str]) -> tuple[DataFrame, T.StructType]:
    """``keep`` and all other columns as one text; the schema brings them back."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*rest), {**JSON_TIME, "ignoreNullFields": "false"}).alias("_rest")), df.select(*rest).schema


def unpack(df: DataFrame, schema: T.StructType) -> DataFrame:
    named = [c for c in df.columns if c != "_rest"]
    return df.withColumn("_rest", F.from_json("_rest", schema, JSON_TIME)).select(*named, "_rest.*")


class Forgetting(StatefulProcessor):
    """A processor whose key has one timer: it is moved with ``expire_at`` and clears the state when it fires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms bigint")

    def expire_at(self, us: int, life: int) -> None:
        """Forget the key once the watermark is ``life`` seconds past this event time."""
        ms = us // 1000 + life * 1000 + 1
        if self.due.exists():
            old = self.due.get()[0]
            if old == ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def keep(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.forget()
        self.due.clear()
        yield from ()

    def close(self) -> None:
        pass


ENTITY_OUT = (
    "tenant_id string, entity string, event_id {id}, timestamp timestamp, event_count bigint, events_5m bigint, events_1h bigint, "
    "unique_dst_ips bigint, unique_dst_ports bigint, sticky_campaign string, before_event_count bigint, before_events_5m bigint, "
    "before_events_1h bigint, before_unique_dst_ips bigint, before_unique_dst_ports bigint, before_sticky_campaign string, "
    "before_last_seen_us bigint, events_before bigint, times_us array<bigint>, _rest string"
)


def timing(events: DataFrame, lateness: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The events with a watermark, the columns that carry it, and the arguments that set the time mode."""
    mode = {"outputMode": "Append", "timeMode": "EventTime"}
    if lateness == INHERITED:
        return events, [], mode | {"eventTimeColumnName": "timestamp"}
    # the first watermark is the epoch, and a row at the watermark is late: a row at the epoch must not be
    return events.withColumn("_at", F.col("timestamp") + F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_at", lateness), ["_at"], mode


class EntityState(Forgetting):
    """Counters, run lengths, capped distinct sets and recent times of one (tenant, entity); forgotten after a day without events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counters = handle.getValueState("counters", "n bigint, m5 bigint, h1 bigint, last bigint, campaign string, sights bigint")
        self.ips = handle.getMapState("ips", "value string", "sight bigint")
        self.ports = handle.getMapState("ports", "value string", "sight bigint")
        self.times = handle.getListState("times", "us bigint")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        r = initialState.iloc[0]
        sights = 0
        for state, values in ((self.ips, r["dst_ips"]), (self.ports, r["dst_ports"])):
            for v in values:
                state.updateValue((v,), (sights,))
                sights += 1
        camp = r["sticky_campaign"]
        self.counters.update((int(r["event_count"]), int(r["events_5m"]), int(r["events_1h"]), int(r["last_seen_us"]), None if pd.isna(camp) else camp, sights))
        self.times.put([(int(t),) for t in r["times_us"]])
        self.expire_at(int(r["last_seen_us"]), IDLE_TTL)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        c = self.counters.get() if self.counters.exists() else None
        n, m5, h1, last, camp, sights = c if c is not None else (0, 0, 0, None, None, 0)
        seen = [{k[0]: v[0] for k, v in s.iterator()} for s in (self.ips, self.ports)]
        stored = [dict(s) for s in seen]
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        out = []
        pdf = ordered(rows)
        for r in pdf.itertuples(index=False):
            gap = 0 if last is None else max(r.us - last, 0)
            if last is None or gap > IDLE_TTL * SEC_US:
                n, m5, h1, camp, times, last = 0, 0, 0, None, [], None
                seen = [{}, {}]
            before = (n, m5, h1, len(seen[0]), len(seen[1]), camp, last) if last is not None else (None,) * 7
            if gap > ONE_HOUR * SEC_US:
                h1, seen = 0, [{}, {}]
            if gap > FIVE_MIN * SEC_US:
                m5 = 0
            n, m5, h1 = n + 1, m5 + 1, h1 + 1
            for values, value in zip(seen, (r.dst_ip, r.dst_port)):
                if value and value not in values:
                    values[value] = sights
                    sights += 1
                    if len(values) > DISTINCT_CAP:
                        del values[min(values, key=values.get)]
            camp = r.campaign_id or camp
            last = r.us if last is None else max(r.us, last)
            times = (times + [r.us])[-RECENT:]
            out.append((*key, r.event_id, r.timestamp, n, m5, h1, len(seen[0]), len(seen[1]), camp, *before, n - 1, list(times), r.rest))
        self.counters.update((n, m5, h1, last, camp, sights))
        for state, old, new in zip((self.ips, self.ports), stored, seen):
            for v in old.keys() - new.keys():
                state.removeKey((v,))
            for v in new.items() - old.items():
                state.updateValue((v[0],), (v[1],))
        self.times.put([(t,) for t in times])
        self.expire_at(last, IDLE_TTL)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ENTITY_OUT.split(", ")]).convert_dtypes()

    def forget(self) -> None:
        for s in (self.counters, self.ips, self.ports, self.times):
            s.clear()


def with_entity_state(events: DataFrame, initial: DataFrame | None = None, lateness: str = LATENESS) -> DataFrame:
    """Each event, all columns, with its entity's state before and after it, the number of earlier events and the recent times.

    ``events`` needs tenant_id, entity, event_id, timestamp, dst_ip, dst_port and campaign_id. ``initial`` is what
    ``final_entity_state`` gives for the history before the stream. ``lateness`` sets the watermark;
    ``INHERITED`` takes that of the input. Rows of a key are taken in the order of event time inside a
    micro-batch and in order of arrival across batches.
    """
    kind = events.schema["event_id"].dataType.simpleString()
    events, marks, mode = timing(events, lateness)
    keys = ["tenant_id", "entity", "event_id", "timestamp", *marks]
    packed, rest = pack(events, keys)
    fields = F.from_json("_rest", rest, JSON_TIME)
    text = lambda c, kind="string": F.coalesce(fields[c].cast(kind), F.lit(""))
    rows = packed.select(
        *keys, F.unix_micros("timestamp").alias("us"), text("dst_ip").alias("dst_ip"), F.when(text("dst_port") != "0", text("dst_port")).otherwise("").alias("dst_port"),
        text("campaign_id").alias("campaign_id"), F.col("_rest").alias("rest"),
    )
    out = rows.groupBy("tenant_id", "entity").transformWithStateInPandas(
        statefulProcessor=EntityState(), outputStructType=ENTITY_OUT.format(id=kind),
        initialState=None if initial is None else initial.groupBy("tenant_id", "entity"), **mode,
    )
    return unpack(out, rest)


def entity_state_stream(events: DataFrame, initial: DataFrame | None = None, lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of ``entity_state``."""
    return with_entity_state(events, initial, lateness).select("tenant_id", "entity", "event_id", *STATE)


class SequenceState(Forgetting):
    """Progress of one (tenant, entity, pattern): stages done and the time of the first; forgotten when the span is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("progress", "done int, t0 bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = ordered(rows)
        state = tuple(self.state.get()) if self.state.exists() else (0, 0)
        cols: dict[str, np.ndarray] = {c: pdf[c].to_numpy() for c in FOLD_COLS}
        state, at, values = advance(state, cols)
        if state[0]:
            self.state.update((int(state[0]), int(state[1])))
            self.expire_at(int(state[1]), int(pdf["span_us"].iloc[-1]) // SEC_US)
        else:
            self.forget()
            self.keep()
        alerts = [(*key, pdf["event_id"].iloc[i], pdf["timestamp"].iloc[i], v[0]) for i, v in zip(at, values)]
        if alerts:
            yield pd.DataFrame(alerts, columns=["tenant_id", "entity_key", "pattern_id", "triggering_event_id", "timestamp", "span_us"])

    def forget(self) -> None:
        self.state.clear()


def match_sequence_stream(events: DataFrame, patterns: list[Pattern] = ATTACK_PATTERNS, lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of ``match_sequence``; only rows that fit a stage reach the state store."""
    kind = events.schema["event_id"].dataType.simpleString()
    events, marks, mode = timing(events, lateness)
    hits = stage_hits(events, patterns, carry=["timestamp", *marks])
    fired = hits.groupBy("tenant_id", "entity_key", "pattern_id").transformWithStateInPandas(
        statefulProcessor=SequenceState(),
        outputStructType=f"tenant_id string, entity_key string, pattern_id string, triggering_event_id {kind}, timestamp timestamp, span_us bigint", **mode,
    )
    dim = pattern_table(events.sparkSession, patterns).drop("span_seconds")
    # the pattern list is an argument of this call, so its table is as small as the plan
    return fired.join(F.broadcast(dim), "pattern_id").withColumn("span_seconds", F.round(F.col("span_us") / 1e6, 1)).drop("span_us")


class EntitySequences(Forgetting):
    """Progress of all patterns of one (tenant, entity) in a map; passes every event on with the sequences it completes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.progress = handle.getMapState("progress", "pattern_id string", "done int, t0 bigint, span_us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = {k[0]: tuple(v) for k, v in self.progress.iterator()}
        stored = dict(state)
        out = []
        for r in ordered(rows).itertuples(index=False):
            fired = []
            for h in r.hits:
                done, t0, _ = state.get(h["pattern_id"], (0, 0, 0))
                cols = {"us": np.array([r.us]), "mask": np.array([h["mask"]]), "stages": np.array([h["stages"]]), "span_us": np.array([h["span_us"]])}
                (done, t0), at, values = advance((done, t0), cols)
                state[h["pattern_id"]] = (int(done), int(t0), int(h["span_us"]))
                if at:
                    fired.append({"pattern_id": h["pattern_id"], "span_us": int(values[0][0])})
            out.append((*key, r.event_id, r.timestamp, fired, r.rest))
        for p, value in state.items():
            if value[0] and stored.get(p) != value:
                self.progress.updateValue((p,), value)
            elif not value[0] and p in stored:
                self.progress.removeKey((p,))
        ends = [t0 + span for done, t0, span in state.values() if done]
        if ends:
            self.expire_at(max(ends), 0)
        else:
            self.keep()
        yield pd.DataFrame(out, columns=["tenant_id", "entity", "event_id", "timestamp", "sequences", "_rest"])

    def forget(self) -> None:
        self.progress.clear()


def with_sequences(events: DataFrame, patterns: list[Pattern] = ATTACK_PATTERNS) -> DataFrame:
    """Each event of a stream that has a watermark, all columns, with the sequences it completes: array of (pattern_id, span_us)."""
    keys = ["tenant_id", "entity", "event_id", "timestamp"]
    hits = events.withColumn("_hits", hit_structs(patterns))
    packed, rest = pack(hits, [*keys, "_hits"])
    rows = packed.select(*keys, F.unix_micros("timestamp").alias("us"), F.col("_hits").alias("hits"), F.col("_rest").alias("rest"))
    kind = events.schema["event_id"].dataType.simpleString()
    out = rows.groupBy("tenant_id", "entity").transformWithStateInPandas(
        statefulProcessor=EntitySequences(), outputMode="Append", timeMode="EventTime", eventTimeColumnName="timestamp",
        outputStructType=(
            f"tenant_id string, entity string, event_id {kind}, timestamp timestamp, sequences array<struct<pattern_id:string,span_us:bigint>>, _rest string"
        ),
    )
    return unpack(out, rest)


class Posture(Forgetting):
    """Running posture of one tenant; forgotten after thirty days without events."""

    LIFE = 30 * 86400

    def __init__(self, start: float):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.score = handle.getValueState("score", "x double")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.score.update((float(initialState["score"].iloc[0]),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        x = self.score.get()[0] if self.score.exists() else self.start
        pdf = ordered(rows)
        scores = []
        for m in pdf["meta_score"].tolist():
            x = max(0.0, x - m * 2.5) if m > 0.7 else min(100.0, x + 0.3) if m < 0.3 else x
            scores.append(x)
        self.score.update((x,))
        self.expire_at(int(pdf["us"].iloc[-1]), self.LIFE)
        yield pd.DataFrame({"tenant_id": key[0], "event_id": pdf["event_id"], "timestamp": pdf["timestamp"], "posture": scores, "_rest": pdf["rest"]})

    def forget(self) -> None:
        self.score.clear()


def with_posture(events: DataFrame, start: float = 82.0, initial: DataFrame | None = None) -> DataFrame:
    """Each event of a stream that has a watermark, all columns, with its tenant's posture after it. A tenant's rows of a micro-batch meet in one task."""
    packed, rest = pack(events, ["tenant_id", "event_id", "timestamp", "meta_score"])
    rows = packed.select("tenant_id", "event_id", "timestamp", F.unix_micros("timestamp").alias("us"), "meta_score", F.struct("meta_score", "_rest").alias("p"))
    rows = rows.select("tenant_id", "event_id", "timestamp", "us", "meta_score", F.to_json("p").alias("rest"))
    kind = events.schema["event_id"].dataType.simpleString()
    out = rows.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=Posture(start), outputMode="Append", timeMode="EventTime", eventTimeColumnName="timestamp",
        outputStructType=f"tenant_id string, event_id {kind}, timestamp timestamp, posture double, _rest string",
        initialState=None if initial is None else initial.groupBy("tenant_id"),
    )
    both = out.withColumn("_p", F.from_json("_rest", "meta_score double, _rest string")).select(
        "tenant_id", "event_id", "timestamp", "posture", "_p.meta_score", "_p._rest"
    )
    return unpack(both, rest)


def throughput_stream(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Event counts per window, source and severity; rows later than the watermark are dropped."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", width).alias("w"), "source_type", "severity")
        .agg(F.count("*").alias("events"))
    )


class Liveness(StatefulProcessor):
    """Last beat of one connector. A timer reports it dead when no beat follows; the next beat reports it alive again."""

    def __init__(self, silence: int, clock: bool):
        self.silence, self.clock = silence, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("beat", "last bigint, due bigint, alive boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        beats = sorted(int(us) for pdf in rows for us in pdf["us"])
        out, last, alive = [], old[0] if old else None, bool(old[2]) if old else False
        for us in beats:
            # a silence inside the batch is reported as the timer would have
            if alive and us - last > self.silence * SEC_US:
                out.append((*key, "dead", last, last + self.silence * SEC_US))
                alive = False
            if not alive:
                out.append((*key, "alive", us, us))
                alive = True
            last = us if last is None else max(last, us)
        if old and old[2]:
            self.handle.deleteTimer(old[1])
        due = (timerValues.getCurrentProcessingTimeInMs() if self.clock else last // 1000) + self.silence * 1000 + 1
        self.handle.registerTimer(due)
        self.state.update((last, due, True))
        if out:
            yield pd.DataFrame(out, columns=["connector_id", "status", "last_us", "at_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame([(*key, "dead", last, last + self.silence * SEC_US)], columns=["connector_id", "status", "last_us", "at_us"])

    def close(self) -> None:
        pass


def liveness_stream(heartbeats: DataFrame, silence: int = 120, lateness: str = "10 seconds", clock: bool = False) -> DataFrame:
    """Changes of connector liveness: connector_id, status, last_beat, at. A connector is dead ``silence`` seconds after its last beat.

    In event time the beats of the other connectors move the watermark that fires the timers; with ``clock`` the
    wall clock does, so that silence is noticed without any input, ``silence`` seconds after the beat arrived. A dead
    connector leaves no state.
    """
    beats = heartbeats if clock else heartbeats.withWatermark("timestamp", lateness)
    out = beats.select("connector_id", "timestamp", F.unix_micros("timestamp").alias("us")).groupBy("connector_id").transformWithStateInPandas(
        statefulProcessor=Liveness(silence, clock), outputStructType="connector_id string, status string, last_us bigint, at_us bigint", outputMode="Append",
        timeMode="ProcessingTime" if clock else "EventTime",
    )
    return out.select("connector_id", "status", F.timestamp_micros("last_us").alias("last_beat"), F.timestamp_micros("at_us").alias("at"))
