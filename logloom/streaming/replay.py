"""The replay as a stream: state by battle in the state store, bounded by timers, restored from a stored state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.replay import COLUMNS, OUT, ReplayConfig, ReplayState, advance, message_of

#: The look-back maps of a ReplayState; each is a map of the state store.
LOOK_BACK = ("seen", "candidates", "accepted")


class Replayer(StatefulProcessor):
    """Messages wait until the watermark has passed them, so that they are read in order however they
    arrive; look-back records are dropped by timer once they are out of their window. Only what
    has changed is written back."""

    def __init__(self, cfg: ReplayConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "timestamp_ms long, id string", "event_type string, text string, slots string")
        self.lists = handle.getValueState("lists", "names array<string>, moves array<string>, last_event string")
        self.maps = {name: handle.getMapState(name, "key string", "at long") for name in LOOK_BACK}

    def load(self) -> ReplayState:
        state = ReplayState()
        if self.lists.exists():
            names, moves, last = self.lists.get()
            state.names, state.moves, state.last_event = list(names), list(moves), last
        for name, held in self.maps.items():
            getattr(state, name).update({k[0]: v[0] for k, v in held.iterator()})
        return state

    def save(self, before: dict, state: ReplayState) -> None:
        after = asdict(state)
        if any(before[c] != after[c] for c in ("names", "moves", "last_event")):
            self.lists.update((state.names, state.moves, state.last_event))
        for name, held in self.maps.items():
            for key in before[name].keys() - after[name].keys():
                held.removeKey((key,))
            for key, at in after[name].items():
                if before[name].get(key) != at:
                    held.updateValue((key,), (at,))

    def wake(self, at: int | None) -> None:
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for row in batch.itertuples(index=False):
                kind = row.event_type if isinstance(row.event_type, str) else None
                text = row.text if isinstance(row.text, str) else None
                self.waiting.updateValue((int(row.timestamp_ms), row.id), (kind, text, row.slots))
                first = int(row.timestamp_ms) if first is None else min(first, int(row.timestamp_ms))
        timers = list(self.handle.listTimers())
        if first is not None and (not timers or first < min(timers)):
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        state = self.load()
        before = json.loads(json.dumps(asdict(state)))
        waiting = sorted(((k[0], k[1]), v) for k, v in self.waiting.iterator())
        out = []
        for (at, own), (kind, text, slots) in waiting:
            if at > passed:
                break
            read = advance(state, message_of({"timestamp_ms": at, "id": own, "event_type": kind, "text": text, "slots": slots}), self.cfg)
            out.append((int(key[0]), *(read[c] for c in COLUMNS[1:])))
            self.waiting.removeKey((at, own))
        left = [at for (at, _), _ in waiting[len(out) : len(out) + 1]]
        state.prune(passed, self.cfg)
        self.save(before, state)
        ends = state.expires(self.cfg)
        self.wake(min([*left, *([ends] if ends is not None else [])], default=None))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        state = ReplayState(**json.loads(initialState["state"].iloc[0]))
        self.save(asdict(ReplayState()), state)
        self.wake(state.expires(self.cfg))

    def close(self) -> None:
        pass


def replay_stream(messages: DataFrame, cfg: ReplayConfig = ReplayConfig(), states: DataFrame | None = None) -> DataFrame:
    """What operators.replay.replay tells of a stream of messages with event_time and its watermark (sessions.with_event_time).

    A message is told once the watermark has passed it. Rows behind the watermark are dropped, as Structured Streaming does; of
    equal time and id the last to arrive counts. states(battle_id, state) begins battles where a
    stored log left them, as a new query has no state of its own; it holds for battles that the query sees first.
    """
    begun = None if states is None else states.select("battle_id", "state").groupBy("battle_id")
    schema = T._parse_datatype_string(f"struct<{','.join(':'.join(f.split()) for f in OUT.split(','))}>")
    rows = messages.select("battle_id", "timestamp_ms", "id", "event_type", "text", "slots", "event_time")
    return rows.groupBy("battle_id").transformWithStateInPandas(Replayer(cfg), schema, "Append", "EventTime", begun)


def on_two_clocks(samples: DataFrame, readings: DataFrame, tolerance_ms: int) -> DataFrame:
    """Each of readings with the samples of its battle at most tolerance_ms apart; readings without one stay, with nulls.

    samples(battle_id, sample_id, sample_ms, ...) and readings(battle_id, reading_id, reading_ms, ...) may both be streams, each with a
    watermark of its own on its event_time (clocked). A row behind its own watermark is dropped; a reading
    without a sample is told when no sample could come any more. Tables give the same rows at once.
    Rows are joined by battle and time bucket, so that a battle of any length is spread over tasks.
    """
    width = tolerance_ms + 1
    left = samples.withColumns({"bucket": F.floor(F.col("sample_ms") / width)}).withColumnRenamed("event_time", "sample_time").withColumnRenamed("battle_id", "sample_battle")
    right = readings.withColumnRenamed("event_time", "reading_time")
    near = F.expr(f"sample_time >= reading_time - INTERVAL {tolerance_ms} MILLISECONDS AND sample_time <= reading_time + INTERVAL {tolerance_ms} MILLISECONDS")
    # A sample's bucket is that of the reading or one beside it: the sample is dealt to all three.
    spread = left.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    dealt = right.withColumn("bucket", F.floor(F.col("reading_ms") / width))
    keys = (F.col("sample_battle") == F.col("battle_id")) & (spread["bucket"] == dealt["bucket"]) & near
    return dealt.join(spread, keys, "left").drop(dealt["bucket"]).drop(spread["bucket"]).drop("sample_battle")


def clocked(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Add event_time of a column of milliseconds, with a watermark `late` behind it."""
    return rows.withColumn("event_time", F.timestamp_millis(ts)).withWatermark("event_time", late)
