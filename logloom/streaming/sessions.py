"""Streaming twins of the windows and state machines, on Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators import sessions


def with_event_time(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Add event_time, a timestamp with time zone, and let rows be `late` late."""
    return rows.withColumn("event_time", F.timestamp_millis(ts)).withWatermark("event_time", late)


def windowed_counts(rows: DataFrame, keys: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Counts of each key by event-time window; a window is final when the watermark passes it."""
    span = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    counted = rows.groupBy(span.alias("span"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), *keys, "n")


def session_counts(rows: DataFrame, key: str, gap: str) -> DataFrame:
    """Counts of each key by sessions that end after a gap."""
    counted = rows.groupBy(F.session_window("event_time", gap).alias("span"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), key, "n")


def _machine(rows: DataFrame, new_state: type, step: Callable, cfg: object, schema: str, idle_ms: int) -> DataFrame:
    """Run a transition function over a stream keyed by battle_id; state is one JSON text a battle.

    Rows of one trigger are sorted by time before they are folded. A battle that gets no
    rows for idle_ms of event time is forgotten.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = new_state(**json.loads(held.get[0])) if held.exists else new_state()
        rows_at = pd.concat(list(batches)).sort_values(["timestamp_ms", "seq"], kind="stable")
        yield step(int(key[0]), rows_at, state, cfg)
        held.update((json.dumps(asdict(state)),))
        until = int(rows_at["timestamp_ms"].max()) + idle_ms
        held.setTimeoutTimestamp(max(until, held.getCurrentWatermarkMs() + 1))

    state_schema = T.StructType([T.StructField("state", T.StringType())])
    return rows.groupBy("battle_id").applyInPandasWithState(
        fold, T._parse_datatype_string(f"struct<{','.join(':'.join(f.split()) for f in schema.split(','))}>"), state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )


def phase_gate_stream(samples: DataFrame, cfg: sessions.GateConfig = sessions.GateConfig(), idle_ms: int = 60_000) -> DataFrame:
    return _machine(samples, sessions.GateState, sessions.gate_rows, cfg, sessions.GATE_OUT, idle_ms)


def message_watcher_stream(samples: DataFrame, cfg: sessions.WatcherConfig = sessions.WatcherConfig(), idle_ms: int = 60_000) -> DataFrame:
    return _machine(samples, sessions.WatcherState, sessions.watcher_rows, cfg, sessions.WATCHER_OUT, idle_ms)


def sliding_dedupe_stream(rows: DataFrame, key: list[str], window_ms: int) -> DataFrame:
    """The sliding suppression over a stream of rows(timestamp_ms, event_time, ...): keeps, for each
    key, the time it was last seen, refreshed by suppressed rows too; forgotten after the window."""
    names = [f.name for f in rows.schema.fields]
    out_schema = T.StructType([*rows.schema.fields, T.StructField("suppressed", T.BooleanType())])

    def mark(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last = held.get[0] if held.exists else None
        found = pd.concat(list(batches)).sort_values("timestamp_ms", kind="stable")
        back = found["timestamp_ms"].diff()
        if last is not None and len(found):
            back.iloc[0] = found["timestamp_ms"].iloc[0] - last
        found["suppressed"] = ((back >= 0) & (back <= window_ms)).to_numpy()
        newest = int(found["timestamp_ms"].max())
        held.update((newest if last is None else max(last, newest),))
        held.setTimeoutTimestamp(max(held.get[0] + window_ms + 1, held.getCurrentWatermarkMs() + 1))
        yield found[[*names, "suppressed"]]

    return rows.groupBy(*key).applyInPandasWithState(
        mark, out_schema, T.StructType([T.StructField("last", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout
    )
