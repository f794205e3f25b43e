"""Keyed state machines: the phase gate and the message watcher.

Each has one pure transition function. Batch runs feed it the time-ordered rows of a key
through mapInPandas; the streaming twins in logloom.streaming feed it
from a state store. Keys are spread over tasks; one key's rows need their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class GateConfig:
    streak: int = 2
    idle_lease_ms: int = 6000


@dataclass
class GateState:
    phase: str = "unknown"
    changed_at: int = -1
    activity_at: int = -1
    hud: int = -1
    hud_streak: int = 0
    vs: int = -1
    vs_streak: int = 0
    opened_from_vs: bool = False


def _streak(now: int, wanted: bool) -> int:
    """Positive counts of seen samples, negative ones of unseen."""
    return max(now, 0) + 1 if wanted else min(now, 0) - 1


def advance_gate(state: GateState, row: dict, cfg: GateConfig = GateConfig()) -> list[str]:
    """Take one sample (timestamp_ms, hud, vs or None, busy; activity and ended where they are known) into the
    state; return what changed. An end is final; activity renews the lease of an open phase."""
    if state.phase == "ended":
        return []
    ts, out = int(row["timestamp_ms"]), []
    if row.get("ended") is True:
        state.phase, state.changed_at = "ended", ts
        return ["battle_ended"]
    if row.get("activity") is True and state.phase == "message_candidate":
        state.activity_at = ts

    def enter(phase: str, said: str) -> None:
        if state.phase == phase:
            return
        state.phase, state.changed_at = phase, ts
        if phase == "message_candidate":
            state.activity_at = ts
        out.append(said)

    if row.get("vs") is not None:
        state.vs_streak = _streak(state.vs_streak, bool(row["vs"]))
        if state.vs_streak >= cfg.streak:
            state.vs = 1
        elif state.vs_streak <= -cfg.streak and state.vs == 1 and not state.opened_from_vs:
            state.vs, state.opened_from_vs = 0, True
            out.append("vs_fell")
            enter("message_candidate", "message_phase_opened")
    state.hud_streak = _streak(state.hud_streak, bool(row["hud"]))
    if state.hud_streak >= cfg.streak and state.hud != 1:
        state.hud = 1
        out.append("battle_hud_rose")
        enter("hud", "message_phase_closed")
    elif state.hud_streak <= -cfg.streak and state.hud != 0:
        fell, state.hud = state.hud == 1, 0
        if fell:
            out.append("battle_hud_fell")
            enter("message_candidate", "message_phase_opened")
    if state.phase == "message_candidate" and not row.get("busy"):
        since = state.activity_at if state.activity_at >= 0 else state.changed_at
        if since >= 0 and ts - since >= cfg.idle_lease_ms:
            enter("unknown", "message_phase_expired")
    return out


@dataclass(frozen=True)
class WatcherConfig:
    """When a message counts as there (needed of the samples since it was first seen, for min_ms and with min_score),
    as a flicker (candidate_absences missing samples, or max_ms without confirming), and as gone
    (absences missing samples, or stale_ms); a different picture must hold switch_samples samples."""

    needed: int = 3
    min_ms: int = 250
    max_ms: int = 900
    candidate_absences: int = 2
    min_presence: float = 0.35
    min_score: float = 0.45
    absences: int = 3
    switch_samples: int = 4
    min_active_ms: int = 350
    stale_ms: int = 15000
    better: float = 0.05


@dataclass
class WatcherState:
    mode: str = "empty"
    picture: str = ""
    since: int = 0
    seen: int = 0
    missing: int = 0
    best: float = 0.0
    best_at: int = 0
    other: str = ""
    other_since: int = 0
    other_seen: int = 0
    muted: str = ""
    muted_missing: int = 0
    number: int = 0


def _begin(state: WatcherState, row: dict) -> dict:
    state.number += 1
    state.mode, state.picture, state.since, state.seen, state.missing = "candidate", str(row["picture"]), int(row["timestamp_ms"]), 1, 0
    state.best, state.best_at = float(row["presence"]), int(row["timestamp_ms"])
    return {"kind": "candidate_started", "number": state.number, "reason": ""}


def _forget(state: WatcherState) -> None:
    number = state.number
    state.__init__()
    state.number = number


def advance_watcher(state: WatcherState, row: dict, cfg: WatcherConfig = WatcherConfig()) -> list[dict]:
    """Take one sample (timestamp_ms, picture or None, presence, score, fixed) into the state.

    picture names what is seen; equal names are the same message. fixed says that it is
    part of the screen. Returns the transitions: candidate_started, candidate_suppressed,
    opened, updated, closed.
    """
    ts, out = int(row["timestamp_ms"]), []
    there = row.get("picture") not in (None, "") and float(row["presence"]) >= cfg.min_presence

    def say(kind: str, reason: str = "") -> None:
        out.append({"kind": kind, "number": state.number, "reason": reason})

    def suppress(reason: str) -> None:
        say("candidate_suppressed", reason)
        muted = state.picture
        _forget(state)
        state.muted = muted

    if state.mode == "active" and ts - state.since >= cfg.stale_ms:
        say("closed", "stale")
        _forget(state)
    if state.mode == "active":
        if not there:
            state.missing, state.other_seen = state.missing + 1, 0
            if state.missing >= cfg.absences:
                say("closed", "absence")
                _forget(state)
            return out
        state.missing = 0
        if row["picture"] == state.picture:
            state.other_seen = 0
            if float(row["presence"]) - state.best >= cfg.better:
                state.best, state.best_at = float(row["presence"]), ts
                say("updated")
            return out
        if state.other_seen and state.other == row["picture"]:
            state.other_seen += 1
        else:
            state.other, state.other_since, state.other_seen = str(row["picture"]), ts, 1
        if row.get("fixed") or ts - state.other_since >= cfg.max_ms:
            state.other_seen = 0
        elif state.other_seen >= cfg.switch_samples and ts - state.since >= cfg.min_active_ms and float(row["score"]) >= cfg.min_score:
            say("closed", "fingerprint_changed")
            began, seen = state.other_since, state.other_seen
            _forget(state)
            _begin(state, row)
            state.mode, state.since, state.seen = "active", began, seen
            say("opened")
        return out
    if state.muted:
        if not there:
            state.muted_missing += 1
            if state.muted_missing >= cfg.absences:
                state.muted, state.muted_missing = "", 0
            return out
        if row["picture"] == state.muted:
            state.muted_missing = 0
            return out
        state.muted, state.muted_missing = "", 0
    if state.mode == "empty":
        if there:
            out.append(_begin(state, row))
        return out
    if not there:
        state.missing += 1
        if state.missing >= cfg.candidate_absences:
            suppress("transient")
        return out
    if row["picture"] != state.picture:
        say("candidate_suppressed", "visual_low_quality")
        _forget(state)
        out.append(_begin(state, row))
        return out
    state.seen, state.missing = state.seen + 1, 0
    if float(row["presence"]) > state.best:
        state.best, state.best_at = float(row["presence"]), ts
    good, age = float(row["score"]) >= cfg.min_score, ts - state.since
    if row.get("fixed"):
        suppress("persistent_ui")
    elif age >= cfg.min_ms and state.seen >= cfg.needed and good:
        state.mode = "active"
        say("opened")
    elif age >= cfg.max_ms:
        suppress("timeout" if good else "visual_low_quality")
    return out


GATE_OUT = "battle_id long, timestamp_ms long, transition string, phase string"
WATCHER_OUT = "battle_id long, timestamp_ms long, kind string, number long, reason string"


def gate_rows(key: int, rows: pd.DataFrame, state: GateState, cfg: GateConfig) -> pd.DataFrame:
    out = []
    for row in rows.to_dict("records"):
        out += [(key, int(row["timestamp_ms"]), t, state.phase) for t in advance_gate(state, row, cfg)]
    return pd.DataFrame(out, columns=["battle_id", "timestamp_ms", "transition", "phase"])


def watcher_rows(key: int, rows: pd.DataFrame, state: WatcherState, cfg: WatcherConfig) -> pd.DataFrame:
    out = []
    for row in rows.to_dict("records"):
        out += [(key, int(row["timestamp_ms"]), t["kind"], t["number"], t["reason"]) for t in advance_watcher(state, row, cfg)]
    return pd.DataFrame(out, columns=["battle_id", "timestamp_ms", "kind", "number", "reason"])


def run_sessions(samples: DataFrame, new_state: Callable[[], object], step: Callable, cfg: object, schema: str) -> DataFrame:
    """Fold the time-ordered samples(battle_id, timestamp_ms, seq, ...) of each battle through a machine.

    Rows are dealt by battle and sorted inside Spark; tasks read them as a stream of batches and
    keep one state at a time, so no battle is held whole.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, new_state()
        for batch in batches:
            for own, rows in batch.groupby("battle_id", sort=False):
                if own != key:
                    key, state = own, new_state()
                yield step(int(own), rows, state, cfg)

    dealt = samples.where("battle_id IS NOT NULL").repartition("battle_id").sortWithinPartitions("battle_id", "timestamp_ms", "seq")
    return dealt.mapInPandas(fold, schema)


def phase_gate(samples: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Phase transitions of samples(battle_id, timestamp_ms, seq, hud, vs, busy[, activity, ended])."""
    return run_sessions(samples, GateState, gate_rows, cfg, GATE_OUT)


def message_watcher(samples: DataFrame, cfg: WatcherConfig = WatcherConfig()) -> DataFrame:
    """Visibility transitions of samples(battle_id, timestamp_ms, seq, picture, presence, score, fixed)."""
    return run_sessions(samples, WatcherState, watcher_rows, cfg, WATCHER_OUT)

