"""Sequential replay: each message is read with what its battle has shown before it.

Spark does the matching first, once for each distinct text: a slot of a message comes
with every dictionary entry that could be meant and its score. What is left for the fold over a
battle is to choose between few entries by the roster so far, to look back over
bounded windows, and to move names to the front of the roster. The same step runs in batch
and in streaming.replay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.entities import scored_entries


@dataclass(frozen=True)
class ReplayConfig:
    """Look-back windows, lengths of the roster and of the list of moves, and (accept, review, margin) of matches with these
    lists (lenient, as they are short) and with the whole dictionary."""

    duplicate_ms: int = 2500
    candidate_ms: int = 2500
    accepted_ms: int = 6000
    names: int = 18
    moves: int = 96
    lenient: tuple[float, float, float] = (0.62, 0.54, 0.02)
    strict: tuple[float, float, float] = (0.78, 0.7, 0.06)

    @property
    def floor(self) -> float:
        return min(floor_of(self.lenient), floor_of(self.strict))


def floor_of(thresholds: tuple[float, float, float]) -> float:
    accept, review, margin = thresholds
    return min(review, accept - margin)


@dataclass
class ReplayState:
    #: Names and moves shown so far, newest first.
    names: list[str] = field(default_factory=list)
    moves: list[str] = field(default_factory=list)
    last_event: str | None = None
    #: When what was last seen: messages by their identity, candidates, accepted types and actors.
    seen: dict[str, int] = field(default_factory=dict)
    candidates: dict[str, int] = field(default_factory=dict)
    accepted: dict[str, int] = field(default_factory=dict)

    def prune(self, now: int, cfg: ReplayConfig) -> None:
        for held, window in ((self.seen, cfg.duplicate_ms), (self.candidates, cfg.candidate_ms), (self.accepted, cfg.accepted_ms)):
            for key in [k for k, at in held.items() if now - at > window]:
                del held[key]

    def expires(self, cfg: ReplayConfig) -> int | None:
        """When the next look-back record is out of its window."""
        ends = [at + window for held, window in ((self.seen, cfg.duplicate_ms), (self.candidates, cfg.candidate_ms), (self.accepted, cfg.accepted_ms)) for at in held.values()]
        return min(ends) + 1 if ends else None


def best_of(found: list[dict], thresholds: tuple[float, float, float]) -> tuple[str, str | None]:
    """Status and label of the best entry, as entities.match_entries tells them; found is sorted by score and label."""
    accept, review, margin = thresholds
    floor = floor_of(thresholds)
    near = [e for e in found if e["score"] >= floor]
    if not near:
        return "not_found", None
    score = near[0]["score"]
    lead = score - (near[1]["score"] if len(near) > 1 else floor)
    if score >= 1.0 or score >= accept and lead >= margin - 1e-9:
        return "accepted", near[0]["label"]
    return ("review" if score >= review else "not_found"), near[0]["label"]


def advance(state: ReplayState, message: dict, cfg: ReplayConfig = ReplayConfig()) -> dict:
    """Read one message (timestamp_ms, id, event_type or None, text, slots) and take it into the state.

    slots: kind (name or move) and found (label, score) of each. An entry of the battle's own list counts if that list
    accepts it, else that of the whole dictionary. Status: event, if every slot is accepted; promoted, if one is
    only to be reviewed and the same reading was met within candidate_ms; noise, if its type and actor were accepted within
    accepted_ms; unknown. A message like one within duplicate_ms is suppressed, and renews that; what it
    names counts for the lists all the same.
    """
    now = int(message["timestamp_ms"])
    state.prune(now, cfg)
    after, kind = state.last_event, message["event_type"]
    labels, statuses, sources = [], [], []
    for slot in message["slots"] if kind else []:
        own = state.names if slot["kind"] == "name" else state.moves
        found = sorted(slot.get("found") or [], key=lambda e: (-e["score"], e["label"]))
        status, label = best_of([e for e in found if e["label"] in own], cfg.lenient)
        source = "session"
        if status != "accepted":
            status, label = best_of(found, cfg.strict)
            source = "global"
        labels.append(label)
        statuses.append(status)
        sources.append(source)
    reading = ":".join([kind or "", *(x or "" for x in labels)])
    actor = ":".join([kind or "", labels[0] or "" if labels else ""])
    if kind and all(s == "accepted" for s in statuses):
        status = "event"
    elif kind and all(s != "not_found" for s in statuses):
        status = "promoted" if reading in state.candidates else "unknown"
        state.candidates[reading] = now
    else:
        status = "unknown"
    known = status in ("event", "promoted")
    if not known and kind and actor in state.accepted:
        status = "noise"
    identity = f"event:{reading}" if known else f"unknown:{message['text']}"
    suppressed = status != "noise" and identity in state.seen
    if status != "noise":
        state.seen[identity] = now
    named = {k: label for k, label in zip((s["kind"] for s in message["slots"]), labels, strict=False) if known}
    if known:
        if not suppressed:
            state.accepted[actor] = now
            state.last_event = message["id"]
        for slot, label in zip(message["slots"], labels, strict=True):
            own, most = (state.names, cfg.names) if slot["kind"] == "name" else (state.moves, cfg.moves)
            own[:] = [label, *(x for x in own if x != label)][:most]
    return {
        "id": message["id"], "timestamp_ms": now, "status": status, "event_type": kind if known else None, "name": named.get("name"), "move": named.get("move"),
        "matched_in": ",".join(sources) if known else None, "suppressed": suppressed, "after_event": after,
    }


OUT = "battle_id long, id string, timestamp_ms long, status string, event_type string, name string, move string, matched_in string, suppressed boolean, after_event string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def replay_messages(log: DataFrame, slots: DataFrame, keys: DataFrame, cfg: ReplayConfig = ReplayConfig()) -> DataFrame:
    """Messages as advance takes them, slots in JSON, from log(battle_id, timestamp_ms, id, event_type, text) and
    slots(id, pos, kind, text); keys(kind, entry_id, label, key) is the dictionary.

    Distinct slot texts are matched once, however many messages hold them.
    """
    texts = slots.select("kind", "text").where(F.col("text").isNotNull()).distinct()
    entries = scored_entries(texts, keys, cfg.floor, 4, "kind").groupBy("kind", "text").agg(F.sort_array(F.collect_list(F.struct("label", "score"))).alias("found"))
    filled = slots.join(entries, ["kind", "text"], "left")
    one = filled.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind", "found"))), lambda s: F.struct(s["kind"].alias("kind"), s["found"].alias("found"))).alias("slots"))
    rows = log.where("battle_id IS NOT NULL AND timestamp_ms IS NOT NULL").join(one, "id", "left")
    return rows.select(F.col("battle_id").cast("long").alias("battle_id"), F.col("timestamp_ms").cast("long").alias("timestamp_ms"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "event_type", "text", F.to_json(F.coalesce("slots", F.array().cast("array<struct<kind:string,found:array<struct<label:string,score:double>>>>"))).alias("slots"))


def message_of(row: dict) -> dict:
    kind = row["event_type"]
    return row | {"event_type": kind if isinstance(kind, str) else None, "slots": json.loads(row["slots"])}


def _folded(messages: DataFrame, cfg: ReplayConfig, states: DataFrame | None, ends: bool) -> DataFrame:
    """Fold each battle's messages in order; a state to begin with stands before them."""
    rows = messages.select("battle_id", "timestamp_ms", "id", "event_type", "text", "slots", F.lit(None).cast("string").alias("state"))
    if states is not None:
        given = states.select("battle_id", F.lit(-(1 << 63)).alias("timestamp_ms"), F.lit("").alias("id"), *(F.lit(None).cast("string").alias(c) for c in ("event_type", "text", "slots")), "state")
        rows = rows.unionByName(given)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, ReplayState()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.battle_id != key:
                    if ends and key is not None:
                        out.append((key, json.dumps(asdict(state))))
                    key, state = row.battle_id, ReplayState()
                if isinstance(row.state, str):
                    state = ReplayState(**json.loads(row.state))
                    continue
                read = advance(state, message_of(row._asdict()), cfg)
                if not ends:
                    out.append((key, *(read[c] for c in COLUMNS[1:])))
            yield pd.DataFrame(out, columns=["battle_id", "state"] if ends else COLUMNS)
        if ends and key is not None:
            yield pd.DataFrame([(key, json.dumps(asdict(state)))], columns=["battle_id", "state"])

    dealt = rows.repartition("battle_id").sortWithinPartitions("battle_id", "timestamp_ms", "id")
    return dealt.mapInPandas(fold, "battle_id long, state string" if ends else OUT)


def replay(messages: DataFrame, cfg: ReplayConfig = ReplayConfig(), states: DataFrame | None = None) -> DataFrame:
    """What becomes of each message (OUT), in order of time and id; states(battle_id, state) lets battles go on.

    Battles are dealt to tasks and their messages sorted by Spark; a task reads them as a stream and holds one state.
    """
    return _folded(messages, cfg, states, False)


def replay_states(messages: DataFrame, cfg: ReplayConfig = ReplayConfig(), states: DataFrame | None = None) -> DataFrame:
    """(battle_id, state) after all messages: what a replay of later ones begins with."""
    return _folded(messages, cfg, states, True)


#: Newest accepted events that an import keeps for the look-back.
RESTORED_EVENTS = 16


def states_of_events(events: DataFrame, cfg: ReplayConfig = ReplayConfig()) -> DataFrame:
    """(battle_id, state) of a stored log events(battle_id, id, timestamp_ms, event_type, name, move): the lists and the look-back
    over its newest events; duplicates and candidates begin empty. Grouped sums only: the newest entries of each list."""
    rows = events.where("battle_id IS NOT NULL")
    at = F.struct("timestamp_ms", F.col("id").cast("string").alias("id"))

    def newest(of: str, most: int) -> DataFrame:
        last = rows.where(F.col(of).isNotNull()).groupBy("battle_id", F.col(of).alias("label")).agg(F.max(at).alias("at"))
        listed = F.transform(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("at", "label")))), 1, most), lambda x: x["label"])
        return last.groupBy("battle_id").agg(listed.alias(f"{of}s"))

    keyed = rows.select("battle_id", at.alias("at"), F.concat_ws(":", "event_type", F.coalesce("name", F.lit(""))).alias("key"))
    recent = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("at", "key")))), 1, RESTORED_EVENTS)
    # Of equal keys the newest counts, which comes first.
    held = keyed.groupBy("battle_id").agg(recent.alias("r"))
    latest = held.select("battle_id", F.explode("r").alias("e")).groupBy("battle_id", "e.key").agg(F.max("e.at.timestamp_ms").alias("ts"))
    accepted = latest.groupBy("battle_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "ts"))).alias("accepted"))
    last = held.select("battle_id", F.get("r", F.lit(0))["at"]["id"].alias("last_event"))
    empty = F.create_map().cast("map<string,bigint>")
    every = last.join(accepted, "battle_id", "left").join(newest("name", cfg.names), "battle_id", "left").join(newest("move", cfg.moves), "battle_id", "left")
    none = F.array().cast("array<string>")
    state = F.struct(F.coalesce("names", none).alias("names"), F.coalesce("moves", none).alias("moves"), "last_event", empty.alias("seen"), empty.alias("candidates"), F.coalesce("accepted", empty).alias("accepted"))
    return every.select(F.col("battle_id").cast("long").alias("battle_id"), F.to_json(state).alias("state"))
