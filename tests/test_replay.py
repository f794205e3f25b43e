"""Replay with a growing roster: against a sequential model, as a stream, cut and restored; two clocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import replay as R
from logloom.streaming import replay as S

CFG = R.ReplayConfig(duplicate_ms=300, candidate_ms=2500, accepted_ms=600, names=3, moves=2)
KEYS = [("name", n, n, n) for n in ("red widget", "hot widget", "big widget", "red gear", "blue bolt", "cold ring")] + [("move", m, m, m) for m in ("tackle", "growl", "splash")]
SLOTS = "id string, pos int, kind string, text string"


def worn(rng, word):
    how = rng.randrange(6)
    if how == 0:
        return "xx" + word[2:]
    if how == 1:
        return "xxxx" + word[4:]
    if how == 3:
        return "xxx" + word[3:]
    return word[:-1] if how == 2 else word


def made(spark, seed, battles=4, n=60, start=1000):
    rng = random.Random(seed)
    log, slots = [], []
    for b in range(battles):
        at = start
        for k in range(n):
            at += rng.choice([0, 20, 90, 250, 700])
            own = f"m{b}-{k:03d}"
            kind = rng.choice(["faint", "faint", "move", "move", None])
            name, move = worn(rng, rng.choice([k[1] for k in KEYS[:6]])), worn(rng, rng.choice([k[1] for k in KEYS[6:]]))
            log.append((b, at, own, kind, rng.choice(["a", "b", "c"])))
            if kind:
                slots.append((own, 0, "name", name))
            if kind == "move":
                slots.append((own, 1, "move", move))
    log = spark.createDataFrame(log, "battle_id long, timestamp_ms long, id string, event_type string, text string")
    return R.replay_messages(log, spark.createDataFrame(slots, SLOTS), spark.createDataFrame(KEYS, "kind string, entry_id string, label string, key string"), CFG)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def score(a, b):
    return 1.0 if a == b else 1 - edits(a, b) / max(len(a), len(b)) - 0.08 * max(0, abs(len(a) - len(b)) - 1)


def pick(text, labels, accept, review, margin):
    floor = min(review, accept - margin)
    near = sorted(((-score(text, x), x) for x in labels if abs(len(x) - len(text)) <= 4 and score(text, x) >= floor))
    if not near:
        return "none", None
    first, rest = -near[0][0], (-near[1][0] if len(near) > 1 else floor)
    if first == 1 or first >= accept and first - rest >= margin - 1e-9:
        return "accepted", near[0][1]
    return ("review" if first >= review else "none"), near[0][1]


def model(messages):
    """One battle, message by message, with plain lists of all that happened."""
    names, moves, past, cands, events, last, out = [], [], [], [], [], None, []
    for m in messages:
        now, labels, how = m["ts"], [], []
        for kind, text in m["slots"]:
            own = names if kind == "name" else moves
            status, label = pick(text, own, *CFG.lenient)
            source = "session"
            if status != "accepted":
                status, label = pick(text, [k[1] for k in KEYS if k[0] == kind], *CFG.strict)
                source = "global"
            labels.append(label)
            how.append((status, source))
        reading, actor = (m["kind"], *labels), (m["kind"], labels[0] if labels else None)
        status = "unknown"
        if m["kind"] and all(s == "accepted" for s, _ in how):
            status = "event"
        elif m["kind"] and all(s != "none" for s, _ in how):
            if any(r == reading and now - t <= CFG.candidate_ms for r, t in cands):
                status = "promoted"
            cands.append((reading, now))
        if status == "unknown" and m["kind"] and any(a == actor and now - t <= CFG.accepted_ms for a, t in events):
            status = "noise"
        key = reading if status in ("event", "promoted") else m["text"]
        gone = status != "noise" and any(k == key and now - t <= CFG.duplicate_ms for k, t in past)
        if status != "noise":
            past.append((key, now))
        out.append((m["id"], status, gone, last, tuple(labels) if status in ("event", "promoted") else ()))
        if status in ("event", "promoted"):
            if not gone:
                events.append((actor, now))
                last = m["id"]
            for (kind, _), label in zip(m["slots"], labels, strict=True):
                if kind == "name":
                    names = [label, *[x for x in names if x != label]][: CFG.names]
                else:
                    moves = [label, *[x for x in moves if x != label]][: CFG.moves]
    return out


def test_replay_is_the_sequential_model(spark):
    rng = random.Random(8)
    log, slots, battles = [], [], {}
    for b in range(5):
        at = 1000
        for k in range(80):
            at += rng.choice([0, 20, 90, 250, 700])
            own, kind = f"m{b}-{k:03d}", rng.choice(["faint", "move", "move", None])
            parts = [("name", worn(rng, rng.choice([k[1] for k in KEYS[:6]])))] if kind else []
            parts += [("move", worn(rng, rng.choice([k[1] for k in KEYS[6:]])))] if kind == "move" else []
            text = rng.choice("abc")
            log.append((b, at, own, kind, text))
            slots += [(own, p, k, t) for p, (k, t) in enumerate(parts)]
            battles.setdefault(b, []).append({"ts": at, "id": own, "kind": kind, "slots": parts, "text": text})
    rows = R.replay_messages(
        spark.createDataFrame(log, "battle_id long, timestamp_ms long, id string, event_type string, text string"), spark.createDataFrame(slots, SLOTS),
        spark.createDataFrame(KEYS, "kind string, entry_id string, label string, key string"), CFG,
    )
    got = {r["id"]: r for r in R.replay(rows, CFG).collect()}
    assert len(got) == 400
    seen = set()
    for own in battles.values():
        for message, status, gone, last, labels in model(own):
            r = got[message]
            assert (r["status"], r["suppressed"], r["after_event"], tuple(x for x in (r["name"], r["move"]) if x)) == (status, gone, last, labels), message
            seen.add((status, r["matched_in"]))
    assert {s for s, _ in seen} == {"event", "promoted", "unknown", "noise"} and any(m and "session" in m for _, m in seen)


def run(spark, tmp_path, name, folders, schema, start):  # folders: a glob
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{{{folders}}}/part=*")
    start(read).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(170)
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_streams_whole_and_cut_give_the_rows_of_the_batch(spark, tmp_path, rocks):
    rows = made(spark, 5).cache()
    whole = sorted(map(tuple, R.replay(rows, CFG).collect()), key=repr)
    middle = 1000 + 25 * 200
    # A row of another battle, late in time, moves the watermark over all that waits.
    marker = spark.createDataFrame([(99, 10_000_000, "end", None, "x", "[]")], rows.schema)
    rng = random.Random(1)
    pieces = {"early": rows.where(F.col("timestamp_ms") <= middle), "late": rows.where(F.col("timestamp_ms") > middle)}
    for part, piece in pieces.items():
        # Files are read in order of time of writing; rows come out of order by less than the delay of the watermark.
        for k, chunk in enumerate(_chunks(piece, rng)):
            spark.createDataFrame(chunk, rows.schema).coalesce(1).write.parquet(f"{tmp_path}/{part}/part={k}")
        marker.coalesce(1).write.parquet(f"{tmp_path}/{part}-end/part=9")
    event_time = lambda df: S.clocked(df, "timestamp_ms", "2 seconds")
    told = lambda df: sorted((tuple(r) for r in df.where("battle_id <> 99").collect()), key=repr)
    assert told(run(spark, tmp_path, "r_whole", "early,late,late-end", rows.schema, lambda d: S.replay_stream(event_time(d), CFG))) == whole
    first = told(run(spark, tmp_path, "r_first", "early,early-end", rows.schema, lambda d: S.replay_stream(event_time(d), CFG)))
    states = R.replay_states(pieces["early"], CFG)
    later = told(run(spark, tmp_path, "r_later", "late,late-end", rows.schema, lambda d: S.replay_stream(event_time(d), CFG, states)))
    assert sorted(first + later, key=repr) == whole
    assert sorted(first + [tuple(r) for r in R.replay(pieces["late"], CFG, states).collect()], key=repr) == whole


def _chunks(piece, rng):
    found = sorted(piece.collect(), key=lambda r: r["timestamp_ms"] + rng.randrange(900))
    size = len(found) // 3 + 1
    return [found[k : k + size] for k in range(0, len(found), size)]


def test_states_of_a_stored_log(spark):
    events = spark.createDataFrame(
        [(1, f"e{k:02d}", 100 * k, "move" if k % 2 else "faint", f"n{k % 5}", f"v{k % 3}" if k % 2 else None) for k in range(20)] + [(2, "z", 5, "faint", None, None), (None, "q", 1, "faint", "n", None)],
        "battle_id long, id string, timestamp_ms long, event_type string, name string, move string",
    )
    got = {r["battle_id"]: json.loads(r["state"]) for r in R.states_of_events(events, CFG).collect()}
    assert got[1]["names"] == ["n4", "n3", "n2"] and got[1]["moves"] == ["v1", "v2"] and got[1]["last_event"] == "e19"
    assert got[1]["accepted"]["move:n4"] == 1900 and len(got[1]["accepted"]) == 10 and got[1]["seen"] == {}
    assert got[2]["names"] == [] and set(got) == {1, 2}
    assert R.ReplayState(**got[1]).expires(CFG) == min(got[1]["accepted"].values()) + CFG.accepted_ms + 1


def test_look_back_is_bounded():
    state = R.ReplayState()
    for k in range(1000):
        R.advance(state, {"timestamp_ms": 50 * k, "id": str(k), "event_type": "faint", "text": "", "slots": [{"kind": "name", "found": [{"label": f"n{k}", "score": 1.0}]}]}, CFG)
        assert len(state.seen) <= 7 and len(state.accepted) <= 13 and len(state.names) <= CFG.names


def test_no_messages_and_messages_without_battle_or_slots(spark):
    log = spark.createDataFrame([(None, 1, "a", "faint", "t"), (1, None, "b", "faint", "t"), (1, 5, "c", "faint", None), (1, 5, None, None, None)], "battle_id long, timestamp_ms long, id string, event_type string, text string")
    rows = R.replay_messages(log, spark.createDataFrame([], SLOTS), spark.createDataFrame(KEYS, "kind string, entry_id string, label string, key string"), CFG)
    assert sorted((r["id"], r["status"]) for r in R.replay(rows, CFG).collect()) == [("", "unknown"), ("c", "event")]
    assert R.replay(rows.where("false"), CFG).collect() == []


def test_two_clocks(spark, tmp_path, rocks):
    rng = random.Random(4)
    samples = spark.createDataFrame([(rng.randrange(3), k, 1000 + rng.randrange(5000)) for k in range(150)], "battle_id long, sample_id long, sample_ms long")
    readings = spark.createDataFrame([(rng.randrange(4), k, 1000 + rng.randrange(5000)) for k in range(60)], "battle_id long, reading_id long, reading_ms long")
    columns = ["battle_id", "reading_id", "reading_ms", "sample_id", "sample_ms"]
    batch = S.on_two_clocks(S.clocked(samples, "sample_ms", "0 seconds"), S.clocked(readings, "reading_ms", "0 seconds"), 40).select(*columns)
    got = sorted(map(tuple, batch.collect()), key=repr)
    left, right = samples.collect(), readings.collect()
    expected = []
    for r in right:
        near = [s for s in left if s["battle_id"] == r["battle_id"] and abs(s["sample_ms"] - r["reading_ms"]) <= 40]
        expected += [(*r, s["sample_id"], s["sample_ms"]) for s in near] or [(*r, None, None)]
    assert got == sorted(expected, key=repr) and any(r[3] is None for r in got)
    for part, df, ts in (("s", samples, "sample_ms"), ("r", readings, "reading_ms")):
        df.where(f"{ts} < 3500").coalesce(1).write.parquet(f"{tmp_path}/{part}/part=0")
        df.where(f"{ts} >= 3500").coalesce(1).write.parquet(f"{tmp_path}/{part}/part=1")
        spark.createDataFrame([(77, -1, 900_000)], df.schema).coalesce(1).write.parquet(f"{tmp_path}/{part}/part=2")
        # Too late: behind the watermark that the row before has moved.
        spark.createDataFrame([(0, 1000, 1500)], df.schema).coalesce(1).write.parquet(f"{tmp_path}/{part}/part=3")
        spark.createDataFrame([(77, -2, 900_001)], df.schema).coalesce(1).write.parquet(f"{tmp_path}/{part}/part=4")
    read = lambda part, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{part}/part=*")
    joined = S.on_two_clocks(S.clocked(read("s", samples), "sample_ms", "1 second"), S.clocked(read("r", readings), "reading_ms", "1 second"), 40).select(*columns)
    joined.writeStream.format("memory").queryName("clocks").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(170)
    assert sorted((tuple(r) for r in spark.table("clocks").where("battle_id <> 77").collect()), key=repr) == got
