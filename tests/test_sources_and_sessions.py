import json
import random

from pyspark.sql import functions as F

from logloom.operators import sessions
from logloom.plans import fixtures
from logloom.sources import logs, rulesets
from logloom.streaming import sessions as streams


def test_documents_are_checked_and_filled(spark, tmp_path):
    whole = {"schemaVersion": "0.1.0", "battle": {"id": "b1"}, "ocrMessages": [], "events": [], "unknowns": [], "messageObservations": [{"id": "o", "suppressed": True}, {"id": "p", "suppressionReason": "odd"}]}
    for name, body in {"a": json.dumps(whole), "b": json.dumps(whole | {"schemaVersion": "2"}), "c": '{"schemaVersion": "0.1.0"}', "d": "{broken"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = {r["file"]: r for r in logs.read_documents(spark, str(tmp_path)).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).collect()}
    good = got["a.json"]
    assert good["ok"] and len(good["warnings"]) == 2 and good["summary"]["suppressed"] == 1
    first, second = good["messageObservations"]
    assert (first["commitScore"], second["commitScore"], second["suppressionReason"], second["resolution"]) == (0.0, 1.0, None, "unread")
    assert "unsupported version 2" in got["b.json"]["error"] and "missing" in got["c.json"]["error"] and not got["d.json"]["ok"]


def test_csv_is_ordered_and_quoted(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b", '2,"x,y"'), (1, "a", "1,z")], "timestampMs long, id string, line string")
    logs.write_csv(lines, "t,v", str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n") == ["t,v", "1,z", '2,"x,y"', ""]


def test_store_keeps_the_newest(spark, tmp_path):
    store = logs.DocumentStore(spark, f"file://{tmp_path}/store", buckets=4)
    assert store.latest().count() == 0
    store.put(spark.createDataFrame([("a", "2024-01-01", "one"), ("b", "2024-01-02", "two")], "id string, updated_at string, body string"))
    store.put(spark.createDataFrame([("a", "2024-01-03", "three")], "id string, updated_at string, body string"))
    assert store.get("a").first()["body"] == "three" and store.latest().first()["id"] == "a"
    assert sorted((r["id"], r["body"]) for r in store.all().collect()) == [("a", "three"), ("b", "two")]


def test_name_lists(spark, tmp_path):
    (tmp_path / "names.txt").write_text("﻿ ビル♀\n\nアオ \nビル♀\n")
    names = logs.read_names(spark, str(tmp_path / "names.txt"), "name")
    assert [(r["id"], r["label"]) for r in names.orderBy("id").collect()] == [("name:0001", "ビル♀"), ("name:0002", "アオ")]
    assert [r["label"] for r in logs.expand_markers(names).orderBy("id", "part").collect()] == ["ビル", "ビル♀", "アオ"]


def test_rules_from_trees(spark):
    texts = rulesets.extracted_texts(fixture := fixtures.rule_files(spark))
    assert fixture.count() == 3 and texts.count() == 4
    rules = rulesets.created_rules(texts, ["name", "move"]).collect()
    assert sorted((r["event_type"], r["file"]) for r in rules) == [("activate", "a.json"), ("faint", "a.json"), ("weather_end", "b.json")]
    assert all("{name}" in r["pattern"] for r in rules if "{" in r["pattern"])


def sample(ts, picture, presence=0.9, score=0.8, fixed=False):
    return {"timestamp_ms": ts, "picture": picture, "presence": presence, "score": score, "fixed": fixed}


def feed(steps):
    state, out = sessions.WatcherState(), []
    for s in steps:
        out += [(t["kind"], t["reason"]) for t in sessions.advance_watcher(state, s)]
    return out


def test_watcher_opens_closes_and_suppresses():
    there = [sample(k * 100, "a") for k in range(5)]
    assert feed(there) == [("candidate_started", ""), ("opened", "")]
    assert feed(there + [sample(500 + k * 100, None) for k in range(3)])[-1] == ("closed", "absence")
    assert feed([sample(0, "a"), sample(100, None), sample(200, None)])[-1] == ("candidate_suppressed", "transient")
    assert feed([sample(0, "a"), sample(100, "a", fixed=True), sample(200, "a"), sample(300, "a")])[-1] == ("candidate_suppressed", "persistent_ui")
    assert feed([sample(k * 100, "a", score=0.1) for k in range(10)])[-1] == ("candidate_suppressed", "visual_low_quality")
    switched = feed(there + [sample(500 + k * 100, "b") for k in range(4)])
    assert switched[-2:] == [("closed", "fingerprint_changed"), ("opened", "")]
    assert feed([*there, sample(15_100, "a")])[2:] == [("closed", "stale"), ("candidate_started", "")]


def test_gate_edges_lease_and_order():
    state = sessions.GateState()
    out = []
    for k, hud in enumerate([True, True, False, False, False]):
        out += sessions.advance_gate(state, {"timestamp_ms": k * 100, "hud": hud, "vs": None, "busy": False})
    assert out == ["battle_hud_rose", "message_phase_closed", "battle_hud_fell", "message_phase_opened"]
    assert sessions.advance_gate(state, {"timestamp_ms": 6300, "hud": False, "vs": None, "busy": True}) == []
    assert sessions.advance_gate(state, {"timestamp_ms": 6400, "hud": False, "vs": None, "busy": False}) == ["message_phase_expired"]
    vs = sessions.GateState()
    got = [t for k, v in enumerate([True, True, False, False]) for t in sessions.advance_gate(vs, {"timestamp_ms": k, "hud": False, "vs": v, "busy": False})]
    assert got == ["vs_fell", "message_phase_opened"]


def test_stream_and_batch_agree(spark, tmp_path):
    rng = random.Random(1)
    # Times begin after the epoch: a first watermark stands there, and what isn't later is late.
    given = [(b, 1000 + k * 100, k, rng.choice(["a", "a", "a", "b", None]), 0.9, 0.8, False, rng.random() < 0.5, None, False) for b in range(3) for k in range(60)]
    schema = "battle_id long, timestamp_ms long, seq long, picture string, presence double, score double, fixed boolean, hud boolean, vs boolean, busy boolean"
    batch = spark.createDataFrame(given, schema)
    for part in range(3):
        batch.where(f"seq >= {part * 20} AND seq < {part * 20 + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, twin, one in (("gate", streams.phase_gate_stream, sessions.phase_gate), ("watcher", streams.message_watcher_stream, sessions.message_watcher)):
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
        out = twin(streams.with_event_time(read, "timestamp_ms", "1 hour"))
        run = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, one(batch).collect()))


def test_sliding_dedupe_stream(spark, tmp_path):
    from logloom.operators import timeline

    rng = random.Random(2)
    given = sorted((1 + rng.randrange(3000), k, rng.choice("ab")) for k in range(120))
    batch = spark.createDataFrame(given, "timestamp_ms long, id long, kind string")
    for part in range(2):
        batch.where(f"{'timestamp_ms < 1500' if part == 0 else 'timestamp_ms >= 1500'}").coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    read = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    out = streams.sliding_dedupe_stream(streams.with_event_time(read, "timestamp_ms", "1 hour"), ["kind"], 30)
    out.writeStream.format("memory").queryName("deduped").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    expected = timeline.sliding_dedupe_unique(batch, ["kind"], "timestamp_ms", "id", 30)
    assert sorted((r["id"], r["suppressed"]) for r in spark.table("deduped").collect()) == sorted((r["id"], r["suppressed"]) for r in expected.collect())
