"""Rule sources, packs, reports, readings and the store's compaction."""

import json

from pyspark.sql import functions as F

from logloom.operators import readings, sessions
from logloom.sources import logs, reports, rulesets


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_texts_that_are_never_live(spark):
    df = spark.createDataFrame([(0, "BTL_HELP", "倒れた"), (1, "x", "確率が上がった"), (2, "x", "倒れた"), (3, None, "秘密"), (4, "own_1", "倒れた")], "k int, label string, text string")
    got = one(df.orderBy("k"), rulesets.non_live(F.col("label"), F.col("text"), ["^own_"], ["秘密"]))
    assert got == [(True,), (True,), (False,), (True,), (True,)]


def test_texts_about_battles(spark):
    rows = [(0, "btl_set.json", None, "x"), (1, "a.json", "BTL_MSG_1", "x"), (2, "a.json", None, "相手の番"), (3, "a.json", None, "x"), (4, "btl_a.json", "X_INFO_1", "x"), (5, "btl_a.json", None, "選択")]
    df = spark.createDataFrame(rows, "k int, file string, label string, text string")
    assert one(df.orderBy("k"), rulesets.battle_related(F.col("file"), F.col("label"), F.col("text"))) == [(True,), (True,), (True,), (False,), (False,), (False,)]


def test_types_of_rule_texts(spark):
    texts = [("効果はバツグンだ", "supereffective"), ("雨が上がった", "weather_end"), ("{0}の攻撃が上がった", "boost"), ("雨が降り始めた", "weather_start"), ("フィールドが消えた", "terrain_end"), ("ひるんで技がだせない", "flinch"), ("なにか", "activate"), ("独自", "own")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k int, text string").withColumn("file", F.when(F.col("k") == 6, "btl_attack_x.json").otherwise("a.json"))
    got = [r[0] for r in one(df.orderBy("k"), rulesets.keyword_type(F.col("text"), F.col("file"), F.lit(None).cast("string"), [("独自", "own")]))]
    assert got == [t if t != "activate" else "move" for _, t in texts]


def test_packs_unite_and_come_back(spark, tmp_path):
    schema = "id string, event_type string, patterns array<string>"
    own, other = spark.createDataFrame([("a", "move", ["x"])], schema), spark.createDataFrame([("a", "faint", ["y"]), ("b", "heal", None)], schema)
    pack = rulesets.united_packs(own, other)
    assert sorted(one(pack, "id", "event_type")) == [("a", "move"), ("b", "heal")]
    rulesets.write_pack(pack, f"{tmp_path}/pack", "2024-01-01T00:00:00.000Z")
    back, wrong = rulesets.read_pack(spark, f"{tmp_path}/pack", schema)
    assert wrong is None and sorted(back.collect()) == sorted(pack.select("id", "event_type", "patterns").collect())
    spark.createDataFrame([('{"schemaVersion":"9"}',)], "value string").write.mode("overwrite").text(f"{tmp_path}/pack/head")
    assert rulesets.read_pack(spark, f"{tmp_path}/pack", schema) == (None, "unsupported version 9")


def test_review_index(spark):
    texts = spark.createDataFrame(
        [("a", "OK_1", "p", "{0}は 倒れた！"), ("a", "NO_1", "p", "倒れた！"), ("a", "OK_2", "p", "{0}の {1}！"), ("b", "x", "p", "選択"), ("c", "RankupLv1_2_x", "p", "{0}の {1}が 上がった！")],
        "file string, label string, path string, text string",
    )
    sources = spark.createDataFrame([("a", "enabled", ["^OK"], [], [], "actor"), ("b", "hold", [], [], [], None)], "file string, status string, allow array<string>, deny array<string>, hints array<string>, policy string")
    got = {(r["file"], r["label"]): (r["status"], r["risks"], r["skeleton"]) for r in rulesets.review_index(texts, sources).collect()}
    assert got[("a", "OK_1")] == ("enabled", [], "は倒れた") and got[("a", "OK_2")][:2] == ("enabled", [])
    assert got[("a", "NO_1")][:2] == ("review_index", ["review_index_only", "blocked_by_current_config"])
    assert got[("b", "x")][:2] == ("hold", ["blocked_by_deny_pattern"])
    assert got[("c", "RankupLv1_2_x")][:2] == ("review_index", ["review_index_only", "placeholder_policy_required", "risky_placeholder"])


def test_reports_and_proposals(spark, tmp_path):
    summary = spark.createDataFrame([(5, 2)], "events int, unknowns int")
    proposals = spark.createDataFrame([(k, f"p{k}") for k in range(20, 0, -1)], "rank int, text string")
    document = reports.report_document(summary, proposals, "2024-01-01T00:00:00.000Z")
    reports.write_report(document, f"{tmp_path}/report")
    reports.write_proposals(document, f"{tmp_path}/proposals")
    report, alone = (json.loads(spark.read.text(f"{tmp_path}/{n}").first()["value"]) for n in ("report", "proposals"))
    assert report["summary"] == {"events": 5, "unknowns": 2} and [p["text"] for p in report["proposals"]] == [f"p{k}" for k in range(1, 13)]
    assert alone == {k: report[k] for k in ("schemaVersion", "generatedAt", "proposals")}


def test_fragments_and_noise(spark):
    texts = [("雨", True), (None, True), ("相手のアオマルの", True), ("砂あらしがひどい", True), ("砂あらしが吹き始めた", False), ("アオマルのひのたま", False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r[0] for r in one(df, reports.likely_fragment(F.col("t")))] == [e for _, e in texts]
    noise = spark.createDataFrame([(0, False, "12:30", "1230"), (1, None, "x", "特性ひらめき"), (2, True, "x", "x"), (3, None, None, None)], "k int, s boolean, n string, m string").orderBy("k")
    assert [r[0] for r in one(noise, reports.likely_ui_noise(F.col("s"), F.col("n"), F.col("m")))] == [True, True, True, False]


def test_segments_become_one_reading(spark):
    rows = [("j", "r", 2, " b ", 0.4, ["b"]), ("j", "r", 1, "a", 0.8, None), ("j", "r", 3, " ", None, []), ("j", "r", 4, "late", 1.0, ["late"]), ("k", "r", 1, None, None, None)]
    segments = spark.createDataFrame(rows, "job_id string, reading_id string, nth int, text string, confidence double, lines array<string>")
    got = {r["job_id"]: (r["text"], r["confidence"] and round(r["confidence"], 9), r["lines"]) for r in readings.combined_reading(readings.reading_candidates(segments)).collect()}
    assert got == {"j": ("a\nb", 0.6, ["b"]), "k": ("", None, [])}
    picked = spark.createDataFrame([("j", "event"), ("k", "held")], "job_id string, outcome string")
    assert one(readings.read_again(picked), "job_id") == [("k",)]


def test_records_and_times(spark):
    events = spark.createDataFrame([("b", "move", "x", None, "r", 5, None), ("b", None, None, None, None, 6, 1)], "battle_id string, event_type string, actor string, side string, reading string, timestamp_ms long, frame int")
    assert one(readings.accepted_records(events), "event_type", "at") == [("move", "time:5")]
    unread = spark.createDataFrame([("b", ["constrained-review:margin;constrained-candidate;rule=a;name=x", "other"], 5, 1)], "battle_id string, evidence array<string>, timestamp_ms long, frame int")
    assert one(readings.candidate_records(unread), "identity", "frame") == [("rule=a;name=x", 1)]
    times = spark.createDataFrame([(1704067200123,)], "ms long")
    assert one(times, readings.iso_time(F.col("ms")), readings.file_stamp(F.col("ms"))) == [("2024-01-01T00:00:00.123Z", "2024-01-01T00-00-00-123Z")]


def test_the_store_compacts(spark, tmp_path):
    store = logs.DocumentStore(spark, f"{tmp_path}/store", 4)
    for k in range(3):
        store.put(spark.createDataFrame([("a", f"t{k}", str(k)), (f"b{k}", "t", "x")], store.SCHEMA))
    before = sorted(store.all().collect())
    store.compact()
    assert store.versions().count() == 4 and sorted(store.all().collect()) == before and store.get("a").first()["body"] == "2"


def test_an_end_is_final_and_activity_renews_the_lease():
    def run(rows):
        state = sessions.GateState()
        return [t for r in rows for t in sessions.advance_gate(state, r)], state.phase

    open_phase = [{"timestamp_ms": 100 * k, "hud": k < 3, "vs": None, "busy": False} for k in range(6)]
    assert run(open_phase)[1] == "message_candidate"
    quiet = [{"timestamp_ms": 6600, "hud": False, "vs": None, "busy": False}]
    assert run(open_phase + quiet)[1] == "unknown"
    busy = [{"timestamp_ms": 3000, "hud": False, "vs": None, "busy": False, "activity": True}]
    assert run(open_phase + busy + quiet)[1] == "message_candidate"
    ended = [{"timestamp_ms": 4000, "hud": False, "vs": None, "busy": False, "ended": True}]
    assert run(open_phase + ended + open_phase) == (run(open_phase)[0] + ["battle_ended"], "ended")
