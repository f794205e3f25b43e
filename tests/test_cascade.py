"""The parse cascade on worn and clean messages, its gating, and the words of events."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import cascade, context, shapes, templates
from logloom.plans import fixtures
from logloom.sources.shared import written

#: text, confidence, and what is read: stage, kind, actor, side, move, target, stat.
CASES = [
    ("ゆけっ アオマル！", 0.9, ("constrained", "switch_in", "アオマル", None, None, None, None)),
    ("アオマルの\nひのたま！", 0.9, ("template", "move", "アオマル", None, "ひのたま", None, None)),
    ("効果は バツグンだ！", 0.8, ("context", "supereffective", None, None, None, None, None)),
    ("ドロバンの攻撃が上がった！", 0.85, ("context", "boost", "ドロバン", None, None, None, "攻撃")),
    ("ドロバンの素早さががくっと下がった", 0.9, ("context", "unboost", "ドロバン", None, None, None, "素早さ")),
    ("なにかが上がった", 0.9, ("unknown", None, None, None, None, None, None)),
    ("相手のキリカゼに効果はバックンだ", 0.9, ("context", "supereffective", None, None, None, "キリカゼ", None)),
    ("キリカゼは倒れだ", 0.8, ("constrained", "faint", "キリカゼ", None, None, None, None)),
    ("キリカゼは倒れだ", 0.6, ("unknown", None, None, None, None, None, None)),
    ("相手のアオマルの ひのたま！", 0.9, ("move_split", "move", "アオマル", "opponent", "ひのたま", None, None)),
    ("アオマル の みずてっぽう", 0.9, ("move_split", "move", "アオマル", None, "みずでっぽう", None, None)),
    ("今ユキネのあのでんげきだ", 0.9, ("move_span", "move", "ユキネ", None, "でんげき", None, None)),
    ("ゅけっ！ ドロバン！", 0.8, ("degraded_entry", "switch_in", "ドロバン", None, None, None, None)),
    ("ゅけっ！ ドロバン！", 0.6, ("unknown", None, None, None, None, None, None)),
    ("ユキネは命が少し削られた", 0.9, ("life_cost", "damage", "ユキネ", "player", None, None, None)),
    ("ゆけっ", 0.9, ("entry_call", "switch_in", None, None, None, None, None)),
    ("効果はパックンだ", 0.9, ("constrained", "supereffective", None, None, None, None, None)),
    ("効果はちようバッグンだ", 0.5, ("unknown", None, None, None, None, None, None)),
    ("03:15", 0.9, ("unknown", None, None, None, None, None, None)),
    ("", 0.9, ("unknown", None, None, None, None, None, None)),
    (None, None, ("unknown", None, None, None, None, None, None)),
    ("アオマルの ひのたま！ ｘｙ", 0.9, ("template", "move", "アオマル", None, "ひのたま", None, None)),
    ("ドロバンの", 0.9, ("unknown", None, None, None, None, None, None)),
    ("アオマルとユキネ", 0.9, ("double_entry", "switch_in", "アオマル", None, None, None, None)),
]


@pytest.fixture(scope="module")
def parsed(spark):
    log = spark.createDataFrame([(k, t, c) for k, (t, c, _) in enumerate(CASES)], "id int, text string, confidence double")
    rows = log.select("id", "confidence", text.both_texts("text").alias("t")).select("id", "confidence", F.col("t.normalized").alias("normal"), F.coalesce("t.match", F.lit("")).alias("match"))
    views = templates.match_surfaces(templates.surfaces_of(log.select("id", F.coalesce("text", F.lit("")).alias("text"))))
    out = {}
    for r in cascade.cascade(rows, views, fixtures.rules(spark), fixtures.keys(spark)).orderBy("id", "actor").collect():
        out.setdefault(int(r["id"]), []).append(r)
    return out


def test_each_message_is_read_by_the_first_stage_that_can(parsed):
    got = [(t, parsed[k][0]["stage"], *(parsed[k][0][c] for c in ("event_type", "actor", "side", "move", "target", "stat"))) for k, (t, _, _) in enumerate(CASES)]
    assert got == [(t, *e) for t, _, e in CASES]
    assert [r["actor"] for r in parsed[len(CASES) - 1]] == ["アオマル", "ユキネ"]
    assert {len(rows) for k, rows in parsed.items() if k < len(CASES) - 1} == {1}


def test_unread_messages_keep_evidence(parsed):
    told = {t: parsed[k][0]["evidence"] for k, (t, c, _) in enumerate(CASES) if parsed[k][0]["stage"] == "unknown"}
    assert told["ドロバンの"] == ["partial-template;actor=%E3%83%89%E3%83%AD%E3%83%90%E3%83%B3"]
    assert any(e.startswith("constrained-review:confidence;") for e in told["キリカゼは倒れだ"])


def test_keyword_strings_match_word_for_word(spark):
    texts = ["効果はバックンだ", "効果はパックンだ", "効果はちようバッグンだ", "下かった", "急所", "効果がない"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, match string")
    keys = spark.createDataFrame([], "entry_id string, label string, key string")
    got = {r["id"]: r["reading"] for r in context.context_events(df, keys).collect()}
    assert got == {0: "effect_supereffective", 4: "critical_hit", 5: "effect_immune"}


def test_only_rules_of_seen_shapes_are_tried(spark):
    rules = spark.createDataFrame([("a", "faint", True), ("b", "weather_end", True), ("c", "weather_end", False), ("d", "heal", True)], "id string, event_type string, generated boolean")
    views = spark.createDataFrame([(1, "キリカゼは倒れた"), (2, "雨が上がった"), (3, "何もない")], "id int, text string")
    kept_views, kept = shapes.gated(views.where("id <> 2"), rules.where("id <> 'd'"))
    assert {r["id"] for r in kept.collect()} == {"a", "c"} and {r["id"] for r in kept_views.collect()} == {1}
    assert {r["id"]: r["s"] for r in views.select("id", shapes.shapes_of(F.col("text")).alias("s")).collect()} == {1: ["faint"], 2: ["boost", "weather_end"], 3: []}


WORDS = [
    (("move", "アオマル", "opponent", "ひのたま", None), {}, "相手のアオマルの ひのたま!"),
    (("move", None, None, "ひのたま", None), {}, "ひのたま!"),
    (("move", "アオマル", None, None, None), {}, "アオマルの 技!"),
    (("protect", "アオマル", None, None, None), {"signal": "ワイドガードで守られた"}, "アオマルは ワイドガードで 守られた!"),
    (("protect", None, None, None, None), {"signal": "protect_stance"}, "守りの 体勢に 入った!"),
    (("supereffective", None, None, None, "ユキネ"), {"signal": "ちようバツグン"}, "ユキネに 効果は ちょうバツグンだ!"),
    (("damage", "ユキネ", "opponent", None, None), {"signal": "どく"}, "相手のユキネは 毒の ダメージを 受けた!"),
    (("boost", "ユキネ", None, None, None), {"signal": "ぐーんと上がった", "stat": "特攻"}, "ユキネの 特攻が ぐーんと 上がった!"),
    (("unboost", "ユキネ", None, None, None), {}, "ユキネの 能力が 下がった!"),
    (("fail", "ユキネ", None, None, None), {"signal": "反動で動けない"}, "ユキネは 攻撃の 反動で 動けない!"),
    (("fail", None, None, None, "ユキネ"), {}, "しかし ユキネには うまく 決まらなかった!"),
    (("item", "ユキネ", None, None, None), {"signal": "もちこたえた", "captured": "ひも"}, "ユキネは ひもで もちこたえた!"),
    (("item", None, None, None, None), {}, "道具で 行動が はやくなった!"),
    (("activate", "ユキネ", None, None, None), {"signal": "メガシンカ", "mega_form": "メガユキネ"}, "ユキネは メガユキネに メガシンカした!"),
    (("activate", "ユキネ", None, None, "アオマル"), {"signal": "飲みほした"}, "ユキネが たてた お茶を アオマルは 飲みほした!"),
    (("weather_end", None, None, None, None), {"signal": "雨が上がった"}, "雨が 上がった!"),
    (("side_start", None, "opponent", None, None), {"signal": "追い風"}, "相手に 追い風が 吹き始めた!"),
    (("side_start", None, None, None, None), {}, "場の効果が 始まった!"),
    (("side_end", None, None, None, None), {"signal": "味方の追い風"}, "味方の 追い風が 止んだ!"),
    (("battle_end", None, None, None, None), {"signal": "降参"}, "降参が 選ばれました!"),
    (("status", "ユキネ", None, None, None), {}, "ユキネ: status"),
    (("critical", "ユキネ", None, None, None), {}, "急所に 当たった!"),
]


def test_events_in_canonical_words(spark):
    names = ("signal", "stat", "captured", "mega_form")
    rows = [(k, *event, *[more.get(n) for n in names]) for k, (event, more, _) in enumerate(WORDS)]
    df = spark.createDataFrame(rows, "k int, kind string, actor string, side string, move string, target string, signal string, stat string, captured string, mega_form string")
    said = context.canonical_text(*[F.col(c) for c in ("kind", "actor", "side", "move", "target")], None, *[F.col(c) for c in names])
    got = [r["said"] for r in df.select("k", said.alias("said")).orderBy("k").collect()]
    assert got == [w for _, _, w in WORDS]


def test_evidence_and_mega_forms(spark):
    told = spark.createDataFrame([("x:text=ひも,a:y", "a:stat:こうげき->攻撃", "kind;a=1;b=x%20y"), ("no", "stat=防御", "kind")], "a string, b string, c string")
    got = told.select(context.text_captured(F.col("a")).alias("a"), context.stat_captured(F.col("b")).alias("b"), context.fields_of(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("ひも", "攻撃", {"a": "1", "b": "x y"}), (None, "防御", {})]
    forms = spark.createDataFrame([("メガユキネ",), ("メガアオマルX",), ("メガアオマルY",)], "label string")
    events = spark.createDataFrame([(1, "ユキネ", None), (2, "アオマル", "アオマルY"), (3, "アオマル", None), (4, "ドロバン", "x")], "id int, actor string, captured string")
    assert {r["id"]: r["mega_form"] for r in context.mega_form_of(events, forms).collect()} == {1: "メガユキネ", 2: "メガアオマルY"}


def test_surfaces_without_noise(spark):
    views = spark.createDataFrame([(1, 0, "いろ 相手のアオマルは! 倒れた! xy 12"), (2, 5, "a!bcdefghijklmn"), (3, 0, "!!")], "id int, priority int, text string")
    got = {(r["id"], r["match"]): r["priority"] for r in templates.match_surfaces(views).collect()}
    assert got == {
        (1, "いろ相手のアオマルは倒れたxy12"): 0, (1, "いろ相手のアオマルは"): 30, (1, "いろ相手のアオマルは倒れた"): 31, (1, "いろ相手のアオマルは倒れたxy"): 34,
        (1, "相手のアオマルは倒れたxy12"): 40, (1, "相手のアオマルは"): 70, (1, "相手のアオマルは倒れた"): 71, (1, "相手のアオマルは倒れたxy"): 74, (2, "a!bcdefghijklmn".replace("!", "")): 5,
    }


def test_equal_messages_are_read_once_and_told_for_each(spark):
    asked = []

    def read(texts):
        asked.extend(texts.collect())
        two = texts.select("id", F.explode(F.array(F.lit("a"), F.col("text"))).alias("said"))
        return written(two.where("text IS NOT NULL"), "read")

    log = spark.createDataFrame([(1, "x", 0.5), (2, "x", 0.5), (3, "x", None), (4, None, 0.5), (5, "x", 0.5), (5, "y", 0.5)], "id int, text string, confidence double")
    got = sorted(tuple(r) for r in cascade.once_each(log, read).collect())
    assert len(asked) == 4
    assert got == sorted((k, s) for k, t in ((1, "x"), (2, "x"), (3, "x"), (5, "x"), (5, "y")) for s in ("a", t))
