import pytest
from pyspark.sql import functions as F

from logloom.functions import signals, text
from logloom.operators import context, entities, gate, templates
from logloom.plans import fixtures


def test_normalisation():
    assert text.normalized("ｱｵ\r\n  ﾏﾙ｡\n\n") == "アオマル。"
    assert text.normalized("a　 b／／c|！！") == "a b!c!"
    assert text.match_form("効果は バツグンだ！") == "効果はバツグンだ"
    assert text.match_form(" A.B (c) ") == "abc"


def test_similarities(spark):
    assert text.weighted_similarity("アカリュー", "アカリュ") == pytest.approx(1 - 0.2 / 5)
    assert text.weighted_similarity("ッ", "ツ") == pytest.approx(0.65)
    assert text.weighted_similarity("ャ", "ヤ") == pytest.approx(0.85)
    assert text.weighted_similarity("abc", "abc") == 1.0
    assert text.weighted_similarity("", "ab") == 0.0
    df = spark.createDataFrame([("ミズオオオカミ", "ミズオオカミ"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 - 1 / 7), 1.0]


def fnv(parts):
    value = 0x811C9DC5
    units = "\x1f".join(parts).encode("utf-16-be")
    for k in range(0, len(units), 2):
        value = (value ^ int.from_bytes(units[k : k + 2], "big")) * 0x01000193 & 0xFFFFFFFF
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while value:
        value, d = divmod(value, 36)
        out = digits[d] + out
    return out or "0"


def test_rule_hash(spark):
    df = spark.createDataFrame([("move", "{name}の{move}"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(text.rule_hash(F.col("a"), F.col("b"))).collect()]
    assert got == [fnv(["move", "{name}の{move}"]), fnv(["", "x"])]


def test_csv_cells_and_folding(spark):
    df = spark.createDataFrame([('a"b', "x,y", None, "ッポォポオ")], "a string, b string, c string, d string")
    row = df.select(text.csv_row(F.col("a"), F.col("b"), F.col("c")).alias("line"), text.fold_kana(F.col("d")).alias("folded")).first()
    assert row["line"] == '"a""b","x,y",'
    assert row["folded"] == "っぽおぽお"


@pytest.mark.parametrize(
    "raw,confidence,candidates,reason",
    [
        ("", 0.9, [], "too_short"),
        ("アオマルの", 0.9, [], "prefix_only"),
        ("のこり 03:15", 0.9, [], "timer"),
        ("特性 ひらめき", 0.9, [], "ui_fragment"),
        ("＊＊＋＋あ", 0.9, [], "symbol_noise"),
        ("a b c 1 2 x", 0.9, [], "other_noise"),
        ("ふしぎな光が", 0.3, [], "low_confidence_no_action_signal"),
        ("ふしぎな光があたり", 0.9, [], "accepted"),
        ("倒れた", 0.2, ["near"], "accepted"),
        ("ab", 0.9, [], "too_short"),
    ],
)
def test_gate(spark, raw, confidence, candidates, reason):
    df = spark.createDataFrame([(text.match_form(raw), text.normalized(raw), confidence, candidates)], "m string, n string, c double, k array<string>")
    assert df.select(gate.gate_reason(F.col("m"), F.col("n"), F.col("c"), F.col("k"))).first()[0] == reason


def test_dictionary_matching(spark):
    entries = spark.createDataFrame([(1, "lavender", []), (2, "lavandin", ["lavandine"]), (3, "rose", None)], "id long, label string, aliases array<string>")
    keys = entities.dictionary_keys(entries)
    texts = spark.createDataFrame([("lavender",), ("rosa",), ("lavendar",), ("",), ("zzzzzzzzz",), (None,)], "text string")
    got = {r["text"]: r for r in entities.match_entries(texts, keys).collect()}
    assert got["lavender"]["status"] == "accepted" and got["lavender"]["score"] == 1.0
    assert got["rosa"]["status"] == "review" and got["rosa"]["label"] == "rose"
    assert got["lavendar"]["status"] == "accepted" and got["lavendar"]["label"] == "lavender"
    assert got["zzzzzzzzz"]["status"] == "not_found" and got[""]["status"] == "not_found" and None not in got


def test_spans_are_greedy_longest_first(spark):
    texts = spark.createDataFrame([(1, "abcdabxcd"), (2, ""), (3, None)], "id long, text string")
    keys = spark.createDataFrame([("abc",), ("cdab",), ("ab",), ("cd",)], "key string")
    got = sorted((r["id"], r["start"], r["end"], r["key"]) for r in entities.dictionary_spans(texts, keys).collect())
    assert got == [(1, 0, 2, "ab"), (1, 2, 6, "cdab"), (1, 7, 9, "cd")]


def test_templates_decode_the_bundled_log(spark):
    got = {r["id"]: (r["event_type"], dict(r["found"])) for r in templates.decoded(fixtures.surfaces(spark), fixtures.rules(spark), fixtures.keys(spark)).collect()}
    assert got["m01"] == ("move", {"name_0": "アオマル", "move_1": "ひのたま"})
    assert got["m04"] == ("faint", {"name_0": "キリカゼ"})
    assert got["m02"][0] == "supereffective" and "m06" not in got and "m15" not in got


def test_placeholders_are_renamed(spark):
    df = spark.createDataFrame([("{0}の{1}と{2}！", ["name", "move"])], "t string, p array<string>")
    assert df.select(templates.typed_placeholders(F.col("t"), F.col("p"))).first()[0] == "{name}の{move}と{move}！"


def test_picture_kernels(spark):
    white, black = b"\xff\xff\xff\xff", b"\x00\x00\x00\xff"
    pixels = b"".join(white if 4 <= y < 8 else black for y in range(16) for x in range(32))
    df = spark.createDataFrame([(bytearray(pixels), 32, 16)], "p binary, w int, h int")
    row = df.select(signals.picture_fingerprint("p", "w", "h").alias("f"), signals.line_bands("p", "w", "h").alias("b"), signals.picture_occupancy("p", "w", "h").alias("g")).first()
    assert len(row["g"]) == 32 * 12 and sum(row["g"]) % 32 == 0 and sum(row["g"]) >= 96
    yellow = bytes([250, 220, 60, 255])
    assert signals.text_mask(yellow * 4, 2, 2, "yellow").all() and not signals.text_mask(yellow * 4, 2, 2).any()
    assert row["f"]["foreground_ratio"] == 0.25 and sum(row["f"]["cells"]) == 32 * 15
    assert [(b["top"], b["bottom"]) for b in row["b"]] == [(4, 7)]


def test_context_readings(spark):
    keys = spark.createDataFrame([("p0", "アオマル", "アオマル"), ("p1", "キリカゼ", "キリカゼ")], "entry_id string, label string, key string")
    lines = [(1, "相手のアオマルは倒れた"), (2, "効果はバツグンだ"), (3, "能力が上がった"), (4, "アオマルの攻撃が下がった"), (5, "アオマルとキリカゼを繰り出した"), (6, "相手のキリカゼは命が少し削られた"), (7, "")]
    df = spark.createDataFrame([(k, text.match_form(t)) for k, t in lines], "id long, match string")
    got = {r["id"]: (r["event_type"], r["actor"], r["side"]) for r in context.context_events(df, keys).collect()}
    assert got == {1: ("faint", "アオマル", "opponent"), 2: ("supereffective", None, None), 4: ("unboost", "アオマル", None)}
    assert sorted((r["id"], r["slot"], r["label"]) for r in context.double_entries(df, keys).collect()) == [(5, 1, "アオマル"), (5, 2, "キリカゼ")]
    assert [(r["id"], r["label"], r["side"]) for r in context.life_cost_events(df, keys).collect()] == [(6, "キリカゼ", "opponent")]


def test_canonical_words_and_suffix_guard(spark):
    df = spark.createDataFrame([("faint", "アオマル", "opponent", None, None), ("move", "アオマル", "player", "ひのたま", None), ("immune", None, None, None, "キリカゼ"), ("odd", None, None, None, None)], "k string, a string, s string, m string, t string")
    got = [r[0] for r in df.select(context.canonical_text(F.col("k"), F.col("a"), F.col("s"), F.col("m"), F.col("t"))).collect()]
    assert got == ["相手のアオマルは たおれた!", "アオマルの ひのたま!", "キリカゼに 効果が ない!", "odd"]
    row = spark.createDataFrame([("ひのたまを", "ひのたま"), ("ひのたま", "ひのたま")], "a string, b string")
    assert [r[0] for r in row.select(context.unsafe_suffix(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_workers_hold_few_texts_at_once(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    seen = F.pandas_udf(lambda t: t.map(lambda _: len(t)), "long")
    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("ab "), 3000).alias("text"))
    rows.select(text.both_texts("text").alias("t")).count()
    assert rows.select(seen("text").alias("n")).agg(F.max("n")).first()[0] <= 512


def test_views_of_a_row_need_no_shuffle_and_repeated_ids_share_theirs(spark):
    texts = [(1, "a\nb\na\nb"), (2, "a"), (3, ""), (4, None), (None, "x\ny")]
    views = templates.surfaces_of(spark.createDataFrame(texts, "id long, text string"))
    assert "Exchange" not in views._jdf.queryExecution().executedPlan().toString()
    expected = {(1, "abab"): 0, (1, "ab"): 12, (1, "ba"): 13, (1, "aba"): 13, (1, "bab"): 14, (1, "a"): 20, (1, "b"): 21, (2, "a"): 0, (3, ""): 0, (4, None): 0, (None, "xy"): 0, (None, "x"): 20, (None, "y"): 21}
    assert {(r.id, r.text): r.priority for r in views.collect()} == expected and views.count() == len(expected)
    again = templates.surfaces_of(spark.createDataFrame([*texts, (1, "b\nc"), (None, "y")], "id long, text string"))
    expected |= {(1, "bc"): 0, (1, "b"): 20, (1, "c"): 21, (None, "y"): 0}
    assert {(r.id, r.text): r.priority for r in again.collect()} == expected and again.count() == len(expected)
