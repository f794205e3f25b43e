"""A small message log of our own, with its rules and dictionary, for the parsing queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from logloom.functions.text import match_text
from logloom.operators.templates import surfaces_of

NAMES = ["アオマル", "キリカゼ", "ドロバン", "ユキネ", "ホムラゴ", "カナデリ"]
MOVES = ["ひのたま", "みずでっぽう", "いわなだれ", "つむじかぜ", "こおりのいき", "でんげき"]
RULES = [
    ("move", "move", 80, ["{name}の{move}"]),
    ("faint", "faint", 100, ["{name}は倒れた"]),
    ("switch_in", "switch_in", 90, ["ゆけっ{name}", "{name}を繰り出した"]),
    ("damage", "damage", 90, ["{name}は反動でダメージを受けた"]),
    ("effective", "supereffective", 100, ["効果はバツグンだ"]),
    ("resisted", "resisted", 100, ["効果は今ひとつのようだ"]),
    ("boost", "boost", 90, ["{name}の{text}が上がった"]),
    ("heal", "heal", 90, ["{name}は体力を回復した"]),
]
LINES = [
    ("b1", 1000, "ゆけっ アオマル！", 0.9), ("b1", 2000, "アオマルの\nひのたま！", 0.9), ("b1", 2500, "効果は バツグンだ！", 0.8), ("b1", 3900, "効果はバツグンだ！", 0.8),
    ("b1", 5000, "キリカゼは倒れた！", 0.95), ("b1", 6000, "アオマノレの", 0.4), ("b1", 7000, "03:15", 0.9), ("b1", 8000, "ドロバンの攻撃が上がった！", 0.85),
    ("b1", 9000, "ふしぎな光があたりをつつんでいる", 0.9), ("b1", 9900, "", 0.9), ("b2", 1000, "ユキネを繰り出した！", 0.9), ("b2", 2000, "ユキネの こおりのいき！", 0.9),
    ("b2", 2100, "ユキネの こおりのいき！", 0.9), ("b2", 3000, "効果は今ひとつのようだ", 0.7), ("b2", 4000, "ホムラゴは体力を回復した", 0.9), ("b2", 5000, "ホムラコは倒れた", 0.9),
    ("b2", 6000, "？？／／＊＊", 0.9), ("b2", 7000, "カナデリは反動でダメージを受けた！", 0.9), ("b2", 8000, "特性 ひらめき", 0.9), ("b2", 9000, "あ", 0.3),
]


def messages(spark: SparkSession) -> DataFrame:
    rows = [(f"m{k:02d}", *r) for k, r in enumerate(LINES)]
    return spark.createDataFrame(rows, "id string, battle_id string, timestamp_ms long, text string, confidence double")


def surfaces(spark: SparkSession) -> DataFrame:
    return surfaces_of(messages(spark).select("id", "text")).select("id", match_text("text").alias("text")).distinct()


def rules(spark: SparkSession) -> DataFrame:
    rows = [(*r, {}) for r in RULES]
    return spark.createDataFrame(rows, "id string, event_type string, priority int, patterns array<string>, constants map<string,string>")


def keys(spark: SparkSession) -> DataFrame:
    rows = [("name", f"p{k}", n, n.lower()) for k, n in enumerate(NAMES)] + [("move", f"w{k}", n, n.lower()) for k, n in enumerate(MOVES)]
    return spark.createDataFrame(rows, "kind string, entry_id string, label string, key string")


def rule_files(spark: SparkSession) -> DataFrame:
    tree = {"LabelName": "TRAINER_msg_btl_01", "Words": [{"OriginalText": "{0}は 倒れた！"}, {"LabelName": "TRAINER_msg_btl_02", "OriginalText": "{0}の {1}！"}, {"OriginalText": "x"}]}
    other = {"Items": {"a": {"LabelName": "WEATHER_msg_end_1", "OriginalText": "雨が 上がった！"}, "b": {"OriginalText": "{0}は 倒れた！"}}}
    return spark.createDataFrame([("a.json", json.dumps(tree)), ("b.json", json.dumps(other)), ("c.json", "{broken")], "file string, json string")
