"""Shapes of messages: which kinds of event a text can be about, and the rules that are worth trying on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.context import OPPONENT, holds_any

# The shapes of each kind. A text has the shape if one of the alternatives holds; an
# alternative holds if of each of its groups one string is there.
SHAPES = {
    "faint": [[("倒れ", "たおれ", "たおあれ", "だおれ", "おれだ", "ひんし")]],
    "supereffective": [[("効果",), ("バツ", "パツ", "バウツ", "バッグ", "パッグ", "バック", "グン")]],
    "fail": [[("反動",), ("動けない", "動けな")], [("失敗", "しかし", "うまく", "うまぐ", "うま"), ("決ま", "きま"), ("なかった", "なかつた")]],
    "flinch": [[("ひるん", "技がだせない", "技かだせない"), ("だせない", "出せない")]],
    "item": [[("行動がはやく", "行動かはやく", "行動が早く"), ("なった", "なつた")], [("もちこたえ", "持ちこたえ"), ("で",)]],
    "protect": [[("身を守", "守りの体勢", "守りの 体勢")], [("ワイドガード", "ファストガード"), ("守られた", "守られ")]],
    "redirection": [[("注目の的",)], [("注目",), ("なった",)], [("的",), ("なった",)]],
    "activate": [[("メガ",), ("シンカ", "シン力", "シソカ")], [("お茶",), ("飲",)]],
    "damage": [[("砂あらし",), ("襲", "おそう")], [("毒", "どく"), ("ダメージ",), ("受けた", "受けだ", "受け")]],
    "status_cure": [[("治った", "なおった", "回復した", "なくなった", "溶けた", "覚ました", "とれた", "解けた")]],
    "status": [[("状態", "まひ", "麻痺", "やけど", "毒", "どく", "眠", "ねむ", "こおり", "凍", "混乱", "メロメロ")]],
    "immune": [[("効果がない",)], [("効果はない",)], [("効果",), ("ない",)]],
    "miss": [[("当たらなかった", "当たらなかつた", "あたらなかった", "あたらなかつた")]],
    "boost": [[("が",), ("上がった", "上がつた", "ぐーん")]],
    "unboost": [[("が",), ("下がった", "下かった", "下がっだ", "がくっと")]],
    "weather_start": [[("日差し",), ("強くなった", "強くなつた")], [("雨",), ("降り始め", "ふり始め")], [("砂あらし",), ("吹き始め", "ふき始め")], [("雪", "ゆき"), ("降り始め", "ふり始め")]],
    "weather_end": [[("日差し",), ("元に戻った", "元に戻つた")], [("雨",), ("上がった", "上がつた")], [("砂あらし",), ("おさまった", "止んだ")], [("雪", "ゆき"), ("止んだ",)]],
    "side_start": [[("追い風",), ("吹き始め", "ふき始め")]],
    "side_end": [[("追い風",), ("止んだ", "やんだ")]],
}


def move_shape(text: Column) -> Column:
    """Somebody's の something: after the mark of the other side, or with parts of the lengths of a name and a move."""
    actor, move = F.instr(text, "の") - 1, F.length(text) - F.instr(text, "の")
    return F.contains(text, F.lit("の")) & (F.startswith(text, F.lit(OPPONENT)) | (actor.between(2, 8) & move.between(2, 14)))


def effect_target_shape(text: Column) -> Column:
    """An effect that names whom it meets: at least two characters and に in front of it."""
    at = F.instr(text, "効果")
    return (at >= 4) & (F.substring(text, at - 1, F.lit(1)) == "に")


def has_shape(text: Column, kind: str) -> Column:
    if kind == "move":
        return move_shape(text)
    out = F.lit(False)
    for groups in SHAPES[kind]:
        one = F.lit(True)
        for strings in groups:
            one = one & holds_any(text, strings)
        out = out | one
    return out


def shapes_of(text: Column) -> Column:
    """The kinds whose shape the text has."""
    return F.array_compact(F.array(*[F.when(has_shape(text, k), F.lit(k)) for k in ["move", *SHAPES]]))


def gated(surfaces: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The surfaces(id, text, ...) with their shapes, without those that no rule can be about, and the rules without
    generated ones of a kind that no surface is about.

    rules(event_type, generated, ...): own rules are always tried, and on every surface if their kind has no shape.
    """
    shaped = surfaces.withColumn("shapes", shapes_of(F.col("text")))
    known = F.array(*map(F.lit, ["move", *SHAPES]))
    seen = shaped.select(F.explode("shapes").alias("event_type")).distinct()
    kept = rules.join(F.broadcast(seen.withColumn("_seen", F.lit(True))), "event_type", "left")
    kept = kept.where(~F.coalesce("generated", F.lit(False)) | F.coalesce("_seen", F.lit(False))).drop("_seen")
    # The kinds of the rules: as many as there are kinds of events.
    kinds = [r["event_type"] for r in kept.select("event_type").distinct().collect()]
    own = F.array(*map(F.lit, kinds)).cast("array<string>")
    free = F.size(F.array_except(own, known)) > 0
    return shaped.where(F.arrays_overlap("shapes", own) | free), kept
