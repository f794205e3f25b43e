"""Rule sources: arbitrary JSON trees scanned for texts, filtered, classified, packed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import label_prefix, literal_length, match_text, placeholder_signature, rule_hash
from logloom.operators.aggregates import keep_first
from logloom.operators.gate import SCRIPTS
from logloom.operators.context import holds_any

# The ordered keywords that tell a rule's event type. Of each of the groups one string must be in the
# text. The end of a weather comes before the stat changes, whose keyword its text also contains.
TYPES = (
    ("supereffective", [("効果はバツグン",)]),
    ("resisted", [("効果はいまひとつ",)]),
    ("immune", [("効果がない", "効果はない")]),
    ("critical", [("急所",)]),
    ("switch_in", [("ゆけっ", "いけっ")]),
    ("switch_out", [("引っこめ", "ひっこめ", "戻れ")]),
    ("faint", [("倒れ", "たおれ", "ひんし")]),
    ("flinch", [("ひるんで",), ("技がだせない",)]),
    ("miss", [("外れた", "あたらなかった")]),
    ("fail", [("失敗", "うまく決まらない")]),
    ("item", [("行動がはやくなった",)]),
    ("protect", [("身を守った", "守られた")]),
    ("weather_end", [("雨が上がった", "砂あらしが止んだ", "雪が止んだ", "天気は普通に戻った")]),
    ("boost", [("上がった",)]),
    ("unboost", [("下がった",)]),
    ("weather_start", [("雨", "あめ", "降りはじめた", "降り始めた", "砂あらし", "雪", "日差し")]),
    ("terrain_end", [("フィールド",), ("消えた", "なくなった")]),
    ("terrain_start", [("フィールド",)]),
    ("ability", [("特性",)]),
    ("item", [("道具", "ブーストエナジー", "たべのこし", "もちもの")]),
    ("heal", [("HP", "体力", "回復")]),
    ("damage", [("ダメージ", "反動", "削られ")]),
    ("status", [("状態になった",)]),
    ("status_cure", [("治った",)]),
)
# Labels and words of texts that are never seen in a battle, and what tells those that are.
NON_LIVE_LABEL = "(?i)INFO|TUTORIAL|HELP|SELECT|POKESELECT|RECEPTION|BUTTON|UI"
NON_LIVE_HINTS = ("確率", "ボタン", "選択", "選ぶ", "一覧", "説明", "ルール", "チュートリアル", "受付", "トレーニング", "プレミアム", "購入", "ランキング", "シーズン", "バトルパス")
IMPORT_HINTS = ("確率", "ボタン", "選択", "選ぶ", "一覧", "説明", "ルール", "チュートリアル", "受付", "トレーニング")
INFO_LABEL = "(?i)(?:^|_)INFO(?:_|$)|TUTORIAL|HELP|SELECT|POKESELECT|RECEPTION"
BATTLE_FILE, BATTLE_LABEL = r"(?i)(^|[\\/])(btl_|battle)|btl_", "(?i)^(BTL|ATKMSG|WAZA_BTL|BATTLE)[A-Z0-9_]*|_BTL_"
BATTLE_WORDS = (
    "相手", "効果", "急所", "倒れ", "たおれ", "ひんし", "ゆけっ", "いけっ", "引っこめ", "ひっこめ", "もどれ", "戻れ", "ダメージ", "反動", "削られ", "HP", "回復",
    "フィールド", "天気", "雨", "あめ", "雪", "砂あらし", "日差し", "特性", "道具", "ブーストエナジー", "発動", "外れ", "失敗", "守った", "まもる", "上がった", "下がった",
)
PACK_VERSION = "0.1.0"


def non_live(label: Column, text: Column, label_deny: list[str] | None = None, hints: list[str] | None = None) -> Column:
    """Whether a text is one of menus and help, by its label or a word in it; a source may deny more of either."""
    label = F.coalesce(label, F.lit(""))
    return label.rlike("|".join([NON_LIVE_LABEL, *[f"(?:{p})" for p in label_deny or []]])) | holds_any(text, NON_LIVE_HINTS + tuple(hints or ()))


def battle_related(file: Column, label: Column, text: Column) -> Column:
    """Whether a text of an imported file is about a battle: not by an information label or word, but by file, label or a word."""
    known = F.coalesce(label, F.lit(""))
    good = file.rlike(BATTLE_FILE) | known.rlike(BATTLE_LABEL) | holds_any(text, BATTLE_WORDS)
    return ~known.rlike(INFO_LABEL) & ~holds_any(text, IMPORT_HINTS) & good


def keyword_type(text: Column, file: Column | None = None, label: Column | None = None, rules: list[tuple[str, str]] | None = None, default: str = "activate") -> Column:
    """The event type of a rule text: by a source's own (pattern, type) rules, by a file or label of moves, then by keyword."""
    out = F.lit(default)
    for kind, groups in reversed(TYPES):
        found = F.lit(True)
        for strings in groups:
            found = found & holds_any(text, strings)
        out = F.when(found, kind).otherwise(out)
    if file is not None:
        out = F.when(F.contains(F.lower(file), F.lit("btl_attack")), "move").otherwise(out)
    if label is not None:
        out = F.when(F.coalesce(label, F.lit("")).rlike("(?i)^ATKMSG_"), "move").otherwise(out)
    for pattern, kind in reversed(rules or []):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def extracted_texts(files: DataFrame) -> DataFrame:
    """(file, label, path, text): every OriginalText in the trees of files(file, json), with
    the nearest label above it and its path. Files that aren't JSON give no rows.

    The tree has no schema, so its walk is a small Python generator; files are spread over tasks.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, source in zip(batch["file"], batch["json"], strict=True):
                try:
                    todo = [(json.loads(source), "", "$")] if source else []
                except ValueError:
                    continue
                while todo:
                    node, label, path = todo.pop()
                    if isinstance(node, dict):
                        own = node.get("LabelName")
                        label = own if isinstance(own, str) else label
                        if isinstance(node.get("OriginalText"), str):
                            out.append((file, label, f"{path}.OriginalText", node["OriginalText"]))
                        todo += [(v, label, f"{path}.{k}") for k, v in reversed(node.items())]
                    elif isinstance(node, list):
                        todo += [(v, label, f"{path}[{k}]") for k, v in reversed(list(enumerate(node)))]
            yield pd.DataFrame(out, columns=["file", "label", "path", "text"])

    rows = files.select("file", "json").mapInPandas(walk, "file string, label string, path string, text string")
    size = F.length("text")
    return rows.where(size.between(2, 140) & F.col("text").rlike(f"[{SCRIPTS}]"))


def created_rules(texts: DataFrame, slots: list[str], least_literal: int = 3, limit: int = 600) -> DataFrame:
    """Rules(id, event_type, priority, pattern, signature, prefix, file) from extracted texts:
    placeholders named after slots in turn, type by keyword, id by hash, first of equal rules kept."""
    pattern = F.col("text")
    for k, name in enumerate(slots):
        pattern = F.replace(pattern, F.lit(f"{{{k}}}"), F.lit(f"{{{name}}}"))
    rows = texts.withColumns({"pattern": pattern, "event_type": keyword_type(F.regexp_replace("text", r"(?U)\s+", ""), F.col("file"), F.col("label"))})
    rows = rows.where(literal_length(F.col("pattern")) >= least_literal).select(
        rule_hash(F.col("event_type"), F.col("pattern")).alias("id"),
        "event_type",
        F.when(F.col("pattern").contains("{"), 58).otherwise(50).alias("priority"),
        "pattern",
        placeholder_signature(F.col("text")).alias("signature"),
        label_prefix(F.col("label")).alias("prefix"),
        "file",
        "path",
    )
    return keep_first(rows, ["event_type", "pattern"], ["file", "path"], limit)


def file_profile(rules: DataFrame) -> DataFrame:
    """For each file: rules, prefixes, placeholder patterns, types, and what to do with it."""
    out = rules.groupBy("file").agg(
        F.count("*").alias("rules"), F.count_distinct("prefix").alias("prefixes"), F.count_distinct("signature").alias("signatures"),
        F.count_distinct("event_type").alias("types"), F.avg((F.col("event_type") == "activate").cast("double")).alias("untyped_share"),
    )
    advice = F.when(F.col("untyped_share") > 0.5, "hold").when(F.col("rules") < 3, "review").otherwise("enable")
    return out.withColumn("advice", advice)


def united_packs(*packs: DataFrame) -> DataFrame:
    """Rules of several packs, own ones first: of rules with one id that of the earliest pack holds."""
    rows = None
    for k, pack in enumerate(packs):
        own = pack.withColumn("_pack", F.lit(k))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("id").orderBy("_pack"))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place", "_pack")


def write_pack(rules: DataFrame, path: str, imported_at: str) -> None:
    """A rule pack as text: a line with the version, then a rule a line, as JSON. Packs of any size are written by many tasks."""
    head = rules.sparkSession.createDataFrame([(PACK_VERSION, imported_at)], "schemaVersion string, importedAt string")
    head.select(F.to_json(F.struct("schemaVersion", "importedAt")).alias("value")).write.mode("overwrite").text(f"{path}/head")
    rules.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/rules")


def read_pack(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame | None, str | None]:
    """The rules of a pack, or what is wrong with it: another version, or a rule that can't be read."""
    head = spark.read.text(f"{path}/head").select(F.get_json_object("value", "$.schemaVersion").alias("v")).first()
    if head is None or head["v"] != PACK_VERSION:
        return None, f"unsupported version {head and head['v']}"
    rows = spark.read.text(f"{path}/rules").select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    if not rows.where("get_json_object(value, '$.id') IS NULL").isEmpty():
        return None, "a rule without id"
    return rows.select("r.*"), None


def review_index(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """Every extracted text(file, label, path, text) with its standing under sources(file, status, allow, deny, hints, policy).

    status: enabled if the labels that the source allows have it and nothing denies it, else the source's hold or disabled,
    else review_index. risks names why it isn't a rule yet; match and skeleton are what messages are compared with.
    Sources are few: a row for each file.
    """
    rows = texts.join(F.broadcast(sources.withColumnRenamed("file", "_file")), F.col("file") == F.col("_file"), "left").drop("_file")
    label = F.coalesce("label", F.lit(""))

    def any_of_patterns(patterns: str) -> Column:
        return F.coalesce(F.exists(patterns, lambda p: F.regexp_like(label, p)), F.lit(False))

    limited = F.size(F.coalesce("allow", F.array().cast("array<string>"))) > 0
    outside = limited & ~any_of_patterns("allow")
    denied = non_live(F.col("label"), F.col("text")) | any_of_patterns("deny") | F.coalesce(F.exists("hints", lambda h: F.contains(F.col("text"), h)), F.lit(False))
    allowed = F.coalesce(F.col("status") == "enabled", F.lit(False)) & ~outside & ~denied
    count = F.size(F.regexp_extract_all("text", F.lit(r"\{\s*\d+\s*\}"), F.lit(0)))
    ranked = F.col("text").rlike("上がった|下がった|ぐーん|がくっと")
    policy = F.col("policy").isNotNull()
    needs = (count > 0) & ~(allowed & policy) & (label.rlike("(?i)Rank(?:up|down)Lv") | ((F.col("file") == "btl_set.json") & ~allowed) | ((count > 1) & ranked) | ~policy)
    risky = ~allowed & ((count >= 2) | label.rlike("(?i)Rank(?:up|down)Lv[123]_[2-5]_") | label.rlike("(?i)_(?:PP|EE)_syn$"))
    standing = F.when(allowed, "enabled").when(F.col("status").isin("hold", "disabled"), F.col("status")).otherwise("review_index")
    rows = rows.withColumns({"standing": standing, "outside": ~allowed & outside, "denied": denied, "needs_policy": needs, "risky": risky})
    risks = F.array_compact(F.array(
        F.when(F.col("standing") == "review_index", "review_index_only"), F.when(F.col("outside"), "blocked_by_current_config"), F.when(F.col("denied"), "blocked_by_deny_pattern"),
        F.when(F.col("needs_policy"), "placeholder_policy_required"), F.when(F.col("risky"), "risky_placeholder"),
    ))
    return rows.select("file", "label", "path", "text", F.col("standing").alias("status"), risks.alias("risks"), match_text("text").alias("match"), match_text(F.regexp_replace("text", r"\{[^}]*\}", "")).alias("skeleton"))


def pack_statistics(texts: DataFrame) -> DataFrame:
    """How a pack came about: for each file, for each type, for both and in all, from texts(file, key, text, candidate, event_type).

    extracted texts; candidates; generated rules (candidates with a type); duplicates among these (not the first, by file and key, of
    its type and text); skipped (all that aren't generated). One pass of grouping sets; scope says which
    columns count (file, type, file_type, all). Texts are told apart by one shuffle on type and text. No texts give no rows.
    """
    of = Window.partitionBy("event_type", "text").orderBy("file", "key")
    generated = F.coalesce(F.col("candidate"), F.lit(False)) & F.col("event_type").isNotNull()
    first = F.row_number().over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Only generated rows compete; the others would meet in one group.
    own = texts.withColumn("event_type", F.when(generated, F.col("event_type"))).withColumn("is_rule", F.col("event_type").isNotNull())
    numbered = own.where("is_rule").withColumn("again", first > 1).unionByName(own.where("NOT is_rule").withColumn("again", F.lit(False)))
    count = lambda c: F.count_if(c)
    grouped = numbered.groupingSets([["file", "event_type"], ["file"], ["event_type"], []], "file", "event_type").agg(
        F.grouping_id("file", "event_type").alias("level"), F.count("*").alias("extracted"), count(F.coalesce(F.col("candidate"), F.lit(False))).alias("candidates"),
        count(F.col("is_rule")).alias("generated"), count(F.col("again")).alias("duplicates"), count(~F.col("is_rule")).alias("skipped"),
    )
    scope = F.when(F.col("level") == 0, "file_type").when(F.col("level") == 1, "file").when(F.col("level") == 2, "type").otherwise("all")
    return grouped.select(scope.alias("scope"), "file", "event_type", "extracted", "candidates", "generated", "duplicates", "skipped")
