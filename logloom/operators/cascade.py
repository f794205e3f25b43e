"""From messages to events: every way of reading a message is a table, and the first that succeeds counts.

Each stage is a DataFrame of (id, ...) rows made by joins over all messages at once; the cascade is their
union, ranked by stage. Nothing is parsed message by message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import similarity
from logloom.operators.context import OPPONENT, context_events, double_entries, entry_call, life_cost_events, partial_template, unsafe_suffix
from logloom.operators.entities import dictionary_spans, match_entries
from logloom.operators.templates import compiled, constrained, decoded
from logloom.sources.shared import removed, scratch, written

Put = Callable[[DataFrame, str], DataFrame]

#: Stages in order. Of two readings the one of the earlier stage holds.
STAGES = ("context", "double_entry", "degraded_entry", "constrained", "template", "life_cost", "move_split", "move_span", "entry_call")
# How somebody is called in, how well a worn call must fit, and what a confidence it takes.
CALLS, CALL_LEAST, CALL_CONFIDENCE = ("ゆけっ", "いけっ"), 0.72, 0.7
#: Characters besides の between a name and a move that belong together; pieces of evidence of an unknown message.
GAP_NOISE, MOST_EVIDENCE = 4, 16

EVENT = "id string, stage string, event_type string, reading string, actor string, side string, move string, target string, target_side string, stat string, confidence double, evidence array<string>"


def combined(confidence: Column, *scores: Column) -> Column:
    """The least of the confidence of the reading and the scores; nulls aren't known and don't count."""
    return F.least(confidence, *scores)


def beside_opponent(match: Column, label: Column) -> Column:
    """opponent if a known name stands right behind the mark of the other side in the text, else null."""
    return F.when(F.contains(match, F.concat(F.lit(OPPONENT), F.lower(label))), "opponent")


def move_splits(messages: DataFrame, names: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, actor, side, move, score) of messages(id, match) cut at one of their の into a name and a move that are known.

    Both are read strictly, but a name that is (nearly) exact lets the move be read leniently, and the
    other way round. A move that is not exact and ends in a particle is doubted. The first cut holds.
    """
    theirs = F.startswith("match", F.lit(OPPONENT))
    body = F.when(theirs, F.substring("match", len(OPPONENT) + 1, 1 << 20)).otherwise(F.col("match"))
    rows = messages.select("id", F.when(theirs, "opponent").alias("side"), body.alias("body"))
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.length("body") - 1, F.lit(2))), lambda k: F.substring(F.col("body"), k, F.lit(1)) == "の")
    cut = rows.select("id", "side", "body", F.explode(places).alias("at")).where(F.col("at") < F.length("body"))
    cut = cut.select("id", "side", "at", F.substring("body", F.lit(1), F.col("at") - 1).alias("name"), F.substring("body", F.col("at") + 1, F.length("body")).alias("said"))

    def read(text: str, keys: DataFrame, strict: tuple[float, float], lenient: tuple[float, float, float], strong: float) -> DataFrame:
        found = match_entries(cut.select(F.col(text).alias("text")), keys, *lenient).where("label IS NOT NULL")
        exact = F.col("score") >= 1.0
        return found.select(
            F.col("text").alias(text), F.col("label").alias(f"{text}_label"), F.col("score").alias(f"{text}_score"), exact.alias(f"{text}_exact"),
            (exact | ((F.col("score") >= strict[0]) & (F.col("margin") >= strict[1]))).alias(f"{text}_strict"),
            (F.col("status") == "accepted").alias(f"{text}_lenient"), (F.col("score") >= strong).alias(f"{text}_strong"),
        )

    actors = read("name", names, (0.78, 0.06), (0.62, 0.58, 0.10), 0.9)
    acts = read("said", moves, (0.78, 0.06), (0.72, 0.68, 0.12), 0.94)
    both = cut.join(actors, "name").join(acts, "said")
    good = (F.col("name_strict") & F.col("said_strict")) | (F.col("name_strict") & F.col("name_strong") & F.col("said_lenient")) | (F.col("said_strict") & F.col("said_strong") & F.col("name_lenient"))
    unsafe = ~F.col("said_exact") & unsafe_suffix(F.col("said"), F.lit("\x00"))
    first = both.where(good & ~unsafe).groupBy("id").agg(F.min_by(F.struct(F.col("name_label").alias("actor"), "side", F.col("said_label").alias("move"), F.least("name_score", "said_score").alias("score")), "at").alias("r"))
    return first.select("id", "r.*")


def span_moves(surfaces: DataFrame, names: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, actor, side, move, score, gap) of surfaces(id, priority, match) in which a known name, の and a known move follow
    each other with little between them; of several the closest, then the first surface, then the first name.

    Names and moves are found once as spans; the relation is a join of the spans of one text.
    """
    texts = surfaces.select(F.struct("id", "priority", "match").alias("id"), F.col("match").alias("text"))
    label = {side: keys.select("key", F.col("label").alias(f"{side}_label")).dropDuplicates(["key"]) for side, keys in (("name", names), ("move", moves))}
    found = {side: dictionary_spans(texts, keys).join(label[side], "key") for side, keys in (("name", names), ("move", moves))}
    a = found["name"].select("id", F.col("start").alias("name_start"), F.col("end").alias("name_end"), "name_label")
    b = found["move"].select("id", F.col("start").alias("move_start"), "move_label")
    pairs = a.join(b, "id").where("name_end <= move_start")
    gap = F.substring("id.match", F.col("name_end") + 1, F.col("move_start") - F.col("name_end"))
    noise = F.length(F.replace(gap, F.lit("の"), F.lit("")))
    good = pairs.where(F.contains(gap, F.lit("の")) & (noise <= GAP_NOISE))
    score = F.greatest(F.lit(0.75), 1.0 - 0.04 * noise)
    side = F.when(F.substring("id.match", F.col("name_start") - len(OPPONENT) + 1, F.lit(len(OPPONENT))) == OPPONENT, "opponent")
    side = F.when(F.col("name_start") >= len(OPPONENT), side)
    best = good.select("id.id", F.struct(F.col("name_label").alias("actor"), side.alias("side"), F.col("move_label").alias("move"), score.alias("score"), gap.alias("gap")).alias("r"), F.struct(-score, F.col("id.priority"), "name_start", "move_start").alias("order"))
    return best.groupBy("id").agg(F.min_by("r", "order").alias("r")).select("id", "r.*")


def degraded_entries(messages: DataFrame, names: DataFrame) -> DataFrame:
    """(id, actor, score, call_score) of messages(id, normal, confidence) of which one part between exclamation marks is a worn
    call and the others hold exactly one known name.

    A call is two to five kana that end in けっ or けつ, or are similar to a call; one that is whole is left to the other stages.
    """
    parts = messages.where(F.col("confidence") >= CALL_CONFIDENCE).select("id", F.posexplode(F.split("normal", "!")).alias("nth", "part")).where(F.trim("part") != "")
    kana = F.regexp_replace("part", r"[^\p{IsHiragana}\p{IsKatakana}]", "")
    like = F.greatest(*[similarity(F.col("kana"), F.lit(c)) for c in CALLS])
    score = (
        F.when(~F.length("kana").between(2, 5) | F.col("kana").rlike("^(?:ゆけ|いけ)[っつ]?$"), 0.0)
        .when(F.col("kana").rlike(r"^[\p{IsHiragana}\p{IsKatakana}]?け[っつ]$"), 0.76)
        .otherwise(like)
    )
    rows = parts.withColumn("kana", kana).withColumn("call", score)
    rows = rows.withColumn("best", F.max("call").over(Window.partitionBy("id"))).where(F.col("best") >= CALL_LEAST)
    left = rows.where(F.col("call") < CALL_LEAST).select("id", "best", F.lower(F.regexp_replace("part", r"\s+", "")).alias("text"))
    found = match_entries(left.select("text"), names, 0.68, 0.62, 0.03).where("status = 'accepted'").select("text", "label", "score")
    one = left.join(found, "text").groupBy("id", F.col("best").alias("call_score")).agg(F.collect_set("label").alias("labels"), F.max("score").alias("score"))
    return one.where(F.size("labels") == 1).select("id", F.get("labels", F.lit(0)).alias("actor"), "score", "call_score")


def rule_events(found: DataFrame, stage: str) -> DataFrame:
    """Events of decoded(id, rule_id, event_type, slots, confidence, match): the first name is the actor, or the target of
    kinds that are said of one, a second name the target; a rank changes only for somebody."""
    def nth(kind: str, n: int) -> Column:
        return F.get(F.transform(F.filter("slots", lambda s: s["kind"] == kind), lambda s: s["label"]), F.lit(n))

    aimed = F.col("event_type").isin("supereffective", "resisted", "immune") & nth("name", 1).isNull()
    actor, target = F.when(~aimed, nth("name", 0)), F.when(aimed, nth("name", 0)).otherwise(nth("name", 1))
    told = F.concat(F.lit(f"{stage}:"), F.col("rule_id"), F.concat_ws("", F.transform("slots", lambda s: F.concat(F.lit(":"), s["kind"], F.lit("="), s["label"]))))
    rows = found.select(
        "id", F.lit(stage).alias("stage"), "event_type", F.col("rule_id").alias("reading"), actor.alias("actor"), beside_opponent(F.col("match"), actor).alias("side"),
        nth("move", 0).alias("move"), target.alias("target"), beside_opponent(F.col("match"), target).alias("target_side"), nth("text", 0).alias("stat"),
        "confidence", F.array(told).alias("evidence"), "match",
    )
    doubted = (F.col("event_type") == "move") & F.col("move").isNotNull() & unsafe_suffix(F.col("match"), F.lower("move"))
    return rows.where(~(F.col("event_type").isin("boost", "unboost") & F.col("actor").isNull()) & ~doubted).drop("match")


def stage_rows(found: DataFrame, stage: str, kind: Column | str, reading: str | Column, **columns: Column) -> DataFrame:
    """Rows of the cascade from those of a stage; what it doesn't tell is null."""
    given = {"id": F.col("id"), "stage": F.lit(stage), "event_type": F.lit(kind) if isinstance(kind, str) else kind, "reading": F.lit(reading) if isinstance(reading, str) else reading} | columns
    return found.select(*[F.coalesce(given.get(f.name, F.lit(None)).cast(f.dataType), F.lit(None)).alias(f.name) if f.name != "evidence" else given.get("evidence", F.array().cast("array<string>")).alias("evidence") for f in T.StructType.fromDDL(EVENT)])


def readings_of(messages: DataFrame, surfaces: DataFrame, rules: DataFrame, keys: DataFrame, tried: DataFrame, put: Put) -> DataFrame:
    """All readings of messages(id, normal, match, confidence) by all stages, columns as in EVENT. Each stage is written
    to the shared folder by itself, so no plan holds them all; the caller's result reads them.

    surfaces(id, priority, match) are the views of a message that rules, keywords and spans are tried on;
    rules(id, event_type, priority, patterns, constants) and keys(kind, entry_id, label, key) are the pack; tried is what the
    constrained decoder makes of them.
    """
    names, moves = (keys.where(F.col("kind") == k).drop("kind") for k in ("name", "move"))
    sure = messages.select("id", "confidence", F.col("match").alias("message"))
    said = messages.select("id", "match")
    views = surfaces.select("id", "priority", F.col("match").alias("text"))
    score, c = F.col("score"), F.col("confidence")

    def own(found: DataFrame) -> DataFrame:
        return found.join(sure, "id")

    context = context_events(surfaces.select("id", "priority", "match"), names)
    stages = [
        stage_rows(
            own(context), "context", F.col("event_type"), F.col("reading"), actor=F.col("actor"), target=F.col("target"), stat=F.col("stat"), confidence=combined(c, score),
            side=F.when(F.col("actor").isNotNull(), F.col("side")), target_side=F.when(F.col("target").isNotNull(), F.col("side")),
            evidence=F.array_compact(F.array(F.col("reading"), F.concat(F.lit("stat="), F.col("stat")), F.concat(F.lit("rank:"), F.col("degree")))),
        ),
        stage_rows(own(double_entries(said, names)), "double_entry", "switch_in", "switch_in_double", actor=F.col("label"), confidence=c, evidence=F.array(F.concat(F.lit("slot="), F.col("slot").cast("string")))),
        stage_rows(own(degraded_entries(messages, names)), "degraded_entry", "switch_in", "switch_in_degraded_call", actor=F.col("actor"), confidence=combined(c, score, F.col("call_score")), evidence=F.array(F.concat(F.lit("switch-in-degraded-call:score="), F.format_number("call_score", 2)))),
        rule_events(tried.where("accepted").join(sure.select("id", F.col("message").alias("match")), "id"), "constrained"),
        rule_events(decoded(views, rules, keys, as_list=True).join(sure.select("id", F.col("message").alias("match"), F.col("confidence").alias("own")), "id").withColumn("confidence", combined(F.col("own"), F.col("confidence"))), "template"),
        stage_rows(own(life_cost_events(said, names)), "life_cost", "damage", "hp_loss_life_cost", actor=F.col("label"), side=F.col("side"), confidence=c),
        stage_rows(own(move_splits(said, names, moves)), "move_split", "move", "attack_actor_move", actor=F.col("actor"), side=F.col("side"), move=F.col("move"), confidence=combined(c, score)),
        stage_rows(own(span_moves(surfaces, names, moves)), "move_span", "move", "attack_actor_move_span", actor=F.col("actor"), side=F.col("side"), move=F.col("move"), confidence=combined(c, score), evidence=F.array(F.concat(F.lit("span-relation:accepted;gap="), F.url_encode("gap")))),
        stage_rows(messages.where(entry_call(F.col("match"))), "entry_call", "switch_in", "switch_in_call", confidence=F.col("confidence")),
    ]
    out = None
    for name, rows in zip(STAGES, stages, strict=True):
        rows = put(rows, f"stage-{name}")
        out = rows if out is None else out.unionByName(rows)
    # A move whose message goes on in a particle is doubted, whichever stage read it.
    doubted = (F.col("event_type") == "move") & unsafe_suffix(F.col("message"), F.lower("move"))
    late = out.where(F.col("stage").isin("move_split", "move_span")).join(sure.select("id", "message"), "id").where(~doubted).drop("message")
    return out.where(~F.col("stage").isin("move_split", "move_span")).unionByName(late)


def cascade(messages: DataFrame, surfaces: DataFrame, rules: DataFrame, keys: DataFrame) -> DataFrame:
    """The events of each message by the first stage that reads it, and a row without event_type for each unread one.

    Several events of one stage stay together (two entries of one call). Unread messages list evidence: what the
    decoder rejected, and the actor of a message that stops behind it. A message without text is
    unread; confidence may be null.
    """
    ranks = F.create_map(*[F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)])
    with scratch(messages.sparkSession) as put:
        messages, surfaces = put(messages, "messages"), put(surfaces, "surfaces")
        views = surfaces.select("id", "priority", F.col("match").alias("text")).join(messages.select("id", "confidence"), "id")
        tried = constrained(views, compiled(rules), keys)
        read = readings_of(messages, surfaces, rules, keys, tried, put).withColumn("rank", F.element_at(ranks, F.col("stage")))
        first = read.withColumn("least", F.min("rank").over(Window.partitionBy("id"))).where("rank = least").drop("rank", "least")
        first = put(first, "events")
        review = F.concat(F.lit("constrained-review:"), F.col("reason"), F.lit(";constrained-candidate;"), F.col("candidate"))
        told = tried.where("NOT accepted").groupBy("id").agg(F.slice(F.sort_array(F.collect_set(review)), 1, MOST_EVIDENCE).alias("told"))
        unread = messages.join(first.select("id").distinct(), "id", "left_anti").join(told, "id", "left")
        evidence = F.array_compact(F.concat(F.coalesce("told", F.array().cast("array<string>")), F.array(partial_template(F.col("match")))))
        none = F.lit(None).cast("string")
        whole = written(first.unionByName(stage_rows(unread, "unknown", none, none, confidence=F.col("confidence"), evidence=evidence)), "cascade")
        removed(messages.sparkSession, tried)
        return whole


def once_each(log: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """read(texts) of log(id, ...), where texts has each row that differs in more than the id once, given back for every id.

    What read makes must be written by then, as by cascade: a log says the same things over and over, and its texts are few.
    """
    own = [c for c in log.columns if c != "id"]
    key = F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)
    asked = log.select("id", key.alias("asked"))
    with scratch(log.sparkSession) as put:
        texts = put(log.select(key.alias("id"), *own).distinct(), "texts")
        found = read(texts).withColumnRenamed("id", "asked")
    return asked.join(found, "asked").drop("asked")
