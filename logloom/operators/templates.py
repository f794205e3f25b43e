"""Message templates as data: rules are rows, matching is a join, slots are regex groups.

A pattern such as "{name}の{move}" becomes a regular expression with one group for each
placeholder and, as join key, its longest literal. Messages meet only the rules whose
literal they contain; slots are then resolved against dictionaries by equi-joins
on the captured text, exact first, similar second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import normalize_text, similarity, squeezed
from logloom.operators.entities import dictionary_spans, match_entries, sized
from logloom.sources.shared import scratch, written
from logloom.views import let

OPPONENT = "相手の"
MARK = r"\{([a-z]+)(?:\[[0-9]+\])?\}"
#: Longest captured text of a slot.
SLOT = 18
#: Ids of several rows that may be broadcast; more are joined by shuffles.
BROADCAST_IDS = 200_000


def compiled(rules: DataFrame) -> DataFrame:
    """One row for each pattern of rules(id, event_type, priority, patterns, constants): pattern as
    regex, names of its slots in order, its literals, the longest of them, its first two
    characters (one if it has no more)."""
    # Constants travel as JSON text, which can be compared and grouped.
    rows = rules.select("id", "event_type", "priority", F.to_json("constants").alias("constants"), F.explode("patterns").alias("pattern"))
    literals = F.filter(F.split("pattern", MARK), lambda x: F.length(x) > 0)
    quoted = F.regexp_replace("pattern", r"([\\.\[\]()*+?^$|])", r"\\$1")
    rows = rows.withColumn("literals", F.split("pattern", MARK)).withColumn("slots", F.regexp_extract_all("pattern", F.lit(MARK), F.lit(1)))
    rows = rows.withColumn("regex", F.regexp_replace(quoted, r"\{[a-z]+(?:\\\[[0-9]+\\\])?\}", f"(.{{1,{SLOT}}}?)"))
    longest = F.array_max(F.transform(literals, lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))["t"]
    return rows.withColumn("anchor", longest).where(F.length("anchor") >= 1).withColumn("head", F.substring("anchor", 1, 2))


def template_hits(surfaces: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, rule_id, event_type, priority, constants, hit, slots, values): each rule pattern that a
    text of surfaces(id, text) matches, with what its slots caught; hit tells the matches apart.

    The join key is the head of the pattern's longest literal, looked up at every
    position of the text, so a text isn't held against every rule.
    """
    places = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    cut = F.flatten(F.transform(places, lambda at: F.array(F.substring(F.col("text"), at, F.lit(2)), F.substring(F.col("text"), at, F.lit(1)))))
    heads = surfaces.select("id", "text", F.explode(F.array_distinct(cut)).alias("head"))
    near = heads.join(sized(patterns.withColumnRenamed("id", "rule_id").withColumnRenamed("head", "p_head")), F.col("head") == F.col("p_head"))
    whole = F.concat(F.lit("^.{0,3}?"), F.col("regex"), F.lit("[!。]?$"))
    hits = near.where(F.contains("text", F.col("anchor")) & F.regexp_like(F.col("text"), whole))
    caught = F.transform(F.sequence(F.lit(1), F.greatest(F.size("slots"), F.lit(1))), lambda k: F.call_function("regexp_extract", F.col("text"), whole, k))
    found = hits.select(
        "id", "rule_id", "event_type", "priority", "constants", "regex", "slots",
        F.when(F.size("slots") > 0, caught).otherwise(F.array().cast("array<string>")).alias("values"),
    )
    return found.withColumn("hit", F.concat_ws("\x1f", "regex", "values")).drop("regex").distinct()


def resolved_hits(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """The hits with each dictionary slot's label, score and status; free text slots stay as caught.

    keys(kind, entry_id, label, key) hold the dictionaries of all slot kinds. Distinct
    captured texts are matched once, whatever number of messages they come from.
    """
    slots = hits.select("id", "rule_id", "event_type", "priority", "constants", "hit", F.posexplode(F.arrays_zip(F.col("slots").alias("kind"), F.col("values").alias("value"))).alias("pos", "slot"))
    slots = slots.select("id", "rule_id", "event_type", "priority", "constants", "hit", "pos", "slot.kind", "slot.value")
    known = keys.select(F.col("kind").alias("known_kind")).distinct()
    found = match_entries(slots.select("kind", F.col("value").alias("text")), keys, scope="kind").withColumnRenamed("kind", "slot_kind")
    joined = slots.join(found, (slots["kind"] == found["slot_kind"]) & (slots["value"] == found["text"]), "left")
    joined = joined.join(F.broadcast(known), joined["kind"] == known["known_kind"], "left")  # as many rows as kinds of slots
    free = F.col("known_kind").isNull()
    return joined.select(
        "id", "rule_id", "event_type", "priority", "constants", "hit", "pos", "kind", "value",
        F.when(free, F.col("value")).otherwise(F.col("label")).alias("label"),
        F.when(free, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(free, "accepted").otherwise(F.coalesce("status", F.lit("not_found"))).alias("status"),
    )


def decoded(surfaces: DataFrame, rules: DataFrame, keys: DataFrame, as_list: bool = False) -> DataFrame:
    """The best event of each message: id, rule_id, event_type, found (map of slot to label) or, as a list, slots
    (pos, kind, label), confidence.

    A rule counts if all its slots are accepted. Order: priority, mean score, rule id.
    Messages without one are left out (see the gate for what becomes of them).
    """
    patterns = compiled(rules)
    hits = template_hits(surfaces, patterns)
    slotless = hits.where(F.size("slots") == 0).select("id", "rule_id", "event_type", "priority", "hit", "constants", F.lit(1.0).alias("confidence"), F.array().cast("array<struct<pos:int,kind:string,label:string>>").alias("slots"))
    by_slot = resolved_hits(hits.where(F.size("slots") > 0), keys)
    whole = by_slot.groupBy("id", "rule_id", "event_type", "priority", "hit").agg(
        F.first("constants").alias("constants"),
        F.avg("score").alias("confidence"),
        F.bool_and(F.col("status") == "accepted").alias("sure"),
        F.sort_array(F.collect_set(F.struct("pos", "kind", "label"))).alias("slots"),
    )
    every = whole.where("sure").drop("sure").unionByName(slotless)
    by = Window.partitionBy("id").orderBy(F.desc("priority"), F.desc("confidence"), "rule_id", "hit")
    best = every.withColumn("place", F.row_number().over(by)).where(F.col("place") == 1).drop("place", "hit")
    if as_list:
        return best
    named = F.transform("slots", lambda s: F.struct(F.concat_ws("_", s["kind"], s["pos"].cast("string")), s["label"]))
    return best.withColumn("found", F.map_from_entries(named)).drop("slots")


# The constrained decoder's bounds and weights.
LITERAL_LEAST, FINAL_LEAST, MARGIN_LEAST, FUZZY_CONFIDENCE = 0.62, 0.72, 0.04, 0.65
AHEAD_FIRST, AHEAD_LATER, SEGMENT = 32, 4, 24
WEIGHTS = {"literal": 0.35, "slots": 0.45, "confidence": 0.15, "surface": 0.05}
UNKNOWN_CONFIDENCE = 0.75


def literal_places(surfaces: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, priority, rule_id, regex, nth, start, end, likeness): where each literal of a pattern stands in a text, word for word or
    nearly (a stretch of its length, or one more or less, that is similar enough).

    Only patterns whose longest literal has a two-character piece in common with the text are looked at.
    """
    size = F.length("text")
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: F.substring(F.col("text"), k, F.lit(2))))
    heads = surfaces.select("id", "priority", "text", "confidence", F.explode(cut).alias("piece"))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("anchor") - 1, F.lit(1))), lambda k: F.substring(F.col("anchor"), k, F.lit(2))))
    known = patterns.select(F.col("id").alias("rule_id"), "event_type", F.col("priority").alias("rule_priority"), "regex", "literals", F.explode(own).alias("piece"))
    near = heads.join(sized(known), "piece").drop("piece").distinct()
    each = near.select("id", "priority", "text", "rule_id", "regex", F.posexplode("literals").alias("nth", "literal")).where("literal <> ''")
    spans = F.flatten(F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda d: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("text") - F.length("literal") - d + 1, F.lit(1))),
        lambda at: F.struct(at.alias("at"), F.substring(F.col("text"), at, F.length("literal") + d).alias("part")),
    )))
    each = each.select("id", "priority", "rule_id", "regex", "nth", "literal", F.explode(spans).alias("s"))
    likeness = similarity(F.col("s.part"), F.col("literal"))
    each = each.select("id", "priority", "rule_id", "regex", "nth", (F.col("s.at") - 1).alias("start"), (F.col("s.at") - 1 + F.length("s.part")).alias("end"), likeness.alias("likeness")).where((F.col("likeness") >= LITERAL_LEAST) & (F.col("end") > F.col("start")))
    # A stretch beside a better one of the same literal tells nothing new.
    by = Window.partitionBy("id", "priority", "rule_id", "regex", "nth", "start").orderBy(F.desc("likeness"), "end")
    return each.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def constrained(surfaces: DataFrame, patterns: DataFrame, keys: DataFrame) -> DataFrame:
    """Readings of surfaces(id, priority, text, confidence) by patterns whose literals and slots may both be worn:
    id, rule_id, event_type, slots, confidence, accepted, reason, candidate; the best of each message.

    The literals of a pattern are chained by joins, each behind the one before and not too far away; what lies between is a
    slot. Slots are resolved once for each distinct text: a known name inside it scores by how much of it it is,
    a similar one by its likeness. A reading is accepted if its score and its lead over the next different one
    are high enough; one with a worn literal or slot also needs a good confidence of the text. The result
    is written to the shared folder, the tables on the way are removed.
    """
    with scratch(surfaces.sparkSession) as put:
        return written(_constrained(surfaces, patterns, keys, put), "constrained")


def _constrained(surfaces: DataFrame, patterns: DataFrame, keys: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    places = put(literal_places(surfaces, patterns), "literals")
    shape = patterns.select(F.col("id").alias("rule_id"), "event_type", F.col("priority").alias("rule_priority"), "regex", "literals", F.col("slots").alias("kinds"))
    # Patterns have a handful of literals.
    most = (patterns.select(F.max(F.size("literals"))).first() or [0])[0] or 0
    texts = surfaces.select("id", "priority", "text", "confidence")
    grown = texts.join(places.select("id", "priority", "rule_id", "regex").distinct(), ["id", "priority"]).join(F.broadcast(shape), ["rule_id", "regex"])
    grown = grown.withColumns({"at": F.lit(0), "worn": F.lit(1.0), "cuts": F.array().cast("array<struct<from:int,to:int>>")})
    for k in range(most):
        here = places.where(F.col("nth") == k).select("id", "priority", "rule_id", "regex", F.col("start").alias("s"), F.col("end").alias("e"), "likeness")
        literal = F.get("literals", F.lit(k))
        with_text = grown.where(literal != "").join(here, ["id", "priority", "rule_id", "regex"])
        slot = F.struct(F.col("at").alias("from"), F.col("s").cast("int").alias("to"))
        between = F.col("s") - F.col("at")
        fits = F.when(F.lit(k == 0), between <= AHEAD_LATER).otherwise(between.between(1, AHEAD_FIRST))
        chained = with_text.where(fits).withColumns({"cuts": F.when(F.lit(k > 0), F.concat("cuts", F.array(slot))).otherwise(F.col("cuts")), "at": F.col("e").cast("int"), "worn": F.least("worn", "likeness")}).drop("s", "e", "likeness")
        # No literal at this place: a slot at the very start (nothing to do) or at the very end.
        last = F.struct(F.col("at").alias("from"), F.length("text").alias("to"))
        open_end = grown.where(literal == "").withColumn("cuts", F.when(F.lit(k > 0), F.concat("cuts", F.array(last))).otherwise(F.col("cuts"))).withColumn("at", F.when(F.lit(k > 0), F.length("text")).otherwise(F.col("at")))
        done = grown.where(literal.isNull())
        grown = chained.unionByName(open_end.select(chained.columns)).unionByName(done.select(chained.columns))
    # Little may follow the last literal; a pattern that begins with a slot has it in front of its first literal.
    grown = grown.where((F.length("text") - F.col("at") <= 10) & (F.size("cuts") == F.size("kinds")))
    values = F.transform("cuts", lambda c: F.substring(F.col("text"), c["from"] + 1, c["to"] - c["from"]))
    grown = grown.where(F.forall("cuts", lambda c: (c["to"] - c["from"]).between(1, SEGMENT)))
    grown = grown.withColumn("hit", F.sha2(F.concat_ws("\x1f", "id", F.col("priority").cast("string"), "rule_id", "regex", F.to_json("cuts"), F.col("worn").cast("string")), 256))
    wide = put(grown.select("id", "priority", "rule_id", "event_type", "rule_priority", "confidence", "worn", "hit", "kinds", values.alias("values")).dropDuplicates(["hit"]), "chains")
    slots = wide.select("hit", F.posexplode(F.arrays_zip(F.col("kinds").alias("kind"), F.col("values").alias("value"))).alias("pos", "s")).select("hit", "pos", "s.kind", "s.value")
    known = keys.select(F.col("kind").alias("known_kind")).distinct()
    asked = slots.select("kind", F.col("value").alias("text")).distinct()
    spans = dictionary_spans(asked.select(F.struct("kind", "text").alias("id"), "text"), keys)
    inside = spans.select("id.kind", "id.text", "key").join(keys.select("kind", "key", F.col("label").alias("held")).dropDuplicates(["kind", "key"]), ["kind", "key"])
    inside = inside.groupBy("kind", "text").agg(F.max_by(F.struct("held", (0.92 + 0.08 * F.length("key") / F.length("text")).alias("held_score")), F.struct(F.length("key"), "key")).alias("h")).select("kind", "text", "h.*")
    like = match_entries(asked, keys, 0.78, 0.7, 0.06, scope="kind").select("kind", "text", F.col("label").alias("like"), F.col("score").alias("like_score"), F.col("status"))
    solved = asked.join(like, ["kind", "text"], "left").join(inside, ["kind", "text"], "left").join(F.broadcast(known), F.col("kind") == F.col("known_kind"), "left")
    free = F.col("known_kind").isNull()
    exact = F.coalesce(F.col("held_score"), F.lit(0.0)) >= F.coalesce("like_score", F.lit(0.0))
    solved = put(solved.select(
        "kind", F.col("text").alias("value"),
        F.when(free, F.col("text")).when(exact, F.col("held")).when(F.col("status") == "accepted", F.col("like")).alias("label"),
        F.when(free, 1.0).when(exact, F.col("held_score")).when(F.col("status") == "accepted", F.col("like_score")).otherwise(0.0).alias("score"),
        (~free & ~exact).alias("fuzzy"),
    ), "slots")
    by_hit = slots.join(solved, ["kind", "value"]).groupBy("hit").agg(F.avg("score").alias("slot_score"), F.sum(F.col("fuzzy").cast("int")).alias("fuzzy"), F.bool_and(F.col("label").isNotNull()).alias("whole"), F.sort_array(F.collect_list(F.struct("pos", "kind", "label"))).alias("slots"))
    rows = wide.drop("kinds", "values").join(by_hit, "hit", "left").withColumns({"whole": F.coalesce("whole", F.lit(True)), "fuzzy": F.coalesce("fuzzy", F.lit(0)), "slot_score": F.coalesce("slot_score", F.lit(1.0)), "slots": F.coalesce("slots", F.array().cast("array<struct<pos:int,kind:string,label:string>>"))})
    final = WEIGHTS["literal"] * F.col("worn") + WEIGHTS["slots"] * F.col("slot_score") + WEIGHTS["confidence"] * F.coalesce("confidence", F.lit(UNKNOWN_CONFIDENCE)) + WEIGHTS["surface"] * (1.0 / (1.0 + F.col("priority")))
    told = F.concat_ws(";", F.concat(F.lit("rule="), F.col("rule_id")), F.transform("slots", lambda s: F.concat(s["kind"], F.lit("="), F.coalesce(F.url_encode(s["label"]), F.lit("")))))
    rows = rows.withColumns({"final": final, "candidate": told})
    best = rows.groupBy("id", "candidate").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in ("id", "candidate")]), F.struct("final", "hit")).alias("b")).select("id", "candidate", "b.*")
    by = Window.partitionBy("id").orderBy(F.desc("whole"), F.desc("final"), F.desc("rule_priority"), "candidate")
    ranked = best.withColumns({"place": F.row_number().over(by), "next": F.lead("final").over(by), "next_whole": F.lead("whole").over(by)}).where("place = 1")
    lead = F.col("final") - F.when(F.col("next_whole"), F.col("next")).otherwise(0.0)
    worn = (F.col("worn") < 1.0) | (F.col("fuzzy") > 0)
    reason = (
        F.when(~F.col("whole"), "slot")
        .when(F.col("final") < FINAL_LEAST, "score")
        .when(F.coalesce(lead, F.lit(1.0)) < MARGIN_LEAST, "margin")
        .when(worn & (F.coalesce("confidence", F.lit(0.0)) < FUZZY_CONFIDENCE), "confidence")
        .when((F.col("fuzzy") >= 2) & ((F.col("confidence") < 0.78) | (F.coalesce(lead, F.lit(1.0)) < 0.08)), "two_fuzzy")
        .when((F.col("fuzzy") == 1) & (F.coalesce(lead, F.lit(1.0)) < 0.06), "one_fuzzy")
    )
    return ranked.select("id", "rule_id", "event_type", "slots", F.least("confidence", "slot_score", "worn").alias("confidence"), reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"), "candidate")


def surfaces_of(messages: DataFrame) -> DataFrame:
    """The views of messages(id, text) with line breaks that templates are tried on: the whole,
    each line, two and three lines together; equal texts once, with the least priority.

    Views of a row are told apart within the row; only those of ids that several rows have are grouped by a shuffle."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    n = F.size("lines")
    cut = messages.select("id", lines.alias("lines"))

    def windows(size: int, base: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct((k + base).alias("priority"), F.array_join(F.slice(F.col("lines"), k + 1, size), "").alias("text")))

    whole = F.array(F.struct(F.lit(0).alias("priority"), F.array_join("lines", "").alias("text")))
    views = F.transform(F.concat(whole, windows(2, 12), windows(3, 13), windows(1, 20)), lambda v: F.struct(v["text"], v["priority"]))
    once = let(F.sort_array(views), lambda vs: F.filter(vs, lambda v, k: (k == 0) | (F.get(vs, k - 1)["text"] != v["text"])))
    shown = lambda rows: rows.select("id", F.explode(once).alias("v")).select("id", "v.*")
    again = messages.groupBy(F.col("id").alias("again")).count().where("count > 1").select("again")
    repeated = again.count()
    if not repeated:
        return shown(cut)
    again = F.broadcast(again) if repeated <= BROADCAST_IDS else again
    same = F.col("id").eqNullSafe(F.col("again"))
    grouped = shown(cut.join(again, same, "left_semi")).groupBy("id", "text").agg(F.min("priority").alias("priority"))
    return shown(cut.join(again, same, "left_anti")).unionByName(grouped)


#: Characters of noise that may follow a message.
NOISE = 10


def match_surfaces(views: DataFrame) -> DataFrame:
    """(id, priority, match) of views(id, priority, text), as surfaces_of makes them, with more of each: what stands up to an exclamation
    mark behind which little follows, the text without a short last word, and, of all these, what begins at the
    mark of the other side. Equal match texts of a message once, with the least priority."""
    rows = views.select("id", "priority", normalize_text("text").alias("normal"))
    parts = F.split("normal", "!")
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.struct(
        F.trim(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "!"), F.lit("!"))).alias("text"), F.trim(F.array_join(F.slice(parts, k + 1, F.size(parts)), "!")).alias("rest"),
    ))
    ended = F.filter(upto, lambda v: (F.size(parts) > 1) & (v["text"] != "!") & (v["rest"] != "") & (F.length(squeezed(v["rest"])) <= NOISE))
    ended = F.transform(ended, lambda v, k: F.struct((F.lit(30) + k).alias("more"), v["text"].alias("text")))
    short = F.regexp_extract("normal", "^(.+?)[\\s\u3000]+[A-Za-z0-9ぁ-んァ-ヶー一-龯]{1,10}$", 1)
    trimmed = F.filter(F.array(F.struct(F.lit(34).alias("more"), short.alias("text"))), lambda v: v["text"] != "")
    own = F.array(F.struct(F.lit(0).alias("more"), F.col("normal").alias("text")))
    every = rows.select("id", "priority", F.explode(F.concat(own, ended, trimmed)).alias("v"))
    every = every.select("id", (F.col("priority") + F.col("v.more")).alias("priority"), squeezed(F.col("v.text")).alias("match"))
    at = F.instr("match", OPPONENT)
    behind = every.where(at > 1).select("id", (F.col("priority") + 40).alias("priority"), F.substring("match", at, F.length("match")).alias("match"))
    return every.unionByName(behind).where("match <> ''").groupBy("id", "match").agg(F.min("priority").alias("priority")).select("id", "priority", "match")


def typed_placeholders(texts: Column, policy: Column) -> Column:
    """Replace {0}, {1}, ... by the names in the array policy, the last one for those beyond it."""
    numbers = F.transform(F.regexp_extract_all(texts, F.lit(r"\{([0-9]+)\}"), F.lit(1)), lambda d: d.cast("int"))
    return F.aggregate(
        F.array_distinct(numbers),
        texts,
        lambda out, k: F.replace(out, F.concat(F.lit("{"), k.cast("string"), F.lit("}")), F.concat(F.lit("{"), F.element_at(policy, F.least(k + 1, F.size(policy))), F.lit("}"))),
    )


def select_reading(readings: DataFrame) -> DataFrame:
    """One reading of each job of readings(job_id, reading_id, event_type, slots, method, confidence, length, bundle).

    Events score above unknowns; two strong events that differ are a conflict, and the job
    becomes unknown; a weak event is held back as unknown too.
    """
    methods = F.create_map(*[F.lit(x) for p in (("template", 18), ("dictionary", 14), ("relation", 7), ("context", 3)) for x in p])
    sure = F.coalesce("confidence", F.lit(0.0))
    event = F.col("event_type").isNotNull()
    score = F.when(event, 100 + 24 * F.col("slots") + F.coalesce(F.element_at(methods, F.col("method")), F.lit(0)) + 10 * sure + F.least(F.lit(10.0), F.col("length") / 3)).otherwise(F.least(F.lit(30), F.col("length")) + 5 * sure)
    strong = event & (F.col("slots") >= 1) & F.col("method").isin("template", "dictionary") & (sure >= 0.6)
    rows = readings.withColumns({"score": score, "strong": strong})
    by = Window.partitionBy("job_id")
    rows = rows.withColumn("bundles", F.size(F.collect_set(F.when(F.col("strong"), F.col("bundle"))).over(by)))
    rows = rows.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "reading_id"))).where(F.col("place") == 1)
    outcome = F.when(F.col("bundles") > 1, "conflict").when(F.col("strong"), "event").when(F.col("event_type").isNotNull(), "held").otherwise("unknown")
    return rows.select("job_id", "reading_id", "score", outcome.alias("outcome"))
