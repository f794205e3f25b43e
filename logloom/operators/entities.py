"""Dictionaries: fuzzy matching with score and margin, and exact spans in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.occurrences import SPANS, Keys, over_texts
from logloom.functions.text import similarity

#: A dictionary is broadcast only below this many keys; above, Spark chooses the join.
BROADCAST_KEYS = 50_000
#: Characters of all keys together up to which an automaton is broadcast (some 100 bytes each in a worker).
AUTOMATON_CHARS = 2_000_000


def dictionary_keys(entries: DataFrame) -> DataFrame:
    """(entry_id, label, key): one row for the label and each alias of entries(id, label, aliases)."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return entries.select(F.col("id").alias("entry_id"), "label", F.explode(names).alias("key"))


def sized(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def pieces_of(text: Column, size: Column, edits: Column) -> Column:
    """(n, k, start, length) of the edits + 1 pieces into which a key of so many characters is cut."""
    short = F.floor(size / (edits + 1))
    longer = size - short * (edits + 1)  # so many pieces at the end are one longer
    whole = edits + 1 - longer

    def piece(k: Column) -> Column:
        late = F.greatest(k - whole, F.lit(0))
        return F.struct(size.alias("n"), k.alias("k"), (k * short + late).alias("start"), (short + (k >= whole).cast("int")).alias("length"))

    return F.transform(F.sequence(F.lit(0), edits.cast("int")), piece)


def edit_candidates(texts: DataFrame, keys: DataFrame, least: float, band: int) -> DataFrame:
    """The pairs of texts(text, scope) and keys(key, scope, ...) that may have a similarity of at least least and
    whose lengths differ by at most band, each once.

    A similar pair differs by so few edits that one of edits + 1 pieces of the key stands in the text, shifted
    by no more than these edits. So pairs are joined on length, piece number and piece, however long the
    lists; no similar pair is missed. Keys too short to be cut are joined on all of the text.
    """
    def edits(size: Column) -> Column:
        return F.floor((1.0 - least) * size + 1e-9).cast("int")

    # The longer of both decides, and it is at most band longer than the key.
    size = F.length("key")
    allowed = F.least(edits(size + band), F.floor((1.0 - least) / least * size + 1e-9).cast("int"))
    cut = keys.withColumn("p", F.explode(pieces_of(F.col("key"), size, F.least(allowed, F.greatest(size - 1, F.lit(0))))))
    cut = cut.withColumns({"n": F.col("p.n"), "k": F.col("p.k"), "piece": F.substring("key", F.col("p.start") + 1, F.col("p.length")), "start": F.col("p.start")})
    shapes = cut.select("n", "k", "start", F.length("piece").alias("length"), F.least(allowed, F.lit(band + 100)).alias("reach")).distinct()
    # One row for each key length and piece: as many as the lengths allow, whatever the list.
    length = F.length("text")
    near = texts.join(F.broadcast(shapes), (F.abs(length - F.col("n")) <= band))
    first, last = F.greatest(F.col("start") - F.col("reach"), F.lit(0)), F.least(F.col("start") + F.col("reach"), length - F.col("length"))
    near = near.where(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    near = near.select("text", "scope", "n", "k", F.substring("text", F.col("at") + 1, F.col("length")).alias("piece"))
    found = near.distinct().join(cut.select(*keys.columns, "n", "k", "piece"), ["scope", "n", "k", "piece"])
    return found.select("text", *keys.columns).distinct()


def _scored(own: DataFrame, known: DataFrame, floor: float, band: int) -> DataFrame:
    """(text, scope, entry_id, label, score) of the entries that score at least floor by their best key."""
    pairs = edit_candidates(own, known, floor, band)
    apart = F.abs(F.length("text") - F.length("key"))
    raw = similarity(F.col("text"), F.col("key"))
    scored = pairs.withColumn("score", F.when(F.col("text") == F.col("key"), 1.0).otherwise(raw - 0.08 * F.greatest(apart - 1, F.lit(0))))
    return scored.where(F.col("score") >= floor).groupBy("text", "scope", "entry_id", "label").agg(F.max("score").alias("score"))


def scored_entries(texts: DataFrame, keys: DataFrame, floor: float, band: int, scope: str) -> DataFrame:
    """(scope column, text, entry_id, label, score) of all entries that match_entries would weigh at that floor."""
    at = F.col(scope).cast("string")
    own = texts.select("text", at.alias("scope")).where(F.col("text").isNotNull()).distinct()
    return _scored(own, keys.select("entry_id", "label", "key", at.alias("scope")), floor, band).withColumnRenamed("scope", scope)


def match_entries(texts: DataFrame, keys: DataFrame, accept: float = 0.84, review: float = 0.72, margin: float = 0.08, band: int = 4, scope: str | None = None) -> DataFrame:
    """The best entry for each distinct text of texts(text): status, label, score, margin, exact.

    An entry scores its best key of a length within the band, less .08 for each further character of
    length difference. Entries below the floor, the lesser of review and accept - margin, are no candidates: they
    change no status. The margin is that to the next entry, or to the floor if that is
    higher. Accepted: score and margin high enough; review: score high enough for that;
    an empty text or one without candidates isn't found. With a scope, a column of both tables,
    texts meet the keys of their scope only.
    """
    floor = min(review, accept - margin)
    at = F.col(scope).cast("string") if scope else F.lit("")
    own = texts.select(*([scope] if scope else []), "text", at.alias("scope")).where(F.col("text").isNotNull()).distinct()
    entries = _scored(own.select("text", "scope"), keys.select("entry_id", "label", "key", at.alias("scope")), floor, band)
    by = Window.partitionBy("text", "scope").orderBy(F.desc("score"), "entry_id")
    ranked = entries.select("*", F.row_number().over(by).alias("place"), F.lead("score").over(by).alias("second"), F.lead("label").over(by).alias("second_label"))
    best = ranked.where(F.col("place") == 1).withColumn("margin", F.col("score") - F.coalesce("second", F.lit(floor)))
    status = (
        F.when(F.col("score") >= 1.0, "accepted")
        .when((F.col("score") >= accept) & (F.col("margin") >= margin - 1e-9), "accepted")
        .when(F.col("score") >= review, "review")
        .otherwise("not_found")
    )
    found = best.select("text", "scope", "entry_id", "label", "score", "margin", "second_label", status.alias("status"))
    out = own.join(found, ["text", "scope"], "left").withColumn("status", F.coalesce("status", F.lit("not_found")))
    return out.drop("scope")


def prioritized_match(texts: DataFrame, session: DataFrame, keys: DataFrame, scope: str, lenient: tuple[float, float, float] = (0.62, 0.54, 0.02), strict: tuple[float, float, float] = (0.78, 0.7, 0.06)) -> DataFrame:
    """The match of each distinct (scope, text): that of the session's own keys if they accept it, by thresholds
    (accept, review, margin) that are lenient as these are few, else that of all keys by strict ones.

    session(scope, entry_id, label, key) holds what a battle has shown so far. evidence lists what either side found.
    """
    own = match_entries(texts, session, *lenient, scope=scope)
    rest = match_entries(texts.select("text"), keys, *strict)

    def told(side: str) -> Column:
        return F.concat_ws(":", F.lit(side), F.coalesce("label", F.lit("-")), "status", F.coalesce(F.format_number("score", 2), F.lit("--")))

    own = own.withColumn("told", told("session"))
    rest = rest.withColumn("told", told("global")).select("text", *[F.col(c).alias(f"g_{c}") for c in ("entry_id", "label", "score", "margin", "status", "told")])
    both = own.join(rest, "text")
    mine = F.col("status") == "accepted"
    return both.select(
        scope, "text", *[F.when(mine, F.col(c)).otherwise(F.col(f"g_{c}")).alias(c) for c in ("entry_id", "label", "score", "margin", "status")],
        F.when(mine, "session").otherwise("global").alias("matched_in"), F.when(mine, F.array("told")).otherwise(F.array("told", "g_told")).alias("evidence"),
    )


def dictionary_spans(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Occurrences (id, start, end, key) of keys in texts(id, text): longest first, then earliest, without overlaps.

    Keys of together at most AUTOMATON_CHARS characters are broadcast and looked for all at once, in one pass over each
    text; beyond, texts meet keys by joins on the first two characters. Empty and null keys and texts have none.
    """
    known = keys.select("key").where(F.length("key") > 0).distinct()
    if known.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0] > AUTOMATON_CHARS:
        return joined_spans(texts, known)
    spans = over_texts(texts.sparkSession, Keys([r.key for r in known.collect()]), SPANS, Keys.spans)
    return texts.select("id", F.explode(spans(F.col("text"))).alias("s")).select("id", "s.start", "s.end", "s.key")


def joined_spans(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The same by joins: texts meet keys on their first two characters (one, for keys of one), which every
    occurrence has; the greedy choice is a fold over the few occurrences of one text."""
    starts = texts.select("id", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))).alias("start"))
    heads = F.array_distinct(F.array(F.substring("text", F.col("start"), F.lit(2)), F.substring("text", F.col("start"), F.lit(1))))
    starts = starts.withColumn("head", F.explode(heads))
    hits = starts.join(keys.withColumn("head", F.substring("key", 1, 2)), "head").where(F.substring("text", F.col("start"), F.length("key")) == F.col("key"))
    span = F.struct((-F.length("key")).alias("order"), F.col("start"), (F.col("start") + F.length("key")).alias("end"), F.col("key"))
    one = hits.groupBy("id").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    kept = F.aggregate(
        "spans",
        F.filter("spans", lambda s: F.lit(False)),
        lambda got, s: F.when(F.exists(got, lambda g: (s["start"] < g["end"]) & (g["start"] < s["end"])), got).otherwise(F.concat(got, F.array(s))),
    )
    return one.select("id", F.explode(kept).alias("s")).select("id", (F.col("s.start") - 1).alias("start"), (F.col("s.end") - 1).alias("end"), "s.key")
