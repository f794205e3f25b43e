"""The life of an observation as a fold over its change log, and look-ups among texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import similarity

# Failure reasons by rising priority.
REASONS = {"ocr_busy": 1, "no_ocr_attempt": 2, "preprocess_rejected": 3, "density_rejected": 3, "ocr_empty": 4, "ocr_deferred_dropped": 5, "ocr_timeout": 6, "ocr_error": 7, "parser_unknown": 8}


def strict_fallback(lines: Column, components: Column, largest: Column, warmed: Column, commit: Column, presence: Column, overlap: Column, dynamic: Column) -> Column:
    """Whether a picture alone is good enough to be read: its shape, and one of two sets of thresholds."""
    shape = (lines >= 1) & (components >= 2) & (largest <= 0.55)
    cold = (commit >= 0.97) & (presence >= 0.95)
    warm = (commit >= 0.94) & (presence >= 0.9) & (overlap <= 0.35) & (dynamic >= 0.65)
    return shape & F.when(warmed, warm).otherwise(cold)


def folded(changes: DataFrame) -> DataFrame:
    """The last state of each observation from changes(observation_id, seq, kind, value, ts).

    Kinds: opened, closed, attempt, failed (value: reason), event, unknown (value: id), suppressed
    (value: reason), message. Resolved is final; every attribute is one aggregate, so
    no observation's log is collected.
    """
    priorities = F.create_map(*[F.lit(x) for p in REASONS.items() for x in p])
    kind, value = F.col("kind"), F.col("value")

    def last(of: str) -> Column:
        return F.max_by(F.when(kind == of, value), F.when(kind == of, F.col("seq")))

    rank = F.struct(F.coalesce(F.element_at(priorities, value), F.lit(0)), F.col("seq"))
    out = changes.groupBy("observation_id").agg(
        F.min(F.when(kind == "opened", F.col("ts"))).alias("opened_ms"),
        F.max(F.when(kind == "closed", F.col("ts"))).alias("closed_ms"),
        F.count(F.when(kind == "attempt", 1)).alias("attempts"),
        F.count(F.when(kind == "message", 1)).alias("messages"),
        F.count(F.when(kind == "event", 1)).alias("events"),
        F.count(F.when(kind == "unknown", 1)).alias("unknowns"),
        F.max_by(F.when(kind == "failed", value), F.when(kind == "failed", rank)).alias("failure"),
        last("suppressed").alias("suppression"),
    )
    return out


def settled(states: DataFrame, pending: Column, strong: Column) -> DataFrame:
    """Resolution, disposition and failure of folded states: resolved with events, review with unknowns,
    and once closed with nothing pending unread, shown or not by what was seen."""
    done = F.col("closed_ms").isNotNull() & (pending == 0)
    unread = done & (F.col("events") == 0) & (F.col("unknowns") == 0)
    usable = F.col("messages") > 0
    resolution = F.when(F.col("events") > 0, "resolved").when(F.col("unknowns") > 0, "ocr_unknown").when(unread, "unread").otherwise("pending")
    gated = F.coalesce(F.col("suppression") == "phase_gate", F.lit(False))
    disposition = (
        F.when(F.col("events") > 0, "primary")
        .when(F.col("unknowns") > 0, "review")
        .when(unread & usable & ~strong, "suppressed")
        .when(unread & ~usable & gated, "suppressed")
        .when(unread, "primary")
        .otherwise(F.when(F.col("suppression").isNotNull(), "suppressed").otherwise("primary"))
    )
    failure = F.when(unread & usable, "parser_unknown").when(unread, F.coalesce("failure", F.when(F.col("attempts") > 0, "ocr_empty").otherwise("no_ocr_attempt"))).otherwise(F.col("failure"))
    return states.withColumns({"resolution": resolution, "disposition": disposition, "failure": failure})


def best_text_similarity(a: Column, b: Column) -> Column:
    """The greatest similarity between a text of a and a text of b; 0 if one of them is empty."""
    each = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: similarity(x, y))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def bundle_signature(parts: Column) -> Column:
    """The sorted distinct parts of a bundle, one a line."""
    return F.array_join(F.array_sort(F.array_distinct(parts)), "\n")


def coverage_candidates(messages: DataFrame, index: DataFrame, least: float = 0.68, n: int = 5) -> DataFrame:
    """Up to n source texts of index(source, priority, skeleton) for each message(id, match): one
    contains the other (.94, .90) or they are similar enough; by priority, then score. Empty texts match nothing.

    Distinct texts meet over their rarest two-character pieces (a text of one character over itself). A
    text that is contained in another has its rarest piece there. Similar texts share so many pieces that the
    rarest ones of either side, all but so many, share one. So a piece that everyone has pairs nobody.
    """
    own = messages.select(F.col("match").alias("text")).where("text <> ''").distinct()
    theirs = index.select(F.col("skeleton").alias("text")).where("text <> ''").distinct()

    def pieces(rows: DataFrame) -> DataFrame:
        """(text, piece, nth): repeated pieces of a text are told apart by their number."""
        size = F.length("text")
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: F.substring(F.col("text"), k, F.lit(2)))
        spread = rows.select("text", F.explode(pairs).alias("piece"))
        by = Window.partitionBy("text", "piece").orderBy("piece")
        return spread.withColumn("nth", F.row_number().over(by))

    mine, known = pieces(own), pieces(theirs)
    often = mine.unionByName(known).groupBy("piece").agg(F.count("*").alias("often"))

    def by_rarity(rows: DataFrame) -> DataFrame:
        rare = Window.partitionBy("text").orderBy("often", "piece", "nth")
        # Of L characters an edit takes two pieces at most: so many pieces of a similar text stay.
        stay = F.greatest(F.ceil((2.0 * least - 1.0) * F.length("text") - 1e-9) - 1, F.lit(1))
        ranked = rows.join(often, "piece").withColumn("place", F.row_number().over(rare))
        return ranked.withColumn("prefix", F.greatest(F.length("text") - 1, F.lit(1)) - stay + 1)

    mine, known = by_rarity(mine), by_rarity(known)
    a, b = mine.withColumnRenamed("text", "match"), known.withColumnRenamed("text", "skeleton")
    near = a.where("place <= prefix").select("match", "piece", "nth").join(b.where("place <= prefix").select("skeleton", "piece", "nth"), ["piece", "nth"])
    short, long = F.least(F.length("match"), F.length("skeleton")), F.greatest(F.length("match"), F.length("skeleton"))
    near = near.where(short >= least * long - 1e-9)
    inside = a.where("place = 1").select("match", "piece").join(b.where("nth = 1").select("skeleton", "piece"), "piece").where(F.contains("skeleton", F.col("match")))
    around = a.where("nth = 1").select("match", "piece").join(b.where("place = 1").select("skeleton", "piece"), "piece").where(F.contains("match", F.col("skeleton")))

    def one_character(short_rows: DataFrame, of: str, long_rows: DataFrame, name: str) -> DataFrame:
        chars = long_rows.select(F.col("text").alias(name), F.explode(F.array_distinct(F.split("text", ""))).alias("piece"))
        return short_rows.where(F.length("text") == 1).select(F.col("text").alias(of), F.col("text").alias("piece")).join(chars, "piece")

    alone = one_character(own, "match", theirs, "skeleton").unionByName(one_character(theirs, "skeleton", own, "match"), allowMissingColumns=False)
    pairs = near.select("match", "skeleton").unionByName(inside.select("match", "skeleton")).unionByName(around.select("match", "skeleton")).unionByName(alone.select("match", "skeleton")).distinct()
    score = (
        F.when(F.contains("match", F.col("skeleton")), 0.94)
        .when(F.contains("skeleton", F.col("match")), 0.90)
        .otherwise(similarity(F.col("match"), F.col("skeleton")))
    )
    scored = pairs.withColumn("score", score).where(F.col("score") >= least)
    every = messages.select("id", "match").join(scored, "match").join(index.select("source", "priority", "skeleton").distinct(), "skeleton")
    by = Window.partitionBy("id").orderBy("priority", F.desc("score"), "source")
    return every.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select("id", "source", "priority", "score", "place")
