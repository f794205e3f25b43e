"""Joins on time and on intervals, and the merging of nearby observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, tolerance_ms: int) -> DataFrame:
    """Pairs of rows with equal keys whose times differ by at most the tolerance.

    Times are dealt into buckets of the tolerance's width, the right side into its own and both
    neighbours, so the join is an equi-join on keys and bucket. Columns of the right
    side get the prefix r_.
    """
    width = max(1, tolerance_ms)
    bucket = F.floor(F.col(ts) / width)
    near = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    near = near.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(f"r_{ts}") / width) + d for d in (-1, 0, 1)])))
    own = left.withColumn("_bucket", bucket)
    on = own["_bucket"] == near["_bucket"]
    for k in keys:
        on = on & (own[k] == near[f"r_{k}"])
    return own.join(near, on).where(F.abs(F.col(ts) - F.col(f"r_{ts}")) <= tolerance_ms).drop("_bucket")


def nearest_events(rows: DataFrame, others: DataFrame, keys: list[str], ts: str, row_id: str, tolerance_ms: int, n: int) -> DataFrame:
    """Up to n events around each row, the first in time order."""
    pairs = band_join(rows, others, keys, ts, tolerance_ms)
    by = Window.partitionBy(row_id).orderBy(f"r_{ts}", f"r_{row_id}")
    return pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def attached(observations: DataFrame, events: DataFrame) -> DataFrame:
    """(observation_id, event_id): the event is listed by the observation or names it.

    Two equi-joins and a distinct instead of one join on either condition.
    """
    listed = observations.select(F.col("id").alias("observation_id"), F.explode("event_ids").alias("event_id"))
    listed = listed.join(events.select(F.col("id").alias("event_id")), "event_id").select("observation_id", "event_id")
    named = events.select("observation_id", F.col("id").alias("event_id")).join(
        observations.select(F.col("id").alias("observation_id")), "observation_id"
    )
    return listed.unionByName(named.select("observation_id", "event_id")).distinct()


def unattached(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events that no observation holds."""
    return events.join(pairs.select(F.col("event_id").alias("id")).distinct(), "id", "left_anti")


def merge_score(text: Column, visual: Column, identity: Column) -> Column:
    """The score of a pair from its similarities and whether the identities agree."""
    return F.least(F.lit(1.0), 0.3 + 0.35 * text + 0.2 * visual + F.when(identity, 0.15).otherwise(0.0))


def merge_candidates(
    observations: DataFrame,
    text_similarity: Column,
    visual_similarity: Column,
    max_gap_ms: int = 1500,
    min_text: float = 0.66,
    min_visual: float = 0.58,
    min_score: float = 0.72,
) -> DataFrame:
    """The best partner of each unresolved observation among nearby resolved ones.

    observations(battle_id, id, opened_ms, end_ms, resolved, identity, ...); the similarities are
    expressions over the columns of the unresolved row and, with prefix r_, of the
    resolved one. A resolved observation that opened strictly between the two
    openings rules the pair out; ties go to the smaller id.

    The pairing is a join on time buckets, whose width follows the longer of both intervals: an
    interval has at most three buckets of each width that occurs and is not below its own, however long it is
    open. The check for one in between is a count over the openings of the battle, not a
    second range join.
    """
    order = Window.partitionBy("battle_id").orderBy("opened_ms").rangeBetween(Window.unboundedPreceding, 0)
    upto = observations.withColumn("_upto", F.sum(F.col("resolved").cast("int")).over(order))
    at_same = F.sum(F.col("resolved").cast("int")).over(Window.partitionBy("battle_id", "opened_ms"))
    counted = upto.withColumn("_below", F.col("_upto") - at_same)
    open_rows, done = counted.where(~F.col("resolved")), counted.where("resolved")
    # Intervals at most max_gap_ms apart share a bucket once one of them is widened by the gap.
    open_rows, done = open_rows.withColumns({"_from": F.col("opened_ms"), "_to": F.col("end_ms")}), done.withColumns({"_from": F.col("opened_ms") - max_gap_ms, "_to": F.col("end_ms") + max_gap_ms})

    def levelled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_own", F.greatest(F.ceil(F.log2(F.greatest(F.col("_to") - F.col("_from"), F.lit(1)) / max_gap_ms)), F.lit(0)).cast("int"))

    open_rows, done = levelled(open_rows), levelled(done)
    # A few dozen levels at most: each doubles the width.
    present = open_rows.select("_own").unionByName(done.select("_own")).distinct().where("_own IS NOT NULL").collect()
    levels = F.array(*[F.lit(r["_own"]) for r in present]).cast("array<int>")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_level", F.explode(F.filter(levels, lambda x: x >= F.col("_own"))))
        wide = F.lit(max_gap_ms) * F.pow(F.lit(2.0), "_level")
        return rows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / wide), F.floor(F.col("_to") / wide)))).drop("_from", "_to")

    near = dealt(done).select(*[F.col(c).alias(f"r_{c}") for c in [*counted.columns, "_own", "_level", "_bucket"]])
    same = (F.col("battle_id") == F.col("r_battle_id")) & (F.col("_level") == F.col("r__level")) & (F.col("_bucket") == F.col("r__bucket"))
    pairs = dealt(open_rows).join(near, same & (F.greatest("_own", "r__own") == F.col("_level")))
    pairs = pairs.drop("_own", "_level", "_bucket", "r__own", "r__level", "r__bucket").dropDuplicates(["battle_id", "id", "r_id"])
    gap = F.greatest(F.lit(0), F.greatest("opened_ms", "r_opened_ms") - F.least("end_ms", "r_end_ms"))
    late = F.col("opened_ms") >= F.col("r_opened_ms")
    between = F.when(late, F.col("_below") - F.col("r__upto")).otherwise(F.col("r__below") - F.col("_upto"))
    scored = pairs.where((gap <= max_gap_ms) & (F.greatest(between, F.lit(0)) == 0)).select(
        "battle_id", "id", F.col("r_id").alias("partner_id"), gap.alias("gap_ms"),
        text_similarity.alias("text_similarity"), visual_similarity.alias("visual_similarity"),
        merge_score(text_similarity, visual_similarity, F.col("identity").eqNullSafe(F.col("r_identity"))).alias("score"),
    )
    good = scored.where((F.col("text_similarity") >= min_text) & (F.col("visual_similarity") >= min_visual) & (F.col("score") >= min_score))
    best = Window.partitionBy("battle_id", "id").orderBy(F.desc("score"), "partner_id")
    return good.withColumn("_place", F.row_number().over(best)).where(F.col("_place") == 1).drop("_place")


def union_of_pair(rows: DataFrame) -> DataFrame:
    """The merged interval of each pair of rows(target: struct, other: struct) with fields
    opened_ms, closed_ms, presence, best_frame, attempts, event_ids."""
    a, b = F.col("target"), F.col("other")
    closed = F.when(a["closed_ms"].isNull() | b["closed_ms"].isNull(), None).otherwise(F.greatest(a["closed_ms"], b["closed_ms"]))
    better = b["presence"] > a["presence"]
    return rows.select(
        "*",
        F.struct(
            F.least(a["opened_ms"], b["opened_ms"]).alias("opened_ms"),
            closed.alias("closed_ms"),
            closed.isNull().alias("active"),
            F.greatest(a["presence"], b["presence"]).alias("presence"),
            F.when(better, b["best_frame"]).otherwise(a["best_frame"]).alias("best_frame"),
            (a["attempts"] + b["attempts"]).alias("attempts"),
            F.array_union(a["event_ids"], b["event_ids"]).alias("event_ids"),
        ).alias("merged"),
    )
