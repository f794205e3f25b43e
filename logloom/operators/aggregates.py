"""Statistics of the log: one pass of conditional counts for each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.views import fixed

# The event types that count as a participant's action.
ACTIONS = (
    "move switch_out switch_in damage heal status status_cure flinch boost unboost protect miss fail item ability activate redirection"
).split()


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def rate(part: Column, whole: Column) -> Column:
    """The share, 0 where there is nothing to share."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def battle_statistics(events: DataFrame, unknowns: DataFrame) -> DataFrame:
    """For each battle of events(battle_id, type, actor) or unknowns(battle_id): totals, counts
    by kind, and the share of unknown messages. A battle with only one of the two counts."""
    kinds = {"observed_moves": ["move"], "switches": ["switch_in", "switch_out"], "faints": ["faint"], "criticals": ["critical"]}
    effects = {e: count_if(F.col("type") == e) for e in ("supereffective", "resisted", "immune")}
    known = events.groupBy("battle_id").agg(
        F.count("*").alias("resolved"),
        *[count_if(F.col("type").isin(v)).alias(k) for k, v in kinds.items()],
        *[c.alias(e) for e, c in effects.items()],
        count_if(F.col("type").isin(ACTIONS) & F.col("actor").isNotNull()).alias("actions"),
    )
    missed = unknowns.groupBy("battle_id").agg(F.count("*").alias("unknowns"))
    both = known.join(missed, "battle_id", "full_outer").na.fill(0)
    total = F.col("resolved") + F.col("unknowns")
    return both.withColumns({"effective_total": F.col("supereffective") + F.col("resisted") + F.col("immune"), "unknown_rate": rate(F.col("unknowns"), total)})


def type_statistics(rows: DataFrame, key: str, kind: str, kinds: list[str], unknown: str) -> DataFrame:
    """Counts by kind of each key, with `unknown` as the kind that isn't classified."""
    total = F.count("*")
    return rows.groupBy(key).agg(
        count_if(F.col(kind) != unknown).alias("resolved"),
        *[count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds],
        count_if(F.col(kind) == unknown).alias("unknowns"),
        fixed(rate(count_if(F.col(kind) == unknown), total), 4).alias("unknown_rate"),
    )


def action_counts(events: DataFrame) -> DataFrame:
    """Actions of each participant of events(side, name, type): most first, then by name in the
    order of Japanese dictionaries, then by side; a missing side is unknown."""
    side = F.coalesce("side", F.lit("unknown"))
    counts = events.where(F.col("type").isin(ACTIONS) & F.col("name").isNotNull()).groupBy(side.alias("side"), "name").agg(F.count("*").alias("n"))
    keyed = counts.withColumn("key", F.concat_ws(":", "side", "name"))
    return keyed.orderBy(F.desc("n"), F.collate("name", "ja"), "side")


def zero_filled(known: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The count of rows for every known key, zeros included."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return known.select(key).distinct().join(counts, key, "left").na.fill(0, ["n"])


def signal_summary(rows: DataFrame, key: str, score: str, visible: Column) -> DataFrame:
    """Samples, visible samples, total and greatest score of each key."""
    return rows.groupBy(key).agg(
        F.count("*").alias("samples"), count_if(visible).alias("visible"), F.sum(score).alias("score_total"), F.max(score).alias("score_max")
    )


def best_row(rows: DataFrame, key: str, score: str, order: str, value: str, into: str) -> DataFrame:
    """The value of each key's row with the greatest score; ties go to the smaller order value."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(F.col(score), -F.col(order))).alias(into), F.max(score).alias(score))


def observation_summary(observations: DataFrame) -> DataFrame:
    """Counters over observations(battle_id, active, suppressed, resolution, attempts). Suppressed rows count
    as suppressed only; detected and committed are the same number."""
    shown = ~F.col("suppressed")
    names = ("resolved", "ocr_unknown", "unread", "pending")
    return observations.groupBy("battle_id").agg(
        count_if(shown).alias("detected"),
        count_if(shown).alias("committed"),
        *[count_if(shown & (F.col("resolution") == r)).alias(r) for r in names],
        count_if(F.col("suppressed")).alias("suppressed"),
        count_if(F.col("active") & shown).alias("active"),
        F.sum(F.when(shown, F.col("attempts")).otherwise(0)).alias("attempts"),
    )


def cluster_key(text: Column, limit: int = 32) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


# What a missed event of each kind is worth in the weighted loss.
LOSS_VALUES = {
    "move": 2.2, "switch_in": 2.0, "switch_out": 1.8, "faint": 2.4, "flinch": 1.7, "status": 1.8, "status_cure": 1.6,
    "supereffective": 1.7, "immune": 1.7, "fail": 1.5, "protect": 1.4, "damage": 1.4, "item": 1.4, "activate": 1.4,
    "weather_start": 1.3, "weather_end": 1.3, "terrain_start": 1.2, "terrain_end": 1.2, "side_start": 1.2, "side_end": 1.2,
    "boost": 1.5, "unboost": 1.5, "noise": 0.15, "unknown": 0.75,
}


def loss_value(kind: Column) -> Column:
    values = F.create_map(*[F.lit(x) for pair in LOSS_VALUES.items() for x in pair])
    return F.coalesce(F.element_at(values, kind), F.lit(LOSS_VALUES["unknown"]))


def coverage_clusters(items: DataFrame) -> DataFrame:
    """Clusters of missed messages(key, id, text, kind, confidence, duplicate, noted).

    Two steps: the duplicate factor depends on the whole cluster, so clusters are
    marked first. Returns key, n, first ids and texts, mean confidence, weighted loss.
    """
    near = items.groupBy("key").agg(F.max(F.col("duplicate").cast("int")).alias("_near"), F.max(F.col("noted").cast("int")).alias("_noted"))
    rows = items.join(near, "key")
    sure = F.greatest(F.lit(0.35), F.least(F.lit(1.15), 0.45 + F.coalesce("confidence", F.lit(0.6))))
    loss = loss_value(F.col("kind")) * sure * F.when(F.col("_near") == 1, 0.25).otherwise(1.0) * F.when(F.col("_noted") == 1, 1.25).otherwise(1.0)
    # The first six ids come from a ranked subset, so no cluster is collected whole.
    ranked = rows.withColumn("_loss", loss).withColumn("_place", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    return ranked.groupBy("key").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("_place") <= 6, F.col("id")))).alias("first_ids"),
        fixed(F.avg("confidence"), 3).alias("mean_confidence"),
        fixed(F.sum("_loss"), 3).alias("weighted_loss"),
        F.max("_near").alias("near_existing"),
        F.max("_noted").alias("noted"),
    )


CAUSES = ("ui_noise", "ocr_fragment", "near_existing_event", "source_candidate", "near_miss", "dictionary_gap")


def classification(causes: Column) -> Column:
    """The first of the causes in order of precedence, else unclassified."""
    out = F.lit("unclassified")
    for cause in reversed(CAUSES):
        out = F.when(F.array_contains(causes, cause), cause).otherwise(out)
    return out


# What each cause asks for.
CAUSE_ACTIONS = {
    "ui_noise": ["suppress_noise"],
    "ocr_fragment": ["suppress_noise"],
    "near_existing_event": ["review_only"],
    "source_candidate": ["add_rule"],
    "near_miss": ["adjust_threshold", "add_fixture"],
    "dictionary_gap": ["add_alias", "add_fixture"],
}


def actions_of(causes: Column) -> Column:
    """The set of actions that a set of causes asks for; review_only if there are none."""
    table = F.create_map(*[x for c, a in CAUSE_ACTIONS.items() for x in (F.lit(c), F.array(*map(F.lit, a)))])
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(causes, lambda c: F.coalesce(F.element_at(table, c), F.array().cast("array<string>"))))))
    return F.when(F.size(found) == 0, F.array(F.lit("review_only"))).otherwise(found)


def ranked_proposals(clusters: DataFrame, kind: Column, risk: Column, n: int) -> DataFrame:
    """The top n clusters as numbered proposals: lowest risk, greatest loss, most evidence, key.

    The top n are taken first (each task keeps n rows), and only they are numbered.
    """
    order = ["risk", F.desc("weighted_loss"), F.desc("n"), "key"]
    top = clusters.withColumns({"kind": kind, "risk": risk}).orderBy(*order).limit(n)
    numbered = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("proposal_id", F.format_string("unknown_cov_%03d", "place"))


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Unknown rates of before(key, unknown) and after(key, unknown), and their difference, to 4 places."""
    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"), fixed(rate(count_if(F.col("unknown")), F.count("*")), 4).alias(f"rate_{name}"))

    both = one(before, "before").join(one(after, "after"), key, "full_outer").na.fill(0).na.fill(0.0)
    return both.withColumn("delta", fixed(F.col("rate_after") - F.col("rate_before"), 4))


def counts_with_total(rows: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Measures of each key and, under the key "total", of all rows."""
    out = rows.rollup(key).agg(F.grouping_id().alias("_all"), *[m.alias(n) for n, m in measures.items()])
    return out.withColumn(key, F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col(key).cast("string"))).drop("_all")


def highest_reason(rows: DataFrame, key: str, reason: str, order: str, priorities: dict[str, int]) -> DataFrame:
    """The reason of the highest priority of each key; of equal ones the newest."""
    table = F.create_map(*[F.lit(x) for pair in priorities.items() for x in pair])
    return rows.groupBy(key).agg(F.max_by(reason, F.struct(F.coalesce(F.element_at(table, F.col(reason)), F.lit(0)), order)).alias(reason))


def keep_first(rows: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """The first row of each key in order, of these the first `limit`."""
    out = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") == 1).drop("_place")
    return out if limit is None else out.orderBy(*order).limit(limit)
