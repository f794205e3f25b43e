"""Event-time operators: duplicate suppression, runs, streaks, as-of look-ups.

All are window expressions partitioned by the log's key, ordered by time and then by
the row's own order column, so results don't depend on how rows are dealt. A key's rows meet in one
task, sorted and spilled: a battle is as long as a battle is, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_dedupe(rows: DataFrame, keys: list[str], ts: str, message: list[str], window_ms: int) -> DataFrame:
    """Add suppressed: an earlier message with the same keys lies at most window_ms back.

    Suppressed rows count as earlier ones too, so the window slides. Rows of one message
    (equal message columns) don't see each other: they all survive or all go. The rows
    are folded to one for each key and message before the look-back.
    """
    back = Window.partitionBy(*keys).orderBy(ts, *message)
    own = rows.groupBy(*keys, *dict.fromkeys([ts, *message])).agg(F.count("*").alias("_rows"))
    marked = own.withColumn("suppressed", F.coalesce(F.col(ts) - F.lag(ts).over(back) <= window_ms, F.lit(False))).drop("_rows")
    return rows.join(marked, list(dict.fromkeys([*keys, ts, *message])))


def sliding_dedupe_unique(rows: DataFrame, keys: list[str], ts: str, order: str, window_ms: int) -> DataFrame:
    """The same where every row is a message of its own: one window, no join."""
    back = Window.partitionBy(*keys).orderBy(ts, order)
    return rows.withColumn("suppressed", F.coalesce(F.col(ts) - F.lag(ts).over(back) <= window_ms, F.lit(False)))


def run_lengths(rows: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: partition, run (1, 2, ...), value, first and last order value, count."""
    by = Window.partitionBy(partition).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    runs = rows.withColumn("run", F.sum(changed).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(partition, "run").agg(
        F.first(value).alias(value), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count("*").alias("n")
    )


def streak_edges(rows: DataFrame, partition: str, order: list[str], flag: Column, needed: int) -> DataFrame:
    """The rows at which a flag has held for `needed` samples in a row, with the flag as edge."""
    by = Window.partitionBy(partition).orderBy(*order)
    flagged = rows.withColumn("_flag", flag)
    changed = F.when(F.col("_flag").eqNullSafe(F.lag("_flag").over(by)), 0).otherwise(1)
    runs = flagged.withColumn("_run", F.sum(changed).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(partition, "_run").orderBy(*order))
    return runs.withColumn("_place", place).where(F.col("_place") == needed).withColumn("edge", F.col("_flag")).drop("_flag", "_run", "_place")


def as_of_last(rows: DataFrame, partition: str, ts: str, order: str, value: Column, window_ms: int, into: str) -> DataFrame:
    """Add the last non-null value of strictly earlier rows at most window_ms back (ties in time: the greater order)."""
    frame = Window.partitionBy(partition).orderBy(ts).rangeBetween(-window_ms, -1)
    latest = F.max(F.when(value.isNotNull(), F.struct(F.col(ts).alias("_t"), F.col(order).alias("_o"), value.alias("_v")))).over(frame)
    return rows.withColumn(into, latest["_v"])


def seen_before(rows: DataFrame, keys: list[str], ts: str, order: str, window_ms: int, into: str) -> DataFrame:
    """Add whether the row before it with the same keys is at most window_ms older."""
    back = Window.partitionBy(*keys).orderBy(ts, order)
    return rows.withColumn(into, F.coalesce(F.col(ts) - F.lag(ts).over(back) <= window_ms, F.lit(False)))


def exists_within(rows: DataFrame, partition: list[str], ts: str, condition: Column, window_ms: int, into: str) -> DataFrame:
    """Add whether a strictly earlier row at most window_ms back meets the condition."""
    frame = Window.partitionBy(*partition).orderBy(ts).rangeBetween(-window_ms, -1)
    return rows.withColumn(into, F.coalesce(F.max(condition.cast("int")).over(frame) == 1, F.lit(False)))


def last_pointer(rows: DataFrame, partition: str, order: list[str], value: Column, into: str) -> DataFrame:
    """Add the last non-null value among all rows before this one."""
    frame = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(frame))


def newest(rows: DataFrame, partition: str, ts: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each partition, with their place."""
    by = Window.partitionBy(partition).orderBy(F.desc(ts), F.desc(order))
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def rolling_occupancy(rows: DataFrame, keys: list[str], order: list[str], occupied: Column, samples: int) -> DataFrame:
    """Add, over the last `samples` rows, the occupied ratio, the share of changes, and whether the
    cell is persistent (occupied for at least .8 of them, changed in at most .2 of the steps)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    frame = by.rowsBetween(-(samples - 1), 0)
    steps = rows.withColumn("_on", occupied.cast("int"))
    steps = steps.withColumn("_step", F.when(F.lag("_on").over(by).isNull(), 0).otherwise((F.col("_on") != F.lag("_on").over(by)).cast("int")))
    # A change counts if both its samples are in the frame: that of the oldest sample doesn't.
    inner = by.rowsBetween(-(samples - 2), 0)
    n = F.count("*").over(frame)
    return (
        steps.withColumn("occupied_ratio", F.sum("_on").over(frame) / n)
        .withColumn("transition_ratio", F.when(n > 1, F.sum("_step").over(inner) / (n - 1)).otherwise(0.0))
        .withColumn("persistent", (F.col("occupied_ratio") >= 0.8) & (F.col("transition_ratio") <= 0.2))
        .drop("_on", "_step")
    )


def m_of_n(rows: DataFrame, keys: list[str], order: list[str], ts: str, present: Column, m: int, n: int, min_ms: int) -> DataFrame:
    """Add confirmed: at least m of the last n samples are present and they span min_ms or more."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    span = F.max(F.when(present, F.col(ts))).over(frame) - F.min(F.when(present, F.col(ts))).over(frame)
    return rows.withColumn("confirmed", (F.sum(present.cast("int")).over(frame) >= m) & F.coalesce(span >= min_ms, F.lit(False)))


def recent_distinct(rows: DataFrame, partition: str, ts: str, order: str, label: str, n: int) -> DataFrame:
    """The n most recently seen labels of each partition, newest first (a re-seen label moves to the front)."""
    last = rows.groupBy(partition, label).agg(F.max(F.struct(ts, order)).alias("_at"))
    by = Window.partitionBy(partition).orderBy(F.desc("_at"))
    return last.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select(partition, label, "place", F.col(f"_at.{ts}").alias(ts))


def numbered_slots(rows: DataFrame, message: str, slot: str, into: str) -> DataFrame:
    """Add an id: the message's, with _1, _2, ... only where it has more than one row."""
    of = Window.partitionBy(message)
    place = F.row_number().over(of.orderBy(slot))
    many = F.count("*").over(of) > 1
    return rows.withColumn(into, F.when(many, F.concat_ws("_", F.lit("evt"), F.col(message).cast("string"), place.cast("string"))).otherwise(F.concat_ws("_", F.lit("evt"), F.col(message).cast("string"))))


def unified_timeline(events: DataFrame, unknowns: DataFrame, ts: str, order: str, n: int | None) -> DataFrame:
    """Both kinds of items in one timeline, newest first, the newest n or all."""
    both = events.withColumn("kind", F.lit("event")).unionByName(unknowns.withColumn("kind", F.lit("unknown")), allowMissingColumns=True)
    sorted_rows = both.orderBy(F.desc(ts), F.desc(order))
    return sorted_rows if n is None else sorted_rows.limit(n)
