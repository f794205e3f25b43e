"""Readings of pictures: how segments become one, which are read again, and the small rows kept of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import frame_reference, identity

#: Segments of a reading.
MOST_SEGMENTS = 3


def reading_candidates(segments: DataFrame) -> DataFrame:
    """(job_id, reading_id, segments) of segments(job_id, reading_id, nth, text, confidence, lines): the first few of each reading."""
    rows = segments.groupBy("job_id", "reading_id").agg(F.sort_array(F.collect_list(F.struct("nth", "text", "confidence", "lines"))).alias("segments"))
    return rows.withColumn("segments", F.slice("segments", 1, MOST_SEGMENTS))


def combined_reading(readings: DataFrame) -> DataFrame:
    """The readings with the text of their segments that aren't blank, a line each, the mean of the confidences that are
    known, and all lines."""
    texts = F.filter(F.transform("segments", lambda s: F.trim(F.coalesce(s["text"], F.lit("")))), lambda t: t != "")
    sure = F.filter(F.transform("segments", lambda s: s["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure))
    lines = F.flatten(F.transform("segments", lambda s: F.coalesce(s["lines"], F.array().cast("array<string>"))))
    return readings.select("job_id", "reading_id", F.array_join(texts, "\n").alias("text"), mean.alias("confidence"), lines.alias("lines"))


def read_again(selected: DataFrame) -> DataFrame:
    """Jobs of templates.select_reading whose best reading is not a strong event."""
    return selected.where(F.col("outcome") != "event")


def accepted_records(events: DataFrame) -> DataFrame:
    """What later messages look back at of accepted events(battle_id, event_type, actor, side, reading, timestamp_ms, frame)."""
    return events.where("event_type IS NOT NULL").select("battle_id", "event_type", "actor", "side", "reading", "timestamp_ms", "frame", frame_reference(F.col("frame"), F.col("timestamp_ms")).alias("at"))


def candidate_records(unread: DataFrame) -> DataFrame:
    """The same of what the decoder rejected: one row for each candidate among the evidence of unread(battle_id, evidence, timestamp_ms, frame)."""
    each = unread.select("battle_id", "timestamp_ms", "frame", F.explode("evidence").alias("told"))
    each = each.where(F.startswith("told", F.lit("constrained-review:")))
    return each.select("battle_id", identity(F.substring_index("told", ";constrained-candidate;", -1)).alias("identity"), "timestamp_ms", "frame")


def iso_time(ms: Column) -> Column:
    """Milliseconds since the epoch as an ISO time in UTC."""
    return F.concat(F.date_format(F.to_timestamp_ntz(F.timestamp_millis(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def file_stamp(ms: Column) -> Column:
    """A time as part of a file's name."""
    return F.regexp_replace(iso_time(ms), "[:.]", "-")
