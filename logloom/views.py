"""The canonical views that the operators take, made from stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, where a scan has fewer (a file of one row group): for work that
    costs far more than a shuffle of them. Large tables have more partitions and stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a zone-less UTC time."""
    return F.unix_millis(ts.cast("timestamp"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """battle_id, id, timestamp_ms, type, identity, score of each event."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("battle_id"),
        F.col("event_id").alias("id"),
        millis(F.col("ts")).alias("timestamp_ms"),
        F.col("event_type").alias("type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("identity"),
        F.col("value").alias("score"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """battle_id, id, seq, side, raw_text of each message."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("battle_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("turn").alias("seq"),
        F.col("role").alias("side"),
        F.col("text").alias("raw_text"),
    )


def fixed(value: Column, digits: int) -> Column:
    """Round half up on the binary value, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
