"""What the text operators share: table access, shared-folder tables, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import short_batches
from logloom.sources.shared import removed, scratch, shared_dir, written
from logloom.views import spread

__all__ = ["SPACE", "fold_of", "removed", "scratch", "shared_dir", "short_batches", "table", "without_ids", "written"]

#: The white space that separates words: space and \t \n \x0b \f \r.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, over as many partitions as there are cores if its scan has fewer."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: Ids that may be broadcast; a larger set is joined by shuffles.
BROADCAST_IDS = 200_000


def without_ids(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids(doc_id); a null id matches a null id.

    The ids are counted first: a small set is broadcast, so that texts aren't
    shuffled, a larger one is joined by shuffles that Spark may split.
    """
    gone = written(ids.select(F.col("doc_id").alias("gone_id")).distinct(), label)
    # A table of ids that the result still reads; it stays.
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
