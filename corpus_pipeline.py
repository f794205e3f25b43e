"""The corpus pipeline: five of the text operators in a row over documents.

Each stage takes what the one before has kept; all but the last return the columns of
documents. Between stages the rows are written as Parquet in the shared folder and
read again, so a lost executor never costs more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.bpe import public_vocabulary, round_trip
from logloom.llm.common import table, written
from logloom.llm.copies import one_of_copies
from logloom.llm.decontamination import decontaminated
from logloom.llm.line_dedup import line_dedup
from logloom.llm.toxicity import THRESHOLD, toxicity, train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars is that of the text that stays."""
    return line_dedup(docs, carry=["lang", "source"]).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by shared shingles or near fingerprints."""
    return one_of_copies(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text decoded from them."""
    return round_trip(docs, public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near duplicates", keep_one_of_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode_and_decode),
]

# Trained scores, template windows and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
