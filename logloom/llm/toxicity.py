"""Operator 6: toxicity, a character n-gram linear classifier.

Indicators of character n-grams are scaled by naive Bayes log-count ratios and
weighed by a linear model trained on labelled text. Texts are lower-cased and runs of
white space count as one space, so that n-grams see where words begin and end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import fold_of, table
from logloom.llm.nbsvm import Model, TrainConfig, hashed, train, with_score

#: Lengths of the character n-grams.
SIZES = range(4, 8)
#: Code points of a text that are read at once.
BLOCK = 1 << 15
SPACES = re.compile(r"\s+")
#: Labels are learnt from the other folds.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5


def character_grams(text: str) -> Iterator[np.ndarray]:
    """N-grams of " " + text + " ", block by block; each block begins with the end of the one before."""
    tail = " "
    for k in range(0, len(text), BLOCK):
        block = SPACES.sub(" ", text[k : k + BLOCK].lower())
        if tail[-1] == " " and block[:1] == " ":
            block = block[1:]
        if k + BLOCK >= len(text) and (tail + block)[-1] != " ":
            block += " "
        block = tail + block
        tail = block[1 - SIZES.stop :]
        yield hashed(np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32), SIZES)


def train_toxicity(docs: DataFrame, labels: DataFrame, cfg: TrainConfig = TrainConfig()) -> Model:
    """Learn from labels(doc_id, toxic) of documents outside the held-out fold."""
    known = labels.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", F.col("toxic").alias("label"))
    return train(docs, known, character_grams, cfg)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1, higher: more toxic) to docs; rows and other columns stay.

    A null or empty text has a score too: that of no n-grams. Texts of any length are scored whole,
    BLOCK code points at a time. An existing column named score is replaced.
    """
    return with_score(docs, model, character_grams)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
