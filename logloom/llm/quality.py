"""Operator 1: quality classifier, naive Bayes support vectors.

Indicators of n-grams are scaled by class log-count ratios; a linear hinge-loss model
is fitted to them by dual coordinate descent. The n-grams run over word shapes
(letter case, digits, marks, whether a word repeats the one before), which carry
over to words never seen in training, and over the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import fold_of, table
from logloom.llm.nbsvm import Model, TrainConfig, hashed, train, with_score

#: Lengths of the n-grams over word shapes.
SHAPE_SIZES = range(1, 5)
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

#: Words of a text that are read at once, words whose codes a task remembers, and how long those may be.
BLOCK, KNOWN_WORDS, LONG_WORD = 1 << 13, 1 << 16, 64
WORDS = re.compile(r"\S+")
MARKS = re.compile(r"(\W)\1{2,}")
RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"))


def letters(found: re.Match) -> str:
    word = found[0]
    if word.islower():
        return "a"
    if word.isupper():
        return "A" if len(word) == 1 else "AA"
    return "Aa" if word[:1].isupper() and word[1:].islower() else "mX"


class Codes(dict):
    """Place of a word in the tables of hash codes of its shape and of itself. Long words are hashed
    anew each time; the tables are emptied between blocks when they have grown large."""

    def __init__(self) -> None:
        self.shapes: list[int] = []
        self.words: list[int] = []

    def __missing__(self, word: str) -> int:
        # Marks keep their run length up to 3; a shape is taken whole, however long.
        shape = RUNS[1][0].sub("9", RUNS[0][0].sub(letters, word))
        self.shapes.append(stable(MARKS.sub(r"\1\1\1", shape)))
        self.words.append(stable(word.lower()))
        if len(word) <= LONG_WORD:
            self[word] = len(self.words) - 1
        return len(self.words) - 1

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the shapes and of the words."""
        if len(self.words) > KNOWN_WORDS:
            self.clear()
            self.shapes.clear()
            self.words.clear()
        at = list(map(self.__getitem__, words))
        return np.array([self.shapes[k] for k in at], np.uint64), np.array([self.words[k] for k in at], np.uint64)


CODES = Codes()


def stable(text: str) -> int:
    """A hash that is the same in every process."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def word_grams(text: str) -> Iterator[np.ndarray]:
    """N-grams over the shapes of all words, and the words; each block begins with the last shapes of the one before."""
    found, last, tail = WORDS.finditer(text), None, np.zeros(0, np.uint64)
    while words := [m[0] for m in islice(found, BLOCK)]:
        shapes, words_at = CODES.of(words)
        again = np.empty(len(words), bool)
        again[0] = words_at[0] == last
        again[1:] = words_at[1:] == words_at[:-1]
        shapes[again] ^= np.uint64(0x5851F42D4C957F2D)
        shapes = np.concatenate([tail, shapes])
        tail, last = shapes[len(shapes) - min(len(shapes), SHAPE_SIZES.stop - 2) :], words_at[-1]
        yield np.concatenate([hashed(shapes, SHAPE_SIZES), hashed(words_at ^ np.uint64(0x14057B7EF767814F), range(1, 2))])


def train_quality(docs: DataFrame, labels: DataFrame, cfg: TrainConfig = TrainConfig()) -> Model:
    """Learn from labels(doc_id, quality) of documents outside the held-out fold."""
    known = labels.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", F.col("quality").alias("label"))
    return train(docs, known, word_grams, cfg)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1, higher: better) to docs; rows and other columns stay.

    A null or empty text has a score too: that of no n-grams. Texts of any length are scored whole,
    BLOCK words at a time. An existing column named score is replaced.
    """
    return with_score(docs, model, word_grams)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return quality(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
