"""Many keys at once: an automaton over all of them (a trie with failure links) passes each text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("key", T.StringType())]))


class Keys:
    """Keys as they travel to workers; each worker builds the automaton once."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = sorted({k for k in keys if k})

    def __reduce__(self) -> tuple:
        return Keys, (self.keys,)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for key in self.keys:
            made.add_word(key, key)
        made.make_automaton()
        return made

    def occurrences(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, key) of every occurrence of every key."""
        if not text or not self.keys:
            return []
        return [(last + 1 - len(key), last + 1, key) for last, key in self.automaton.iter(text)]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Occurrences without overlaps, the longest first, then the earliest; in order of their starts."""
        taken, kept = bytearray(len(text or "")), []
        for start, end, key in sorted(self.occurrences(text), key=lambda o: (o[0] - o[1], o[0])):
            # Nothing taken so far is shorter, so an overlap covers an end of this one.
            if not (taken[start] or taken[end - 1]):
                taken[start:end] = b"\x01" * (end - start)
                kept.append((start, end, key))
        return sorted(kept)


def over_texts(spark: SparkSession, keys: object, kind: T.DataType, of: Callable[[object, str | None], object]) -> Callable[[Column], Column]:
    """A function of text columns that applies of(keys, text); the keys are broadcast."""
    shared = spark.sparkContext.broadcast(keys)

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([of(shared.value, t) for t in texts], index=texts.index, dtype=object)

    return apply
