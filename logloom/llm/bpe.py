"""Operator 8: byte-level BPE encoding and decoding over a contiguous rank array.

A text is cut into words by the vocabulary's pattern. For each short word an array holds
the part boundaries, another the rank of every part joined with its right neighbour;
the least rank is looked for again and again, its boundary deleted, and
the two ranks beside it refreshed. Long words go to a heap that makes the same merges
in the same order, so that a run of a million letters stays near-linear.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import short_batches, table

#: Words of more bytes than this are merged with a heap.
SHORT_WORD = 96
#: Words whose ids a worker remembers, in two halves: when the younger is full, it takes
#: the place of the older, and words that are met again move to the younger.
REMEMBERED = 1 << 18
#: How byte-level BPE files cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_MERGE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable
    Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE file in the tokenizers JSON format."""

    def __init__(self, source: str) -> None:
        got = json.loads(source)
        letters = byte_letters()
        ids = got["model"]["vocab"]
        special = {t["content"]: t["id"] for t in got["added_tokens"]}
        self.token_bytes = [b""] * (1 + max(*ids.values(), *special.values(), 0))
        for token, k in ids.items():
            self.token_bytes[k] = bytes(letters[c] for c in token) if token not in special else token.encode()
        for token, k in special.items():
            self.token_bytes[k] = token.encode()
        by_byte = {self.token_bytes[k]: k for k in ids.values() if len(self.token_bytes[k]) == 1}
        self.first = [by_byte[bytes([b])] for b in range(256)]
        #: (left id, right id) to (rank, id of the two joined).
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(got["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.joins[ids[left], ids[right]] = (rank, ids[left + right])
        self.special = special
        marks = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
        self.special_pattern = regex.compile(f"({marks})") if marks else None
        self.word_pattern = regex.compile(WORDS)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def short_word(self, parts: list[int]) -> list[int]:
        """Merge with contiguous arrays: parts holds the ids between boundaries, ranks[i]
        the rank of parts i and i + 1 together."""
        joins = self.joins
        found = [joins.get(pair) for pair in zip(parts, parts[1:], strict=False)]
        ranks = [f[0] if f else NO_MERGE for f in found]
        while ranks:
            at = ranks.index(least := min(ranks))
            if least == NO_MERGE:
                break
            parts[at] = joins[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                right = joins.get((parts[at], parts[at + 1]))
                ranks[at] = right[0] if right else NO_MERGE
            if at:
                left = joins.get((parts[at - 1], parts[at]))
                ranks[at - 1] = left[0] if left else NO_MERGE
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        """The same merges from a heap of (rank, position) over linked parts."""
        joins, n = self.joins, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joins[p][0], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in joins]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if parts[at] < 0 or right >= n or joins.get((parts[at], parts[right]), (-1,))[0] != rank:
                continue  # a later merge has changed this pair
            parts[at] = joins[parts[at], parts[right]][1]
            parts[right] = -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (pair := joins.get((parts[left], parts[after[left]]))):
                    heapq.heappush(heap, (pair[0], left))
        return [p for p in parts if p >= 0]

    def word_ids(self, word: str) -> bytes:
        parts = [self.first[b] for b in word.encode()]
        merged = self.short_word(parts) if len(parts) <= SHORT_WORD else self.long_word(parts)
        return struct.pack(f"<{len(merged)}I", *merged)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens in the text become their ids."""
        if self.special_pattern is None:
            pieces = [text]
        else:
            pieces = self.special_pattern.split(text) if any(s in text for s in self.special) else [text]
        known, out = self.known, []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
                continue
            for word in self.word_pattern.findall(piece):
                ids = known.get(word)
                if ids is None:
                    ids = self.older.get(word) or self.word_ids(word)
                    if len(word) <= SHORT_WORD:
                        if len(known) >= REMEMBERED // 2:
                            self.older, self.known = known, {}
                            known = self.known
                        known[word] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The text of a public vocabulary file (about 2 MB), read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


ENCODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
CHECKED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def _per_text(spark: SparkSession, source: str, kind: T.DataType, make):
    """An Arrow function over a column; the vocabulary (one file) is broadcast."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(source)

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = vocabulary(shared.value)
        for values in batches:
            yield make(own, values)

    return apply


def encode(docs: DataFrame, source: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """Add a column struct(ids, n_tokens): packed ids of each whole text and their number.

    A null text is encoded as the empty one (no ids). Other columns stay; one named like
    the new column is replaced.
    """

    def make(own: Vocabulary, texts: pd.Series) -> pd.DataFrame:
        ids = [own.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "n_tokens": [len(i) // 4 for i in ids]})

    return docs.withColumn(into, _per_text(docs.sparkSession, source, ENCODED, make)(F.col(text)))


def decode(rows: DataFrame, source: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of a column of packed ids; null ids give the empty text."""
    spark = rows.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(source)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = vocabulary(shared.value)
        for values in batches:
            yield pd.Series([own.decode(v or b"") for v in values], dtype=object)

    return rows.withColumn(into, texts(F.col(ids)))


def round_trip(docs: DataFrame, source: str, text: str = "text") -> DataFrame:
    """Digests of each text's ids and of the text decoded from them, made in one pass so that
    neither leaves the worker. Returns doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one, repeated rows give equal digests, an empty table an empty one. Texts
    may be of any length, word by word; a word of over 96 bytes is merged by a heap.
    """

    def make(own: Vocabulary, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            ids = own.encode(t or "")
            decoded = own.decode(ids).encode()
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = _per_text(docs.sparkSession, source, CHECKED, make)(F.col(text))
    return docs.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_vocabulary())
