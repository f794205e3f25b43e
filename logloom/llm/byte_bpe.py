"""Operator 11: byte-level BPE by ranks, folded with Spark's higher-order functions.

A Python step cuts whole texts into words, block by block, and gives every block the byte
arrays of its distinct words, with the ranks of the tokens that stand in them, and, for every text, the words' numbers;
numbers and ranks come from Arrow and numpy, many words at once.
All merging is done by Spark expressions: a fold over a word's ranks, from the least on, looks up each one's pair
in a literal rank map and merges it where its parts still stand side by side. Ids are gathered by word number;
decoding looks up each id's bytes in a literal array and joins them.

Blocks need no shuffle, so no word, text or source is hot, and a lost executor costs the
tasks that it ran.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.bpe import WORDS, Vocabulary
from logloom.llm.common import short_batches, table

#: Words of more bytes than this are merged by a heap in the Python step: a fold takes time with the square of a word.
SHORT_WORD = 96
#: Characters of a block's texts; a longer text is a block of its own.
BLOCK_CHARS = 16 << 20
#: Characters of texts whose words are numbered together before a block's words are: no block's words are held with their repeats.
PIECE_CHARS = 1 << 20
#: Words whose tokens are looked for at once: arrays of this size stay in a core's cache.
WORDS_AT_ONCE = 8_000
#: WORDS for texts of ASCII only, which the plain module reads in half the time. White space is spelt out, as there it holds \x1c to \x1f too.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class Beginnings(NamedTuple):
    """What tokens begin with, numbered by length and then by bytes: 0 is the empty one, 1 + b the byte b."""

    #: Ascending, for each but the empty one: 256 times the number of what stands before its last byte, plus that byte.
    longer: np.ndarray
    #: The rank where the beginning is a token itself, else -1.
    ranks: np.ndarray
    #: Bytes of the token of each rank.
    sizes: np.ndarray


class Ranks:
    """A tiktoken rank file: a token of base64 and its rank in each line; ranks are the ids.

    Every token must be the result of merging its own bytes by rank (true of files that training
    has left as they are). Then a rank is always reached by the same two parts, and
    pairs of ids can stand for pairs of byte strings.
    """

    def __init__(self, source: str) -> None:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, filter(None, source.splitlines()))}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing[:8]}")
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.token_bytes = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 1:
                least, at = min((ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if least > rank or len(parts) == 2 and least != rank:
                    raise ValueError(f"the merges don't reach the token of rank {rank}")
                if len(parts) == 2:
                    self.pairs[ranks[parts[0]], ranks[parts[1]]] = rank
                parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @cached_property
    def beginnings(self) -> Beginnings:
        ranks = {token[:k]: -1 for token in self.token_bytes for k in range(len(token))}
        ranks |= {token: rank for rank, token in enumerate(self.token_bytes) if token}
        every = sorted(ranks, key=lambda b: (len(b), b))
        numbers = {b: k for k, b in enumerate(every)}
        longer = np.array([numbers[b[:-1]] << 8 | b[-1] for b in every[1:]], np.int64)
        return Beginnings(longer, np.array([ranks[b] for b in every], np.int64), np.array([len(b) for b in self.token_bytes], np.int64))


#: Inside the fold an id is the letter of this code point plus the id: always four bytes, sorted as the ids are.
LETTERS = 1 << 16


def letter(number: int) -> str:
    return chr(LETTERS + number)


@lru_cache(maxsize=4)
def ranks_of(source: str) -> Ranks:
    return Ranks(source)


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The text of a public rank file (under 1 MB), read where the driver runs."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="ascii")


def literal(values: list, kind: str) -> Column:
    """A list as one literal: the optimizer reads the text once, when it folds constants."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; unlike views.let it works out no types for each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def ranks_in(octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray, known: Beginnings) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of all tokens of two or more bytes that stand anywhere in some words, which are slices of octets, as
    pairs of arrays (number of the word, rank), ascending and distinct. No other token can be merged in a word.

    All places of all words are read at once, a byte further at each step, as long as a token begins with what was read.
    """
    word = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(word)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    last = (starts + sizes - 1)[word]
    state = octets[at].astype(np.int64) + 1
    found = [np.empty(0, np.int64)]
    while len(at):
        more = at < last
        at, word, last = at[more] + 1, word[more], last[more]
        sought = state[more] << 8 | octets[at]
        place = np.searchsorted(known.longer, sought)
        hit = known.longer.take(place, mode="clip") == sought
        at, word, last, state = at[hit], word[hit], last[hit], place[hit] + 1
        ranks = known.ranks[state]
        token = ranks >= 0
        found.append(word[token] << 32 | ranks[token])
    every = np.sort(np.concatenate(found))
    every = every[np.diff(every, prepend=-1) != 0]
    return every >> 32, every & 0xFFFFFFFF


def folded(octets: Column, ranks: Column, first: Column, pairs: Column, letters: Column) -> Column:
    """Ids of a word from its bytes, by a fold over the ranks of the tokens in it, ascending.

    A step replaces the pair that makes a token, if it stands there, by the token, from left to right. That is the order
    of merging least ranks first, as no merge of a rank file that Ranks accepts makes a pair of a lower rank.
    """

    def ids(word: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.ascii(F.substring(word, k, F.lit(1))) - LETTERS)

    start = F.array_join(F.transform(octets, lambda b: F.get(first, b.cast("int").bitwiseAND(255))), "")
    return F.aggregate(ranks, start, lambda word, rank: F.replace(word, F.get(pairs, rank), F.get(letters, rank)), ids)


class Heap(Vocabulary):
    """The merges of a rank file for long words, in a worker."""

    def __init__(self, first: list[int], pairs: dict[tuple[int, int], int]) -> None:
        self.first = first
        self.joins = {pair: (rank, rank) for pair, rank in pairs.items()}


def in_blocks(docs: DataFrame, ranks: Ranks, text: str, carry: list[str]) -> DataFrame:
    """A row for each block of texts: rows (carry, codes), words (bytes and the ranks of the tokens in them, or ids of
    long words and of words that are tokens: Ranks sees that their merges reach them)."""
    spark = docs.sparkSession
    short_batches(spark)
    kinds = [docs.schema[c] for c in carry]
    rows = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(kinds)] + [T.StructField("codes", T.ArrayType(T.IntegerType()))])
    words = T.StructType([T.StructField("bytes", T.ArrayType(T.ByteType())), T.StructField("ranks", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("rows", T.ArrayType(rows)), T.StructField("words", T.ArrayType(words))])
    shared = spark.sparkContext.broadcast((ranks.first, ranks.pairs))
    beginnings = spark.sparkContext.broadcast(tuple(ranks.beginnings))

    def lists(values: pa.Array, lengths: Sequence[int]) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, find_ascii = regex.compile(WORDS).findall, re.compile(ASCII_WORDS).findall
        heap = None
        found: list[pa.Array] = []
        numbered: list[pa.DictionaryArray] = []
        counts: list[int] = []
        carried: list[pa.RecordBatch] = []
        size = held = 0

        def number() -> None:
            nonlocal held
            if found:
                numbered.append(pa.concat_arrays(found).dictionary_encode())
            found.clear()
            held = 0

        def block() -> pa.RecordBatch:
            nonlocal heap
            known = Beginnings(*beginnings.value)
            number()
            every = pa.concat_arrays(numbered)
            numbered.clear()
            sizes = pc.binary_length(every.dictionary).to_numpy().astype(np.int64)
            octets = np.frombuffer(every.dictionary.buffers()[2] or b"", np.uint8)
            starts = np.cumsum(sizes) - sizes
            steps, inside = np.zeros(len(sizes), np.int64), [np.empty(0, np.int32)]
            ids: list[list[int] | None] = [None] * len(sizes)
            for k in np.flatnonzero(sizes == 1).tolist():
                ids[k] = [int(known.ranks[1 + octets[starts[k]]])]
            for k in np.flatnonzero(sizes > SHORT_WORD).tolist():
                heap = heap or Heap(*shared.value)
                ids[k] = heap.long_word([heap.first[b] for b in octets[starts[k] : starts[k] + sizes[k]].tolist()])
            short = np.flatnonzero((sizes > 1) & (sizes <= SHORT_WORD))
            for some in (short[k : k + WORDS_AT_ONCE] for k in range(0, len(short), WORDS_AT_ONCE)):
                word, rank = ranks_in(octets, starts[some], sizes[some], known)
                whole = known.sizes[rank] == sizes[some][word]
                for k, own in zip(some[word[whole]].tolist(), rank[whole].tolist(), strict=True):
                    ids[k] = [own]
                folds = np.ones(len(some), bool)
                folds[word[whole]] = False
                inside.append(rank[folds[word]].astype(np.int32))
                steps[some] = np.bincount(word, minlength=len(some)) * folds
            folds = np.array([i is None for i in ids], bool)
            own = pa.array(octets[np.repeat(folds, sizes)].view(np.int8))
            in_words = pa.array(np.concatenate(inside))
            inside.clear()
            distinct = pa.StructArray.from_arrays([lists(own, sizes * folds), lists(in_words, steps), pa.array(ids, pa.list_(pa.int32()))], words.names)
            columns = [pa.concat_arrays([b.column(k) for b in carried]) for k in range(len(carry))]
            of_text = pa.StructArray.from_arrays([*columns, lists(every.indices, counts)], rows.names)
            counts.clear(), carried.clear()
            return pa.RecordBatch.from_arrays([lists(of_text, [len(of_text)]), lists(distinct, [len(distinct)])], ["rows", "words"])

        for batch in batches:
            texts, start = batch.column(0), 0
            for k, value in enumerate(texts):
                string = value.as_py() or ""
                if size and size + len(string) > BLOCK_CHARS:
                    carried.append(batch.slice(start, k - start).select(range(1, 1 + len(carry))))
                    yield block()
                    start, size = k, 0
                if held and held + len(string) > PIECE_CHARS:
                    number()
                size += len(string)
                held += len(string)
                found.append(pa.array((find_ascii if string.isascii() else find)(string), pa.string()))
                counts.append(len(found[-1]))
            carried.append(batch.slice(start).select(range(1, 1 + len(carry))))
        if counts:
            yield block()

    return docs.select(F.col(text), *(F.col(c) for c in carry)).mapInArrow(cut, schema)


def encode(docs: DataFrame, source: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), into: str = "ids") -> DataFrame:
    """The columns of carry and the ids of each whole text (array of int), as by tiktoken's encode_ordinary.

    source is the text of a rank file. A null or empty text has no ids; repeated rows each
    give a row; an empty table gives none. A text of any length is encoded whole;
    words of over 96 bytes are merged by a heap. Other columns than those of carry don't matter.
    """
    blocks, ids = word_ids(docs, source, text, list(carry))
    gathered = lambda of: lambda r: F.struct(*carried(r, carry), F.flatten(F.transform(r["codes"], lambda c: F.get(of, c))).alias("ids"))
    each = blocks.select(F.explode(bound(ids, lambda of: F.transform("rows", gathered(of)))).alias("r"))
    return each.select(*(F.col(f"r.c{k}").alias(c) for k, c in enumerate(carry)), F.col("r.ids").alias(into))


def word_ids(docs: DataFrame, source: str, text: str, carry: list[str]) -> tuple[DataFrame, Column]:
    """Blocks of texts, and the ids of the distinct words of each."""
    ranks = ranks_of(source)
    parts = {rank: letter(left) + letter(right) for (left, right), rank in ranks.pairs.items()}
    first = literal([letter(k) for k in ranks.first], "array<string>")
    pairs = literal([parts.get(k) for k in range(len(ranks.token_bytes))], "array<string>")
    letters = literal([letter(k) for k in range(len(ranks.token_bytes))], "array<string>")
    ids = F.transform("words", lambda w: F.coalesce(w["ids"], folded(w["bytes"], w["ranks"], first, pairs, letters)))
    return in_blocks(docs, ranks, text, carry), ids


def carried(row: Column, carry: Sequence[str]) -> list[Column]:
    return [row[f"c{k}"].alias(f"c{k}") for k in range(len(carry))]


def round_trip(docs: DataFrame, source: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and decoded_sha256 (of the bytes that the ids
    stand for) of each whole text.

    Ids are written down and decoded once for each distinct word of a block; a text joins those of its words. Nulls,
    repeated rows, empty tables and long texts are as in encode.
    """
    blocks, ids = word_ids(docs, source, text, list(carry))
    pieces = literal([t.hex() for t in ranks_of(source).token_bytes], "array<string>")

    def of_texts(numbers: Column, octets: Column) -> Column:
        joined = lambda r, of, by: F.array_join(F.transform(r["codes"], lambda c: F.get(of, c)), by)
        return F.transform("rows", lambda r: F.struct(*carried(r, carry), joined(r, numbers, ",").alias("numbers"), joined(r, octets, "").alias("text")))

    def of_ids(each: Column) -> Column:
        numbers = F.transform(each, lambda i: F.array_join(i.cast("array<string>"), ","))
        # The bytes of a whole word are a string again, which a text joins as it is.
        octets = F.transform(each, lambda i: F.unhex(F.array_join(F.transform(i, lambda k: F.get(pieces, k)), "")).cast("string"))
        return bound(numbers, lambda n: bound(octets, lambda o: of_texts(n, o)))

    rows = blocks.select(F.explode(bound(ids, of_ids)).alias("r")).select("r.*")
    commas = F.octet_length("numbers") - F.octet_length(F.replace("numbers", F.lit(","), F.lit("")))
    return rows.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)),
        F.when(F.col("numbers") == "", 0).otherwise(commas + 1).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("numbers").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def decoded(ids: Column, source: str) -> Column:
    """The bytes that ids stand for, in a row; null ids give none. Ids outside the file stand for nothing."""
    pieces = literal([t.hex() for t in ranks_of(source).token_bytes], "array<string>")
    return F.unhex(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda k: F.get(pieces, k)), ""))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_ranks())
