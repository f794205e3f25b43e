"""Ranked byte-level BPE against tiktoken and against a merge-by-merge version."""

import base64
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from logloom.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
SOURCE = byte_bpe.public_ranks()
RANKS = {base64.b64decode(a): int(b) for a, b in map(str.split, SOURCE.splitlines())}

TEXTS = [
    None,
    "",
    "The cat sat on the mat.",
    "The cat sat on the mat.",
    "  two  blanks\n\n\nand lines \t\x00\x7f",
    "Größe, niño, été; 数字 ١٢٣ и слово",
    "a" * 95 + " " + "a" * 96 + " " + "a" * 97 + " " + "a" * 5000,
    "-" * 200 + " " * 300 + "ab" * 700,
    "emoji 👩‍👩‍👧 and \U0001e4d0 \U00010d40 " + "̈́",
    "x" + "é" * 2000,
    "<|endoftext|> isn't special; we'll see 'S 's",
    "word " * 20000,
]


def expected(text):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    return plain.encode_ordinary(text or "")


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_ids_are_those_of_tiktoken(spark, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", block)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "no id", "y")], "doc_id long, text string, ids string").repartition(2)
    rows = byte_bpe.encode(docs, SOURCE).withColumn("bytes", byte_bpe.decoded(F.col("ids"), SOURCE)).collect()
    assert len(rows) == len(TEXTS) + 1
    digests = {r.doc_id: tuple(r)[1:] for r in byte_bpe.round_trip(docs, SOURCE).collect()}
    for k, text in [*enumerate(TEXTS), (None, "no id")]:
        ids = expected(text)
        assert digests[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    for row in rows:
        text = "no id" if row.doc_id is None else TEXTS[row.doc_id]
        assert row.ids == expected(text)
        assert bytes(row.bytes) == (text or "").encode()


def test_empty_tables_other_columns_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(none, SOURCE).collect() == []
    one = spark.createDataFrame([(1, {"a": 1}, "hi")], "rows long, words map<string,int>, text string")
    assert [tuple(r) for r in byte_bpe.encode(one, SOURCE, carry=("rows", "words"), into="codes").collect()] == [(1, {"a": 1}, expected("hi"))]
    null = spark.createDataFrame([(None,)], "ids array<int>").select(byte_bpe.decoded(F.col("ids"), SOURCE).alias("b"))
    assert bytes(null.first().b) == b""


def small_ranks(*tokens):
    """A rank file of all bytes and some tokens."""
    every = [bytes([b]) for b in range(256)] + list(tokens)
    return "\n".join(f"{base64.b64encode(t).decode()} {k}" for k, t in enumerate(every))


def test_overlapping_pairs_merge_from_the_left(spark):
    source = small_ranks(b"aa", b"ab", b"aab", b"aaaa")
    docs = spark.createDataFrame([(1, "aaab"), (2, "aaaaa"), (3, "abaab")], "doc_id long, text string")
    found = {r.doc_id: [byte_bpe.ranks_of(source).token_bytes[k] for k in r.ids] for r in byte_bpe.encode(docs, source).collect()}
    assert found == {1: [b"aa", b"ab"], 2: [b"aaaa", b"a"], 3: [b"ab", b"aab"]}


def test_files_whose_merges_do_not_reach_a_token_are_refused():
    with pytest.raises(ValueError, match="don't reach"):
        byte_bpe.Ranks(small_ranks(b"abc"))
    with pytest.raises(ValueError, match="without a rank"):
        byte_bpe.Ranks("YQ== 0")


def test_words_that_are_tokens_need_no_fold(spark):
    docs = spark.createDataFrame([(1, "the cat " + "q" * 90 + "zx")], "doc_id long, text string")
    blocks = byte_bpe.in_blocks(docs, byte_bpe.ranks_of(SOURCE), "text", ["doc_id"])
    words = [(bytes(b & 255 for b in w.bytes), w.ids) for w in blocks.first().words]
    assert [w[1] for w in words[:2]] == [[RANKS[b"the"]], [RANKS[b" cat"]]] and words[2] == (b" " + b"q" * 90 + b"zx", None)


def test_a_fold_takes_the_tokens_that_stand_in_a_word_and_no_others(spark):
    docs = spark.createDataFrame([(1, "toonesingon " + "ab" * 40)], "doc_id long, text string")
    blocks = byte_bpe.in_blocks(docs, byte_bpe.ranks_of(SOURCE), "text", ["doc_id"])
    for row in blocks.first().words:
        word = bytes(b & 255 for b in row.bytes)
        parts = {word[i:j] for i in range(len(word)) for j in range(i + 2, len(word) + 1)}
        assert row.ranks == sorted(RANKS[p] for p in parts if p in RANKS)


def test_words_put_together_at_random_are_encoded_as_by_tiktoken(spark):
    draw = random.Random(11)
    pieces = [t.decode("utf-8", "ignore") for t in draw.sample(sorted(RANKS), 400)] + list("aeinorst éßñ數") + ["aa", "abab"]
    texts = [" ".join("".join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in byte_bpe.encode(docs, SOURCE).collect():
        assert row.ids == expected(texts[row.doc_id])


def standing(word, tokens):
    """The ranks of the tokens that stand in a word, place by place; tokens: RANKS, and -1 for what only begins one."""
    found = set()
    for i in range(len(word) - 1):
        for j in range(i + 2, len(word) + 1):
            if (rank := tokens.get(word[i:j])) is None:
                break
            if rank >= 0:
                found.add(rank)
    return sorted(found)


def test_tokens_of_all_words_are_found_at_once_and_faster_than_place_by_place():
    draw = random.Random(3)
    pieces = [t for t in draw.sample(sorted(RANKS), 400) if len(t) < 9] + ["ß".encode(), b"\xff", b"\x00"]
    words = [b"".join(draw.choices(pieces, k=draw.randint(1, 5))) for _ in range(byte_bpe.WORDS_AT_ONCE)]
    octets, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    known = byte_bpe.ranks_of(SOURCE).beginnings
    tokens = {t[:k]: -1 for t in RANKS for k in range(1, len(t))} | RANKS
    took = {"plain": [], "own": []}
    for _ in range(3):
        began = time.process_time()
        plain = [standing(w, tokens) for w in words]
        took["plain"].append(time.process_time() - began)
        began = time.process_time()
        word, rank = byte_bpe.ranks_in(octets, np.cumsum(sizes) - sizes, sizes, known)
        took["own"].append(time.process_time() - began)
        assert list(zip(word.tolist(), rank.tolist(), strict=True)) == [(k, r) for k, ranks in enumerate(plain) for r in ranks]
    assert 2 * min(took["own"]) < min(took["plain"])
    some = [5, 2, 9]  # slices may be any of those of octets
    word, rank = byte_bpe.ranks_in(octets, (np.cumsum(sizes) - sizes)[some], sizes[some], known)
    assert list(zip(word.tolist(), rank.tolist(), strict=True)) == [(k, r) for k, w in enumerate(some) for r in plain[w]]


def test_texts_of_ascii_are_cut_into_the_same_words():
    find, find_ascii = regex.compile(public_tokenizers.PATTERN).findall, re.compile(byte_bpe.ASCII_WORDS).findall
    every = list(map(chr, range(128)))
    chosen = "a Z9'\n\t\x1c\x1f\x0b\x00-_" + "stmdrevl"
    for text in [*map("".join, itertools.product(every, repeat=2)), *map("".join, itertools.product(chosen, repeat=4))]:
        assert find_ascii(text) == find(text), repr(text)


@pytest.mark.parametrize("piece", [1, 200])
def test_words_numbered_in_pieces_are_those_of_the_block(spark, monkeypatch, piece):
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", piece)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    blocks = byte_bpe.in_blocks(docs, byte_bpe.ranks_of(SOURCE), "text", ["doc_id"])
    words = {w for t in TEXTS for w in regex.findall(public_tokenizers.PATTERN, t or "")}
    assert [len(b.words) for b in blocks.collect()] == [len(words)]
    for row in byte_bpe.encode(docs, SOURCE).collect():
        assert row.ids == expected(TEXTS[row.doc_id])


def test_words_of_one_byte_and_null_texts_keep_their_places(spark):
    texts = ["a", "\x1c\x1d a", " ", "a b\n\n", None, "\x00", "\x1f", "é", "q" * 97 + " the xqzj é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for row in byte_bpe.encode(docs, SOURCE).collect():
        assert row.ids == expected(texts[row.doc_id])
