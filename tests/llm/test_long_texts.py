"""Very long texts through the operators that take texts apart in Python."""

import random

import numpy as np

from logloom.llm import bpe, html_text, line_dedup, simhash


def long_text(n=400_000):
    rng = random.Random(2)
    return "".join(rng.choice(["word ", "Ünï ", "12 ", "\n", "... ", "日本 ", "ab" * 20 + " "]) for _ in range(n // 6))


def test_bpe_of_long_texts_and_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.Vocabulary(bpe.public_vocabulary())
    rng = random.Random(3)
    for text in (long_text(), "".join(rng.choice("abcde") for _ in range(60_000)), " " * 50_000, "é" * 20_000):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_fingerprints_and_lines_of_long_texts():
    from test_text_operators import slow_fingerprint

    text = long_text(200_000)
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    places, hashes = line_dedup._long_lines("x" * 300_000 + "\n" + "short\n" + "y" * 40, 40)
    assert places == [0, 2] and len(set(hashes)) == 2


def test_pages_of_a_megabyte():
    page = "<p>" + "<b>some</b> text &amp; more " * 40_000
    assert html_text.page_text(page).split() == ["some", "text", "&", "more"] * 40_000
