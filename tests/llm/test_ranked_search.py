"""Tiered search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from logloom.llm import ranked_search
from logloom.llm.ranked_search import TERM, ranked


def terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 75 + 25 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return out


def compare(spark, docs, items, top=20):
    left = spark.createDataFrame([(*d, 0, "x", 1) for d in docs], "doc_id long, text string, row int, term string, score int").repartition(3)
    right = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int")
    order = lambda r: tuple((x is None, x or 0) for x in r)
    found = sorted((tuple(r) for r in ranked(left, right, top=top).select("item_id", "rank", "doc_id", "score").collect()), key=order)
    assert found == sorted(plain(docs, items, top), key=order)


@pytest.mark.parametrize("tiers", [((256, 1 / 256), (4096, 1 / 16)), ((2, 0.0), (5, 0.0)), ((1, 0.0), (1, 0.0), (4, 0.1))])
def test_answers_are_exact_whatever_the_tiers(spark, monkeypatch, tiers):
    monkeypatch.setattr(ranked_search, "TIERS", tiers)
    monkeypatch.setattr(ranked_search, "PROBED", 6)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=n))
    docs = [(k, text(rng.choice([1, 5, 20, 80]))) for k in range(300)]
    docs += [(k + 1000, docs[k % 7][1]) for k in range(60)]
    items = [(k, text(rng.choice([1, 3, 12]))) for k in range(12)]
    compare(spark, docs, items, top=5)


def test_nulls_case_repeats_and_long_texts(spark):
    docs = [(1, None), (2, ""), (3, " ,;"), (4, "Straße ÄPFEL apple"), (4, "Straße ÄPFEL apple"), (None, "apple apple"), (5, "APPLE_pie\x7fapple"), (6, "x " * 50_000 + "apple"), (7, "other")]
    items = [(1, "Apple äpfel"), (1, "apple apple"), (None, "straße"), (2, None), (3, "missing words"), (4, "x")]
    compare(spark, docs, items)


def test_a_term_of_all_documents_and_empty_tables(spark):
    compare(spark, [(k, "the") for k in range(30)], [(1, "the the")])
    compare(spark, [], [(1, "a")])
    compare(spark, [(1, "a b"), (2, "b")], [])
    compare(spark, [(1, None)], [(1, "a")])
