"""The copies that the pipeline drops, against all pairs of small corpora."""

import random

from test_text_operators import slow_fingerprint

import corpus_pipeline
from logloom.llm.copies import copies, one_of_copies

DOCS = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def slow_copies(docs):
    sets, prints = [shingles(t) for _, t in docs], [slow_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * either or (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(d, least.get(find(k), d))
    return sorted((d, least[find(k)]) for k, (d, _) in enumerate(docs))


def edited_texts():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    docs, passage = [], [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(40, 160))]
        docs.append(base)
        for edits in (1, 1, 2, 3, 4, 6):
            other = list(base)
            for at in rng.sample(range(len(base)), edits):
                other[at] = word()
            docs.append(other)
        docs.append(passage + base[:60])
    # A chain whose ends are far apart.
    chain = [word() for _ in range(120)]
    for k in range(0, 60, 3):
        chain[2 * k : 2 * k + 2] = [word(), word()]
        docs.append(list(chain))
    rng.shuffle(docs)
    rows = [(k, " ".join(words)) for k, words in enumerate(docs)]
    return [*rows, (900, ""), (901, " \n"), (902, "one"), (903, "One")]


def test_copies_are_those_of_all_pairs(spark):
    docs = edited_texts()
    expected = slow_copies(docs)
    got = sorted((r["doc_id"], r["component_id"]) for r in copies(spark.createDataFrame(docs, DOCS)).collect())
    assert got == expected


def test_the_stage_drops_a_copy_with_a_few_words_changed(spark):
    words = [f"w{k}" for k in range(150)]
    texts = [" ".join("x" if k in edits else w for k, w in enumerate(words)) for edits in ([], [20, 21], [90], [140, 141, 142])]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], f"{DOCS}, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_of_copies(spark, docs, "").collect()] == [0]


def test_rows_without_id_and_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "")], DOCS)
    assert sorted(r["doc_id"] or 0 for r in one_of_copies(docs).collect()) == [0, 1, 1, 2]
    assert copies(docs.limit(0)).count() == 0
