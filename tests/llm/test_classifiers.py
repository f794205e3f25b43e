"""The classifiers' n-grams, sample statistics and fit against plain versions."""

import random

import numpy as np
import pytest

from logloom.llm import nbsvm, quality, toxicity

DOCS = "doc_id long, text string"


def plain_hash(codes):
    value = 0
    for code in codes:
        value = (value * 0x9E3779B97F4A7C15 + int(code) + 1) & (1 << 64) - 1
    return ((value ^ value >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 64 - nbsvm.BITS


def plain_toxic(text):
    plain = f" {' '.join(text.lower().split())} "
    return {plain_hash(map(ord, plain[k : k + n])) for n in toxicity.SIZES for k in range(len(plain) - n + 1)}


def plain_quality(text):
    codes, last = quality.Codes(), None
    shapes, out = [], set()
    for word in text.split():
        (shape,), (own,) = codes.of([word])
        shapes.append(int(shape) ^ (0x5851F42D4C957F2D if own == last else 0))
        out.add(plain_hash([int(own) ^ 0x14057B7EF767814F]))
        last = own
    return out | {plain_hash(shapes[k : k + n]) for n in quality.SHAPE_SIZES for k in range(len(shapes) - n + 1)}


def texts():
    rng = random.Random(8)
    pieces = ["Word", "word", " ", "  ", "\n", "\t \n", " ", "ÄÖ", "x1-y", "日本", "ab", "###", "A", "Mc9", "..", "same same"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 120))) for _ in range(80)]
    return ["", " ", "\n\n", "a", " a ", "word" * 300, *made]


@pytest.mark.parametrize("block", [1, 2, 7, 50, 1 << 15])
@pytest.mark.parametrize("module,grams,plain", [(toxicity, toxicity.character_grams, plain_toxic), (quality, quality.word_grams, plain_quality)])
def test_ngrams_do_not_depend_on_the_blocks(monkeypatch, module, grams, plain, block):
    monkeypatch.setattr(module, "BLOCK", block)
    for text in texts():
        found = nbsvm.present(text, grams)
        assert found.dtype == np.int32 and set(found.tolist()) == plain(text) and (np.diff(found) > 0).all()


def test_words_that_differ_late_have_shapes_of_their_own():
    codes = quality.Codes()
    shapes, _ = codes.of(["1-" * 40 + "a", "1-" * 40 + "A", "1-" * 40 + "b"])
    assert shapes[0] != shapes[1] and shapes[0] == shapes[2]
    assert not codes  # too long to be remembered


def test_long_texts_take_bounded_memory():
    import tracemalloc

    for grams, text in ((toxicity.character_grams, "some Words and 12 more " * 60_000), (toxicity.character_grams, "x" * 1_000_000), (quality.word_grams, "some Words and 12 more " * 60_000)):
        tracemalloc.start()
        nbsvm.present(text, grams)
        assert tracemalloc.get_traced_memory()[1] < 40_000_000
        tracemalloc.stop()


def made_labels(n=260):
    rng = random.Random(3)
    out = []
    for k in range(n):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 40))]
        label = int(rng.random() < 0.4)
        if label and rng.random() < 0.9:
            words.insert(rng.randrange(len(words)), "grobian")
        out.append((k, " ".join(words), label))
    return out


def plain_model(made, prior, cfg):
    """The same estimator from sets and dictionaries."""
    docs = [(sorted(plain_toxic(t)), y) for _, t, y in made]
    count = {0: {}, 1: {}}
    for grams, y in docs:
        for g in grams:
            count[y][g] = count[y].get(g, 0) + 1
    n = [sum(y == c for _, y in docs) for c in (0, 1)]
    ratio = {}
    for g in count[0].keys() | count[1].keys():
        low, high = count[0].get(g, 0), count[1].get(g, 0)
        if low + high < cfg.min_df:
            continue
        a = cfg.smoothing
        low, high = low + a, high + a
        r = np.log(high / (n[1] + 2 * a)) - np.log(low / (n[0] + 2 * a))
        if abs(r) >= cfg.min_z * np.sqrt(1 / high + 1 / low - 1 / (n[1] + 2 * a) - 1 / (n[0] + 2 * a) + 1e-12):
            ratio[g] = r
    return ratio, docs


def test_training_matches_a_plain_version(spark):
    made, cfg = made_labels(), nbsvm.TrainConfig()
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], DOCS)
    labels = spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, label int")
    model = nbsvm.train(docs, labels, toxicity.character_grams, cfg)
    ratio, rows = plain_model(made, None, cfg)
    assert set(model.buckets.tolist()) == set(ratio) and len(ratio) > 10
    # The primal objective of the fitted weights is not lowered by any small change.
    place = {b: k for k, b in enumerate(model.buckets.tolist())}
    scale = np.array([ratio[b] for b in model.buckets.tolist()])
    x = np.zeros((len(rows), len(place) + 1))
    x[:, -1] = 1
    for k, (grams, _) in enumerate(rows):
        for g in grams:
            if g in place:
                x[k, place[g]] = ratio[g]
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    w = np.append(model.weights / scale, model.bias)
    loss = lambda v: v @ v / 2 + cfg.cost * np.maximum(0, 1 - y * (x @ v)).sum()
    best, rng = loss(w), np.random.default_rng(1)
    for size in (1e-3, 1e-2, 1e-1):
        for _ in range(200):
            assert loss(w + size * rng.standard_normal(len(w))) >= best - 2e-2


def test_labels_of_one_class_and_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, None)], DOCS)
    score = lambda labels: toxicity.toxicity(docs, nbsvm.train(docs, spark.createDataFrame(labels, "doc_id long, label int"), toxicity.character_grams)).first()["score"]
    assert score([(1, 1), (2, 1)]) > 0.9 and score([(1, 0)]) < 0.1 and score([(9, 1)]) == pytest.approx(0.5)
