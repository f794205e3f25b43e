"""Vector codes against a plain loop over all entries."""

import math
import random

import numpy as np
import pytest

from logloom.llm import vector_codes
from logloom.llm.vector_codes import CodeConfig, compressed


def plain(rows, config):
    """(vec_id, code, error) of rows(vec_id, vector), in Python integers."""
    kept = [(k, [math.floor(config.scale * x) for x in v]) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // config.parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(config.parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v in kept[: config.entries]), strict=True)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(config.rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v in kept:
                groups.setdefault(near(cut(v)[p], book)[1], []).append(cut(v)[p])
            for e, members in groups.items():
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for k, v in kept:
        found = [near(part, book) for part, book in zip(cut(v), books, strict=True)]
        out.append((k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def compare(spark, rows, config):
    kind = "vec_id long, embedding array<double>, code string, vector int, key string"
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], kind).repartition(3)
    found = compressed(docs, config=config).collect()
    expected, books = plain(rows, config)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.code, r.error) for r in found), key=order) == sorted(expected, key=order)
    if books:
        assert {r.codebooks_sha256 for r in found} == {vector_codes.Codebooks(np.array(books)).sha256()}


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_codes_of_random_vectors_with_ties(spark, spread):
    rng = random.Random(5)
    rows = [(k, [rng.choice([-1, 0, 1]) * spread * rng.random() for _ in range(8)]) for k in range(300)]
    rows += [(k + 300, rows[k][1]) for k in range(40)] + [(7, rows[9][1])]
    compare(spark, rows, CodeConfig(entries=16, rounds=4))


def test_what_is_dropped_and_what_stays(spark):
    rng = random.Random(6)
    good = [(k, [rng.uniform(-2, 2) for _ in range(4)]) for k in range(2, 12)]
    bad = [(0, None), (1, [1.0, None, 0.0, 0.0]), (20, [float("nan")] * 4), (21, [float("inf"), 0.0, 0.0, 0.0]), (22, []), (23, [1.0] * 8), (None, [0.5] * 4)]
    compare(spark, good + bad, CodeConfig(entries=4, rounds=2))
    compare(spark, good + bad, CodeConfig())


def test_large_components_stay_exact(spark):
    rng = random.Random(7)
    for size in (3e4, 5e5):
        compare(spark, [(k, [rng.uniform(-size, size) for _ in range(8)]) for k in range(60)], CodeConfig(entries=8, rounds=3))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert compressed(empty).collect() == []
    null = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert compressed(null).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        compressed(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))


def test_an_annulus_is_inclusive():
    ring = vector_codes.Ring(np.array([[0, 5], [3, 4], [5, 0], [3, 4], [0, 0]], float))
    found, best = ring.nearest(np.array([[3, 4], [0, 0], [4, 2], [0, 3]], float))
    assert found.tolist() == [1, 4, 1, 0] and best.tolist() == [0, 0, 5, 4]
