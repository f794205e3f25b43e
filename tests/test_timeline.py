"""Window operators against plain sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import aggregates, joins, timeline


def log(n=300, seed=1, span=5000):
    rng = random.Random(seed)
    return [(rng.randrange(4), k, rng.randrange(span), rng.choice("abc"), rng.random() * 100) for k in range(n)]


COLUMNS = "battle long, id long, ts long, kind string, score double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(log(), COLUMNS)


def sequential_dedupe(given, window):
    out, last = {}, {}
    for battle, k, ts, kind, _ in sorted(given, key=lambda r: (r[2], r[1])):
        seen = [t for t in last.get((battle, kind), []) if 0 <= ts - t <= window]
        out[k] = bool(seen)
        last.setdefault((battle, kind), []).append(ts)  # suppressed rows count too
    return out


def test_sliding_dedupe_is_the_sequential_loop(rows):
    got = timeline.sliding_dedupe_unique(rows, ["battle", "kind"], "ts", "id", 60)
    assert {r["id"]: r["suppressed"] for r in got.collect()} == sequential_dedupe(log(), 60)


def test_rows_of_one_message_do_not_see_each_other(spark):
    given = [(1, "m1", 0, "x"), (1, "m1", 0, "x"), (1, "m2", 10, "x"), (1, "m3", 100, "x")]
    df = spark.createDataFrame(given, "battle long, message string, ts long, kind string")
    got = timeline.sliding_dedupe(df, ["battle", "kind"], "ts", ["message"], 20)
    assert sorted((r["message"], r["suppressed"]) for r in got.collect()) == [("m1", False), ("m1", False), ("m2", True), ("m3", False)]


def test_run_lengths_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "p long, ts long, v string")
    got = timeline.run_lengths(df, "p", ["ts"], "v").orderBy("run").collect()
    assert [(r["v"], r["n"]) for r in got] == [("a", 2), (None, 2), ("a", 1)]


def test_as_of_and_existence(rows):
    given = log()
    got = timeline.as_of_last(rows, "battle", "ts", "id", F.when(F.col("kind") == "a", F.col("score")), 200, "last")
    for r in got.collect():
        earlier = [g for g in given if g[0] == r["battle"] and g[3] == "a" and r["ts"] - 200 <= g[2] < r["ts"]]
        expected = max(earlier, key=lambda g: (g[2], g[1]))[4] if earlier else None
        assert r["last"] == expected
    got = timeline.exists_within(rows, ["battle"], "ts", F.col("kind") == "b", 50, "there")
    for r in got.collect():
        assert r["there"] == any(g[0] == r["battle"] and g[3] == "b" and r["ts"] - 50 <= g[2] < r["ts"] for g in given)


def test_band_join_misses_no_pair(rows):
    given = log()
    got = {(r["id"], r["r_id"]) for r in joins.band_join(rows, rows, ["battle"], "ts", 37).collect()}
    assert got == {(a[1], b[1]) for a in given for b in given if a[0] == b[0] and abs(a[2] - b[2]) <= 37}


def test_merge_candidates_against_brute_force(spark):
    rng = random.Random(3)
    given = [(rng.randrange(3), k, t := rng.randrange(40_000), t + rng.randrange(3000), rng.random() < 0.4, rng.randrange(3), rng.random()) for k in range(120)]
    df = spark.createDataFrame(given, "battle_id long, id long, opened_ms long, end_ms long, resolved boolean, identity long, word double")
    near = 1 - F.abs(F.col("word") - F.col("r_word")) / 3
    got = {r["id"]: (r["partner_id"], round(r["score"], 9)) for r in joins.merge_candidates(df, near, F.lit(0.9)).collect()}
    expected = {}
    for a in given:
        best = []
        for b in given:
            if a[0] != b[0] or a[4] or not b[4]:
                continue
            gap = max(0, max(a[2], b[2]) - min(a[3], b[3]))
            low, high = sorted((a[2], b[2]))
            between = any(c[0] == a[0] and c[4] and low < c[2] < high for c in given)
            text = 1 - abs(a[6] - b[6]) / 3
            score = min(1, 0.3 + 0.35 * text + 0.2 * 0.9 + (0.15 if a[5] == b[5] else 0))
            if gap <= 1500 and not between and text >= 0.66 and score >= 0.72:
                best.append((-score, b[1]))
        if best:
            score, partner = min(best)
            expected[a[1]] = (partner, round(-score, 9))
    assert got == expected


def test_m_of_n_and_slots(spark):
    df = spark.createDataFrame([(1, k, k * 100, k in (1, 2, 4)) for k in range(7)], "p long, k long, ts long, there boolean")
    got = timeline.m_of_n(df, ["p"], ["k"], "ts", F.col("there"), 3, 5, 250).orderBy("k").collect()
    assert [r["confirmed"] for r in got] == [False, False, False, False, True, True, False]
    slots = timeline.numbered_slots(spark.createDataFrame([("m1", 1), ("m2", 1), ("m2", 2)], "m string, s long"), "m", "s", "slot")
    assert sorted(r["slot"] for r in slots.collect()) == ["evt_m1", "evt_m2_1", "evt_m2_2"]


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "battle_id long, type string, actor string")
    one = spark.createDataFrame([(1, "x", None)], "battle_id long, type string, actor string")
    assert aggregates.battle_statistics(none, none).count() == 0
    row = aggregates.battle_statistics(none, one).first()
    assert (row["resolved"], row["unknowns"], row["unknown_rate"]) == (0, 1, 1.0)


def test_classification_and_actions(spark):
    df = spark.createDataFrame([(["dictionary_gap", "near_miss"],), ([],), (["ui_noise"],)], "causes array<string>")
    got = df.select(aggregates.classification(F.col("causes")).alias("c"), aggregates.actions_of(F.col("causes")).alias("a")).collect()
    assert [r["c"] for r in got] == ["near_miss", "unclassified", "ui_noise"]
    assert got[0]["a"] == ["add_alias", "add_fixture", "adjust_threshold"] and got[1]["a"] == ["review_only"]
