"""The candidate searches that block their pairs lose none of them: against all pairs."""

import random

from logloom.operators import entities, joins, lifecycle
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, above[j + 1] + 1, above[j] + (x != y)))
    return row[-1]


def alike(a, b):
    return 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b))


def noisy(rng, word):
    letters = list(word)
    for _ in range(rng.randrange(0, 4)):
        at = rng.randrange(len(letters) + 1)
        step = rng.randrange(3)
        if step == 0:
            letters.insert(at, rng.choice("abcde"))
        elif letters and at < len(letters):
            letters[at : at + 1] = [] if step == 1 else [rng.choice("abcde")]
    return "".join(letters)


def words(rng, n):
    return sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 15))) for _ in range(n)})


def test_entries_match_those_of_all_pairs(spark):
    rng = random.Random(2)
    labels = words(rng, 120)
    texts = sorted({noisy(rng, rng.choice(labels)) for _ in range(250)} | {"", "zzzzzz"})
    keys = spark.createDataFrame([(k, w, w) for k, w in enumerate(labels)], "entry_id long, label string, key string")
    for accept, review, margin in ((0.84, 0.72, 0.08), (0.62, 0.54, 0.02)):
        floor, expected = min(review, accept - margin), {}
        for t in texts:
            scores = sorted((-(alike(t, w) if t != w else 1.0) + 0.08 * max(abs(len(t) - len(w)) - 1, 0), k) for k, w in enumerate(labels) if t and abs(len(t) - len(w)) <= 4)
            good = [(-s, k) for s, k in scores if -s >= floor]
            if good:
                second = good[1][0] if len(good) > 1 else floor
                sure = good[0][0] >= 1 or (good[0][0] >= accept and good[0][0] - second >= margin - 1e-9)
                expected[t] = ("accepted" if sure else "review" if good[0][0] >= review else "not_found", round(good[0][0], 9))
            else:
                expected[t] = ("not_found", None)
        got = entities.match_entries(spark.createDataFrame([(t,) for t in texts], "text string"), keys, accept, review, margin).collect()
        assert {r["text"]: (r["status"], r["score"] and round(r["score"], 9)) for r in got} == expected


def test_session_keys_come_first_and_only_in_their_own_battle(spark):
    texts = spark.createDataFrame([("b1", "akumoro"), ("b2", "akumoro"), ("b1", "tesnira"), ("b2", "qq")], "battle string, text string")
    session = spark.createDataFrame([("b1", 1, "akumaru", "akumaru"), ("b2", 2, "tesniro", "tesniro")], "battle string, entry_id int, label string, key string")
    keys = spark.createDataFrame([(1, "akumaru", "akumaru"), (2, "tesniro", "tesniro"), (3, "akamoro", "akamoro")], "entry_id int, label string, key string")
    got = {(r["battle"], r["text"]): (r["label"], r["status"], r["matched_in"], len(r["evidence"])) for r in entities.prioritized_match(texts, session, keys, "battle").collect()}
    assert got[("b1", "akumoro")] == ("akumaru", "accepted", "session", 1)
    assert got[("b2", "akumoro")][:3] == ("akamoro", "accepted", "global")
    assert got[("b1", "tesnira")][:3] == ("tesniro", "accepted", "global")
    assert got[("b2", "qq")][1] == "not_found" and got[("b2", "qq")][3] == 2


def test_coverage_candidates_match_all_pairs(spark):
    rng = random.Random(7)
    skeletons = words(rng, 60) + ["a", "b", "aaaa", "aaaaaa", "ab" * 8]
    matches = sorted({noisy(rng, rng.choice(skeletons)) for _ in range(120)} | {"c", "d", "xay", "abc", "aaaaa", "ba" * 8, ""})
    expected = {}
    for m in filter(None, matches):
        found = []
        for k, s in enumerate(skeletons):
            score = 0.94 if s in m else 0.9 if m in s else alike(m, s)
            if score >= 0.68:
                found.append((k % 3, -round(score, 9), f"s{k:03d}"))
        if found:
            expected[m] = sorted(found)[:5]
    index = spark.createDataFrame([(f"s{k:03d}", k % 3, s) for k, s in enumerate(skeletons)], "source string, priority int, skeleton string")
    got = {}
    for r in lifecycle.coverage_candidates(spark.createDataFrame([(m, m) for m in matches], "id string, match string"), index).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["priority"], -round(r["score"], 9), r["source"]))
    assert got == expected
    assert {"xay", "abc"} <= set(got)


def test_merge_candidates_with_very_long_intervals(spark):
    rng = random.Random(5)
    rows = []
    for k in range(160):
        opened = rng.randrange(0, 400_000)
        rows.append(("b", k, opened, opened + rng.choice([0, 10, 900, 1500, 1501, 40_000, 86_400_000]), rng.random() < 0.4, "x"))
    df = spark.createDataFrame(rows, "battle_id string, id long, opened_ms long, end_ms long, resolved boolean, identity string")
    got = {r["id"]: r["partner_id"] for r in joins.merge_candidates(df, F.lit(1.0), F.lit(1.0)).collect()}
    expected = {}
    for _, k, opened, end, resolved, _ in rows:
        near = []
        for _, j, other, other_end, done, _ in rows if not resolved else []:
            gap = max(0, max(opened, other) - min(end, other_end))
            between = any(d and min(opened, other) < o < max(opened, other) for _, _, o, _, d, _ in rows)
            if done and gap <= 1500 and not between:
                near.append(j)
        if near:
            expected[k] = min(near)
    assert got == expected and len(got) > 20
