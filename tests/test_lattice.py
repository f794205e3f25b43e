"""Spans by automaton and the template walk, against plain versions."""

import itertools
import random

import pytest

from logloom.functions.occurrences import Keys
from logloom.operators import entities, lattice

KEYS = [("name", n) for n in ("イダイトウ", "ガブリアス", "カラマネロ", "ガブ")] + [("move", m) for m in ("たきのぼり", "じしん")] + [("stat", s) for s in ("攻撃", "素早さ")]
RULES = [
    ("life", "damage", 5, ["{name}は命が 少し削られた!"], {}),
    ("life_theirs", "damage", 5, ["相手の{name}は命が 少し削られた!"], {"actor.side": "opponent"}),
    ("field", "terrain_start", 5, ["エレキフィールドに なった!", "足元に 電気が"], {}),
    ("ability", "ability", 1, ["{name}の特性{text}が発動した"], {}),
    ("boost", "boost", 1, ["{name}の{stat}が 上がった!"], {}),
    ("used", "move", 2, ["{name}の {move}!"], {"target.side": "player"}),
    ("onto", "hit", 3, ["{name}は{target}に {move}"], {"target.side": "player"}),
    ("bare", "seen", 0, ["{name}{move}"], {}),
    ("free", "said", -1, ["{text}"], {}),
]


def tables(spark, rules=RULES):
    return spark.createDataFrame(rules, "id string, event_type string, priority int, patterns array<string>, constants map<string,string>"), spark.createDataFrame([(k, w, w, w) for k, w in KEYS], "kind string, entry_id string, label string, key string")


def read(spark, *texts, rules=RULES):
    surfaces = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id int, priority int, match string")
    return {r["id"]: r for r in lattice.matched_templates(surfaces, *tables(spark, rules)).collect()}


def test_noise_before_and_behind_sides_fields_text_and_stats(spark):
    got = read(spark, "尼手のイダイトウは命が少し削られたーー9", "相手のイダイトウは命が少し削られた", "エレキフィールドになった", "カラマネロの特性あまのじゃくが発動した", "ガブリアスの攻撃が上がった", "ガブリアスはイダイトウにじしん", "", None)
    assert (got[0]["rule_id"], got[0]["actor"], got[0]["actor_side"], got[0]["move"]) == ("life", "イダイトウ", None, None)
    assert (got[1]["rule_id"], got[1]["actor_side"]) == ("life_theirs", "opponent")
    assert (got[2]["rule_id"], got[2]["actor"]) == ("field", None)
    assert (got[3]["rule_id"], got[3]["actor"], got[3]["texts"]) == ("ability", "カラマネロ", ["あまのじゃく"])
    assert (got[4]["rule_id"], got[4]["stat"], got[4]["stat_key"]) == ("boost", "攻撃", "攻撃")
    assert (got[5]["rule_id"], got[5]["actor"], got[5]["target"], got[5]["target_side"], got[5]["move"]) == ("onto", "ガブリアス", "イダイトウ", "player", "じしん")
    assert set(got) == {0, 1, 2, 3, 4, 5}


def test_gaps_cost_and_end_at_the_bound(spark):
    rules = [r for r in RULES if r[0] in ("used", "bare")]
    got = read(spark, *(f"xxxxxガブリアス{'z' * g}の{'y' * h}じしん" for g in range(5) for h in range(5)), rules=rules)
    for k, (g, h) in enumerate(itertools.product(range(5), range(5))):
        if g > 3 or h > 3:
            assert k not in got or got[k]["rule_id"] == "bare"
        else:
            assert got[k]["rule_id"] == "used" and got[k]["confidence"] == pytest.approx(max(0.55, 0.92 - 0.03 * (g + h)))


def plain_walk(text, tokens, spans, max_gap, max_text):
    """All paths, without a bound on branches."""
    if not tokens:
        return [(0.0, 0, ())]
    out = []
    for penalty, at, caught in plain_walk(text, tokens[:-1], spans, max_gap, max_text):
        token, first = tokens[-1], len(tokens) == 1
        for start in range(at, len(text) + 1):
            for end in range(start + 1, len(text) + 1):
                gap_ok = first or start - at <= max_gap
                cost = 0 if first else (start - at) * 0.03
                if token["slot"] == "text" and start == at and end - start <= max_text:
                    out.append((penalty, end, (*caught, ("text", text[start:end], None))))
                elif token["slot"] and token["slot"] != "text" and gap_ok:
                    out += [(penalty + cost, end, (*caught, (token["slot"], s["label"], s["key"]))) for s in spans if (s["start"], s["end"], s["kind"]) == (start, end, lattice.KINDS[token["slot"]])]
                elif token["literal"] and gap_ok and text[start:end] == token["literal"]:
                    out.append((penalty + cost, end, caught))
    return sorted(out, key=lambda p: p[:2])


def test_the_walk_finds_the_cheapest_path():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("abc", k=9))
        spans = [{"kind": rng.choice(["name", "move"]), "start": (s := rng.randrange(8)), "end": s + rng.choice([1, 2]), "label": text[s : s + 2], "key": "k"} for _ in range(3)]
        spans.sort(key=lambda s: s["start"])
        tokens = [rng.choice([{"slot": None, "literal": rng.choice(["a", "ab", "c"])}, {"slot": rng.choice(["actor", "move", "text"]), "literal": None}]) for _ in range(rng.randrange(1, 4))]
        full, found = plain_walk(text, tokens, spans, 3, 4), lattice.walk(text, tokens, spans, 3, 4)
        assert set(found) <= set(full) and found == sorted(found, key=lambda p: p[:2]) and len(found) <= lattice.BRANCHES
        if max(len(plain_walk(text, tokens[: k + 1], spans, 3, 4)) for k in range(len(tokens))) <= lattice.BRANCHES:
            assert sorted(map(repr, found)) == sorted(map(repr, full))


def test_spans_by_automaton_and_by_join_are_the_same(spark, monkeypatch):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 5))) for _ in range(12)})
    texts = [(k, "".join(rng.choices("abc", k=rng.randrange(0, 25)))) for k in range(60)] + [(60, None), (61, "ab" * 3000)]
    texts, table = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(k,) for k in [*keys, keys[0], "", None]], "key string")
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "start", "end", "key").collect())
    automaton = rows(entities.dictionary_spans(texts, table))
    small = texts.where("id < 61")
    monkeypatch.setattr(entities, "AUTOMATON_CHARS", 0)
    assert rows(entities.dictionary_spans(small, table)) == [r for r in automaton if r[0] < 61]
    for own, text in small.collect():
        taken, kept = set(), []
        for start, end, key in sorted(((s, s + len(k), k) for k in keys for s in range(len(text or "")) if (text or "").startswith(k, s)), key=lambda o: (o[0] - o[1], o[0])):
            if not taken & set(range(start, end)):
                taken |= set(range(start, end))
                kept.append((own, start, end, key))
        assert sorted(kept) == [r for r in automaton if r[0] == own]
    assert Keys([]).spans("abc") == [] and Keys(["a"]).spans(None) == []
