"""Exact template matching as a walk over a lattice of spans, with small gaps at a price.

A pattern is a row of tokens: literals, dictionary slots, free text. A text has spans: where a
dictionary's keys stand in it. A match goes from token to token along spans and literals; before
the first it may skip anything, later at most max_gap characters, each of which costs confidence. Texts
meet only the patterns whose longest literal they hold (an equi-join on literals that one automaton
finds), and a small best-path search decides each such pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.occurrences import Keys, over_texts
from logloom.functions.text import match_form
from logloom.operators.entities import AUTOMATON_CHARS

# What a rule has that says nothing else, the price of a skipped character, the least confidence.
MAX_GAP, MAX_TEXT, CONFIDENCE, GAP_COST, LEAST = 3, 14, 0.92, 0.03, 0.55
#: Paths that are followed from token to token, and ways on from one path.
BRANCHES = 12
#: Slots by the name of a placeholder, and the kind of dictionary each reads; any other name is free text.
SLOTS = {"name": "actor", "actor": "actor", "pokemon": "actor", "target": "target", "move": "move", "stat": "stat"}
KINDS = {"actor": "name", "target": "name", "move": "move", "stat": "stat"}

TOKENS = T.ArrayType(T.StructType([T.StructField("slot", T.StringType()), T.StructField("literal", T.StringType())]))
LATTICE = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType() if c in ("start", "end") else T.StringType()) for c in ("kind", "start", "end", "label", "key")]))
PATHS = T.ArrayType(
    T.StructType([T.StructField("penalty", T.DoubleType()), *(T.StructField(c, T.StringType()) for c in ("actor", "target", "move", "stat", "stat_key")), T.StructField("texts", T.ArrayType(T.StringType()))])
)


@F.pandas_udf(TOKENS)
def tokens_of(patterns: pd.Series) -> pd.Series:
    """Tokens of patterns such as "{name}の{move}": literals as match texts, blank ones left out."""

    def cut(pattern: str) -> list[tuple[str | None, str | None]]:
        parts = re.split(r"\{([^}]+)\}", pattern)
        made = [(SLOTS.get(p.strip().lower(), "text"), None) if k % 2 else (None, match_form(p)) for k, p in enumerate(parts)]
        return [t for t in made if t[0] or t[1]]

    return patterns.map(cut, na_action="ignore")


def walk(text: str, tokens: list, spans: list, max_gap: int, max_text: int) -> list[tuple[float, int, tuple]]:
    """The cheapest paths through all tokens, as (penalty, end, captures), cheapest and shortest first."""
    paths: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
    for place, token in enumerate(tokens):
        grown = []
        for penalty, at, caught in paths:
            reach = len(text) if place == 0 else at + max_gap
            slot = token["slot"]
            if slot == "text":
                grown += [(penalty, end, (*caught, (slot, text[at:end], None))) for end in range(at + 1, min(len(text), at + max_text) + 1)]
                continue
            if slot:
                ways = [(s["start"], s["end"], (*caught, (slot, s["label"], s["key"]))) for s in spans if s["kind"] == KINDS[slot] and at <= s["start"] <= reach]
            else:
                literal = token["literal"]
                ways = [(k, k + len(literal), caught) for k in range(at, min(reach, len(text) - len(literal)) + 1) if text.startswith(literal, k)]
            grown += [(penalty + (start - at) * GAP_COST if place else penalty, end, more) for start, end, more in ways[:BRANCHES]]
        paths = sorted(grown, key=lambda p: p[:2])[:BRANCHES]
    return paths


@F.pandas_udf(PATHS)
def paths_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for text, tokens, spans, gap, most in batches:
        out = []
        for one in zip(text, tokens, spans, gap, most, strict=True):
            found = []
            for penalty, _, caught in walk(*one):
                # A slot that is named twice holds what it caught last.
                held = {slot: (value, key) for slot, value, key in caught}
                texts = list(dict.fromkeys(value for slot, value, _ in caught if slot == "text" and value))
                found.append((penalty, *(held.get(s, (None, None))[0] for s in ("actor", "target", "move", "stat")), held.get("stat", (None, None))[1], texts))
            out.append(found)
        yield pd.Series(out, index=text.index, dtype=object)


def lattice_of(dictionaries: dict[str, tuple[Keys, dict[str, str]]], text: str | None) -> list[tuple]:
    """(kind, start, end, label, key) of the spans of each kind's dictionary, found apart from the others."""
    return [(kind, start, end, labels[key], key) for kind, (keys, labels) in dictionaries.items() for start, end, key in keys.spans(text)]


def matched_templates(surfaces: DataFrame, rules: DataFrame, keys: DataFrame) -> DataFrame:
    """The best exact match of each message: id, rule_id, event_type, pattern, actor, actor_side, target, target_side, move, stat, stat_key, texts, confidence.

    surfaces(id, priority, match) are views of messages as match texts, rules(id, event_type, priority, patterns, constants[, max_gap,
    max_text, confidence]) and keys(kind, label, key) tables of bounded size (AUTOMATON_CHARS characters together, else an error). Of equal keys of
    a kind the least label counts. Order: rule priority, sides that the rule knows, confidence, view priority; then rule id,
    pattern, view and path, so that it is one. Messages without a match are left out.
    """
    spark = surfaces.sparkSession
    given = {"max_gap": (MAX_GAP, "int"), "max_text": (MAX_TEXT, "int"), "confidence": (CONFIDENCE, "double")}
    own = [F.coalesce(F.col(c) if c in rules.columns else F.lit(None), F.lit(v)).cast(t).alias(c) for c, (v, t) in given.items()]
    patterns = rules.select(F.col("id").alias("rule_id"), "event_type", F.col("priority").alias("rule_priority"), "constants", *own, F.posexplode("patterns").alias("pattern_place", "pattern"))
    patterns = patterns.withColumn("tokens", tokens_of("pattern")).where(F.size("tokens") > 0)
    literals = F.transform(F.filter("tokens", lambda t: t["slot"].isNull()), lambda t: t["literal"])
    kinds = F.array_distinct(F.transform(F.filter("tokens", lambda t: t["slot"].isNotNull()), lambda t: F.concat(F.lit("\0"), t["slot"])))
    dictionary = F.create_map(*(F.lit(f"\0{x}") for pair in KINDS.items() for x in pair))
    kinds = F.transform(kinds, lambda k: F.coalesce(dictionary[k], k))
    longest = F.array_max(F.transform(literals, lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))["t"]
    # What a text must hold; the longest literal, or else a slot's kind, is what they are joined on.
    patterns = patterns.withColumns({"needs": F.array_distinct(F.concat(literals, kinds)), "anchor": F.coalesce(longest, F.get(kinds, F.lit(0)))})
    known = keys.where(F.length("key") > 0).groupBy("kind", "key").agg(F.min("label").alias("label"))
    words = patterns.select(F.explode("needs").alias("w")).where(~F.startswith("w", F.lit("\0"))).distinct()
    size = known.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0] + words.agg(F.coalesce(F.sum(F.length("w")), F.lit(0))).first()[0]
    if size > AUTOMATON_CHARS:
        raise ValueError(f"dictionaries and literals of {size} characters are more than the {AUTOMATON_CHARS} that are broadcast")
    by_kind: dict[str, dict[str, str]] = {}
    for row in known.collect():
        by_kind.setdefault(row.kind, {})[row.key] = row.label
    spans = over_texts(spark, {k: (Keys(list(labels)), labels) for k, labels in by_kind.items()}, LATTICE, lattice_of)
    holds = over_texts(spark, Keys([r.w for r in words.collect()]), T.ArrayType(T.StringType()), lambda k, t: sorted({key for _, _, key in k.occurrences(t)}))
    texts = surfaces.where(F.length("match") > 0).select("match").distinct().select("match", spans("match").alias("spans"), holds("match").alias("words"))
    held = F.array_distinct(F.concat("words", F.transform("spans", lambda s: F.concat(F.lit("\0"), s["kind"])), F.array(F.lit("\0text"))))
    texts = texts.select("match", "spans", held.alias("holds")).withColumn("anchor", F.explode("holds"))
    near = texts.join(patterns, "anchor").where(F.size(F.array_except("needs", "holds")) == 0)
    found = near.select("match", "rule_id", "event_type", "rule_priority", "constants", "confidence", "pattern_place", "pattern", F.posexplode(paths_of("match", "tokens", "spans", "max_gap", "max_text")).alias("path_place", "p"))
    side = lambda who: F.col("constants")[f"{who}.side"]
    best_of_text = Window.partitionBy("match").orderBy(F.desc("rule_priority"), F.desc("sides"), F.desc("confidence"), "rule_id", "pattern_place", "path_place")
    scored = found.withColumns({
        "sides": side("actor").isNotNull().cast("int") + side("target").isNotNull().cast("int"), "confidence": F.greatest(F.lit(LEAST), F.col("confidence") - F.col("p.penalty")),
        "actor_side": side("actor"), "target_side": F.when(F.col("p.target").isNotNull(), side("target")),
    })
    one = scored.withColumn("place", F.row_number().over(best_of_text)).where("place = 1").drop("place")
    # A text's best match is that of every view with this text.
    every = surfaces.select("id", "priority", "match").join(one, "match")
    best = Window.partitionBy("id").orderBy(F.desc("rule_priority"), F.desc("sides"), F.desc("confidence"), "priority", "rule_id", "pattern_place", "match")
    rows = every.withColumn("place", F.row_number().over(best)).where("place = 1")
    return rows.select("id", "rule_id", "event_type", "pattern", "p.actor", "actor_side", "p.target", "target_side", "p.move", "p.stat", "p.stat_key", "p.texts", "confidence")
