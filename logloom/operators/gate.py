"""The gate for unclassified messages and other ordered predicates, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.views import let

# What signals an action in a message, and the scripts of its letters.
SIGNALS = (
    "効果", "繰り出", "ゆけ", "いけ", "戻れ", "引っこめ", "ひっこめ", "倒れ", "たおれ", "ひんし", "守り", "身を守", "体勢", "上がっ", "下がっ",
    "治った", "なおった", "回復", "負った", "外れ", "失敗", "命が少し削られ", "命か少し削られ",
)
SIGNAL_PREFIXES = ("constrained-review:", "constrained-candidate;", "span:move", "span-relation:")
SCRIPTS = r"\p{IsHiragana}\p{IsKatakana}\p{IsHan}"
UI_HINTS = ("特性", "持ち物", "もちもの", "味方の")
OWN_PREFIXES = ("味方の", "相手の")


def any_prefix(candidates: Column, prefixes: tuple[str, ...]) -> Column:
    def hit(c: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | c.startswith(p)
        return out

    return F.exists(candidates, hit)


def any_of(text: Column, hints: tuple[str, ...] | list[str]) -> Column:
    """Whether the text holds one of the hints, in one pass over it."""
    return text.rlike("|".join(hints))


def action_signal(match: Column, candidates: Column) -> Column:
    return any_prefix(candidates, SIGNAL_PREFIXES) | any_of(match, SIGNALS)


def prefix_only(match: Column) -> Column:
    return match.isin(*OWN_PREFIXES) | match.rlike(rf"^(?:相手の)?[{SCRIPTS}A-Za-z0-9ー]{{2,14}}(?:の|は)$")


def symbol_ratio(match: Column) -> Column:
    """The share of characters that are no letter of a known script and no digit; the long-vowel mark counts as a symbol."""
    n = F.length(match)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.regexp_replace(match, f"[^{SCRIPTS}A-Za-z0-9]", ""))) / n)


def fragmented(normal: Column, match: Column) -> Column:
    """Mostly single characters, with digits among them."""
    digits = F.regexp_count(match, F.lit(r"\p{N}"))

    def mostly_single(tokens: Column) -> Column:
        single = F.filter(tokens, lambda t: ~t.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}]"))
        return (F.size(tokens) >= 5) & (F.size(single) / F.size(tokens) >= 0.5)

    return (digits >= 2) & let(F.array_remove(F.split(normal, r"(?U)\s+"), ""), mostly_single)


def gate_reason(match: Column, normal: Column, confidence: Column, candidates: Column) -> Column:
    """Why a message becomes an unknown item ("accepted") or doesn't; the first rule that holds decides."""
    match = F.trim(F.coalesce(match, F.lit("")))
    candidates = F.coalesce(candidates, F.array().cast("array<string>"))
    sure, n = F.coalesce(confidence, F.lit(0.0)), F.length(match)
    partial = any_prefix(candidates, ("partial-template;",)) & match.endswith("の")

    # The rules up to here cost little; only what they leave open is searched for signals and symbols.
    early = (
        F.when(n == 0, "too_short")
        .when(prefix_only(match) | partial, "prefix_only")
        .when(normal.rlike(r"(?:^|\D)\d{1,2}\s*[:：]\s*\d{2}(?:\D|$)"), "timer")
        .when(any_of(match, UI_HINTS), "ui_fragment")
    )

    def judged(signal: Column) -> Column:
        return (
            F.when(~signal & (symbol_ratio(match) >= 0.3), "symbol_noise")
            .when(~signal & fragmented(normal, match), "other_noise")
            .when(~signal & (sure < 0.5), "low_confidence_no_action_signal")
            .when((n >= 6) & (sure >= 0.7), "accepted")
            .when((F.size(candidates) > 0) & (n >= 3) & signal, "accepted")
            .when(normal.rlike(f"[{SCRIPTS}]") & (n >= 8), "accepted")
            .when(n < 3, "too_short")
            .otherwise("other_noise")
        )

    return early.otherwise(let(action_signal(match, candidates), judged))


def admission(phase: Column, now: Column, opened: Column, closed: Column, strict: Column, wait_ms: int = 500, grace_ms: int = 1500, longest_ms: int = 6000) -> Column:
    """Struct of action (queue, defer, reject) and deadline for a message picture.

    An ended phase rejects, a candidate phase queues, a display phase queues for a short grace
    after it closed; before the deadline the decision waits; then the strict visual test decides.
    """
    deadline = F.least(opened + wait_ms, opened + longest_ms)
    since = now - closed
    action = (
        F.when(phase == "ended", "reject")
        .when(phase == "message_candidate", "queue")
        .when((phase == "hud") & since.between(0, grace_ms), "queue")
        .when(now < deadline, "defer")
        .when(strict, "queue")
        .otherwise("reject")
    )
    return F.struct(action.alias("action"), deadline.alias("deadline"))


def required_slots(kind: Column, actor: Column, target: Column, move: Column) -> Column:
    """Whether an event has the parts that its kind can't do without."""
    either = ("supereffective", "resisted", "immune", "critical", "damage", "heal", "status", "status_cure", "flinch", "boost", "unboost", "protect", "miss")
    return (
        F.when(kind == "move", actor.isNotNull() & move.isNotNull())
        .when(kind.isin("switch_in", "switch_out", "faint"), actor.isNotNull())
        .when(kind.isin(*either), actor.isNotNull() | target.isNotNull())
        .otherwise(F.lit(True))
    )


def dense_enough(ratio: Column, low: float = 0.004, high: float = 0.18) -> Column:
    return ratio.between(low, high)


def label_allowed(label: Column, allow: list[str], deny: list[str]) -> Column:
    """Any allowed pattern (all labels if none is given) and no denied one."""
    allowed = label.rlike("|".join(f"(?:{p})" for p in allow)) if allow else F.lit(True)
    return allowed & (~label.rlike("|".join(f"(?:{p})" for p in deny)) if deny else F.lit(True))


def disposition(resolution: Column, message_ids: Column, given: Column) -> Column:
    """Where an observation is shown: resolved ones first, unreadable ones without messages not at all."""
    return (
        F.when(resolution == "resolved", "primary")
        .when((resolution == "ocr_unknown") & (F.size(F.coalesce(message_ids, F.array().cast("array<string>"))) <= 0), "suppressed")
        .otherwise(F.coalesce(given, F.lit("review")))
    )
