"""Text functions: normalisation, similarity, folding, ids.

Expressions where Spark has the parts; small Arrow functions over whole batches where
it hasn't (Unicode normalisation, weighted edit distance).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import short_batches

# What normalised text and match text leave out or fold.
SQUEEZE = (
    (re.compile("[!！/／|｜]+"), "!"),
    (re.compile("？"), "?"),
    (re.compile("｡"), "。"),
    (re.compile("､"), "、"),
    (re.compile("…+"), "..."),
    (re.compile(r"\s+"), " "),
)
PUNCTUATION = re.compile(r"""[!！?？。、,.・･/／\\|｜…:：;；"'`´_＿\[\]（）(){}「」『』<>＜＞\s]+""")
SMALL_KANA = str.maketrans("ァィゥェォャュョぁぃぅぇぉゃゅょ", "アイウエオヤユヨあいうえおやゆよ")
CONFUSED = ("ガカ力", "ギキ", "バパハ八六", "ブプフぶぷふ", "ッツっつ", "シツソン", "トド", "ミ三")


def normalized(raw: str) -> str:
    """NFKC; lines trimmed, blank ones dropped, the rest joined without a separator; marks folded."""
    text = "".join(line.strip() for line in unicodedata.normalize("NFKC", raw).replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    for pattern, to in SQUEEZE:
        text = pattern.sub(to, text)
    return text.strip()


def match_form(raw: str) -> str:
    """The normalised text without punctuation and white space, in lower case."""
    return PUNCTUATION.sub("", normalized(raw)).lower()


def in_short_batches(of: Callable[[Column | str], Column]) -> Callable[[Column | str], Column]:
    """A function of whole texts; a worker holds a few megabytes of them, however many rows a task has."""

    @wraps(of)
    def apply(raw: Column | str) -> Column:
        short_batches(SparkSession.active())
        return of(raw)

    return apply


@in_short_batches
@F.pandas_udf(T.StructType([T.StructField("normalized", T.StringType()), T.StructField("match", T.StringType())]))
def both_texts(raw: pd.Series) -> pd.DataFrame:
    """The normalised text and the match text, in one pass."""
    plain = raw.map(normalized, na_action="ignore")
    return pd.DataFrame({"normalized": plain, "match": plain.map(lambda t: PUNCTUATION.sub("", t).lower(), na_action="ignore")})


@in_short_batches
@F.pandas_udf(T.StringType())
def normalize_text(raw: pd.Series) -> pd.Series:
    return raw.map(normalized, na_action="ignore")


@in_short_batches
@F.pandas_udf(T.StringType())
def match_text(raw: pd.Series) -> pd.Series:
    return raw.map(match_form, na_action="ignore")


def squeezed(normal: Column) -> Column:
    """The match text of a normalised text, as an expression."""
    return F.lower(F.regexp_replace(normal, PUNCTUATION.pattern, ""))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; equal texts give 1, also empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _same_sound(a: str, b: str) -> bool:
    return a.translate(SMALL_KANA) == b.translate(SMALL_KANA)


def _confused(a: str, b: str) -> bool:
    return a != b and any(a in g and b in g for g in CONFUSED)


def _indel(chars: str, i: int, other: str, j: int) -> float:
    if chars[i] == "ー":
        return 0.2
    if i and _same_sound(chars[i - 1], chars[i]):
        return 0.25
    beside = other[max(0, j - 1) : j + 1]
    return 0.35 if any(_confused(chars[i], c) for c in beside) else 1.0


def _swap(a: str, b: str) -> float:
    return 0.0 if a == b else 0.15 if _same_sound(a, b) else 0.35 if _confused(a, b) else 1.0


@lru_cache(maxsize=50_000)
def weighted_similarity(a: str, b: str) -> float:
    """Similarity under an edit distance that forgives what text recognition confuses."""
    if a == b:
        return 1.0
    row = [0.0]
    for j in range(len(b)):
        row.append(row[-1] + _indel(b, j, a, 0))
    for i, c in enumerate(a):
        above, row = row, [row[0] + _indel(a, i, b, 0)]
        for j, d in enumerate(b):
            row.append(min(row[j] + _indel(b, j, a, i + 1), above[j + 1] + _indel(a, i, b, j + 1), above[j] + _swap(c, d)))
    return max(0.0, 1.0 - row[-1] / max(len(a), len(b)))


@F.pandas_udf(T.DoubleType())
def ocr_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def contains_fuzzily(text: Column, key: Column, least: float = 0.66) -> Column:
    """Whether text holds key or a stretch of about its length that is similar to it."""
    n = F.length(key)

    def window(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
        fits = (size >= 2) & (size <= F.length(text))
        return fits & F.exists(starts, lambda s: similarity(F.substring(text, s, size), key) >= least)

    return F.contains(text, key) | ((n >= 2) & (window(n - 1) | window(n) | window(n + 1)))


def fold_kana(text: Column) -> Column:
    """Small kana to large, katakana to hiragana, repeats collapsed."""
    large = F.translate(text, "ァィゥェォャュョぁぃぅぇぉゃゅょ", "アイウエオヤユヨあいうえおやゆよ")
    katakana = "".join(map(chr, range(0x30A1, 0x30F7)))
    hiragana = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
    return F.regexp_replace(F.translate(large, katakana, hiragana), r"(.)\1+", "$1")


def identity(*parts: Column) -> Column:
    """A composite key; a null part is empty, so that keys of equal rows are equal."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def frame_reference(frame: Column, ts: Column) -> Column:
    return F.when(frame.isNull(), F.concat(F.lit("time:"), ts.cast("string"))).otherwise(F.concat(F.lit("frame:"), frame.cast("string"), F.lit(":"), ts.cast("string")))


def csv_cell(value: Column) -> Column:
    """A cell in quotes if it holds a comma, quote or line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_row(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for v in values])


def rule_hash(*parts: Column) -> Column:
    """FNV-1a (32 bits) over the UTF-16 units of the parts joined by U+001F, in base 36."""
    units = F.encode(F.concat_ws("\x1f", *parts), "UTF-16BE")
    codes = F.transform(F.sequence(F.lit(1), F.floor(F.length(units) / 2).cast("int")), lambda k: F.conv(F.hex(F.substring(units, (2 * k - 1).cast("int"), F.lit(2))), 16, 10).cast("long"))
    joined = F.aggregate(
        codes,
        F.lit(0x811C9DC5).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return F.lower(F.conv(joined.cast("string"), 10, 36))


def label_prefix(label: Column) -> Column:
    """The first three parts of a label."""
    return F.array_join(F.slice(F.split(label, "_"), 1, 3), "_")


def placeholder_signature(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\{[^}]*\}"), F.lit(0)), " ")


def literal_length(pattern: Column) -> Column:
    return F.length(F.regexp_replace(pattern, r"\{[^}]*\}", ""))
