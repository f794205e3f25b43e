"""Operator 4: quality rules, line first, in DataFrame functions only.

Every line is held against rules on punctuation, navigation and boilerplate; lines that
fail go, and a document that loses too much of its text that way is rejected, as is
one that fails the base rules on its words. All of it is one narrow projection: no
row is exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table

#: Words of the windows that count as repeated.
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class RuleConfig:
    """Base rules: fewest words, and percent of words in repeated windows. Line rules: a line
    fails if it has a symbol in every symbol_every characters or more, max_bangs
    doubled marks, max_separators menu separators, no mark that closes a sentence, or a
    boilerplate phrase. A document that loses more than max_lost percent of its word characters is rejected."""

    min_words: int = 10
    max_repeat_percent: int = 20
    symbol_every: int = 20
    max_bangs: int = 3
    max_separators: int = 3
    max_lost_percent: int = 30


# Marks that close a sentence, and phrases of page furniture.
CLOSING = r"""[.!?…:;"'”’»)\]](?:[\x20\x09-\x0D]|$)"""
FURNITURE = (
    "(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|"
    "click here|read more|sign (in|up)|log in|subscribe to|share this|skip to content|powered by|back to top)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def window_keys(words: Column) -> Column:
    """Hashes of all windows of WINDOW words, in order; empty for fewer words.

    64-bit hashes stand for the windows of one text: among the 20,000 windows of
    a very long one, a false repeat has a chance of about 1 in 10^11.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def keys(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - F.lit(WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    return let(hashes, keys)


def repeat_words(words: Column) -> Column:
    """How many words lie in a window that is found twice or more, the first time included."""

    def positions(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))

        def twice(s: Column) -> Column:
            def beside(e: Column, i: Column) -> Column:
                same = F.coalesce(F.get(s, i - 1)["k"] == e["k"], F.lit(False))
                return same | F.coalesce(F.get(s, i + 1)["k"] == e["k"], F.lit(False))

            return F.transform(F.filter(s, beside), lambda e: e["p"])

        return F.sort_array(let(placed, twice))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    def counted(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(positions(keys), covered))

    return let(window_keys(words), counted)


def line_fails(line: Column, cfg: RuleConfig) -> Column:
    """Whether a line with words fails a rule; a line without words never does."""
    plain = F.regexp_replace(line, r"[\x20\x09-\x0D]+$", "")
    marks = count_of(plain, r"!!|\?\?")
    separators = count_of(plain, "[|»›]| > ")
    return has_words(line) & (
        ~plain.rlike(CLOSING)
        | (count_of(plain, SYMBOLS) * F.lit(cfg.symbol_every) >= F.length(plain))
        | (marks >= cfg.max_bangs)
        | (separators >= cfg.max_separators)
        | plain.rlike(FURNITURE)
    )


def quality_rules(docs: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """From docs(doc_id, text): the counts, the verdicts and the cleaned text, one row for each row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_failed_lines, lost_chars, text (without the lines that fail). A null or empty
    text has no words, so it fails the base rules. Repeated rows are judged alike;
    other columns of docs don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    spoken = F.filter(lines, has_words)
    passed = let(lines, lambda all_lines: F.filter(all_lines, lambda line: ~line_fails(line, cfg)))
    counted = docs.select(
        "doc_id",
        F.col("text").alias("given"),
        F.length(dense(text)).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        let(
            words_of(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("repeated")),
        ).alias("words"),
        F.size(lines).alias("n_lines"),
        passed.alias("passed"),
    )
    failed = (F.col("n_words") < cfg.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(cfg.max_repeat_percent) * F.col("n_words")
    )
    out = counted.select(
        "doc_id",
        F.col("words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("words.repeated").alias("n_repeat_words"),
        (F.col("n_lines") - F.size("passed")).cast("long").alias("n_failed_lines"),
        F.array_join("passed", "\n").alias("text"),
    )
    out = out.withColumn("base_failed", failed).withColumn(
        "lost_chars", F.col("word_chars") - F.length(dense(F.col("text")))
    )
    kept = ~F.col("base_failed") & (F.lit(100) * F.col("lost_chars") <= F.lit(cfg.max_lost_percent) * F.col("word_chars"))
    return out.withColumn("kept", kept)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars"
    )


OP4_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS pos, len(list) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM texts)
), windows AS (
  SELECT doc_id, pos, n, word, lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS rest
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, rest) > 1 AS again FROM windows WHERE rest IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM twice, range(5) AS r(k) WHERE again GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts
), judged AS (
  SELECT doc_id, line, regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS plain, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM lines
), verdicts AS (
  SELECT doc_id, line, chars, chars > 0 AND (
    NOT regexp_matches(plain, '[.!?…:;"''”’»)\]](?:[\x20\x09-\x0D]|$)')
    OR 20 * (length(plain) - length(translate(plain, '#*$%&|<>', ''))) >= length(plain)
    OR length(plain) - length(regexp_replace(plain, '(!!|\?\?)', '!', 'g')) >= 3
    OR length(plain) - length(translate(plain, '|»›', '')) + length(plain) - length(replace(plain, ' > ', '  ')) >= 3
    OR regexp_matches(plain, '(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|click here|read more|sign (in|up)|log in|subscribe to|share this|skip to content|powered by|back to top)')
  ) AS fails FROM judged
), by_line AS (
  SELECT doc_id, count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0) AS n_dup_lines,
    count(*) FILTER (WHERE fails) AS n_failed_lines, coalesce(sum(chars) FILTER (WHERE fails), 0)::BIGINT AS lost_chars
  FROM verdicts GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_failed_lines, lost_chars
  FROM texts t JOIN by_line USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept
FROM counts
"""
