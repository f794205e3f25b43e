"""Operator 9: chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut each conversation into spans of whole turns. A window
is the retained system turn, as much of a limited history from before the span as the
budget has room for, and the span itself; only assistant texts of the span are under the loss
mask, so that a repeated target is never trained on twice. Prefix sums run over blocks of turns and then
over their totals, and histories are fetched by turn number, so one endless
conversation is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import table, written


@dataclass(frozen=True)
class ChatConfig:
    """budget_tokens: tokens of a window, all its turns together. A quarter of it is the step of the prefix sums:
    turns that begin within one step are a span, below half the budget; a turn of more than a step is a span
    of its own. So a window keeps to the budget unless a new turn or the system turn alone is
    above half of it; such a window repeats the system turn only. history_turns: turns repeated from before
    the span, the last first, while they fit. block_turns_log2: turn numbers of a prefix-sum block."""

    budget_tokens: int = 1024
    history_turns: int = 2
    block_turns_log2: int = 8

    @property
    def step(self) -> int:
        return self.budget_tokens // 4


# The template's marks, and the control strings of other templates that are escaped too.
NEW, AGAIN, HEAD_END, END = "<|turn:", "<|again:", "|>\n", "<|/turn|>\n"
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>))"
#: What counts as a token of the budget.
TOKEN = r"\w+|[^\w\s]"


def escaped(text: Column) -> Column:
    """Double every backslash and put one inside every control string; no control string is left."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    """The inverse of escaped: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def numbered(rows: DataFrame, cfg: ChatConfig) -> DataFrame:
    """Add tokens, idx, the turn's place in its conversation, and span, the number of its window.

    Order: turn (nulls first), role, text. Places and token sums are totalled by block of
    turn numbers first, so no task holds a whole conversation. Spans are numbered with gaps.
    """
    tidy = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    before_all = F.lit(-(1 << 62))
    tidy = tidy.withColumns(
        {
            "block": F.coalesce(F.shiftright(F.col("turn").cast("long"), cfg.block_turns_log2), before_all),
            "tokens": F.greatest(F.lit(1), F.regexp_count("text", F.lit(TOKEN))).cast("long"),
        }
    ).withColumn("long", (F.col("tokens") > cfg.step).cast("long"))
    totals = tidy.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.sum("long").alias("long"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("long").over(earlier), F.lit(0)).alias("long_before"),
    )
    placed = tidy.join(before, tidy["conv_id"].eqNullSafe(before["c"]) & (tidy["block"] == before["b"])).drop("c", "b")
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("tokens_before") + F.sum("tokens").over(upto) - F.col("tokens")
    # Both terms never fall; a new step raises the first, the begin and the end of a long turn the second.
    long_turns = 2 * (F.col("long_before") + F.sum("long").over(upto)) - F.col("long")
    return placed.select(
        "conv_id",
        "role",
        "text",
        "tokens",
        (F.col("n_before") + F.row_number().over(order) - 1).alias("idx"),
        (F.floor(begins / cfg.step) + long_turns).alias("span"),
    )


def chat_windows(rows: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """From rows(conv_id, turn, role, text) to windows(conv_id, span, formatted, mask).

    formatted is the window's text, mask the spans (start, end; code points, end exclusive) of
    assistant texts that are new in it. A null text or role is empty; repeated rows and
    equal turn numbers all stay; a null conv_id is a conversation of its own; other
    columns are ignored; no rows give no windows. The numbered turns are written once, as
    history, system turns and spans all come from them.
    """
    turns = written(numbered(rows, cfg), "turns")
    starts = turns.groupBy("conv_id", "span").agg(F.min("idx").alias("start"), F.sum("tokens").alias("new_tokens"))
    system = turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by(F.struct("idx", "role", "text", "tokens"), "idx").alias("s"))
    system = system.select(F.col("conv_id").alias("c"), F.col("s.idx").alias("system_idx"), F.col("s.role").alias("role"), F.col("s.text").alias("text"), F.col("s.tokens").alias("system_tokens"))
    starts = starts.join(system, starts["conv_id"].eqNullSafe(system["c"]) & (system["system_idx"] < starts["start"]), "left")
    kept = starts.where("system_idx IS NOT NULL").select("conv_id", "span", F.col("system_idx").alias("idx"), "role", "text", F.lit(True).alias("again"))
    room = F.lit(cfg.budget_tokens) - F.col("new_tokens") - F.coalesce("system_tokens", F.lit(0))
    wanted = starts.where((F.col("start") > 0) & (room > 0)).select(
        F.col("conv_id").alias("c"), F.col("span").alias("at_span"), "system_idx", room.alias("room"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - cfg.history_turns), F.col("start") - 1)).alias("place"),
    ).where("system_idx IS NULL OR place <> system_idx")
    history = turns.join(wanted, turns["conv_id"].eqNullSafe(wanted["c"]) & (turns["idx"] == wanted["place"]))
    backwards = Window.partitionBy("conv_id", "at_span").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    history = history.withColumn("taken", F.sum("tokens").over(backwards)).where("taken <= room").select(
        "conv_id", F.col("at_span").alias("span"), "idx", "role", "text", F.lit(True).alias("again")
    )
    fresh = turns.select("conv_id", "span", "idx", "role", "text", F.lit(False).alias("again"))
    parts = fresh.unionByName(history).unionByName(kept)
    parts = parts.select(
        "conv_id", "span", "idx", "again", F.col("role") == "assistant",
        F.concat(F.when(F.col("again"), AGAIN).otherwise(NEW), escaped(F.col("role")), F.lit(HEAD_END)).alias("head"),
        escaped(F.col("text")).alias("body"),
    ).toDF("conv_id", "span", "idx", "again", "assistant", "head", "body")
    whole = F.length("head") + F.length("body") + F.lit(len(END))
    upto = Window.partitionBy("conv_id", "span").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("from", F.sum(whole).over(upto) - whole + F.length("head"))
    target = F.when(~F.col("again") & F.col("assistant"), F.struct(F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("end")))
    pieces = F.sort_array(F.collect_list(F.struct("idx", F.concat("head", "body", F.lit(END)).alias("piece"))))
    return placed.groupBy("conv_id", "span").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(target)).alias("mask"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The turns and the targets of windows, from their text and mask alone: conv_id, span,
    turns (array of role and text, each once) and loss (array of unescaped target texts)."""
    pieces = F.split("formatted", r"<\|/turn\|>\n")
    fresh = F.filter(pieces, lambda p: p.startswith(NEW))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, HEAD_END)
        role = F.substring(piece, F.lit(len(NEW) + 1), at - F.lit(len(NEW) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(piece, at + F.lit(len(HEAD_END)), F.length(piece))).alias("text"))

    loss = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"].cast("int") + F.lit(1), (m["end"] - m["start"]).cast("int"))))
    return windows.select(
        "conv_id", "span", F.length("formatted").cast("long").alias("chars"), F.transform(fresh, turn).alias("turns"), loss.alias("loss")
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    back = read_back(chat_windows(rows.unionByName(more)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by_window = back.select("conv_id", "span", "chars", F.size("turns").alias("n"), lines.alias("lines"), F.array_join("loss", "").alias("loss"))
    in_order = F.sort_array(F.collect_list(F.struct("span", "lines", "loss")))
    found = by_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), in_order.alias("all")
    )
    found = found.withColumn("loss", F.array_join(F.transform("all", lambda w: w["loss"]), ""))
    return found.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("all", lambda w: w["lines"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


# formatted_chars follows from the same rules: every window's turns and repeats with their marks.
OP9_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, row_number() OVER o - 1 AS idx,
    greatest(1, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]'))) AS tokens,
    length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]|\|>')) AS body,
    length(role) AS head
  FROM given WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), spans AS (
  SELECT *, (sum(tokens) OVER o - tokens) // 256
    + 2 * sum((tokens > 256)::INT) OVER o - (tokens > 256)::INT AS span
  FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY idx)
), system AS (
  SELECT conv_id, min(idx) AS idx, arg_min(tokens, idx) AS tokens FROM spans WHERE role = 'system' GROUP BY ALL
), starts AS (
  SELECT s.conv_id, s.span, s.start, y.idx AS system_idx, 1024 - s.tokens - coalesce(y.tokens, 0) AS room
  FROM (SELECT conv_id, span, min(idx) AS start, sum(tokens) AS tokens FROM spans GROUP BY ALL) s
  LEFT JOIN system y ON y.conv_id = s.conv_id AND y.idx < s.start
), past AS (
  SELECT s.conv_id, t.body, t.head, sum(t.tokens) OVER (PARTITION BY s.conv_id, s.span ORDER BY t.idx DESC) <= s.room AS fits
  FROM starts s JOIN spans t ON t.conv_id = s.conv_id AND t.idx < s.start AND t.idx >= s.start - 2
    AND t.idx IS DISTINCT FROM s.system_idx
), again AS (
  SELECT conv_id, body, head FROM past WHERE fits
  UNION ALL
  SELECT s.conv_id, t.body, t.head FROM starts s JOIN spans t ON t.conv_id = s.conv_id AND t.idx = s.system_idx
), repeats AS (
  SELECT conv_id, sum(body + head + 21) AS chars FROM again GROUP BY ALL
), found AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS loss, sum(body + head + 20) AS chars
  FROM spans GROUP BY ALL
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  (f.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM found f LEFT JOIN repeats r USING (conv_id)
"""
