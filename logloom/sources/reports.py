"""Coverage reports: what of a replay is noise, and the report and its proposals as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.context import holds_any
from logloom.operators.gate import SCRIPTS, UI_HINTS

# Words that begin a fragment of a weather or place message.
FRAGMENT_STARTS = "砂あらし|天気|フィールド|お茶|茶|ヤバソチャ"
REPORT_VERSION = "0.1.0"


def likely_fragment(match: Column) -> Column:
    """A text of five characters or fewer, one that ends behind its first participant, or a few characters of a weather."""
    text = F.coalesce(match, F.lit(""))
    whose = text.rlike(f"^(?:相手の|味方の)?[{SCRIPTS}A-Za-z0-9ー]{{2,14}}(?:の|は)$")
    return (F.length(text) <= 5) | whose | text.rlike(f"^(?:{FRAGMENT_STARTS}).{{0,4}}$")


def likely_ui_noise(suppressed: Column, normal: Column, match: Column) -> Column:
    """A message suppressed as noise, a timer, or words of menus."""
    timer = F.coalesce(normal, F.lit("")).rlike(r"(?:^|\D)\d{1,2}\s*[:：]\s*\d{2}(?:\D|$)")
    return F.coalesce(suppressed, F.lit(False)) | timer | holds_any(F.coalesce(match, F.lit("")), UI_HINTS)


def report_document(summary: DataFrame, proposals: DataFrame, generated_at: str, most: int = 12) -> DataFrame:
    """One row: the report as JSON, with the only row of summary and the first proposals(rank, ...) by rank. Proposals are
    a report's top few, so they fit one row."""
    top = proposals.orderBy("rank").limit(most).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in proposals.columns if c != "rank"]))).alias("proposals"))
    head = summary.select(F.lit(REPORT_VERSION).alias("schemaVersion"), F.lit(generated_at).alias("generatedAt"), F.struct("*").alias("summary"))
    both = head.withColumn("_", F.lit(1)).join(top.withColumn("_", F.lit(1)), "_").drop("_")
    return both.select(F.to_json(F.struct("*")).alias("value"))


def write_report(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)


def write_proposals(document: DataFrame, path: str) -> None:
    """The proposals of a report alone; sources are never edited."""
    parts = document.select(F.from_json("value", "schemaVersion string, generatedAt string").alias("d"), F.get_json_object("value", "$.proposals").alias("p"))
    line = F.concat(F.lit('{"schemaVersion":"'), "d.schemaVersion", F.lit('","generatedAt":"'), "d.generatedAt", F.lit('","proposals":'), "p", F.lit("}"))
    parts.select(line.alias("value")).write.mode("overwrite").text(path)
