"""Versioned nested log documents: reading with back-fill, writing, CSV, keyed storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import csv_row

VERSION = "0.1.0"

MESSAGE = "struct<id:string,observationId:string,rawText:string,ocrConfidence:double,timestampMs:bigint,frameIndex:int,lines:array<struct<text:string,confidence:double>>>"
SIDE = "struct<name:string,side:string>"
EVENT = (
    f"struct<id:string,observationId:string,type:string,timestampMs:bigint,frameIndex:int,turn:int,actor:{SIDE},move:string,target:{SIDE},"
    "rawText:string,normalizedText:string,confidence:double,method:string,templateId:string>"
)
UNKNOWN = "struct<id:string,timestampMs:bigint,afterEventId:string,rawText:string,normalizedText:string,ocrConfidence:double,candidateMatches:array<string>,sourceFrameRef:string,reviewStatus:string>"
OBSERVATION = (
    "struct<id:string,openedAtMs:bigint,closedAtMs:bigint,resolution:string,suppressed:boolean,attempts:int,commitScore:double,"
    "dynamicForegroundRatio:double,suppressionReason:string,eventIds:array<string>>"
)
CORRECTION = "struct<id:string,targetId:string,note:string>"
DOCUMENT = (
    "schemaVersion string, updatedAt string, battle struct<id:string,title:string>, "
    f"ocrMessages array<{MESSAGE}>, events array<{EVENT}>, unknowns array<{UNKNOWN}>, messageObservations array<{OBSERVATION}>, "
    f"manualCorrections array<{CORRECTION}>, phaseTransitions array<struct<timestampMs:bigint,phase:string>>, _corrupt string"
)
#: The type of each section.
SECTIONS = {
    "ocrMessages": f"array<{MESSAGE}>",
    "events": f"array<{EVENT}>",
    "unknowns": f"array<{UNKNOWN}>",
    "messageObservations": f"array<{OBSERVATION}>",
    "manualCorrections": f"array<{CORRECTION}>",
    "phaseTransitions": "array<struct<timestampMs:bigint,phase:string>>",
}
#: Sections that must be there, and those that older documents may lack.
REQUIRED = ("ocrMessages", "events", "unknowns")
OPTIONAL = ("messageObservations", "manualCorrections", "phaseTransitions")
REASONS = ("transient", "persistent_ui", "visual_low_quality", "timeout", "merged_duplicate")


def filled_observation(o: Column) -> Column:
    """An observation with its missing or invalid fields set to their defaults."""
    hidden = F.coalesce(o["suppressed"], F.lit(False))
    reason = F.when(o["suppressionReason"].isin(*REASONS), o["suppressionReason"])
    return F.struct(
        o["id"].alias("id"), o["openedAtMs"].alias("openedAtMs"), o["closedAtMs"].alias("closedAtMs"),
        F.coalesce(o["resolution"], F.lit("unread")).alias("resolution"), hidden.alias("suppressed"),
        F.coalesce(o["attempts"], F.lit(0)).alias("attempts"),
        F.coalesce(o["commitScore"], F.when(hidden, 0.0).otherwise(1.0)).alias("commitScore"),
        F.coalesce(o["dynamicForegroundRatio"], F.lit(1.0)).alias("dynamicForegroundRatio"),
        reason.alias("suppressionReason"), F.coalesce(o["eventIds"], F.array().cast("array<string>")).alias("eventIds"),
    )


def filled(parsed: DataFrame) -> DataFrame:
    """Check the structure and version of parsed documents and back-fill what may be missing.

    Adds ok, error and warnings, and the recounted summary; a document that fails stays as a
    row with its error, so one bad file never ends the job.
    """
    broken = F.col("_corrupt").isNotNull()
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED], F.when(F.col("battle.id").isNull(), F.lit("battle.id"))))
    error = (
        F.when(broken, "not a JSON document")
        .when(F.col("schemaVersion").isNull() | (F.col("schemaVersion") != VERSION), F.concat(F.lit("unsupported version "), F.coalesce("schemaVersion", F.lit("(none)"))))
        .when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    )
    warnings = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} was missing and has been filled")) for c in OPTIONAL]))
    out = parsed.withColumns({"error": error, "warnings": F.when(error.isNull(), warnings).otherwise(F.array().cast("array<string>"))})
    out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast(SECTIONS[c])) for c in (*REQUIRED, *OPTIONAL)})
    out = out.withColumn("messageObservations", F.transform("messageObservations", filled_observation))
    shown = F.filter("messageObservations", lambda o: ~o["suppressed"])
    summary = F.struct(
        F.size(shown).alias("detected"),
        F.size(F.filter(shown, lambda o: o["resolution"] == "resolved")).alias("resolved"),
        F.size(F.filter(shown, lambda o: o["resolution"] == "unread")).alias("unread"),
        F.size(F.filter("messageObservations", lambda o: o["suppressed"])).alias("suppressed"),
    )
    return out.withColumns({"ok": error.isNull(), "summary": summary}).drop("_corrupt")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read one document a file, checked and back-filled."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return filled(raw)


def parse_documents(rows: DataFrame, json: str) -> DataFrame:
    """The same for documents held in a string column."""
    parsed = F.from_json(F.col(json), DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return filled(rows.select(*[c for c in rows.columns if c != json], parsed.alias("_d")).select(*[c for c in rows.columns if c != json], "_d.*"))


def build_documents(messages: DataFrame, events: DataFrame, unknowns: DataFrame, key: str = "battle_id") -> DataFrame:
    """(key, json): one document for each battle, its sections ordered by time and id.

    A battle is one file by contract, so its rows meet in one row here; battles are spread.
    """
    def section(rows: DataFrame, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c != key]
        item = F.struct(F.col("timestampMs").alias("_t"), F.col("id").alias("_i"), F.struct(*fields).alias("_v"))
        return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_v"]).alias(name))

    out = section(messages, "ocrMessages").join(section(events, "events"), key, "full_outer").join(section(unknowns, "unknowns"), key, "full_outer")
    body = F.struct(
        F.lit(VERSION).alias("schemaVersion"),
        F.struct(F.col(key).cast("string").alias("id")).alias("battle"),
        *[F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n) for n in REQUIRED],
    )
    return out.select(key, F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


EVENT_CSV = "id,timestampMs,type,turn,actorName,actorSide,move,targetName,targetSide,rawText,normalizedText,confidence,method,templateId,frameIndex"


def events_csv(events: DataFrame) -> DataFrame:
    """(timestampMs, id, line): the CSV line of each event(id, timestampMs, type, actor, ...)."""
    columns = [F.col(c) for c in "id timestampMs type turn actor.name actor.side move target.name target.side rawText normalizedText confidence method templateId frameIndex".split()]
    return events.select("timestampMs", "id", csv_row(*columns).alias("line"))


def unknowns_csv(unknowns: DataFrame, corrections: DataFrame) -> DataFrame:
    """(timestampMs, id, line): unknowns with the last manual note of each, empty if there is none."""
    notes = corrections.groupBy("targetId").agg(F.max_by("note", "id").alias("note"))
    rows = unknowns.join(notes, unknowns["id"] == notes["targetId"], "left")
    line = csv_row(
        *[F.col(c) for c in ("id", "timestampMs", "afterEventId", "rawText", "normalizedText", "ocrConfidence")],
        F.array_join("candidateMatches", " | "), F.col("sourceFrameRef"), F.col("reviewStatus"), F.coalesce("note", F.lit("")),
    )
    return rows.select("timestampMs", "id", line.alias("line"))


def write_csv(lines: DataFrame, header: str, path: str) -> None:
    """Write (timestampMs, id, line) as text in order, the header in front.

    Range-partitioned by time, so the files in order of their names are the whole; the header is a row
    that sorts before all others.
    """
    head = lines.sparkSession.createDataFrame([(None, None, header)], lines.schema)
    everything = lines.unionByName(head).orderBy(F.asc_nulls_first("timestampMs"), F.asc_nulls_first(F.collate("id", "UNICODE")))
    everything.select("line").write.mode("overwrite").text(path)


def corrections_of(unknowns: DataFrame, notes: DataFrame) -> DataFrame:
    """A correction for each unknown that has a note that isn't blank, or is reviewed."""
    rows = unknowns.select(F.col("id").alias("targetId"), "reviewStatus").join(notes.select(F.col("id").alias("targetId"), F.trim("note").alias("note")), "targetId", "left")
    kept = rows.where((F.coalesce("note", F.lit("")) != "") | (F.col("reviewStatus") == "reviewed"))
    return kept.select(F.concat(F.lit("cor_"), "targetId").alias("id"), "targetId", F.coalesce("note", F.lit("")).alias("note"), "reviewStatus")


class DocumentStore:
    """Documents by id in a Parquet folder partitioned by a hash of the id.

    put appends a batch; get and latest look at the newest version of an id; compact
    rewrites the folder without the older ones, on which all() then has no work left.
    """

    SCHEMA = "id string, updated_at string, body string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def put(self, rows: DataFrame) -> None:
        """Upsert rows(id, updated_at, body)."""
        keyed = rows.select("id", "updated_at", "body", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket"))
        keyed.write.mode("append").partitionBy("bucket").parquet(self.path)

    def versions(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA + ", bucket int")
        return self.spark.read.schema(self.SCHEMA + ", bucket int").parquet(self.path)

    def all(self) -> DataFrame:
        newest = F.max_by(F.struct("updated_at", "body"), F.struct("updated_at", "body"))
        return self.versions().groupBy("id").agg(newest.alias("d")).select("id", "d.*")

    def get(self, key: str) -> DataFrame:
        """Reads only the partition of the id."""
        bucket = F.pmod(F.xxhash64(F.lit(key)), F.lit(self.buckets)).cast("int")
        return self.versions().where((F.col("bucket") == bucket) & (F.col("id") == key)).orderBy(F.desc("updated_at"), F.desc("body")).limit(1).select("id", "updated_at", "body")

    def compact(self) -> None:
        """Replace the folder by one with the newest version of each id; readers of the old files must be done.

        The new folder is whole before the old one goes, so a run that ends in between loses nothing.
        """
        following = f"{self.path.rstrip('/')}.next"
        keyed = self.all().select("id", "updated_at", "body", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket"))
        keyed.write.mode("overwrite").partitionBy("bucket").parquet(following)
        old, new = (self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (self.path, following))
        files = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(old, True)
        files.rename(new, old)

    def latest(self) -> DataFrame:
        return self.versions().orderBy(F.desc("updated_at"), F.desc("id")).limit(1).select("id", "updated_at", "body")


def read_names(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Dictionary entries (id, label, aliases) from a text file with a name a line, in the file's order.

    A name list is one small file, read whole into a row and split inside Spark.
    """
    text = spark.read.text(path, wholetext=True)
    names = F.split(F.regexp_replace("value", "^\\uFEFF", ""), r"\r?\n")
    lines = F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))
    rows = text.select(F.posexplode(lines).alias("pos", "label"))
    return rows.select(F.format_string(f"{kind}:%04d", F.col("pos") + 1).alias("id"), "label", F.array().cast("array<string>").alias("aliases"))


def expand_markers(entries: DataFrame) -> DataFrame:
    """A label that ends in a gender mark also gives the label without it, once and first."""
    marked = F.col("label").rlike("[♀♂]$")
    both = F.when(marked, F.array(F.regexp_replace("label", "[♀♂]$", ""), "label")).otherwise(F.array("label"))
    rows = entries.select("id", "aliases", F.posexplode(both).alias("part", "label"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("id", "part"))
    return rows.withColumn("_n", first).where(F.col("_n") == 1).select("id", "part", "label", "aliases")


def csv_hints(spark: SparkSession, path: str) -> DataFrame:
    """Ids named in a CSV file's columns id, eventId or unknownId, whichever are there."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = [F.col(c) for c in ("id", "eventId", "unknownId") if c in rows.columns]
    return rows.select(F.coalesce(*known).alias("id")).where("id IS NOT NULL").distinct() if known else spark.createDataFrame([], "id string")
