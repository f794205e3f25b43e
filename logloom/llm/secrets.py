"""Operator 10: secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A ledger keeps, for
each such blob, the rule versions that have scanned it and the spans they found.
A run scans only blobs with a rule version that the ledger doesn't have, appends
what it finds, and joins the spans back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import shared_dir, table, written

LEDGER = "blob_id string, versions array<string>, spans array<struct<start:int,rank:int,kind:string,end:int>>"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Non-overlapping matches of pattern, leftmost first, whose group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        """Changes with everything that can change the rule's findings."""
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


# The base rules, in the order of their kinds, then those this scan adds.
# Runs that must reach a length are matched with that length at once: a shorter run is
# bounded by other characters, so it can neither hide nor begin a longer one.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of a rule in a text, in code points.

    The pieces between the matches and the matches themselves alternate, so running sums of
    their lengths give the places. Only texts that match at all are taken apart.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern)
    kind = F.lit(rule.kind)
    rows = F.zip_with(
        F.arrays_zip(matches.alias("match"), values.alias("value")),
        F.slice(between, F.lit(1), F.size(matches)),
        lambda m, piece: F.struct(F.length(piece).alias("gap"), F.length(m["match"]).alias("long"), F.length(m["value"]).alias("size")),
    )
    nothing = F.array().cast(SPANS)
    # The last element of the running array ends where the next gap begins.
    placed = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
        lambda state, m: F.struct(
            (state["at"] + m["gap"] + m["long"]).alias("at"),
            F.when(
                m["size"] >= rule.least,
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + m["gap"]).alias("start"),
                            F.lit(rank).alias("rank"),
                            kind.alias("kind"),
                            (state["at"] + m["gap"] + m["long"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
        lambda state: state["spans"],
    )
    return F.when(text.rlike(rule.pattern), placed).otherwise(nothing)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger with one row for each blob; a folder without batches gives an empty one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if not there:
        return spark.createDataFrame([], LEDGER)
    batches = spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(folder)
    return batches.groupBy("blob_id").agg(
        F.array_distinct(F.flatten(F.collect_list("versions"))).alias("versions"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
    )


def scan_blobs(history: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger in folder doesn't have of history(text); returns the number of blobs scanned.

    Only (blob, rule version) pairs without an entry are scanned. The new
    entries are appended as one batch, blobs without findings included.
    """
    spark = history.sparkSession
    blobs = history.select(blob_of(F.col("text")).alias("blob_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob_id"])
    known = read_ledger(spark, folder).select("blob_id", F.col("versions").alias("seen"))
    all_versions = F.array(*[F.lit(r.version) for r in rules])
    todo = blobs.join(known, "blob_id", "left").withColumn(
        "todo", F.array_except(all_versions, F.coalesce("seen", F.array().cast("array<string>")))
    ).where(F.size("todo") > 0)
    nothing = F.array().cast(SPANS)
    found = [
        F.when(F.array_contains("todo", r.version), rule_spans(F.col("text"), r, rank)).otherwise(nothing)
        for rank, r in enumerate(rules)
    ]
    rows = todo.select("blob_id", F.col("todo").alias("versions"), F.concat(*found).alias("spans"))
    batch = f"{folder}/batch-{uuid.uuid4().hex}"
    rows.write.parquet(batch)
    return spark.read.schema(LEDGER).parquet(batch).count()


def secret_scan(history: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of history(text and any other columns but blob_id and spans, which are replaced),
    each with blob_id and the spans of its text by start, then rule.

    folder holds the ledger between runs; without one, a fresh ledger in the shared
    folder serves this run. A null text is an empty one; equal texts, in repeated
    rows or under several paths, are scanned once and all get the spans; no rows
    give none. Findings of rules that aren't among rules stay in the ledger unseen.
    """
    spark = history.sparkSession
    folder = folder or f"{shared_dir(spark)}/logloom-ledger-{uuid.uuid4().hex}"
    scan_blobs(history, folder, rules)
    kinds = [r.kind for r in rules]
    spans = F.sort_array(F.filter("spans", lambda s: s["kind"].isin(kinds)))
    found = read_ledger(spark, folder).where(F.size("spans") > 0).select(F.col("blob_id").alias("found_id"), spans.alias("found"))
    # Written, so that both sides of the join below are plain shuffles, of which Spark may split a hot blob's.
    found = written(found, "findings")
    # The rows travel as one struct, so that none of their columns can clash with the ledger's.
    whole = history.drop("blob_id", "spans")
    rows = whole.select(F.struct("*").alias("row"), blob_of(F.col("text")).alias("blob_id"))
    return rows.join(found, rows["blob_id"] == found["found_id"], "left").select(
        "row.*", "blob_id", F.coalesce("found", F.array().cast(SPANS)).alias("spans")
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written_out(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return rows.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans")
    )


OP10_SQL = r"""
WITH rules(rank, kind, pattern, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 16),
  (2, 'hex', '[0-9a-f]{32,}', 0, 32),
  (3, 'pem', '-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----', 0, 1),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1),
  (5, 'github', 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1)
), taken AS (
  SELECT doc_id, rank, kind, least, string_split_regex(text, pattern) AS pieces, regexp_extract_all(text, pattern, 0) AS whole,
    CASE grp WHEN 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern, 0) END AS vals
  FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), rules WHERE regexp_matches(text, pattern)
), rows AS (
  SELECT doc_id, rank, kind, least, unnest(pieces[1:len(whole)]) AS piece, unnest(whole) AS match, unnest(vals) AS val, generate_subscripts(whole, 1) AS k FROM taken
), placed AS (
  SELECT doc_id, rank, kind, least, length(val) AS size, length(match) AS long,
    sum(length(piece) + length(match)) OVER (PARTITION BY doc_id, rank ORDER BY k) AS stop
  FROM rows
), spans AS (
  SELECT doc_id, rank, kind, (stop - long)::BIGINT AS start, kind || ':' || (stop - long)::BIGINT || ':' || stop::BIGINT AS said FROM placed WHERE size >= least
), found AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found USING (doc_id)
"""
