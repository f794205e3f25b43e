"""Operator 12: ranked lexical search over a tiered index.

Every posting has an impact, the part of its score that doesn't depend on the query. The
postings of a term are dealt to tiers by impact, the highest first, and each term keeps the
highest impact below each tier as its residual bound. An item reads the first tier of its
terms and completes the best documents found there, which gives a score that the twentieth
place has at least. A document that wasn't met can score the sum of the residual bounds at most: where that is
less, the documents met are proven to hold the answer. Other items fall through:
terms, the rarest first, are read one tier deeper until the sum is small enough; below the last tier
the bound is zero. Documents whose partial score and residual bounds reach the proven score
are completed exactly and ranked.

All of it is joins and grouped sums on Spark; no step holds the postings of a term or the
documents of an item in one task.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logloom.llm.common import removed, scratch, shared_dir, short_batches, table, written

#: A term: characters that are neither ASCII controls, blanks nor ASCII punctuation.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a term in the tiers before the last: at least so many, or this share of all its postings.
TIERS = ((256, 1 / 256), (4096, 1 / 16))
#: Tiers are cut between impacts of different multiples of this; impacts stay below 1,000,000.
STEP = 1 << 13
#: Documents of each item that are completed to learn what the last place scores at least.
PROBED = 200
#: Rows of a table that may be broadcast, once they have been counted.
BROADCAST_ROWS = 1_000_000
#: Terms of the items up to which only their postings are indexed; more, and all terms are.
ONLY_TERMS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast where its counted rows allow it; otherwise Spark joins by shuffles that it may split."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def counted_terms(text: str | None) -> Counter[str]:
    """Terms of a text with only A-Z lower-cased, and how often each occurs."""
    return Counter(re.findall(TERM, (text or "").encode().lower().decode()))


def features(docs: DataFrame, doc_id: str, text: str, only: set[str] | None) -> DataFrame:
    """row, doc_id, n (terms with repeats), terms, tfs of each document that has a term; terms of only, if given."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(only)
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("tfs", T.ArrayType(T.LongType())),
        ]
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            places, lengths, terms, tfs = [], [], [], []
            for k, value in enumerate(batch.column(2)):
                found = counted_terms(value.as_py())
                if found:
                    places.append(k)
                    lengths.append(found.total())
                    kept = {t: c for t, c in found.items() if t in wanted} if wanted is not None else found
                    terms.append(list(kept))
                    tfs.append(list(kept.values()))
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
                schema.names,
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, schema)


@dataclass(frozen=True)
class Index:
    #: row, doc_id, n, terms, tfs.
    docs: DataFrame
    #: term, row, impact, tier (a folder for each tier).
    postings: DataFrame
    #: term, df, weight, last tier, residual bounds below each tier.
    terms: DataFrame
    #: Counts that impacts depend on: documents with a term, and all their terms.
    n_docs: int
    n_terms: int

    def impact(self, tf: Column, n: Column) -> Column:
        """(10**9 tf) div (1000 tf + 12 m) with m = 100 - 25 + (25 n N) div L."""
        return whole_part(F.lit(10**9) * tf, 1000 * tf + 12 * (75 + whole_part(25 * n * F.lit(self.n_docs), F.lit(self.n_terms))))


def whole_part(of: Column, by: Column) -> Column:
    """Integer division of numbers that aren't negative."""
    return F.call_function("div", of.cast("bigint"), by.cast("bigint"))


def indexed(docs: DataFrame, put: Callable[[DataFrame, str], DataFrame], doc_id: str = "doc_id", text: str = "text", only: set[str] | None = None) -> Index:
    """The tiered index of whole texts; only restricts it to some terms. put writes a table to the shared folder."""
    spark = docs.sparkSession
    rows = put(features(docs, doc_id, text, only), "search-documents")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    index = Index(rows, rows, rows, n_docs, max(1, n_terms))
    each = rows.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", F.col("t.terms").alias("term"), index.impact(F.col("t.tfs"), F.col("n")).alias("impact"))
    counts = each.groupBy("term", whole_part(F.col("impact"), F.lit(STEP)).alias("level")).agg(F.count("*").alias("c"), F.max("impact").alias("most"))
    of_term = Window.partitionBy("term")
    # A term has as many levels as there are multiples of STEP at most.
    above = F.coalesce(F.sum("c").over(of_term.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tier = F.lit(len(TIERS))
    for k, (least, share) in reversed(list(enumerate(TIERS))):
        tier = F.when(F.col("above") < F.greatest(F.lit(least), F.col("df") * share), F.lit(k)).otherwise(tier)
    levels = counts.withColumns({"above": above, "df": F.sum("c").over(of_term)}).withColumn("tier", tier)
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    bounds = [F.coalesce(F.max(F.when(F.col("tier") > k, F.col("most"))), F.lit(0)) for k in range(len(TIERS))]
    lowest = [F.min(F.when(F.col("tier") <= k, F.col("level"))) for k in range(len(TIERS))]
    terms = put(
        levels.groupBy("term").agg(F.first("df").alias("df"), F.array(*bounds, F.lit(0).cast("bigint")).alias("bounds"), F.array(*lowest).alias("lowest")).withColumn("weight", weight),
        "search-terms",
    )
    of_level = F.aggregate("lowest", F.lit(0), lambda held, low: held + (whole_part(F.col("impact"), F.lit(STEP)) < low).cast("int"))
    dealt = each.join(small(terms.select("term", "lowest"), terms.count()), "term").select("term", "row", "impact", of_level.alias("tier"))
    path = f"{shared_dir(spark)}/logloom-search-postings-{uuid.uuid4().hex}"
    dealt.write.partitionBy("tier").parquet(path)
    postings = spark.read.schema("term string, row bigint, impact bigint, tier int").parquet(path)
    return Index(rows, postings, terms, n_docs, max(1, n_terms))


def completed(pairs: DataFrame, n_pairs: int, index: Index, query: DataFrame, n_query: int) -> DataFrame:
    """item, doc_id, row, score: whole scores of the pairs of item and row, from the documents' own counts."""
    found = index.docs.join(small(pairs.select("item", "row"), n_pairs), "row")
    each = found.select("item", "row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", "row", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    scored = each.join(small(query.select("item", "term", "factor"), n_query), ["item", "term"])
    return scored.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("factor") * index.impact(F.col("tf"), F.col("n"))).alias("score"))


def best(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first rows of each item, with rank; Spark keeps as many of each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def searched(index: Index, items: DataFrame, put: Callable[[DataFrame, str], DataFrame], top: int = 20) -> DataFrame:
    """item, row, doc_id, score, rank of the best documents of items(item, term, tf), exact."""
    base = items.join(index.terms, "term").select("item", "term", (F.col("weight") * F.col("tf")).alias("factor"), "df", "bounds", F.lit(0).alias("depth"))
    open_items = query = put(base.where("factor > 0"), "search-query")
    n_open = n_query = query.count()
    depth = 0
    candidates: list[DataFrame] = []
    while n_open:
        bound = F.col("factor") * F.get("bounds", F.col("depth"))
        asked = open_items.withColumn("bound", bound)
        read = index.postings.where(F.col("tier") <= depth)
        met = read.join(small(asked.select("item", "term", "factor", "bound", "depth"), n_open), "term").where(F.col("tier") <= F.col("depth"))
        pairs = put(met.groupBy("item", "row").agg(F.sum(F.col("factor") * F.col("impact")).alias("partial"), F.sum("bound").alias("seen")), "search-pairs")
        probes = put(best(pairs, PROBED, F.desc("partial"), F.asc("row")).select("item", "row"), "search-probes")
        exact = completed(probes, probes.count(), index, open_items, n_open)
        least = best(exact, top, F.desc("score")).where(F.col("rank") == top).select("item", F.col("score").alias("least"))
        of_item = asked.groupBy("item").agg(F.sum("bound").alias("residual"))
        state = put(of_item.join(least, "item", "left").select("item", "residual", F.coalesce("least", F.lit(0)).alias("least")), "search-state")
        proven = (F.col("residual") < F.col("least")) | (F.col("residual") == 0)
        # What a pair may still gain is bounded by the terms that it wasn't met under.
        reachable = F.col("partial") + F.col("residual") - F.col("seen") >= F.col("least")
        candidates.append(put(pairs.join(F.broadcast(state.where(proven)), "item").where(reachable).select("item", "row"), "search-candidates"))
        depth += 1
        open_items = put(deeper(asked.join(state.where(~proven), "item")), "search-query")
        n_open = open_items.count()
    found = index.docs.select(F.lit(0).cast("bigint").alias("item"), "row").limit(0)
    for more in candidates:
        found = found.unionByName(more)
    scores = completed(found, found.count(), index, query, n_query).where("score > 0")
    return best(scores, top, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))


def deeper(asked: DataFrame) -> DataFrame:
    """The query terms of unproven items, one tier deeper as far as it takes.

    Terms are taken by ascending document count until what is gained brings the residual sum below
    the proven score; commoner terms stay where they are.
    """
    last = len(TIERS)
    gain = F.col("bound") - F.col("factor") * F.get("bounds", F.least(F.col("depth") + 1, F.lit(last)))
    before = F.coalesce(F.sum(gain).over(Window.partitionBy("item").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    raised = F.col("residual") - before >= F.col("least")
    return asked.withColumn("raised", raised).select("item", "term", "factor", "df", "bounds", F.least(F.col("depth") + F.col("raised").cast("int"), F.lit(last)).alias("depth"))


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the documents that score highest for each item.

    A null or empty text has no terms: such a document is in no count and no result, such an item has no
    rows. Every row is a document or an item of its own, also where ids are null or repeat; equal scores
    go by ascending doc_id, nulls last. Empty tables give an empty result. Other columns don't
    matter. Texts are read whole. The index holds the terms of the items, or all
    terms where the items have over 200,000.
    """
    spark = docs.sparkSession
    with scratch(spark) as put:
        numbered = put(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")), "search-items")
        lower = F.translate("item_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        terms = put(numbered.select("item", F.explode(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("term")).groupBy("item", "term").agg(F.count("*").alias("tf")), "search-item-terms")
        distinct = terms.select("term").distinct()
        only = {r.term for r in distinct.collect()} if distinct.count() <= ONLY_TERMS else None
        index = indexed(docs, put, doc_id, text, only)
        found = searched(index, terms, put, top)
        result = found.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = written(result, "ranked-search")
        removed(spark, index.postings)
    return result


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = rf"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
total AS (SELECT count(*) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM d WHERE len(terms) > 0),
p AS MATERIALIZED (SELECT term, doc_id, n, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY term, doc_id, n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, nn),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
