"""Operator 5: SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 1 bit of one
32-bit half. In each half the anchors are the words of a covering code: the Hamming
code of length 31 and, as 32nd bit, a free one, so every half lies within covering
radius 1 of its nearest anchor, its home. A fingerprint is replicated to every
anchor within covering radius plus threshold, 1 + 1 = 2 bits (2 or 17 of them), and
compared there with the fingerprints at home; no pair within the
threshold can be missed, and no fingerprint goes to more than 34 anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import scratch, short_batches, table, without_ids, written
from logloom.llm.components import components

#: Words of a shingle, bits that may differ, seed of the shingle hashes.
SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str) -> int:
    """The SimHash of a whole text, as an unsigned 64-bit integer; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    if len(words) <= SHINGLE:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Add the fingerprint of each whole text as a (signed) long; a null text is an empty one."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(into, made(F.col(text)))


def _half(fp: Column, which: int) -> Column:
    """A 32-bit half as a long."""
    return F.shiftrightunsigned(fp, 32 * which).bitwiseAND(F.lit(0xFFFFFFFF))


def _syndrome(word: Column) -> Column:
    """Which of the positions 1 to 31 to flip so that a word becomes a code word; 0 for none."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        total = total + F.bit_count(word.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * F.lit(1 << k)
    return total


def _flip(position: Column) -> Column:
    """The word with only this position set; position 0 has none."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)


def _anchor(word: Column, which: int) -> Column:
    return word.bitwiseOR(F.lit(which << 32))


def with_home(prints: DataFrame, *carry: str) -> DataFrame:
    """One row (fp, carry, anchor) for each half of each fingerprint, with the anchor nearest to it."""
    rows = []
    for which in (0, 1):
        word = prints.select("fp", *carry, _half(F.col("fp"), which).alias("word"))
        word = word.select("fp", *carry, "word", _syndrome(F.col("word")).alias("syndrome"))
        fixed = F.when(F.col("syndrome") == 0, F.col("word")).otherwise(
            F.col("word").bitwiseXOR(_flip(F.col("syndrome")))
        )
        rows.append(word.select("fp", *carry, _anchor(fixed, which).alias("anchor")))
    return rows[0].unionByName(rows[1])


def with_anchors(prints: DataFrame, *carry: str) -> DataFrame:
    """One row (fp, carry, anchor) for each fingerprint, half and anchor within 2 bits of that half."""
    rows = []
    for which in (0, 1):
        word = prints.select("fp", *carry, _half(F.col("fp"), which).alias("word"))
        word = word.select("fp", *carry, "word", _syndrome(F.col("word")).alias("syndrome"))
        w, s = F.col("word"), F.col("syndrome")
        home = F.when(s == 0, w).otherwise(w.bitwiseXOR(_flip(s)))
        near = F.array(home, home.bitwiseXOR(F.lit(1 << 31)))
        # Two flips whose positions add up to the syndrome also lead to a code word.
        pairs = F.filter(
            F.sequence(F.lit(1), F.lit(31)),
            lambda p: (s != 0) & (p != s) & (p < p.bitwiseXOR(s)),
        )
        far = F.transform(pairs, lambda p: w.bitwiseXOR(_flip(p)).bitwiseXOR(_flip(p.bitwiseXOR(s))))
        rows.append(word.select("fp", *carry, F.explode(F.concat(near, far)).alias("anchor")).select("fp", *carry, _anchor(F.col("anchor"), which).alias("anchor")))
    return rows[0].unionByName(rows[1])


def apart(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v)))


def star_links(prints: DataFrame) -> DataFrame:
    """Links u != v between fingerprints with one home anchor, each with the least and the largest
    one there: at most four for each fingerprint. They join up most of a large group."""
    home = with_home(prints)
    ends = home.groupBy("anchor").agg(F.min("fp").alias("least"), F.max("fp").alias("largest")).where("least != largest")
    pairs = home.join(ends, "anchor").select(F.col("fp").alias("v"), F.explode(F.array("least", "largest")).alias("u"))
    return pairs.where((F.col("u") != F.col("v")) & (apart("u", "v") <= DISTANCE)).select("u", "v").distinct()


def further_links(rooted: DataFrame) -> DataFrame:
    """The pairs of different roots (u, v) of rooted(fp, root), of which two fingerprints differ in at most DISTANCE bits.

    Each fingerprint is at hand once. Every fingerprint is compared with those at home at each of its
    anchors; a pair can be seen in both halves. Spark may split an anchor with very many
    fingerprints over tasks, as both sides are plain shuffles.
    """
    home = with_home(rooted, "root").select("anchor", F.col("fp").alias("u"), F.col("root").alias("root_u"))
    near = with_anchors(rooted, "root").select("anchor", F.col("fp").alias("v"), F.col("root").alias("root_v"))
    # Either end is at home somewhere, so half of the comparisons are enough.
    close = (F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & (apart("u", "v") <= DISTANCE)
    return home.join(near, "anchor").where(close).select(F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """From docs(doc_id, text) to (doc_id, fp, component_id), one row for each row of docs.

    component_id is the least doc_id whose fingerprint is reachable over links of at most
    DISTANCE bits. Null and empty texts have fingerprint 0 and are linked like any other;
    a row with a null doc_id gets a component, but its id never names one (null if no
    other id is there); repeated rows stay; an empty table gives an empty one. Equal
    fingerprints are folded to one before they are compared, so exact copies cost nothing there; of a
    large group of near copies only the pairs that stars have not joined are links. The
    result is written to the shared folder, the tables on the way are removed.
    """
    with scratch(docs.sparkSession) as put:
        prints = put(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
        nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
        stars = put(star_links(nodes.select("fp")), "star-links")
        found = components(stars, put)
        rooted = put(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
        joined = components(further_links(rooted), put).toDF("node", "last_root")
        named = rooted.join(joined, rooted["root"] == joined["node"], "left").select("fp", "least_id", F.coalesce("last_root", "root").alias("root"))
        least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
        classes = named.join(least, "root").select("fp", "component_id")
        return written(prints.join(classes, "fp").select("doc_id", "fp", "component_id"), "near-duplicates")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that name their component: one of each group of near-duplicates.

    Rows that share a doc_id stay or go together; rows without an id stay, since none
    of them can name a component.
    """
    gone = near_duplicates(docs).where(F.col("doc_id") != F.col("component_id"))
    return without_ids(docs, gone, "near-duplicates")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
