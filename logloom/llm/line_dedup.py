"""Operator 7: drop lines that many documents share, with a sharded minimal perfect hash.

The lines that reach the document threshold are dealt over shards by their hash. Each shard
is one task that builds a minimal perfect hash over its line hashes: a cascade of
bit arrays in which every key owns one bit, so that the rank of that bit is
the key's slot in arrays of fingerprints, document counts and last documents.
Documents then probe these arrays, broadcast in groups of shards of a bounded
size; lines themselves are never joined. An index larger than the bound is probed
in several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import SPACE, removed, short_batches, table, written

#: Code points of the shortest key that counts, and documents that must hold it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a shard, as hashes deal them.
SHARD_LINES = 1 << 16
#: Bound of the arrays that one pass broadcasts, and what one line takes in them.
PASS_BYTES, LINE_BYTES = 64 << 20, 24
#: Bits of a level for each key that is left.
GAMMA = 1.5
WORD = np.uint64(64)


def line_key(line: str) -> str:
    """The line without white space at both ends, A-Z in lower case."""
    key = line.strip(SPACE)
    return key.lower() if key.isascii() else key.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def line_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def hash_halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    halves = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, n_docs, last_id) for the hash of each long enough key: how many documents
    hold it and the largest doc_id among them. Rows that share a doc_id are one document, rows without
    one are none, as in OP7_SQL. Each batch names a line and a document once; further repeats go
    before and after the first shuffle."""
    short_batches(docs.sparkSession)
    schema = "high long, low long, doc_id long"

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[bytes, int | None]] = set()
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                keys = {k for line in (text or "").split("\n") if len(line) >= min_chars and len(k := line_key(line)) >= min_chars}
                seen.update((h, doc_id) for h in map(line_hash, keys))
            pairs = list(seen)
            high, low = hash_halves([h for h, _ in pairs])
            columns = [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array([d for _, d in pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["high", "low", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(held, schema)
    return rows.groupBy("high", "low").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_id"))


def _at_level(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    mixed = high * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def built(high: np.ndarray, low: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays (64-bit words) by level, and the slot of each key.

    At every level the keys that share no bit with another keep theirs and the rest goes
    on; distinct 128-bit keys end after a few levels.
    """
    levels, slots, left, filled = [], np.zeros(len(high), np.int64), np.arange(len(high)), 0
    while len(left):
        words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
        at = (_at_level(high[left], low[left], len(levels)) % np.uint64(64 * words)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * words)[at] == 1
        bits = np.zeros(64 * words, bool)
        bits[at[alone]] = True
        slots[left[alone]] = filled + np.cumsum(bits)[at[alone]] - 1
        filled += int(alone.sum())
        levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
        left = left[~alone]
        if len(levels) > 200:
            raise ValueError("equal keys in a shard")
    return levels, slots


SHARD = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("levels", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.BinaryType()),
        T.StructField("prints", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("last_ids", T.BinaryType()),
    ]
)
NO_ID = np.iinfo(np.int64).min


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one shard: words of each level, and by slot the low half as fingerprint,
    the document count and the last document (NO_ID where all ids are null)."""
    high, low = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
    levels, slots = built(high, low)
    order = np.argsort(slots)
    last = np.array([NO_ID if pd.isna(v) else int(v) for v in rows["last_id"]], np.int64)
    made = {
        "shard": [int(rows["shard"].iloc[0])],
        "levels": [[len(w) for w in levels]],
        "words": [np.concatenate(levels).tobytes()],
        "prints": [low[order].tobytes()],
        "counts": [rows["n_docs"].to_numpy(np.int64)[order].astype(np.uint32).tobytes()],
        "last_ids": [last[order].tobytes()],
    }
    return pd.DataFrame(made)


@dataclass(frozen=True)
class LineIndex:
    """The arrays of shards first to first + len(starts) - 1 of all, end to end. starts and sizes
    have, by shard and level, the first word of the level and its words."""

    shards: int
    first: int
    starts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    prints: np.ndarray
    counts: np.ndarray
    last_ids: np.ndarray

    def probe(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each line hash, or -1 if the index doesn't have it."""
        shard = high.view(np.int64) % self.shards - self.first
        slots = np.full(len(high), -1, np.int64)
        left = np.flatnonzero((shard >= 0) & (shard < len(self.starts)))
        for level in range(self.starts.shape[1]):
            sizes = self.sizes[shard[left], level]
            left, sizes = left[sizes > 0], sizes[sizes > 0]
            if not len(left):
                break
            at = _at_level(high[left], low[left], level) % (sizes.astype(np.uint64) * WORD)
            word = self.starts[shard[left], level] + (at // WORD).astype(np.int64)
            bit = at % WORD
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slots[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        found = np.flatnonzero(slots >= 0)
        wrong = self.prints[slots[found]] != low[found]
        slots[found[wrong]] = -1
        return slots


def joined_shards(rows: list, shards: int, first: int, many: int) -> LineIndex:
    """Lay the arrays of some shards end to end; a shard without lines has no levels."""
    rows = sorted(rows, key=lambda r: r["shard"])
    depth = max([1, *(len(r["levels"]) for r in rows)])
    starts, sizes, at = np.zeros((many, depth), np.int64), np.zeros((many, depth), np.int64), 0
    for r in rows:
        for level, size in enumerate(r["levels"]):
            starts[r["shard"] - first, level], sizes[r["shard"] - first, level] = at, size
            at += size
    whole = {n: np.frombuffer(b"".join(bytes(r[n]) for r in rows), t) for n, t in (("words", np.uint64), ("prints", np.uint64), ("counts", np.uint32), ("last_ids", np.int64))}
    bits = np.bitwise_count(whole["words"]).astype(np.int64)
    return LineIndex(shards, first, starts, sizes, ranks=np.cumsum(bits) - bits, **whole)


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """The shards of the index, as a table in the shared folder, and their number.

    Lines below min_docs can never be dropped and take no slot; the fingerprints keep
    them from being taken for one that has.
    """
    spark = docs.sparkSession
    often = written(line_counts(docs, min_chars).where(F.col("n_docs") >= min_docs), "lines")
    shards = max(1, -(-often.count() // SHARD_LINES))
    dealt = often.withColumn("shard", F.pmod("high", F.lit(shards)).cast("long"))
    index = written(dealt.groupBy("shard").applyInPandas(build_shard, SHARD), "line-index")
    removed(spark, often)
    return index, shards


def _long_lines(text: str | None, min_chars: int) -> tuple[list[int], list[bytes]]:
    """Places and key hashes of the lines that are long enough."""
    spots, hashes = [], []
    for k, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
            spots.append(k)
            hashes.append(line_hash(key))
    return spots, hashes


def _dropped(index: LineIndex, doc_id: int | None, spots: list[int], slots: np.ndarray, min_docs: int) -> list[int]:
    """The places of those lines that the index drops from this document."""
    return [spots[n] for n in np.flatnonzero(slots >= 0) if index.counts[slots[n]] >= min_docs and index.last_ids[slots[n]] != doc_id]


def _probe_texts(docs: DataFrame, index: LineIndex, min_chars: int, min_docs: int) -> DataFrame:
    """Fill the column gone with the places of the lines that the index, which is whole, drops."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [_long_lines(text, min_chars) for text in batch["text"].to_pylist()]
            slots = own.probe(*hash_halves([h for _, hashes in found for h in hashes]))
            gone, at = [], 0
            for doc_id, (spots, hashes) in zip(batch["doc_id"].to_pylist(), found, strict=True):
                gone.append(_dropped(own, doc_id, spots, slots[at : at + len(hashes)], min_docs))
                at += len(hashes)
            yield batch.set_column(batch.schema.get_field_index("gone"), "gone", pa.array(gone, pa.list_(pa.int32())))

    return docs.mapInArrow(probe, docs.schema)


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(row_key, doc_id, spots, hashes) of the rows with long lines: 20 bytes a line instead of its text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc_id, text in zip(*(batch[c].to_pylist() for c in ("row_key", "doc_id", "text")), strict=True):
                spots, hashes = _long_lines(text, min_chars)
                if spots:
                    rows.append((key, doc_id, spots, b"".join(hashes)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row_key", "doc_id", "spots", "hashes"])

    return docs.select("row_key", "doc_id", "text").mapInArrow(hashed, "row_key string, doc_id long, spots array<int>, hashes binary")


def _probe_hashes(hashed: DataFrame, index: LineIndex, min_docs: int) -> DataFrame:
    """(row_key, spots) of the rows that lose lines to this part of the index."""
    shared = hashed.sparkSession.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for key, doc_id, spots, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lost := _dropped(own, doc_id, spots, own.probe(*hash_halves([hashes])), min_docs):
                    rows.append((key, lost))
            columns = zip(*rows, strict=True) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.list_(pa.int32())), strict=True)], ["row_key", "spots"])

    return hashed.mapInArrow(probe, "row_key string, spots array<int>")


def drop_lines(docs: DataFrame, index: DataFrame, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: Sequence[str] = ()) -> DataFrame:
    """Return doc_id, text (the lines that stay, joined by \\n), n_lines, n_dropped and the columns
    named in carry for each row of docs; a name of a result column in carry is passed over.

    A line goes if its key is in the index, has min_docs documents, and this isn't the
    largest doc_id that holds it. A null or empty text is one empty line. Rows that
    share the largest doc_id all keep the line; rows with a null doc_id are no documents that
    count, and lose the lines that go.

    An index within PASS_BYTES is probed in one narrow pass over the texts. For a larger
    one the line hashes are written once, each part of the index is probed with them,
    and the places found, which are few, are joined back to the rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    carry = [c for c in carry if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("array<int>").alias("gone"),
        F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
    )
    width = max(1, PASS_BYTES // (SHARD_LINES * LINE_BYTES))

    def part(first: int) -> LineIndex:
        # At most width shards of about SHARD_LINES lines: PASS_BYTES, whatever the input.
        rows = index.where((F.col("shard") >= first) & (F.col("shard") < first + width)).collect()
        return joined_shards(rows, shards, first, min(width, shards - first))

    if shards <= width:
        state = _probe_texts(state, part(0), min_chars, min_docs)
    else:
        # Rows with one id and text lose the same lines, so this key tells enough.
        row_key = F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").cast("binary"), 256)
        keyed = state.drop("gone").withColumn("row_key", row_key)
        hashed = written(_hashed_lines(keyed, min_chars), "line-hashes")
        marks = [written(_probe_hashes(hashed, part(first), min_docs), "line-marks") for first in range(0, shards, width)]
        lost = reduce(DataFrame.unionByName, marks).groupBy(F.col("row_key").alias("lost_key")).agg(F.array_distinct(F.flatten(F.collect_set("spots"))).alias("gone"))
        state = keyed.join(lost, keyed["row_key"] == lost["lost_key"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split("text", "\n")
    kept = F.when(F.size("gone") == 0, lines).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda k: F.get(lines, k)))
    made = state.select("doc_id", kept.alias("kept"), F.size("gone").cast("long").alias("n_dropped"), "carried")
    return made.select(
        "doc_id", F.array_join("kept", "\n").alias("text"), (F.size("kept") + F.col("n_dropped")).alias("n_lines"), "n_dropped", *[F.col("carried")[c].alias(c) for c in carry]
    )


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: Sequence[str] = ()) -> DataFrame:
    """Build the index over docs(doc_id, text) and drop the shared lines from the same docs."""
    index, shards = build_index(docs, min_chars, min_docs)
    return drop_lines(docs, index, shards, min_chars, min_docs, carry)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last_id AS gone FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
