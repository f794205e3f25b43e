"""Copies for the pipeline: documents that share most of their five-word shingles.

Two documents are linked if their fingerprints are within the distance of operator 5, found
at its anchors, or if the Jaccard similarity of their sets of shingles is at least SIMILARITY.
At that similarity some ten of 64 bits differ, which no covering of practical size finds; so pairs
of the second kind come from MinHash bands beside the anchors and are checked exactly, in joins.
A band bucket is first compared with its leader only, the set that shares the most buckets: in a group of
copies the original. What fingerprints and these links have put into one component
needs no further pair, so a large group of near copies takes pairs in proportion to its size. What
is still apart in a bucket is then compared inside a join that returns the similar pairs
alone, so the components are those of all pairs of all buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import BROADCAST_IDS, scratch, short_batches, without_ids, written
from logloom.llm.components import components
from logloom.llm.simhash import SEED, fingerprint, further_links, star_links

#: Words of a shingle; the similarity that links, as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: MinHash bands and rows of a band: a pair of similarity 0.8 is in no common bucket with
#: a chance of (1 - 0.8 ** 5) ** 24, which is 7 in 100,000.
BANDS, ROWS = 24, 5
#: Shingle hashes that are permuted at once.
BLOCK = 1 << 12

Put = Callable[[DataFrame, str], DataFrame]

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str) -> np.ndarray:
    """The sorted set of shingle hashes of a text; a text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    spans = range(max(len(words) - SHINGLE + 1, 1)) if words else []
    return np.unique(np.array([digest(b" ".join(words[k : k + SHINGLE]), SEED) for k in spans], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The bucket of each band, as unsigned 64-bit integers."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), BLOCK):
        mixed = hashes[k : k + BLOCK, None] * FACTORS + SHIFTS
        np.minimum(least, mixed.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def sketch(text: str) -> np.ndarray:
    """Fingerprint, id of the shingle set (0 for the empty one), then the band buckets."""
    hashes = shingle_hashes(text)
    set_id = xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0
    return np.array([fingerprint(text), set_id, *band_keys(hashes)], np.uint64).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """From docs(doc_id, text) to (doc_id, text, fp, set_id, buckets); a null text is an empty one."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sketch(t or "") for t in texts], dtype=object)

    rows = docs.select("doc_id", "text", made("text").alias("sketch"))
    return rows.select(
        "doc_id", "text", F.col("sketch")[0].alias("fp"), F.col("sketch")[1].alias("set_id"), F.slice("sketch", 3, BANDS).alias("buckets")
    )


def shingle_sets(sketches: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) for the wanted(set_id), made again from one text of each."""

    @F.pandas_udf("array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_hashes(t or "").view(np.int64) for t in texts], dtype=object)

    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    one = sketches.select("set_id", "text").join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.first("text").alias("text"))
    return one.select("set_id", made("text").alias("shingles"))


def enough_shared(a: str, b: str) -> Column:
    """Whether the Jaccard similarity of two shingle sets is at least SIMILARITY; sizes that rule it out are looked at first."""
    part, whole = SIMILARITY
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return (F.least(n, m) * whole >= F.greatest(n, m) * part) & (shared * whole >= (n + m - shared) * part)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(u, v, ...) of set ids whose Jaccard similarity is at least SIMILARITY."""
    first = sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("a"))
    second = sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(first, "u").join(second, "v").where(enough_shared("a", "b")).select(*pairs.columns)


def rooted_by(sets: DataFrame, links: DataFrame, put: Put) -> DataFrame:
    """sets(set_id, root, ...) with the roots that links(u, v) between roots lead to."""
    found = components(links, put).toDF("node", "new_root")
    return sets.join(found, sets["root"] == found["node"], "left").withColumn("root", F.coalesce("new_root", "root")).drop("node", "new_root")


def bucket_links(rooted: DataFrame, sketches: DataFrame, put: Put) -> DataFrame:
    """Links (u, v) of roots of rooted(set_id, root) by which all similar pairs of a bucket are joined."""
    one = sketches.groupBy("set_id").agg(F.first("buckets").alias("buckets"))
    dealt = one.join(rooted.select("set_id", "root"), "set_id").select("set_id", "root", F.posexplode("buckets").alias("band", "bucket"))
    # Buckets of one root have nothing to tell.
    several = dealt.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "bucket", "n")
    named = put(dealt.join(several, ["band", "bucket"]), "buckets")
    shares = named.groupBy("set_id").agg(F.sum("n").alias("shares"))
    leaders = named.join(shares, "set_id").groupBy("band", "bucket").agg(F.max_by(F.struct(F.col("set_id").alias("u"), F.col("root").alias("root_u")), F.struct("shares", "set_id")).alias("leader"))
    named = put(named.join(leaders.select("band", "bucket", "leader.*"), ["band", "bucket"]), "led-buckets")
    sets = put(shingle_sets(sketches, put(named.select("set_id").distinct(), "bucket-sets")), "shingle-sets")
    star = named.where("root != root_u").select("u", F.col("set_id").alias("v"), "root_u", F.col("root").alias("root_v")).distinct()
    found = put(similar(star, sets), "star-links")
    # What the leaders have joined needs no pair any more; they have been compared with all others.
    joined = components(found.select("root_u", "root_v").toDF("u", "v"), put).toDF("node", "last_root")
    late = named.where("set_id != u").join(joined, named["root"] == joined["node"], "left").select("band", "bucket", "set_id", F.coalesce("last_root", "root").alias("root"))
    still = late.groupBy("band", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "bucket")
    late = put(late.join(still, ["band", "bucket"]).join(sets, "set_id").join(one, "set_id"), "late-buckets")
    left, right = (late.select("band", "bucket", *[F.col(c).alias(f"{c}_{at}") for c in ("set_id", "root", "shingles", "buckets")]) for at in ("u", "v"))
    # Two sets are compared in the first band that they share, and leave the join only if they are similar.
    first_band = F.array_position(F.zip_with("buckets_u", "buckets_v", lambda x, y: x == y), True) == F.col("band") + 1
    close = (F.col("set_id_u") < F.col("set_id_v")) & (F.col("root_u") != F.col("root_v")) & first_band & enough_shared("shingles_u", "shingles_v")
    more = left.join(right, ["band", "bucket"]).where(close).select("root_u", "root_v")
    return found.select("root_u", "root_v").unionByName(put(more, "late-links")).toDF("u", "v")


def copies(docs: DataFrame) -> DataFrame:
    """From docs(doc_id, text) to (doc_id, component_id), one row for each row of docs.

    component_id is the least doc_id of those that links lead to; nulls, empty texts and
    repeated rows are taken as in simhash.near_duplicates. The result is written to the
    shared folder, the tables on the way are removed.
    """
    with scratch(docs.sparkSession) as put:
        sketches = put(sketched(docs), "sketches")
        nodes = put(sketches.groupBy("set_id", "fp").agg(F.min("doc_id").alias("least_id")), "sets")
        # Roots are fingerprints: a set is where the least of its texts' fingerprints is.
        sets = nodes.groupBy("set_id").agg(F.min("fp").alias("root"), F.min("least_id").alias("least_id"))
        prints = nodes.select("fp").distinct()
        ends = nodes.join(sets.select("set_id", "root"), "set_id").where("fp != root").select(F.col("fp").alias("u"), F.col("root").alias("v"))
        stars = components(put(star_links(prints).unionByName(ends), "print-links"), put)
        rooted = put(prints.join(stars, prints["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "prints")
        near = put(further_links(rooted), "near-prints")
        first = rooted.select(F.col("fp").alias("root"), F.col("root").alias("first_root"))
        sets = put(rooted_by(sets.join(first, "root").select("set_id", "least_id", F.col("first_root").alias("root")), near, put), "rooted-sets")
        sets = rooted_by(sets, bucket_links(sets, sketches, put), put)
        least = sets.groupBy("root").agg(F.min("least_id").alias("component_id"))
        classes = sets.join(least, "root").select("set_id", "component_id")
        return written(sketches.select("doc_id", "set_id").join(classes, "set_id").select("doc_id", "component_id"), "copies")


def one_of_copies(docs: DataFrame) -> DataFrame:
    """The documents that name their component; rows that share a doc_id stay or go together, rows without an id stay."""
    gone = copies(docs).where(F.col("doc_id") != F.col("component_id"))
    return without_ids(docs, gone, "copies")
