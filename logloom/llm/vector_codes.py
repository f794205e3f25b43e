"""Operator 13: vector code compression by product quantization, with annular norm pruning.

A vector's parts are each replaced by the number of the nearest entry of that part's codebook.
To find it, entries lie sorted by norm: as the difference of two norms is at most the
distance of the vectors, the best distance so far bounds the norms of entries that can be
nearer or as near. Both ends of that interval are found by binary search, and only the entries
within it, ends included, decide, with exact integer distances.

Vectors stay where Spark has read them. A round of training sends back counts and
sums of the entries (their number and width are fixed); nothing else passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import short_batches, table, written


@dataclass(frozen=True)
class CodeConfig:
    parts: int = 4
    #: Entries of a codebook; a code has two hex digits a part.
    entries: int = 256
    rounds: int = 4
    #: A component x is the integer floor(scale * x).
    scale: int = 1024


#: Vectors of neighbouring norms whose annuli are evaluated in one matrix product.
BLOCK = 64
#: Entries nearest in norm that give the first best distance.
NEAREST = 8


class Ring:
    """One part's entries, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(np.sqrt(squares.astype(float)), kind="stable")
        self.entries = entries[self.order]
        self.squares = squares[self.order]
        self.norms = np.sqrt(self.squares.astype(float))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (the lowest of those as near) and the squared distance, for each vector."""
        n, k = len(vectors), len(self.entries)
        squares = (vectors * vectors).sum(axis=1)
        norms = np.sqrt(squares.astype(float))
        by_norm = np.argsort(norms, kind="stable")
        found, best = np.zeros(n, np.int64), np.zeros(n, vectors.dtype)
        for at in range(0, n, BLOCK):
            rows = by_norm[at : at + BLOCK]
            own, own_norms = vectors[rows], norms[rows]

            def distances(low: int, high: int, own: np.ndarray = own, rows: np.ndarray = rows) -> np.ndarray:
                return squares[rows][:, None] - 2 * (own @ self.entries[low:high].T) + self.squares[None, low:high]

            middle = int(np.searchsorted(self.norms, np.median(own_norms)))
            start = max(0, min(middle - NEAREST // 2, k - NEAREST))
            reach = np.sqrt(distances(start, min(k, start + NEAREST)).min(axis=1).astype(float)) * (1 + 1e-9) + 1e-6
            low = np.searchsorted(self.norms, own_norms - reach, "left")
            high = np.searchsorted(self.norms, own_norms + reach, "right")
            first, last = int(low.min()), int(high.max())
            exact = distances(first, last)
            places = np.arange(first, last)[None, :]
            outside = (places < low[:, None]) | (places >= high[:, None])
            least = np.where(outside, exact.max() + 1, exact).min(axis=1)
            tied = (exact == least[:, None]) & ~outside
            found[rows] = np.where(tied, self.order[first:last][None, :], k).min(axis=1)
            best[rows] = least
        return found, best


def number_type(largest: int, width: int) -> type:
    """The fastest type in which squared distances of such components are exact."""
    most = 4 * largest * largest * width
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Components of an Arrow list column (without nulls) as integers."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        flat = np.array([int(x) for x in flat], object)
    else:
        flat = flat.astype(np.int64)
    return flat.reshape(-1, width)


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers (a row for each vector, a column for each part) and errors."""
    parts, _, width = books.shape
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = number_type(largest, width)
    numbers, errors = [], 0
    for p in range(parts):
        found, best = Ring(books[p].astype(kind)).nearest(vectors[:, p * width : (p + 1) * width].astype(kind))
        numbers.append(found)
        errors = errors + best.astype(object if kind is object else np.int64)
    return np.stack(numbers, axis=1), errors


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


@dataclass(frozen=True)
class Codebooks:
    #: parts x entries x components; integers.
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def kept_vectors(rows: DataFrame, key: str, vector: str, carry: tuple[str, ...]) -> DataFrame:
    return rows.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).alias("vector"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))


def first_books(kept: DataFrame, config: CodeConfig) -> Codebooks | None:
    """The parts of the vectors of the smallest keys (null keys last, equal keys by vector), of the length that the first of them has."""
    first = [r.vector for r in kept.orderBy(F.col("key").asc_nulls_last(), "vector").select("vector").limit(config.entries).collect()]
    if not first:
        return None
    if any(len(v) != len(first[0]) for v in first):
        of_length = kept.where(F.size("vector") == len(first[0]))
        return first_books(of_length, config)
    if len(first[0]) % config.parts:
        raise ValueError(f"vectors of {len(first[0])} components can't be cut into {config.parts} equal parts")
    matrix = integers(pa.array(first, pa.list_(pa.float64())), len(first[0]), config.scale)
    return Codebooks(matrix.reshape(len(first), config.parts, -1).swapaxes(0, 1).copy())


def trained(kept: DataFrame, start: Codebooks, config: CodeConfig) -> Codebooks:
    """Rounds of assigning all vectors and moving each entry to the floor of its parts' mean; unused entries stay."""
    spark, books = kept.sparkSession, start.books.copy()
    parts, entries, width = books.shape
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    for _ in range(config.rounds):
        shared = spark.sparkContext.broadcast(books)

        def gathered(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for batch in batches:
                vectors = integers(batch.column(0), parts * width, config.scale)
                numbers, _ = assigned(vectors, shared.value)
                for p in range(parts):
                    np.add.at(counts[p], numbers[:, p], 1)
                    np.add.at(sums[p], numbers[:, p], vectors[:, p * width : (p + 1) * width].astype(np.int64))
            used = np.argwhere(counts)
            if len(used):
                columns = [pa.array(used[:, k], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[counts > 0]), pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))], schema.names)

        found = kept.select("vector").mapInArrow(gathered, schema)
        totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)))
        books = books.copy()
        for part, entry, n, *sums in totals.collect():  # as many rows as there are entries
            books[part, entry] = [s // n for s in sums]
    return Codebooks(books)


def coded(kept: DataFrame, codebooks: Codebooks, config: CodeConfig) -> DataFrame:
    """kept without vector, with code (two hex digits a part) and error (squared distance to what the code stands for)."""
    spark = kept.sparkSession
    shared = spark.sparkContext.broadcast(codebooks.books)
    others = [c for c in kept.columns if c != "vector"]
    schema = T.StructType([kept.schema[c] for c in others] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    width = codebooks.width

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, errors = assigned(integers(batch.column(0), width, config.scale), shared.value)
            made = [pa.array([n.tobytes().hex() for n in numbers.astype(np.uint8)], pa.string()), pa.array(errors.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(1 + k) for k in range(len(others))), *made], schema.names)

    return kept.select("vector", *others).mapInArrow(codes, schema)


def compressed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = (), config: CodeConfig = CodeConfig()) -> DataFrame:  # noqa: B008
    """key, the columns of carry, code, error and codebooks_sha256 of each usable vector.

    Rows whose vector is null, empty, or holds null or non-finite components are dropped, as are vectors
    of another length than that of the smallest key. Repeated rows and keys each give a row and count as often
    in the means; a null key gives a row and starts no entry unless there are fewer keys than entries.
    With fewer vectors than entries the codebooks are as small; an empty table gives an empty one.
    Distances are exact for components of any size of which squared sums fit a long. Columns that aren't named don't matter.
    """
    spark = rows.sparkSession
    short_batches(spark)
    kept = kept_vectors(rows, key, vector, carry)
    start = first_books(kept, config)
    if start is None:
        start = Codebooks(np.zeros((config.parts, 0, 1), np.int64))
        final, kept = start, kept.limit(0)
    else:
        kept = kept.where(F.size("vector") == start.width)
        final = trained(kept, start, config)
    names = [key, *carry]
    found = coded(kept, final, config)
    return found.select(*(F.col(c).alias(n) for c, n in zip([c for c in kept.columns if c != "vector"], names, strict=True)), "code", "error", F.lit(final.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(compressed(table(spark, sf_dir, "embeddings"), carry=("label",)), "vector-codes")
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    joined = rows.join(errors, rows["label"].eqNullSafe(errors["of_label"]))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_sql(config: CodeConfig = CodeConfig()) -> str:  # noqa: B008
    """The same by plain comparison with every entry, round by round."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor({config.scale} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT id, p, w, list_dot_product(w, w) AS square FROM
  (SELECT id, p, v[p * len(v) // {config.parts} + 1 : (p + 1) * len(v) // {config.parts}] AS w FROM kept, range({config.parts}) AS t(p)))""",
        f"""book0 AS MATERIALIZED (SELECT p, e, w FROM parts JOIN (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept) USING (id) WHERE e < {config.entries})""",
    ]
    for k in range(config.rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT id, p, min(d) AS d, arg_min(e, d * 1000 + e) AS e FROM
  (SELECT id, p, e, square - 2 * list_dot_product(parts.w, b.w) + list_dot_product(b.w, b.w) AS d FROM parts JOIN book{k} AS b USING (p)) GROUP BY id, p)"""
        )
        if k < config.rounds:
            steps.append(
                f"""moved{k} AS (SELECT p, e, list(m ORDER BY i) AS w FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS m FROM
  (SELECT p, e, unnest(w) AS x, unnest(range(len(w))) AS i FROM near{k} JOIN parts USING (id, p)) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.w, b.w) AS w FROM book{k} AS b LEFT JOIN moved{k} AS m USING (p, e))"""
            )
    last = config.rounds
    return f"""WITH {", ".join(steps)},
found AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY id),
digest AS (SELECT sha256(coalesce(string_agg(array_to_string(list_transform(w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found JOIN kept USING (id), digest"""


OP13_SQL = op13_sql()
