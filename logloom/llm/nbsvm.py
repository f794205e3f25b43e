"""Linear text classifiers on n-gram indicators scaled by naive Bayes log-count ratios.

The shared core of the quality classifier and the toxicity classifier. Training takes a
bounded, documented sample of labelled rows: tasks count its n-grams by class, tasks choose
those that tell the classes apart, and only each row's chosen n-grams meet in the one task that
fits the weights. Scoring is a narrow pass over the documents that needs no shuffle. Texts
are read block by block, so memory doesn't grow with their length.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import removed, short_batches, written

#: Buckets of the n-gram table, as a power of two.
BITS = 22
#: N-gram buckets of one task that chooses among them, as a power of two.
RANGE_BITS = 16
#: Tasks that read the sample.
SAMPLE_TASKS = 8
#: A whole text as the bucket numbers (int32) of its n-grams, block by block, repeats allowed.
Grams = Callable[[str], Iterator[np.ndarray]]


@dataclass(frozen=True)
class TrainConfig:
    """rows_per_class bounds the sample that is fitted: the rows of each class whose
    hashed ids come first. min_df and min_z choose the n-grams that are kept:
    those in at least min_df sampled documents whose class ratio differs from 1
    by min_z standard errors."""

    rows_per_class: int = 2000
    min_df: int = 4
    min_z: float = 3.5
    smoothing: float = 0.5
    cost: float = 1.0
    epochs: int = 60
    tolerance: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Kept buckets in order, their weights (ratio times fitted weight), the bias,
    and the logistic curve that turns a margin into a score."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def hashed(codes: np.ndarray, sizes: range) -> np.ndarray:
    """Bucket numbers of all n-grams of a code sequence, for every n of sizes."""
    if not len(codes):
        return np.zeros(0, np.int32)
    out, rolled = [], np.zeros(len(codes), np.uint64)
    codes = codes.astype(np.uint64)
    for n in range(1, sizes.stop):
        if n > len(codes):
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        if n in sizes:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def present(text: str, grams: Grams, chosen: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a whole text, in order; with a table of chosen ones, only those."""
    found = [np.unique(block if chosen is None else block[chosen[block]]) for block in grams(text)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.int32), *found]))


def chosen_table(buckets: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS, bool)
    table[buckets] = True
    return table


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, cfg: TrainConfig) -> np.ndarray:
    """Weights of the L1-loss (hinge) linear SVM over ratio-scaled indicators, by dual
    coordinate descent; the last weight is the bias.

    Each step solves the dual problem exactly in one coordinate, within
    0 <= alpha <= cost, and keeps w equal to the sum of alpha * y * x. A sweep
    whose projected gradients all lie within tolerance ends the descent.
    """
    weights, alpha = np.zeros(len(ratio) + 1), np.zeros(len(rows))
    norms = np.array([1.0 + np.square(ratio[r]).sum() for r in rows])
    order, chance = np.arange(len(rows)), np.random.default_rng(cfg.seed)
    for _ in range(cfg.epochs):
        chance.shuffle(order)
        worst = 0.0
        for i in order:
            features = rows[i]
            values = ratio[features]
            gradient = y[i] * (weights[features] @ values + weights[-1]) - 1.0
            old = alpha[i]
            if (old <= 0 and gradient >= 0) or (old >= cost[i] and gradient <= 0):
                continue
            worst = max(worst, abs(gradient))
            alpha[i] = min(max(old - gradient / norms[i], 0.0), cost[i])
            step = (alpha[i] - old) * y[i]
            weights[features] += step * values
            weights[-1] += step
        if worst < cfg.tolerance:
            break
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (Newton steps on
    smoothed targets, so that separable margins keep a finite slope)."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    at = np.array([1.0, 0.0])
    x = np.column_stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        pull = x.T @ (weight * (p - target)) + np.array([1e-3, 0.0]) * at
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, pull)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def class_counts(texts: Iterable[tuple[str, int]], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """By class and bucket, the documents that hold an n-gram of the bucket; and the documents by class."""
    in_class, totals = np.zeros((2, 1 << BITS), np.uint32), np.zeros(2, np.int64)
    for text, label in texts:
        in_class[label][present(text, grams)] += 1
        totals[label] += 1
    return in_class, totals


def chosen_ratios(low: np.ndarray, high: np.ndarray, totals: np.ndarray, cfg: TrainConfig) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets are kept, given their documents in class 0 and class 1, and the log ratio
    of the smoothed document shares of those."""
    common = np.flatnonzero(low + high >= cfg.min_df)
    a = cfg.smoothing
    low, high = low[common] + a, high[common] + a
    ratio = np.log(high / (totals[1] + 2 * a)) - np.log(low / (totals[0] + 2 * a))
    error = np.sqrt(1 / high + 1 / low - 1 / (totals[1] + 2 * a) - 1 / (totals[0] + 2 * a) + 1e-12)
    sure = np.abs(ratio) >= cfg.min_z * error
    return common[sure], ratio[sure]


def untrained(labels: Iterable[int]) -> Model | None:
    """The model where no weights can be learnt: 0.5 without labels, a sure score with labels of one class."""
    found = set(labels)
    if len(found) == 2:
        return None
    return Model(np.zeros(0, np.int32), np.zeros(0), 0.0, 1.0, {0: -3.0, 1: 3.0}[found.pop()] if found else 0.0)


def fitted(rows: list[np.ndarray], labels: np.ndarray, prior: float, kept: np.ndarray, scale: np.ndarray, cfg: TrainConfig) -> Model:
    """Fit the weights of the kept buckets, whose log ratios are scale. rows has, by document, the
    places in kept of its n-grams; prior is the share of label 1 among all labelled rows."""
    labels = np.asarray(labels, dtype=np.int64)
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    # Rare-class rows weigh as they would in the whole labelled table.
    share = np.where(labels == 1, prior / (totals[1] / totals.sum()), (1 - prior) / (totals[0] / totals.sum()))
    y = np.where(labels == 1, 1.0, -1.0)
    # Margins for the curve come from the half of the rows that a fit did not see.
    half = np.arange(len(rows)) % 2
    margins = np.zeros(len(rows))
    for side in (0, 1):
        seen = np.flatnonzero(half != side)
        if len(seen) and labels[seen].min() != labels[seen].max():
            w = dual_descent([rows[i] for i in seen], scale, y[seen], cfg.cost * share[seen], cfg)
            for i in np.flatnonzero(half == side):
                margins[i] = w[rows[i]] @ scale[rows[i]] + w[-1]
    slope, offset = logistic_curve(margins, labels, share)
    w = dual_descent(rows, scale, y, cfg.cost * share, cfg)
    return Model(kept, w[:-1] * scale, float(w[-1]), slope, offset)


def counted(sample: DataFrame, grams: Grams) -> DataFrame:
    """(part, at, low, high): the documents of either class by bucket, one row for each reading task and range of buckets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_class, _ = class_counts(((t, y) for b in batches for t, y in zip(b["text"], b["label"], strict=True)), grams)
        for part in range(1 << BITS - RANGE_BITS):
            here = in_class[:, part << RANGE_BITS : part + 1 << RANGE_BITS]
            at = np.flatnonzero(here.any(axis=0))
            if len(at):
                yield pd.DataFrame({"part": [part], "at": [at.astype(np.int32).tobytes()], "low": [here[0, at].tobytes()], "high": [here[1, at].tobytes()]})

    return sample.select("text", "label").mapInPandas(count, "part int, at binary, low binary, high binary")


def ratios(counts: DataFrame, totals: np.ndarray, cfg: TrainConfig) -> tuple[np.ndarray, np.ndarray]:
    """The kept buckets and their log ratios; at most 2 ** BITS of them come to the driver."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros((2, 1 << RANGE_BITS), np.int64)
        for at, low, high in zip(rows["at"], rows["low"], rows["high"], strict=True):
            places = np.frombuffer(at, np.int32)
            both[0, places] += np.frombuffer(low, np.uint32)
            both[1, places] += np.frombuffer(high, np.uint32)
        kept, ratio = chosen_ratios(both[0], both[1], totals, cfg)
        kept = (kept + (int(rows["part"].iloc[0]) << RANGE_BITS)).astype(np.int32)
        return pd.DataFrame({"kept": [kept.tobytes()], "ratio": [ratio.tobytes()]})

    found = counts.groupBy("part").applyInPandas(choose, "kept binary, ratio binary").collect()
    kept = np.frombuffer(b"".join(bytes(r["kept"]) for r in found), np.int32)
    ratio = np.frombuffer(b"".join(bytes(r["ratio"]) for r in found), np.float64)
    order = np.argsort(kept)
    return kept[order], ratio[order]


def train(docs: DataFrame, labels: DataFrame, grams: Grams, cfg: TrainConfig = TrainConfig()) -> Model:
    """Fit a model on docs(doc_id, text) that have a label in labels(doc_id, label).

    The sample is bounded by 2 * rows_per_class documents, chosen by hashed id. Its texts, of
    any length, are read by SAMPLE_TASKS tasks; only their chosen n-grams are fitted in one task, and
    only the model (kept n-grams and weights) comes to the driver. Null or other labels are left
    out; of contrary labels of a document the higher holds; of rows that share an id
    the least text is learnt from; a null text is an empty one; without labelled rows the
    model scores 0.5.
    """
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    keys = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("rank_key", F.xxhash64("doc_id"))
    shares = {0: 0, 1: 0} | {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    if sure := untrained(label for label, n in shares.items() if n):
        return sure
    prior = shares[1] / (shares[0] + shares[1])
    first = [
        keys.where(F.col("label") == label).orderBy("rank_key", "doc_id").limit(cfg.rows_per_class) for label in (0, 1)
    ]
    # At most 2 * rows_per_class rows: the bound that makes this broadcast safe.
    chosen = F.broadcast(first[0].unionByName(first[1]).select("doc_id", "label"))
    sample = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(chosen, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .repartition(SAMPLE_TASKS)
    )
    sample = written(sample, "labelled-sample")
    totals = np.array([min(shares[label], cfg.rows_per_class) for label in (0, 1)])
    kept, scale = ratios(counted(sample, grams), totals, cfg)
    shared = spark.sparkContext.broadcast(kept)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        table = chosen_table(own)
        for batch in batches:
            rows = [np.searchsorted(own, present(t, grams, table)).astype(np.int32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "row": rows})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches)).sort_values("doc_id", kind="stable")
        rows = [np.frombuffer(r, np.int32) for r in got["row"]]
        model = fitted(rows, got["label"].to_numpy(), prior, shared.value, scale, cfg)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    id_type = sample.schema["doc_id"].dataType
    row = T.StructType([T.StructField("doc_id", id_type), T.StructField("label", T.IntegerType()), T.StructField("row", T.BinaryType())])
    rows = sample.mapInPandas(features, row).repartition(1)
    made = rows.mapInPandas(fit, T.StructType([T.StructField("model", T.BinaryType())])).collect()
    removed(spark, sample)
    return pickle.loads(made[0]["model"])


def scored(texts: Iterable[str | None], model: Model, grams: Grams, table: np.ndarray) -> np.ndarray:
    """Scores of whole texts; a null text is scored as an empty one. table marks the model's buckets."""
    out = np.array([model.weights[np.searchsorted(model.buckets, present(t or "", grams, table))].sum() for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(model.slope * (out + model.bias) + model.offset, -35, 35)))


def with_score(docs: DataFrame, model: Model, grams: Grams, text: str = "text", into: str = "score") -> DataFrame:
    """Add a column with the score of each whole text, batch by batch, without a shuffle."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        table = chosen_table(own.buckets)
        for texts in batches:
            yield pd.Series(scored(texts, own, grams, table))

    return docs.withColumn(into, score(F.col(text)))
