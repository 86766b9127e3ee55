"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its features: single words, pairs of neighbours and pairs with one or two words between
them, lower-cased, hashed to BITS bits. Each coordinate has its own rate, and the L1 term leaves most weights
at zero, so what is broadcast is small: at most 2 ** BITS weights, in practice some hundreds.

Training reads a sample of at most TRAIN_ROWS labelled documents (those of the least hash of their id; a
documented bound), whole texts, and passes them through one task in a fixed order, EPOCHS times; their features are
shuffled once, to be read once for each epoch. Scoring reads every document.

Defined results: null and empty texts have no features and the score of the bias alone; labels that are null
say nothing, of several for one document the largest counts; repeated rows get the same score each; without
any label to learn from the score is that of the bias UNKNOWN alone, under 0.5, so none is taken as toxic. The id,
language and source are no features. Columns beside the text pass through, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import _words as W
from pathloom.llm._shared import free_name, map_batches, table

BITS = 20
TRAIN_ROWS = 16384
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
#: How far apart the two words of a pair are.
APART = (1, 2, 3)
#: The bias of a model that had no label to learn from.
UNKNOWN = -1.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, index of its text) of all texts, with repetitions."""
    w = W.split(texts, lower=True, between=W.SYMBOLS)
    h, doc = W.hashes(w), w.owner()
    found, where = [h], [doc]
    for k in APART:
        if len(h) > k:
            same = doc[:-k] == doc[k:]
            pair = W.mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:])
            found.append(pair[same])
            where.append(doc[:-k][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(where)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text", W.SMALL_SLICE):
            f, d = features(part.column("text"))
            both = np.unique(d << BITS | f)
            offsets = np.searchsorted(both >> BITS, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("label"), lists], names=["turn", "label", "features"])


class Ftrl:
    """Per-coordinate learning; the last coordinate is the bias, which has no L1."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, label: int) -> None:
        i = np.append(i, len(self.z) - 1)
        w = self.weights(i)
        g = sigmoid(w.sum()) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(len(self.z)))
        i = np.flatnonzero(w)
        return i, w[i]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl(1 << BITS)
    for batch in batches:
        for label, found in zip(batch.column("label").to_pylist(), batch.column("features"), strict=True):
            model.learn(found.values.to_numpy().astype(np.int64), label)
    i, w = model.sparse()
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(w)], names=["feature", "weight"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights that aren't zero; none, where there is no label to learn from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).alias("turn"), F.col("label").cast("int"), "text")
    found = texts.transform(map_batches, _extract, "turn struct<col1:long,doc_id:long,col3:long>, label int, features array<int>")
    ordered = found.repartition(1).sortWithinPartitions("turn").select("label", "features")
    epochs = ordered
    for _ in range(EPOCHS - 1):
        epochs = epochs.unionAll(ordered)
    # One exchange, read anew by each epoch; all are alike, so it doesn't matter which of them comes first.
    learned = epochs.coalesce(1).transform(map_batches, _learn, "feature int, weight double").toPandas()
    return learned["feature"].to_numpy(), learned["weight"].to_numpy()


def _scorer(index: np.ndarray, weight: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1)
        dense[index] = weight
        for batch in batches:
            for part in W.slices(batch, "text", W.SMALL_SLICE):
                f, d = features(part.column("text"))
                told = np.flatnonzero(dense[f])
                both = np.unique(d[told] << BITS | f[told])
                total = dense[-1] + np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sigmoid(total))], names=[*names, "score"])

    return run


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str = "__loom_score") -> DataFrame:
    """documents with the score in a further column, whose name must be free."""
    model = model if len(model[0]) else (np.array([1 << BITS]), np.array([UNKNOWN]))
    others = [c for c in documents.columns if c != "text"]
    inner = documents.select("text", *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)))
    out = inner.transform(map_batches, _scorer(*model, inner.columns), T.StructType([*inner.schema, T.StructField("score", T.DoubleType())]))
    own = {c: f"_c{i}" for i, c in enumerate(others)} | {"text": "text"}
    return out.select(*(F.col(own[c]).alias(c) for c in documents.columns), F.col("score").alias(column))


def remove_toxic(documents: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """documents that score less than `at`, trained on these documents' own labels."""
    column = free_name(documents.columns, "__loom_score")
    return score(documents, train(documents, labels), column).where(F.col(column) < at).drop(column)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, train(documents, table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
