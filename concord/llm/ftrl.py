"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Training takes a bounded sample of labelled rows (``TRAINING_ROWS``) to one task, which reads it in a fixed order
``EPOCHS`` times; the driver gets the weights that are not zero, at most ``2 ** BITS`` of them. Scoring is a sparse dot
product per whole text, in Arrow batches. Inputs of a score are the text's n-gram counts alone.

Null, empty and blank texts have no n-grams: their score is that of the bias, the share of good labels, whatever that says about
a text without words. Very long texts are scored whole; counts are scaled to length one, so their scores stay finite. A score
equal to ``THRESHOLD`` is predicted 1. Without labels every score is one half. Repeated rows get equal scores, null ids are
scored and not held out, an empty table gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.llm.base import prepared
from concord.llm.hashing import fold, labelled_sample, ngram_slots, packed, word_hashes

BITS = 20
LONGEST = 2
TRAINING_ROWS = 6000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
THRESHOLD = 0.3
HELD_OUT = 0


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's n-grams and their counts, scaled to length one."""
    slots = ngram_slots(word_hashes(text), LONGEST, BITS) if text else np.empty(0, np.int64)
    if not len(slots):
        return slots, np.empty(0)
    slots, counts = np.unique(slots, return_counts=True)
    values = counts.astype(np.float64)
    return slots, values / np.sqrt(values @ values)


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        slots, values = features(text)
        return float(1 / (1 + np.exp(-(self.bias + self.weights[slots] @ values))))


def train(rows: Iterable[tuple[str, float]], epochs: int = EPOCHS) -> Model:
    """Follow-the-regularised-leader with a learning rate per weight, over ``rows`` in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias() -> float:
        return -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)

    labels: list[float] = []
    all_slots, all_values, borders = packed(labels.append(y) or features(t) for t, y in rows)
    for _ in range(epochs):
        for label, start, end in zip(labels, borders, borders[1:], strict=False):
            slots, values = all_slots[start:end], all_values[start:end]
            old_z, old_n = z[slots], n[slots]
            w, b = weight(old_z, old_n), bias()
            error = 1 / (1 + np.exp(-(b + w @ values))) - label
            gradient = error * values
            squares = old_n + gradient * gradient
            z[slots] = old_z + gradient - (np.sqrt(squares) - np.sqrt(old_n)) / ALPHA * w
            n[slots] = squares
            bias_z += error - (np.sqrt(bias_n + error * error) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += error * error
    return Model(bias(), weight(z, n))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """A model of ``label``, learnt from at most ``rows`` labelled documents outside the held-out fold."""
    prepared(docs.sparkSession)
    folds = tuple(k for k in range(5) if k != HELD_OUT)
    sample = labelled_sample(docs, labels, label, folds, rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict({"slot": np.append(used, -1), "weight": np.append(model.weights[used], model.bias)})

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label")
    learnt = ordered.mapInArrow(learn, "slot bigint, weight double").toPandas()
    inner = learnt[learnt.slot >= 0]
    weights = np.zeros(1 << BITS, np.float32)
    weights[inner.slot.to_numpy()] = inner.weight.to_numpy()
    return Model(float(learnt.weight[learnt.slot < 0].sum()), weights)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a text column."""
    slots = np.flatnonzero(model.weights)
    packed, bias = (slots.astype(np.int32).tobytes(), model.weights[slots].astype(np.float32).tobytes()), model.bias

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[np.frombuffer(packed[0], np.int32)] = np.frombuffer(packed[1], np.float32)
        fitted = Model(bias, weights)
        for texts in batches:
            yield pa.array(map(fitted.score, texts.to_pylist()), pa.float64())

    return run(text)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    return docs.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    return docs.where(score(F.col("text"), model) >= threshold)
