"""Quality rules: counts of a whole text against fixed limits, and a calibrated classifier for what the limits let pass.

The classifier is a logistic regression on hashed word n-grams and character n-grams. It is fitted to a bounded sample of
labelled rows (``TRAINING_ROWS``, folds 2 to 4) by accelerated gradient descent; its margins are turned into
probabilities by a logistic curve fitted to labelled rows of fold 1 (``CALIBRATION_ROWS``). Fold 0 is left for tests.
Whole texts are scored in Arrow batches against fixed thresholds.

Null texts count as empty: no words, hence ``base_failed``. Very long texts are counted and scored whole. A probability equal
to ``MIN_QUALITY`` is enough; lines and windows that are equal count by their number, so ties do not arise elsewhere. Without
labels the probability is one half and the limits alone decide. Repeated rows get equal results, an empty table an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.llm.base import prepared
from concord.llm.hashing import char_slots, labelled_sample, ngram_slots, packed, word_hashes

WORD_BITS, CHAR_BITS = 18, 18
LONGEST, CHARS = 2, 4
TRAINING_ROWS, CALIBRATION_ROWS = 2500, 1500
ROUNDS, PENALTY, RATE = 80, 1e-4, 4.0
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_QUALITY = 0.3
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; words end at ASCII white space."""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    return n, word_chars, sum(map(text.count, SYMBOLS)), lines.total() - len(lines), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text has twice or more, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    size = len(numbers)
    pairs = codes[:-1] * size + codes[1:]
    if size >= 1 << 21:  # three numbers no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, found = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    starts = found[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= starts
    return int(inside.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots (words first, then characters) and values; each of the two halves has length one."""
    out = []
    for base, slots in (
        (0, ngram_slots(word_hashes(text), LONGEST, WORD_BITS) if text else np.empty(0, np.int64)),
        (1 << WORD_BITS, char_slots(text, CHARS, CHAR_BITS)),
    ):
        slots, found = np.unique(slots, return_counts=True)
        values = np.sqrt(found)
        out.append((slots + base, values / max(np.sqrt(values @ values), 1e-9)))
    return np.concatenate([s for s, _ in out]), np.concatenate([v for _, v in out])


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str) -> float:
        slots, values = features(text)
        return float(self.bias + self.weights[slots] @ values)

    def quality(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.margin(text) + self.shift))))


def train(rows: Iterable[tuple[str, float]]) -> Model:
    """Logistic loss with a quadratic penalty, minimised over all ``rows`` by accelerated gradient descent."""
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    given: list[float] = []
    slots, values, borders = packed(given.append(y) or features(text) for text, y in rows)
    if not given:
        return Model(0.0, np.zeros(size))
    labels = np.array(given)
    row = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(borders))
    used = np.flatnonzero(np.bincount(slots, minlength=size))
    numbers = np.zeros(size, np.int32)
    numbers[used] = np.arange(len(used))
    place = numbers[slots]
    del slots
    w = ahead = np.zeros(len(used))
    b = ahead_b = 0.0
    for k in range(ROUNDS):
        margin = ahead_b + np.bincount(row, values * ahead[place], len(labels))
        error = (1 / (1 + np.exp(-margin)) - labels) / len(labels)
        new = ahead - RATE * (np.bincount(place, values * error[row], len(used)) + PENALTY * ahead)
        new_b = ahead_b - RATE * error.sum()
        speed = k / (k + 3)
        ahead, ahead_b = new + speed * (new - w), new_b + speed * (new_b - b)
        w, b = new, new_b
    weights = np.zeros(size)
    weights[used] = w
    return Model(float(b), weights)


def calibrate(model: Model, rows: list[tuple[str, float]]) -> Model:
    """Slope and shift of the logistic curve from margins to the labels of ``rows``, smoothed towards the margins' own."""
    labels = [y for _, y in rows]
    if len(set(labels)) < 2:
        return model
    positive = sum(labels)
    target = np.where(np.array(labels) > 0.5, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    margins = np.array([model.margin(text) for text, _ in rows])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    curve = np.array([1.0, 0.0])

    def loss(c: np.ndarray) -> float:
        m = x @ c
        return float(np.sum(np.logaddexp(0, m) - target * m) + 0.05 * (c[0] - 1) ** 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ curve)))
        gradient = x.T @ (p - target) + np.array([0.1 * (curve[0] - 1), 0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6]), gradient)
        scale = 1.0
        while scale > 1e-4 and loss(curve - scale * step) > loss(curve):
            scale /= 2
        curve = curve - scale * step
        if np.abs(scale * step).max() < 1e-7:
            break
    return Model(model.bias, model.weights, float(max(curve[0], 0.0)), float(curve[1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A calibrated model of ``label``: one task learns from the two bounded samples, the driver gets its weights."""
    prepared(docs.sparkSession)
    lesson = labelled_sample(docs, labels, label, (2, 3, 4), TRAINING_ROWS).withColumn("lesson", F.lit(1))
    test = labelled_sample(docs, labels, label, (1,), CALIBRATION_ROWS).withColumn("lesson", F.lit(0))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = []

        def lessons() -> Iterator[tuple[str, float]]:
            for b in batches:
                for t, y, lesson in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                    if lesson:
                        yield t, y
                    else:
                        test.append((t, y))

        model = calibrate(train(lessons()), test)
        used = np.flatnonzero(model.weights)
        rest = [model.bias, model.slope, model.shift]
        yield pa.RecordBatch.from_pydict({"slot": np.append(used, [-1, -2, -3]), "weight": np.append(model.weights[used], rest)})

    ordered = lesson.union(test).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    learnt = ordered.select("text", "label", "lesson").mapInArrow(learn, "slot bigint, weight double").toPandas()
    weights = np.zeros((1 << WORD_BITS) + (1 << CHAR_BITS), np.float32)
    inner = learnt[learnt.slot >= 0]
    weights[inner.slot.to_numpy()] = inner.weight.to_numpy()
    rest = dict(zip(learnt.slot, learnt.weight, strict=True))
    return Model(rest.get(-1, 0.0), weights, rest.get(-2, 1.0), rest.get(-3, 0.0))


FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "quality": pa.float64(),
    "kept": pa.bool_(),
}
RESULT = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in list(FIELDS)[:5]],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("quality", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def verdict(text: Column, model: Model, min_quality: float = MIN_QUALITY) -> Column:
    """Struct of the counts, base_failed, quality (probability) and kept for a text column."""
    weights = model.weights.astype(np.float32).tobytes()
    rest = (model.bias, model.slope, model.shift)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, slope, shift = rest
        fitted = Model(bias, np.frombuffer(weights, np.float32), slope, shift)

        def judged(text: str) -> tuple:
            found = counts(text)
            failed = base_failed(found[0], found[4])
            quality = fitted.quality(text)
            return *found, failed, quality, not failed and quality >= min_quality

        for texts in batches:
            rows = [judged(t or "") for t in texts.to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
            arrays = [pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)]
            yield pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, t in FIELDS.items()])

    return run(text)


def judge(docs: DataFrame, model: Model, min_quality: float = MIN_QUALITY) -> DataFrame:
    """doc_id and the fields of ``verdict`` for each row of ``docs``."""
    return docs.select("doc_id", verdict(F.col("text"), model, min_quality).alias("v")).select("doc_id", "v.*")


def accepted(docs: DataFrame, model: Model, min_quality: float = MIN_QUALITY) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return docs.where(verdict(F.col("text"), model, min_quality)["kept"])
