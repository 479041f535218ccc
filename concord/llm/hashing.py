"""Hashed n-grams of words and characters as numpy arrays, and the labelled sample that classifiers learn from."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: A run of letters, digits and underscores, or a run of other characters without white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_WORDS = 50_000
#: Outside the 32 bits of the hashes of tokens.
REPEATED = np.uint64(1 << 32)
FOLDS = 5


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = value
        return value


HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """A hash of each token of a text, lower-cased. A token that stands one or two places before too is replaced by a
    mark for repetition, so that n-grams tell repetitive texts whatever they repeat."""
    tokens = TOKEN.findall(text.lower())
    hashes = np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))
    again = np.zeros(len(hashes), bool)
    for back in (1, 2):
        again[back:] |= hashes[back:] == hashes[:-back]
    return np.where(again, REPEATED, hashes)


def ngram_slots(hashes: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """Slots below ``2 ** bits`` of all n-grams of 1 to ``longest`` tokens, with repeats."""
    rolling, out = hashes * np.uint64(0x9E3779B97F4A7C15), []
    for n in range(1, longest + 1):
        if n > 1:
            if len(hashes) < n:
                break
            rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[n - 1 :]
        out.append(((rolling ^ np.uint64(n)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


def packed(rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values (four bytes each) of all rows, one after the other, and the border before and behind each row.

    Two large blocks go back to the system when a model is learnt; thousands of small arrays would stay with the worker.
    """
    slots, values, borders = bytearray(), bytearray(), [0]
    for of_row, with_values in rows:
        slots += of_row.astype(np.int32).data
        values += with_values.astype(np.float32).data
        borders.append(borders[-1] + len(of_row))
    return np.frombuffer(slots, np.int32), np.frombuffer(values, np.float32), np.array(borders)


def char_slots(text: str, n: int, bits: int) -> np.ndarray:
    """Slots of all runs of ``n`` characters (code points) of a text, with repeats."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    count = len(codes) - n + 1
    if count < 1:
        return np.empty(0, np.int64)
    rolling = np.zeros(count, np.uint64)
    for k in range(n):
        rolling = rolling * np.uint64(0xBF58476D1CE4E5B9) + codes[k : k + count]
        rolling ^= rolling >> np.uint64(29)
    return ((rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def fold(doc_id: Column) -> Column:
    """Number of the fold of a document, 0 to 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: tuple[int, ...], rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents of ``folds``, those that a hash of the id puts first.

    Null labels, null ids and ids with two different labels teach nothing. An id that several documents have stands for
    its smallest text. The bound on the rows is a bound on what a model is fitted to, not on what is scored.
    """
    known = (
        labels.where(F.col(label).isNotNull() & fold(F.col("doc_id")).isin(*folds))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id", F.col("label").cast("double").alias("label"))
    )
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(known), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select("doc_id", "text", "label")
    )
