"""Spelling variants: words one edit apart, found by probing Bloom filters of the vocabulary.

The vocabulary is counted first. Its words are put into Bloom filters whose blocks are single 64-bit numbers, a filter for
each word length, and these are broadcast. A task then generates the edits of its words and probes the filter of the length
that the edit has. Of the two words of a pair one finds the other: the longer one by deleting a code point, and of two equally
long ones that with the smaller code point by replacing it. Only what the filters let through is made a text and shuffled, to
be joined with the vocabulary; that takes out false positives, so the pairs are exact.

Edits are probed by a polynomial hash of their code points, which follows from that of the word without making the edit.
Filters hold at most ``FILTER_BYTES`` at a time. A larger vocabulary is cut into slices by hash, each with filters and a pass
over the words of its own: what is broadcast stays bounded and no pair is lost.

Null and empty texts have no words; a row with a null id counts like one whose id is the empty text. Repeated rows count each.
Words may be of any length. Among near words of equal count the smaller one in code-point order is the form. If no word is
frequent enough, or the table is empty, the result is empty. Columns other than ids and texts are never looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm.base import written

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is this many times as frequent as the word.
RATIO = 5
#: A run whose hash this divides loses a code point.
DAMAGED = 199
BITS_PER_WORD = 16
FILTER_BYTES = 1 << 24
#: Lengths from this one on share a filter.
LONG_WORD = 64
#: Different words of a task that are held at once while they are counted.
HELD_WORDS = 300_000
WORDS_PER_TASK = 1 << 15
#: Edits that are probed at once.
PROBES = 1 << 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: runs of letters of at least ``least_length`` code points, some of them damaged by their hash."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                begin = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in Counter(run.findall(text.encode().translate(_LOWER).decode())).items():
                    code = zlib.crc32(word.encode(), begin)
                    if code % DAMAGED == 0:
                        at = code % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                held.clear()
        if held:
            yield pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equally long words in the list, and their code points (a row per word), a bounded number at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        length = int(lengths[order[at]])
        end = min(np.searchsorted(lengths[order], length, "right"), at + max(1, PROBES // length))
        which = order[at:end]
        points = np.frombuffer("".join([words[k] for k in which]).encode("utf-32-le"), np.uint32)
        yield which, points.reshape(len(which), length).astype(np.uint64)
        at = end


def powers(length: int) -> np.ndarray:
    """The weight of the code point at each place of a word."""
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(length - 1, _BASE, np.uint64)))


def mixed(code: np.ndarray, length: int) -> np.ndarray:
    """The bits of a polynomial hash and a word's length, well spread."""
    x = code + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def mask(x: np.ndarray) -> np.ndarray:
    """The four bits that a word sets in its block."""
    one, six = np.uint64(1), np.uint64(63)
    return one << (x & six) | one << (x >> np.uint64(6) & six) | one << (x >> np.uint64(12) & six) | one << (x >> np.uint64(18) & six)


class Filters:
    """Bloom filters by word length, one behind the other in one array of blocks, of one slice of the vocabulary."""

    def __init__(self, words_of_length: dict[int, int], slices: int, piece: int):
        """``words_of_length``: number of words of each length (from ``LONG_WORD`` on, of all lengths together)."""
        self.slices, self.piece, self.first, self.size, at = np.uint64(slices), np.uint64(piece), {}, {}, 0
        for length, n in sorted(words_of_length.items()):
            self.first[length], self.size[length] = at, max(1, math.ceil(n * BITS_PER_WORD / 64 / slices))
            at += self.size[length]
        self.blocks = np.zeros(at, np.uint64)

    def place(self, x: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LONG_WORD)
        return ((x >> np.uint64(32)) * np.uint64(self.size[shard]) >> np.uint64(32)).astype(np.int64) + self.first[shard]

    def holds(self, code: np.ndarray, length: int) -> np.ndarray:
        """Whether words of ``length`` with these polynomial hashes may be in the slice."""
        if min(length, LONG_WORD) not in self.first:
            return np.zeros(code.shape, bool)
        x = mixed(code, length)
        bits = mask(x)
        found = self.blocks[self.place(x, length)] & bits == bits
        return found if self.slices == 1 else found & (x % self.slices == self.piece)

    def fill(self, vocabulary: DataFrame) -> None:
        """Sets the bits of the slice's words: each block is made up where its words meet, and sent once."""
        layout = self

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, points in by_length(batch.column(0).to_pylist()):
                    length = points.shape[1]
                    x = mixed(points @ powers(length), length)
                    x = x[x % layout.slices == layout.piece]
                    yield pa.record_batch({"block": layout.place(x, length), "bits": mask(x).view(np.int64)})

        rows = vocabulary.select("word").mapInArrow(bits, "block bigint, bits bigint")
        found = rows.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BYTES / 8 rows
        blocks = np.zeros_like(self.blocks)
        blocks[found["block"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        self.blocks = blocks

    def edits(self, words: list[str], alphabet: list[int]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Places of words in the list and an edit of each that may be a word."""
        for which, points in by_length(words):
            length = points.shape[1]
            power = powers(length)
            terms = points * power
            code = terms.sum(axis=1, dtype=np.uint64)
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            shorter = before + (code[:, None] - before - terms) * _BASE_INVERSE
            found = self.holds(shorter, length - 1)
            found[:, 1:] &= points[:, 1:] != points[:, :-1]  # of equal code points in a row any deletion gives the same
            at, place = np.nonzero(found)
            if len(at):
                texts = [words[k] for k in which[at]]
                yield which[at], [t[:p] + t[p + 1 :] for t, p in zip(texts, place.tolist(), strict=True)]
            for point in alphabet:
                larger = points < point
                row, place = np.nonzero(larger)
                probe = code[row] + (np.uint64(point) - points[larger]) * power[place]
                hit = np.flatnonzero(self.holds(probe, length))
                if len(hit):
                    at, place, char = row[hit], place[hit].tolist(), chr(point)
                    texts = [words[k] for k in which[at]]
                    yield which[at], [t[:p] + char + t[p + 1 :] for t, p in zip(texts, place, strict=True)]


def candidates(vocabulary: DataFrame, filters, alphabet: list[int]) -> DataFrame:
    """word, n, other: edits of words that the broadcast ``filters`` let through."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for which, others in filters.value.edits(words, alphabet):
                yield pa.record_batch(
                    {
                        "word": pa.array([words[k] for k in which], pa.string()),
                        "n": pa.array(counts[which], pa.int64()),
                        "other": pa.array(others, pa.string()),
                    }
                )

    return vocabulary.select("word", "n").mapInArrow(probe, "word string, n bigint, other string")


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, other, other_n: each pair of words that are one edit apart, once."""
    spark = vocabulary.sparkSession
    shard = F.least(F.length("word"), F.lit(LONG_WORD))
    sizes = {r.shard: r.n for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    alphabet = sorted(ord(r.c) for r in letters.collect() if r.c)  # letters of the runs: at most 90
    words = sum(sizes.values())
    slices = math.ceil(words * BITS_PER_WORD / 8 / filter_bytes)
    dealt = vocabulary.repartition(math.ceil(words / WORDS_PER_TASK), "word")
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    parts = []
    for piece in range(slices):
        filters = Filters(sizes, slices, piece)
        filters.fill(vocabulary)
        sent = spark.sparkContext.broadcast(filters)
        pairs = candidates(dealt, sent, alphabet).join(known, "other").select("word", "n", "other", "other_n")
        parts.append(written(pairs, "variant-pairs"))
        sent.destroy()
    result = parts[0]
    for p in parts[1:]:
        result = result.union(p)
    return result


def forms(pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n_near, form, form_n of each word with a near one; the form is null where none is ``ratio`` times as frequent."""
    ends = F.array(
        F.struct(F.col("word"), F.col("n"), F.col("other"), F.col("other_n")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    both = pairs.select(F.inline(ends))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other")))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    frequent = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    return found.select(
        "word",
        "n_near",
        F.when(frequent, F.col("best.other")).alias("form"),
        F.when(frequent, -F.col("best.minus")).alias("form_n"),
    )


def roots(steps: DataFrame) -> DataFrame:
    """word, root: ``steps`` (word, root) followed to the end, each round twice as far.

    Counts rise at each step, so there is no circle.
    """
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not steps.join(further, "root", "left_semi").limit(1).count():
            return steps
        joined = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        steps = written(joined, "variant-roots")


def group(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the vocabulary."""
    vocabulary = written(word_counts(docs).where(F.col("n") >= least_count), "variant-words")
    found = written(forms(near_pairs(vocabulary, filter_bytes), ratio), "variant-forms")
    last = roots(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return (
        vocabulary.join(found, "word", "left")
        .join(last, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            "form_n",
        )
    )
