"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its value is one less than a multiple of the block
size. Each chunk gives two base-64 digits of its checksum. A run of equal chunks one behind the other (equal in all their
bytes), as periodic text makes them, gives the two digits of the chunk and two of a checksum of chunk and number. A
fingerprint is the block size and these digits at that size and at its ``LEVELS - 1`` doublings, joined by colons. The block
size is the smallest of 3, 6, 12, ... at which a text has fewer than ``MOST_CHUNKS`` pairs of digits up to its last boundary;
what is behind that is a chunk as well, so a fingerprint speaks of the whole text and stays short. Two fingerprints are
compared at the smallest block size that both have. Likeness is one less the edit distance (over pairs of digits) divided by
the longer length.

Null texts count as empty; an empty text has fingerprint ``3`` and ``LEVELS`` colons. Equal fingerprints have likeness 1, fingerprints
without a common block size 0. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from concord.llm.base import written

WINDOW = 7
SMALLEST = 3
MOST_CHUNKS = 64
LEVELS = 4
#: Characters of a text that place it among rows of one id; range borders are sampled on the driver, so keys stay short.
KEY_CHARS = 16
DIGITS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
PAIRS = [a + b for a in DIGITS for b in DIGITS]
#: Odd multiplier of the rolling hash (the golden ratio in 32 bits).
MULTIPLIER = 0x9E3779B1


def rolling(data: bytes) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each position (fewer at the start)."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    out, power = codes.copy(), MULTIPLIER
    for back in range(1, min(WINDOW, len(data))):
        out[back:] += codes[:-back] * np.uint32(power)
        power = power * MULTIPLIER & 0xFFFFFFFF
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


#: Base of the checksums by which neighbouring chunks are found equal, and its inverse.
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))


#: Powers for texts of up to this many bytes are kept.
KEPT_POWERS = 1 << 16
_POWERS = [_powers(b, KEPT_POWERS) for b in (BASE, BASE_INVERSE)]


class _Sums:
    """Checksums of any stretch of a text's bytes, from sums of the bytes before each place."""

    def __init__(self, data: bytes):
        n = len(data)
        powers, self.inverse = _POWERS if n <= KEPT_POWERS else [_powers(b, n) for b in (BASE, BASE_INVERSE)]
        codes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.before = np.append(np.uint64(0), np.cumsum(codes * powers[:n], dtype=np.uint64))

    def repeated(self, at: np.ndarray) -> np.ndarray:
        """Whether each of the chunks that end at ``at`` equals the one before it."""
        ends = at + 1
        starts = np.append(0, ends)[:-1]
        sums = (self.before[ends] - self.before[starts]) * self.inverse[starts]
        lengths = ends - starts
        same = np.zeros(len(at), bool)
        same[1:] = (sums[1:] == sums[:-1]) & (lengths[1:] == lengths[:-1])
        return same


def _units(same: np.ndarray) -> int:
    """Pairs of digits that chunks give: one, and one more for a run of equal ones."""
    return int(np.count_nonzero(~same) + np.count_nonzero(same[1:] & ~same[:-1]))


def _chunks(data: bytes, sums: _Sums, at: np.ndarray) -> str:
    view, same = memoryview(data), sums.repeated(at)
    heads = np.flatnonzero(~same)
    ends = (at[heads] + 1).tolist()
    starts = np.append(0, at + 1)[heads].tolist()
    runs = np.diff(np.append(heads, len(at))).tolist()
    out = []
    for start, end, run in zip(starts, ends, runs, strict=True):
        checksum = zlib.crc32(view[start:end])
        out.append(PAIRS[checksum & 4095])
        if run > 1:
            out.append(PAIRS[zlib.crc32(b"%d" % run, checksum) & 4095])
    rest = int(at[-1]) + 1 if len(at) else 0
    if rest < len(data):
        out.append(PAIRS[zlib.crc32(view[rest:]) & 4095])
    return "".join(out)


def signature(text: str | None) -> str:
    """Fingerprint of a whole text."""
    data = (text or "").encode()
    size = SMALLEST
    if not data:
        return f"{size}" + ":" * LEVELS
    hashes = rolling(data)
    # boundaries of a block size hold those of its doublings, as 3 * 2^k - 1 is one less than a multiple of 3 * 2^(k-1)
    at = np.flatnonzero(hashes % np.uint32(size) == size - 1)
    sums = _Sums(data)
    while len(at) >= MOST_CHUNKS and _units(sums.repeated(at)) >= MOST_CHUNKS:
        size *= 2
        at = _at(hashes, at, size)
    signatures = []
    for level in range(LEVELS):
        at = _at(hashes, at, size << level)
        signatures.append(_chunks(data, sums, at))
    return ":".join([str(size), *signatures])


def _at(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return at[hashes[at] % np.uint32(size) == size - 1] if size < 1 << 32 else at[:0]


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and replacements, one column of the table at a time as bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = mask, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        vertical = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & mask
        rise, fall = down | ~(diagonal | up) & mask, up & diagonal
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & mask, fall << 1 & mask
        up, down = fall | ~(vertical | rise) & mask, rise & vertical
    return distance


def likeness(a: str, b: str) -> float:
    """0 (nothing in common) to 1 of two fingerprints."""
    if a == b:
        return 1.0
    (size_a, *sigs_a), (size_b, *sigs_b) = a.split(":"), b.split(":")
    sizes_a = {int(size_a) << k: s for k, s in enumerate(sigs_a)}
    sizes_b = {int(size_b) << k: s for k, s in enumerate(sigs_b)}
    size = min(sizes_a.keys() & sizes_b.keys(), default=None)
    if size is None or not (sizes_a[size] and sizes_b[size]):
        return 0.0
    x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (sizes_a[size], sizes_b[size]))
    return 1 - edit_distance(x, y) / max(len(x), len(y))


def fingerprint(text: Column) -> Column:
    """Fingerprint column of a text column."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([signature(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def similarity(a: Column, b: Column) -> Column:
    """Likeness column of two fingerprint columns; null where one is null."""

    @F.arrow_udf(T.DoubleType())
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else likeness(x, y) for x, y in pairs], pa.float64())

    return run(a, b)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = [
    ("doc_id", T.LongType(), pa.int64()),
    ("n_chars", T.LongType(), pa.int64()),
    ("edited_sha256", T.StringType(), pa.string()),
    ("fingerprint", T.StringType(), pa.string()),
    ("edited_fingerprint", T.StringType(), pa.string()),
    ("near_edited", T.DoubleType(), pa.float64()),
    ("near_next", T.DoubleType(), pa.float64()),
]
#: Of the first and last row of a sorted partition: its number, which row it is, and the text.
EDGES = [("part", T.IntegerType(), pa.int32()), ("edge", T.IntegerType(), pa.int32()), ("text", T.StringType(), pa.string())]
FIRST, LAST = 0, 1


def _compared(doc_id: int | None, text: str, following: str, own: str, theirs: str) -> tuple:
    changed = edited(text, following)
    altered = signature(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc_id, len(text), digest, own, altered, likeness(own, altered), likeness(own, theirs)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by doc_id: each row but the last with its successor, then the partition's two edge rows."""
    part, first, previous = TaskContext.get().partitionId(), None, None
    schema = pa.schema([(n, t) for n, _, t in FIELDS + EDGES])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for data in batches:
        rows = []
        for doc_id, text in zip(data.column(0).to_pylist(), data.column(1).to_pylist(), strict=True):
            text = text or ""
            own = signature(text)
            if previous:
                rows.append((*_compared(*previous[:2], text, previous[2], own), None, None, None))
            previous = (doc_id, text, own)
            first = first or previous
        if rows:
            yield batch(rows)
    if previous:
        yield batch([(row[0], *[None] * 6, part, edge, row[1]) for edge, row in ((FIRST, first), (LAST, previous))])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and against the next document's, ascending doc_id.

    Texts are shuffled once, into sorted ranges of doc_id, and each range is scanned as a stream. The last row of a
    range meets the first one of the next non-empty range (after the last: of the first) in a second, small step: two
    rows per range. Rows with equal doc_id are ordered by text, null ids come first.
    """
    schema = T.StructType([T.StructField(n, t) for n, t, _ in FIELDS + EDGES])
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id"), F.left("text", F.lit(KEY_CHARS)))
        .sortWithinPartitions("doc_id", "text")
    )
    found = written(ordered.mapInArrow(_scan, schema), "ctph")
    done = found.where("part IS NULL").select([n for n, _, _ in FIELDS])
    edges = found.where("part IS NOT NULL")
    # which range follows which: one number per range
    order = Window.orderBy("part")
    parts = edges.where(F.col("edge") == FIRST).select("part")
    follows = parts.select(
        "part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("following_part")
    )
    heads = edges.where(F.col("edge") == FIRST).select(F.col("part").alias("following_part"), F.col("text").alias("following"))
    pairs = edges.where(F.col("edge") == LAST).join(follows, "part").join(heads, "following_part")

    @F.arrow_udf(T.StructType(schema.fields[: len(FIELDS)]))
    def compare(ids: pa.Array, texts: pa.Array, followings: pa.Array) -> pa.Array:
        rows = [
            _compared(d, t, f, signature(t), signature(f))
            for d, t, f in zip(ids.to_pylist(), texts.to_pylist(), followings.to_pylist(), strict=True)
        ]
        columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
        arrays = [pa.array(c, t) for c, (_, _, t) in zip(columns, FIELDS, strict=True)]
        return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, _, t in FIELDS])

    last = pairs.select(compare("doc_id", "text", "following").alias("r")).select("r.*")
    return done.unionByName(last)
