import hashlib
import itertools
import random
import zlib

from hypothesis import given, settings, strategies as st

from concord.llm import ctph, queries
from concord.llm.base import table


def plain_signature(text):
    """One byte at a time."""
    data = (text or "").encode()
    hashes = []
    for k in range(len(data)):
        h, power = 0, 1
        for back in range(ctph.WINDOW):
            if k >= back:
                h = (h + (data[k - back] + 1) * power) % 2**32
            power = power * ctph.MULTIPLIER % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        hashes.append(h ^ h >> 13)

    def chunks(size, rest=True):
        pieces, start = [], 0
        for k, h in enumerate(hashes):
            if h % size == size - 1:
                pieces.append(data[start : k + 1])
                start = k + 1
        out = []
        for piece, run in itertools.groupby(pieces):
            n, checksum = len(list(run)), zlib.crc32(piece)
            out.append(ctph.PAIRS[checksum % 4096])
            if n > 1:
                out.append(ctph.PAIRS[zlib.crc32(str(n).encode(), checksum) % 4096])
        if rest and start < len(data):
            out.append(ctph.PAIRS[zlib.crc32(data[start:]) % 4096])
        return out

    size = 3
    while len(chunks(size, False)) >= ctph.MOST_CHUNKS:
        size *= 2
    return ":".join([str(size), *("".join(chunks(size << level)) for level in range(ctph.LEVELS))])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400) | st.text(alphabet="ab ", max_size=2000) | st.builds(lambda t, n: t * n, st.text(max_size=12), st.integers(1, 300)))
def test_signature(text):
    assert ctph.signature(text) == plain_signature(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=70), st.lists(st.sampled_from("abcd"), max_size=70))
def test_edit_distance(a, b):
    assert ctph.edit_distance(a, b) == plain_distance(a, b)


def test_likeness():
    text = " ".join(f"word{k * k % 1009}" for k in range(800))
    other = " ".join(f"term{k * k % 997}" for k in range(800))
    own = ctph.signature(text)
    assert ctph.likeness(own, own) == 1.0
    assert ctph.likeness(own, ctph.signature(text.replace("word4 ", "term4 "))) > 0.7
    assert 0.2 < ctph.likeness(own, ctph.signature(text[: len(text) // 2])) < 0.8
    assert ctph.likeness(own, ctph.signature(other)) < 0.1
    assert ctph.likeness(ctph.signature(""), ctph.signature(None)) == 1.0
    periodic = "Retionly " * 400 + "thing " * 300 + "over " * 200 + text
    assert ctph.likeness(ctph.signature(periodic), ctph.signature("Retionly " * 500 + periodic)) > 0.8


def test_lines_of_two_forms_are_told_apart():
    some = random.Random(5)
    for _ in range(400):
        tail = "".join(some.choices("abcdefghijklmnopqrstuvwxyz 0123456789", k=20))
        one, two = ("".join(some.choice(["yes", "no "]) + tail + "\n" for _ in range(600)) for _ in range(2))
        assert ctph.likeness(ctph.signature(one), ctph.signature(two)) < 0.8


def test_lengths_of_runs_count():
    signatures = [ctph.signature("abcdefgh" * n) for n in (500, 501, 5_000)]
    assert len(set(signatures)) == 3
    assert len({ctph.signature("a" * n) for n in (500, 501, 5_000)}) == 3


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (doc_id, text), (_, following) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, altered, theirs = map(ctph.signature, (text, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), digest, own, altered, ctph.likeness(own, altered), ctph.likeness(own, theirs)))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    rows = queries.op2_document_fingerprints(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected([tuple(d) for d in docs])


def test_awkward_rows(awkward):
    # equal ids are ordered by text, so the order of the repeated null ids is known
    found = ctph.compare_with_next(awkward).collect()
    given = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in found), key=str) == expected(given)


def test_many_ranges_and_one_row(spark, documents):
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = ctph.compare_with_next(documents(rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted((tuple(r) for r in found), key=str) == expected(rows)
    one = ctph.compare_with_next(documents([(9, "alone")])).collect()
    assert [tuple(r) for r in one] == expected([(9, "alone")])


def test_empty_table(empty_documents):
    assert ctph.compare_with_next(empty_documents).collect() == []
