"""Quality classifier and quality rules: held-out accuracy, and counts against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from concord.llm import ftrl, hashing, queries, rules
from concord.llm.base import table

LABELS = "doc_id bigint, quality int, toxic int"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def area(scores, labels):
    good = [s for s, y in zip(scores, labels, strict=True) if y]
    bad = [s for s, y in zip(scores, labels, strict=True) if not y]
    return float(np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]))


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_classifier_on_the_held_out_fold(spark, larger):
    rows = {r.doc_id: r for r in queries.op3_quality_classifier(spark, larger).collect()}
    assert len(rows) == table(spark, larger, "documents").count()
    assert all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in rows.values())
    test = [(rows[r.doc_id], r.quality) for r in table(spark, larger, "labels").collect() if fold(r.doc_id) == 0]
    assert area([r.score for r, _ in test], [y for _, y in test]) > 0.97
    assert np.mean([r.predicted == y for r, y in test]) > 0.95
    assert all(r.predicted for r, y in test if y)


def test_rules_on_the_held_out_fold(spark, larger):
    rows = {r.doc_id: r for r in queries.op6_quality_rules(spark, larger).collect()}
    test = [(rows[r.doc_id], r.quality) for r in table(spark, larger, "labels").collect() if fold(r.doc_id) == 0]
    assert area([r.quality for r, _ in test], [y for _, y in test]) > 0.97
    assert all(r.kept for r, y in test if y and not r.base_failed)
    assert not any(r.kept for r in rows.values() if r.base_failed)
    texts = {d.doc_id: d.text for d in table(spark, larger, "documents").collect()}
    for i, r in rows.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[i])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, again, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0bé\x1c", max_size=80))
def test_counts(text):
    assert rules.counts(text) == plain_counts(text)


def test_counts_with_more_words_than_fit_three_numbers(monkeypatch):
    words = [b"a", b"b", b"c", b"d"] * 3 + [b"x"]
    assert rules.repeated_words(words) == 12


def test_updates_follow_the_published_rule(monkeypatch):
    """One weight at a time, as a loop."""
    rows = [("good words here", 1.0), ("bad ### words", 0.0), ("good good day", 1.0), ("### bad", 0.0)] * 3
    z, n, bz, bn = Counter(), Counter(), 0.0, 0.0
    a, b, l1, l2 = ftrl.ALPHA, ftrl.BETA, ftrl.L1, ftrl.L2

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)

    for text, y in rows * 2:
        slots, values = ftrl.features(text)
        w = {i: weight(i) for i in slots}
        wb = -bz / ((b + bn**0.5) / a)
        p = 1 / (1 + np.exp(-(wb + sum(w[i] * v for i, v in zip(slots, values, strict=True)))))
        for i, v in zip(slots, values, strict=True):
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
            n[i] += g * g
        g = p - y
        bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / a * wb
        bn += g * g
    model = ftrl.train(rows, epochs=2)
    assert model.bias == pytest.approx(-bz / ((b + bn**0.5) / a))
    for i in z:
        assert model.weights[i] == pytest.approx(weight(i))


def test_rows_may_come_one_at_a_time():
    rows = [("good words here", 1.0), ("", 1.0), ("bad ### words", 0.0), ("good good day", 1.0), ("### bad", 0.0)] * 3
    for train in (ftrl.train, rules.train):
        listed, read = train(rows), train(r for r in rows)
        assert read.bias == listed.bias != 0 and np.array_equal(read.weights, listed.weights) and read.weights.any()
    assert rules.train(iter(())).bias == 0


def test_packed_rows():
    given = [(np.array([3, 5]), np.array([0.5, 1.0])), (np.empty(0, np.int64), np.empty(0)), (np.array([1]), np.array([2.0]))]
    slots, values, borders = hashing.packed(iter(given))
    assert (slots.dtype, values.dtype) == (np.int32, np.float32)
    assert (slots.tolist(), values.tolist(), borders.tolist()) == ([3, 5, 1], [0.5, 1.0, 2.0], [0, 2, 2, 3])


def test_sample_is_bounded_and_excludes_folds(spark, documents):
    docs = documents([(k, f"text {k}") for k in range(40)] + [(3, "other"), (None, "none")])
    marks = [(k, k % 2, 0) for k in range(40)] + [(5, 0, 0), (6, None, 0), (None, 1, 0), (99, 1, 0), (7, 1, 1)]
    labels = spark.createDataFrame(marks, LABELS)
    rows = hashing.labelled_sample(docs, labels, "quality", (1, 2, 3, 4), 100).collect()
    ids = [r.doc_id for r in rows]
    assert sorted(ids) == [k for k in range(40) if fold(k) and k != 5]
    assert {r.text for r in rows if r.doc_id == 3} <= {"other"}
    assert hashing.labelled_sample(docs, labels, "quality", (1, 2, 3, 4), 6).count() == 6


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 0, 0), (-8, 1, 0), (5, None, 0)], LABELS)
    model = ftrl.fit(awkward, labels)
    rows = ftrl.judge(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)
    kept = ftrl.accepted(awkward, model, 0.0)
    assert kept.columns == awkward.columns
    assert kept.count() == awkward.count()
    fitted = rules.fit(awkward, labels)
    judged = rules.judge(awkward, fitted).collect()
    assert len(judged) == awkward.count()
    assert all(r.base_failed and not r.kept for r in judged if r.doc_id in (2, 3, 4))
    assert rules.accepted(awkward, fitted).columns == awkward.columns


def test_without_labels_and_without_documents(spark, documents, empty_documents):
    labels = spark.createDataFrame([], LABELS)
    docs = documents([(1, "some words"), (2, None)])
    assert {r.score for r in ftrl.judge(docs, ftrl.fit(docs, labels)).collect()} == {0.5}
    assert {r.quality for r in rules.judge(docs, rules.fit(docs, labels)).collect()} == {0.5}
    assert ftrl.judge(empty_documents, ftrl.fit(empty_documents, labels)).collect() == []
    assert rules.judge(empty_documents, rules.fit(empty_documents, labels)).collect() == []


def test_calibration_gives_frequencies():
    rng = np.random.default_rng(1)
    model = rules.Model(0.0, np.zeros(0))
    margins = rng.normal(0, 2, 3000)
    labels = (rng.random(3000) < 1 / (1 + np.exp(-(2 * margins - 1)))).astype(float)
    model.margin = lambda k: margins[int(k)]
    fitted = rules.calibrate(model, [(str(k), y) for k, y in enumerate(labels)])
    assert fitted.slope == pytest.approx(2, abs=0.25)
    assert fitted.shift == pytest.approx(-1, abs=0.2)


@pytest.mark.parametrize("text", ["plain text", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a", "\U0001f600\U0001f601\U0001f602\U0001f603\U0001f604"])
def test_character_ngrams_are_runs_of_four_code_points(text):
    slots = hashing.char_slots(text, 4, 18)
    assert len(slots) == len(text) - 3
    for k in range(len(text) - 3):
        assert slots[k] == hashing.char_slots(text[k : k + 4], 4, 18)[0]
        for at in range(4):
            other = text[k : k + at] + "\u0416" + text[k + at + 1 : k + 4]
            assert slots[k] != hashing.char_slots(other, 4, 18)[0]
    assert len(hashing.char_slots(text[:3], 4, 18)) == 0
