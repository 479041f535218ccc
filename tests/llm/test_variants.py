"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import queries, variants
from concord.llm.base import table


def one_edit(a, b):
    """Whether ``b`` is ``a`` with exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def vocabulary(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            code = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if code % 199 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def plain(rows):
    words = vocabulary(rows)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w, n in words.items():
        found = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, []) if one_edit(w, v)]
        near[w] = len(found)
        if found and words[best := min(found, key=lambda v: (-words[v], v))] >= 5 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, near[w], words[form[w]] if w in form else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def variants_of(words, some, rows):
    """Documents of words and of edits of them, some frequent, some rare."""
    pool = []
    for w in words:
        pool += [w] * 200
        for _ in range(4):
            at = some.randrange(len(w))
            v = some.choice([w[:at] + w[at + 1 :], w[:at] + some.choice("abé÷") + w[at + 1 :], w[:at] + some.choice("aßb") + w[at:]])
            pool += [v] * some.choice([2, 8, 30])
            at = some.randrange(len(v))
            pool += [v[:at] + v[at + 1 :]] * some.choice([5, 6])
    some.shuffle(pool)
    return [(k, " ".join(pool[k::rows])) for k in range(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(documents, seed):
    some = random.Random(seed)
    words = ["".join(some.choices("aabbcdé", k=some.randrange(6, 11))) for _ in range(40)] + ["aaaaaaa", "abababab"]
    rows = variants_of(words, some, 50)
    assert any(r[1] for r in plain(rows)) and any(r[2] != (r[1] or r[0]) for r in plain(rows))
    assert found(variants.group(documents(rows))) == plain(rows)


def test_slices_and_flushes(documents, monkeypatch):
    some = random.Random(9)
    rows = variants_of(["".join(some.choices("abcdé", k=7)) for _ in range(30)], some, 30)
    monkeypatch.setattr(variants, "HELD_WORDS", 10)
    monkeypatch.setattr(variants, "WORDS_PER_TASK", 20)
    monkeypatch.setattr(variants, "PROBES", 50)
    assert found(variants.group(documents(rows), filter_bytes=100)) == plain(rows)


def test_long_chains_end_at_the_root(documents):
    chain = ["abcdef"] * 625 + ["abcdeff"] * 125 + ["abcdefff"] * 25 + ["abcdeffff"] * 5
    rows = [(k, " ".join(chain[k::20])) for k in range(20)]
    result = {r[0]: r[2] for r in found(variants.group(documents(rows)))}
    assert found(variants.group(documents(rows))) == plain(rows)
    assert result["abcdefff"] == "abcdef"


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    long = "b" * 30_000
    more = [(20 + k, f"{long} {long}a {long[1:]} ÀÉÎÕÜÿ×÷ ÀÉÎÕÜÿ×") for k in range(6)] + [(None, "Nothing nothing NOTHING")] * 2
    df = awkward.unionByName(awkward.sparkSession.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    for name in ("word", "n", "other", "root", "form"):
        df = df.withColumn(name, F.lit("clash"))
    mine = found(variants.group(df))
    assert mine == plain(rows + more)
    assert any(r[0] == "nothing" and r[3] == 6 for r in mine) and any(r[0] == long for r in mine)


def test_empty_tables(documents, empty_documents):
    assert variants.group(empty_documents).collect() == []
    assert variants.group(documents([(1, "too rare a word here"), (2, None)])).collect() == []


def test_hashes_of_edits_are_those_of_the_words():
    words = ["abcdefg", "aabbccd", "zzzzzzz"]
    filters = variants.Filters({7: 3, 6: 3}, 1, 0)
    filters.blocks[:] = np.iinfo(np.uint64).max  # lets all through, so every edit is listed
    edits = [(words[k], e) for which, es in filters.edits(words, [ord("a"), ord("f")]) for k, e in zip(which, es, strict=True)]
    assert all(one_edit(w, e) for w, e in edits)
    assert len(edits) == len(set(edits))
    assert ("zzzzzzz", "zzzzzz") in edits and ("aabbccd", "aabbcfd") in edits and ("aabbccd", "aabbcad") not in edits


def test_whole_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert found(queries.op11_spelling_variants(spark, sf_dir)) == plain(rows)
