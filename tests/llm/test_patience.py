from itertools import combinations, pairwise, product

import pytest
from hypothesis import given, settings, strategies as st

from concord.llm import patience, queries

GPL = "This work is licensed under the GNU General Public License, version 3."


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def possible(text, template):
    """Every number of words that an alignment by the definition can have: any longest chain of anchors, at each depth."""
    if not text or not template:
        return {0}
    shared = [w for w in template if template.count(w) == 1 and text.count(w) == 1]
    places = [text.index(w) for w in shared]
    for n in range(len(places), 0, -1):
        chains = [c for c in combinations(range(len(places)), n) if all(places[x] < places[y] for x, y in pairwise(c))]
        if chains:
            break
    else:
        return {plain_common(template, text)}
    out = set()
    for chain in chains:
        anchors = [(-1, -1), *((places[k], template.index(shared[k])) for k in chain), (len(text), len(template))]
        gaps = [possible(text[a + 1 : b], template[x + 1 : y]) for (a, x), (b, y) in pairwise(anchors)]
        out |= {len(chain) + sum(found) for found in product(*gaps)}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.lists(st.integers(0, 9), max_size=40))
def test_common(a, b):
    assert patience.common(a, b) == plain_common(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), unique=True, max_size=30))
def test_increasing(values):
    chain = patience.increasing(values)
    assert [values[k] for k in chain] == sorted(values[k] for k in chain)
    best = [1] * len(values)
    for k, v in enumerate(values):
        best[k] = 1 + max((best[j] for j in range(k) if values[j] < v), default=0)
    assert len(chain) == max(best, default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=9), st.lists(st.integers(0, 7), max_size=9))
def test_aligned_is_one_of_the_defined_alignments(text, template):
    found, first, last = patience.aligned(text, template)
    assert found in possible(text, template)
    assert (first >= 0) == (found > 0)
    assert first <= last < max(1, len(text))


def scan(text, min_coverage=patience.MIN_COVERAGE):
    return patience.Scanner(tuple(sorted(patience.TEMPLATES.items())), min_coverage).scan(text)


def test_planted_notices():
    noise = "the work of an under version is by that public and general 3 4 0 " * 400
    for name, text in patience.TEMPLATES.items():
        found = scan(noise + text + " " + noise + text.upper() + noise)
        assert found[0][0] == name and found[0][1] == 1.0
        words = patience.WORD.findall((noise + text).lower())
        assert found[0][4] - found[0][3] < 2 * len(words)
    assert scan(noise) == []


def test_changed_notices_are_covered_in_part():
    words = patience.TEMPLATES["MIT-grant"].split()
    changed = " ".join(w for k, w in enumerate(words) if k % 10)
    found = {f[0]: f[1] for f in scan("some text before " + changed + " and after")}
    assert 0.8 <= found["MIT-grant"] < 1
    assert scan(" ".join(reversed(words))) == []


def test_any_place_is_seen():
    for k in range(40):
        assert scan("filler " * k + GPL + " filler" * 50)[0][:2] == ("GPL-3.0", 1.0)


def test_query_finds_planted_lines(spark, sf_dir):
    from concord.llm.base import table

    lines = {
        GPL: "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = {r.doc_id: r for r in queries.op8_license_scan(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        planted = {name for line, name in lines.items() if line in text}
        assert {f.license for f in rows[i].found} == planted
        assert (rows[i].license in planted) if planted else rows[i].license is None


def test_awkward_rows(awkward, empty_documents):
    rows = patience.scan(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.license for r in rows} == {None}
    assert patience.scan(empty_documents).collect() == []


@pytest.mark.parametrize("templates", [{}, {"empty": ""}])
def test_no_templates(awkward, templates):
    assert {r.license for r in patience.scan(awkward, templates).collect()} == {None}


SIBLINGS = [
    "Released under the BSD License.",
    "released under the GNU General Public License",
    "Licensed under CC BY 4.0.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under the Mozilla Public License, version 2.0.",
    "Licensed under the Apache License, Version 1.1.",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-Non Commercial 4.0 International License.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU General Public License, version 2. See section 3.",
    "This work is licensed under the GNU General Public License, version 2 or any later version. See section 3.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    patience.TEMPLATES["GPL-3.0-or-later"].replace("GNU", "GNU Affero"),
    patience.TEMPLATES["GPL-3.0-or-later"].replace("version 3", "version 2"),
    "This is free software released into the public domain.",
    "Prisoners released from work under the rule of the new MIT dean need a special license.",
    "It is released in spring; what lies under it is the old MIT press, which never had the city's license.",
]


@pytest.mark.parametrize("text", SIBLINGS)
def test_siblings_and_prose_are_no_license(text):
    assert scan(text) == []
    assert scan("some filler before it " * 9 + text + " and some after" * 9) == []


def test_longer_siblings_hide_the_shorter_ones():
    for name in ("BSD-3-Clause", "BSD-4-Clause", "HPND"):
        assert [f[0] for f in scan("words " * 7 + patience.TEMPLATES[name] + " words")] == [name]
    found = scan(patience.TEMPLATES["CC-BY-SA-4.0"])
    assert [f[0] for f in found] == ["CC-BY-SA-4.0"]
    both = patience.TEMPLATES["BSD-2-Clause"] + " words" * 300 + patience.TEMPLATES["BSD-3-Clause"]
    assert {f[0] for f in scan(both)} == {"BSD-2-Clause", "BSD-3-Clause"}
    parts = both.split(" words" * 300)
    assert {f[0] for f in scan((" words" * 300).join(parts[::-1]))} == {"BSD-2-Clause", "BSD-3-Clause"}
    assert {f[0] for f in scan("\n".join(parts))} == {"BSD-2-Clause", "BSD-3-Clause"}
    assert {f[0] for f in scan("\n".join(parts[::-1]))} == {"BSD-2-Clause", "BSD-3-Clause"}


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Released under the terms of the MIT License.", "MIT"),
        ("Licensed under Apache License, version 2.0", "Apache-2.0"),
        ("This work is licensed under the terms of the GNU General Public License (GPL), version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2 or version 3.", "GPL-3.0"),
        ("# This work is licensed under the GNU\nREM General Public License, version\n12 3.", "GPL-3.0"),
        ("This work is licensed under the Creative Commons Attribution-Share Alike 4.0 International License", "CC-BY-SA-4.0"),
    ],
)
def test_changed_wording_is_still_found(text, name):
    assert [f[0] for f in scan(text)] == [name]


@pytest.mark.parametrize("name", ["Apache-2.0-header", "BSD-2-Clause", "GPL-3.0-or-later", "MIT-grant", "MPL-2.0"])
def test_inserted_words_at_every_offset(name):
    words = patience.WORD.findall(patience.TEMPLATES[name])
    size = len(words)
    half = size * 2 // 5
    block = [*words[: size // 2], *["filler"] * half, *words[size // 2 :]]
    spread = [x for k, w in enumerate(words) for x in (("dnl", w) if k % 2 else (w,))]
    for text in (block, spread):
        for offset in range(size):
            found = scan(" ".join(["before"] * offset + text + ["after"] * 2 * size))
            assert found[0] == (name, 1.0, size, offset, offset + len(text) - 1)
    for place in range(1, size):
        found = scan(" ".join(["before"] * 80 + words[:place] + ["filler"] * half + words[place:] + ["after"] * 99))
        assert found[0][:3] == (name, 1.0, size)


def test_changed_and_commented_notice_at_every_offset():
    words = patience.WORD.findall(patience.TEMPLATES["MIT-grant"])
    kept = [w for k, w in enumerate(words) if k % 7 != 3]
    lines = " ".join("\nREM " * (k % 5 == 0) + w for k, w in enumerate(kept))
    for offset in range(len(words)):
        found = scan("before " * offset + lines + " after" * 200)
        assert found[0][:3] == ("MIT-grant", len(kept) / len(words), len(kept))
