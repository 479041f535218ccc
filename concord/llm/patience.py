"""License scans by patience alignment.

A text and a template are aligned on words that stand exactly once in both: the longest run of them in the order of both
anchors the alignment, and the gaps between anchors are aligned in the same way, where more words stand only once. A gap
without such words counts its longest common subsequence. Coverage is the aligned part of the template's words.

A place is at most ``SPAN`` template lengths long, inserted words included (comment signs, line numbers, names). Windows
start a quarter of a template after the other (at every word for templates of fewer than ``LONG`` words) and are longer
than such a place by that step, so each place lies whole inside one of them, wherever it stands, however long the text
is and however often a license stands in it. A window is looked at only if it has enough words of the
template to reach the wanted coverage at all, which excludes nothing that could reach it. What is aligned is the smallest
part of the window that holds the longest common subsequence, or a shorter one of enough words if that fails.

Coverage alone does not tell a license from its siblings, so the words of ``TELLING`` must stand in the aligned part too,
in their order: between two of them other words may stand, but none of ``RIVALS`` and before a version number no other
number but that of the line, or one to choose from ("2 or 3"). In templates of fewer than ``LONG`` words foreign words count: the aligned words must be
``MIN_DENSITY`` of the template's and the foreign ones, of which each line begun inside has one free (comment signs, line
numbers). A license that another one extends is not reported where the other stands. Templates of callers have no
telling words unless they are those of ``TEMPLATES``.

Null and empty texts have no license. Repeated rows get equal results; an empty table gives an empty result; columns
other than doc_id and text are not read. Of templates with equal coverage the longer counts as the better one, then the
first by name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

MIN_COVERAGE = 0.8
MIN_DENSITY = 0.6
LONG = 20
SPAN = 2
WORD = re.compile(r"\w+")

#: Notices and grants of public licenses, as they are printed.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        'required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "BSD-4-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. All advertising materials mentioning features or use of this "
        "software must display the following acknowledgement: This product includes software developed by the "
        "organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "HPND": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without "
        "fee is hereby granted, provided that the above copyright notice appear in all copies and that both that "
        "copyright notice and this permission notice appear in supporting documentation."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words that tell a template from the notices of other licenses, in their order; one of the given forms must stand.
TELLING = {
    "Apache-2.0": ("apache license 2 0",),
    "Apache-2.0-header": ("apache license 2 0",),
    "BSD-3-Clause": ("neither name endorse promote",),
    "BSD-4-Clause": ("advertising materials acknowledgement",),
    "CC-BY-4.0": ("creative commons attribution 4 0",),
    "CC-BY-NC-4.0": ("cc by nc 4 0",),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0", "creative commons attribution share alike 4 0"),
    "GPL-3.0": ("gnu general public license 3",),
    "GPL-3.0-or-later": ("gnu general public license 3 later",),
    "HPND": ("supporting documentation",),
    "MIT": ("mit license",),
    "MPL-2.0": ("mozilla public license 2 0",),
    "Unlicense": ("unencumbered public domain",),
}

#: Words that make another license of what stands before them: telling word -> words between it and the next one.
_CC = frozenset("alike commercial derivatives derivs noderivatives noderivs non noncommercial share sharealike unported".split())
_BY = frozenset("nc nd sa".split())
RIVALS = {
    "gnu": frozenset("affero lesser library".split()),
    **dict.fromkeys(("attribution", "sharealike", "alike"), _CC),
    **dict.fromkeys(("cc", "by", "nc"), _BY),
}

#: Licenses that have all the words of another one and more.
EXTENDED = {
    "BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"),
    "BSD-3-Clause": ("BSD-4-Clause",),
    "ISC": ("HPND",),
}
EXTENDING = frozenset(name for names in EXTENDED.values() for name in names)


def increasing(values: Sequence[int]) -> list[int]:
    """Positions of a longest increasing subsequence: each value goes on the first pile whose top is not smaller."""
    tops: list[int] = []
    piles: list[int] = []
    under = [-1] * len(values)
    for k, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile:
            under[k] = piles[pile - 1]
        tops[pile : pile + 1] = [value]
        piles[pile : pile + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = under[k]
    return out[::-1]


def common(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence, one row of the table at a time as bits of one integer."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    mask = (1 << len(a)) - 1
    row = mask
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def aligned(text: Sequence[int], template: Sequence[int]) -> tuple[int, int, int]:
    """Aligned words, first and last aligned position of ``text`` (-1 if none); words are numbers."""
    total, first, last = 0, -1, -1
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        if a >= a_end or b >= b_end:
            continue
        once_text, once_template = Counter(text[a:a_end]), Counter(template[b:b_end])
        where = {text[k]: k for k in range(a, a_end) if once_text[text[k]] == 1}
        shared = [k for k in range(b, b_end) if once_template[template[k]] == 1 and template[k] in where]
        chain = increasing([where[template[k]] for k in shared])
        if not chain:
            if found := common(template[b:b_end], text[a:a_end]):
                # the ends of the aligned words are no farther out than the gap's outermost words of the template
                inside = [k for k in range(a, a_end) if once_template[text[k]]]
                total += found
                first = inside[0] if first < 0 else min(first, inside[0])
                last = max(last, inside[-1])
            continue
        anchors = [(where[template[shared[k]]], shared[k]) for k in chain]
        total += len(anchors)
        first = anchors[0][0] if first < 0 else min(first, anchors[0][0])
        last = max(last, anchors[-1][0])
        ends = [(a - 1, b - 1), *anchors, (a_end, b_end)]
        gaps += [(x + 1, nx, y + 1, ny) for (x, y), (nx, ny) in zip(ends, ends[1:], strict=False)]
    return total, first, last


def growth(places: dict[int, int], size: int, text: Sequence[int]) -> list[int]:
    """Length of the longest common subsequence of a template and each beginning of ``text``.

    ``places``: the bits of the positions that each word has in the template of ``size`` words.
    """
    mask = (1 << size) - 1
    row, out = mask, []
    for x in text:
        if hit := row & places.get(x, 0):
            row = (row + hit | row - hit) & mask
        out.append(size - row.bit_count())
    return out


def chosen(between: Sequence[str]) -> bool:
    """Whether a version number behind these words is the first one, or a further one to choose from (2 or version 3)."""
    numbers = [k for k, w in enumerate(between) if w.isdigit()]
    rest = between[numbers[-1] + 1 :] if numbers else []
    return not numbers or (bool(rest) and rest[0] in ("or", "and") and all(w in ("version", "v") for w in rest[1:]))


def tells(telling: Sequence[str], words: Sequence[str], leads: Sequence[bool]) -> bool:
    """Whether ``telling`` stands in ``words`` with nothing between that makes it another license.

    ``leads``: which words are the first of a line but the first one.
    """
    for k, word in enumerate(words):
        if word != telling[0]:
            continue
        for last, want in zip(telling, telling[1:], strict=False):
            begin = k + 1
            k = next((j for j in range(begin, len(words)) if words[j] == want), -1)
            if k < 0:
                return False
            end = k
            while end > begin and leads[end - 1]:
                end -= 1
            between = words[begin:end]
            if any(w in RIVALS.get(last, ()) for w in between) or want.isdigit() and not chosen(between):
                break
        else:
            return True
    return False


class Template:
    def __init__(self, name: str, text: str, words: list[int], min_coverage: float):
        self.name, self.words, self.size = name, words, len(words)
        self.least = max(1, int(np.ceil(min_coverage * len(words) - 1e-9)))
        self.telling = [t.split() for t in TELLING.get(name, ())] if TEMPLATES.get(name) == text else []
        self.bag = Counter(words)
        self.places: dict[int, int] = {}
        self.mirrored: dict[int, int] = {}
        for k, x in enumerate(words):
            self.places[x] = self.places.get(x, 0) | 1 << k
            self.mirrored[x] = self.mirrored.get(x, 0) | 1 << (self.size - 1 - k)

    def told(self, words: Sequence[str], leads: Sequence[bool], found: int) -> bool:
        """Whether an aligned part of a text with ``found`` aligned words is this license and no sibling."""
        if self.size < LONG:
            foreign = max(0, len(words) - found - sum(leads))
            if found < MIN_DENSITY * (self.size + foreign):
                return False
        return not self.telling or any(tells(t, words, leads) for t in self.telling)


class Scanner:
    """Templates as numbers of words; word 0 is one that no template has."""

    def __init__(self, templates: tuple[tuple[str, str], ...], min_coverage: float):
        self.numbers: dict[str, int] = {}
        self.templates: list[Template] = []
        self.min_coverage = min_coverage
        for name, text in templates:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in WORD.findall(text.lower())]
            if words:
                self.templates.append(Template(name, text, words, min_coverage))
        self.has = np.zeros((len(self.templates), len(self.numbers) + 1), np.int32)
        for k, t in enumerate(self.templates):
            self.has[k, t.words] = 1

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, aligned words, first and last word of the text), the best place of each found template."""
        words = WORD.findall(text.lower()) if text else []
        numbers = np.fromiter((self.numbers.get(w, 0) for w in words), np.int32, len(words))
        if not numbers.any():
            return []
        present = set(words)
        leads = None
        #: places (aligned words, first, last) of each found template, those that extend another one before it
        places: dict[str, list[tuple[int, int, int]]] = {}
        out = []
        for k, template in sorted(enumerate(self.templates), key=lambda x: -x[1].size):
            if template.telling and not any(present.issuperset(t) for t in template.telling):
                continue
            hidden = [p for name in EXTENDED.get(template.name, ()) for p in places.get(name, ())]
            found: list[tuple[int, int, int]] = []
            for start, end in self.windows(k, numbers):
                if leads is None:
                    leads = leading(text)
                place = self.place(template, numbers[start:end].tolist(), words[start:end], leads[start:end])
                if place is None:
                    continue
                place = (place[0], start + place[1], start + place[2])
                if any(place[1] <= last and first <= place[2] for _, first, last in hidden):
                    continue
                found.append(place)
                if place[0] == template.size == place[2] - place[1] + 1 and template.name not in EXTENDING:
                    break
            if found:
                found.sort(key=lambda p: (-p[0], p[2] - p[1], p[1]))
                out.append((template, *found[0]))
                if template.name in EXTENDING:
                    apart = places.setdefault(template.name, [])
                    for p in found:
                        if all(p[2] < first or last < p[1] for _, first, last in apart):
                            apart.append(p)
        out.sort(key=lambda x: (-x[1] / x[0].size, -x[0].size, x[0].name))
        return [(t.name, found / t.size, found, first, last) for t, found, first, last in out]

    def windows(self, k: int, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """First word and end of the windows that have enough words of a template, counted as often as it has them."""
        template = self.templates[k]
        step = 1 if template.size < LONG else template.size // 4
        starts = np.arange(0, len(numbers), step)
        ends = np.minimum(starts + SPAN * template.size + step, len(numbers))
        seen = np.concatenate([[0], np.cumsum(self.has[k][numbers])])
        for i in np.flatnonzero(seen[ends] - seen[starts] >= template.least).tolist():
            start, end = int(starts[i]), int(ends[i])
            if (Counter(numbers[start:end].tolist()) & template.bag).total() >= template.least:
                yield start, end

    @staticmethod
    def place(
        template: Template, numbers: list[int], words: list[str], leads: list[bool]
    ) -> tuple[int, int, int] | None:
        """Aligned words, first and last word of the template's place in a window."""
        grown = growth(template.places, template.size, numbers)
        for most in range(grown[-1], template.least - 1, -1):
            end = bisect_left(grown, most) + 1
            back = growth(template.mirrored, template.size, numbers[:end][::-1])
            begin = end - 1 - bisect_left(back, most)
            found, first, last = aligned(numbers[begin:end], template.words)
            if found < template.least:
                continue
            first, last = begin + first, begin + last
            if template.told(words[first : last + 1], [False, *leads[first + 1 : last + 1]], found):
                return found, first, last
        return None


def leading(text: str) -> list[bool]:
    """Of each word, whether it is the first of its line."""
    out: list[bool] = []
    # lower-casing first, as the words are counted in lower-cased text
    for line in text.lower().split("\n"):
        n = len(WORD.findall(line))
        out += [k == 0 for k in range(n)]
    return out


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...], min_coverage: float) -> Scanner:
    return Scanner(templates, min_coverage)


FOUND = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("n_aligned", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
    ]
)


def licenses(text: Column, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> Column:
    """Array of the found licenses of a text column, best first. ``templates``: name -> text, a list of bounded size."""
    known = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    kind = pa.list_(pa.struct([pa.field(f.name, k) for f, k in zip(FOUND, kinds, strict=True)]))

    @F.arrow_udf(T.ArrayType(FOUND))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(known, min_coverage).scan
        names = FOUND.names
        for texts in batches:
            yield pa.array([[dict(zip(names, f, strict=True)) for f in scan(t)] for t in texts.to_pylist()], kind)

    return run(text)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, license (null: none), coverage, first_word, last_word, found (all of them)."""
    best = F.get("found", F.lit(0))
    return docs.select("doc_id", licenses(F.col("text"), templates, min_coverage).alias("found")).select(
        "doc_id",
        best["license"].alias("license"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        best["first_word"].alias("first_word"),
        best["last_word"].alias("last_word"),
        "found",
    )
