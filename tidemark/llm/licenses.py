"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a template are anchors; the longest run of anchors in the same
order is kept (longest increasing subsequence), and the gaps between them are aligned the same way. Coverage is the
share of the template's words that are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

WORD = re.compile(r"\w+(?:[.-]\w+)*")

@dataclass(frozen=True)
class Notice:
    """A license's notice: words that must be aligned (they tell versions and kin apart), and words that must not stand
    in the stretch or, for `after` words, behind it."""

    name: str
    text: str
    need: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    after: int = 0


MIT_WORDS = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.')
BSD_WORDS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GNU_WORDS = "free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
KIN = ("lesser", "library", "affero")

# License notices, by SPDX name.
TEMPLATES: list[Notice] = [
    Notice("MIT", "Released under the MIT License.", need=("mit",)),
    Notice("MIT", "Licensed under the MIT License.", need=("mit",)),
    Notice("MIT", MIT_WORDS),
    Notice("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Notice("Apache-2.0", "Licensed under the Apache License, Version 2.0.", need=("apache", "2.0")),
    Notice("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', need=("apache",)),
    *[Notice(name, f"This work is licensed under the GNU {kind}, version {v}.", need=(v, *words), never=tuple(w for w in KIN if w not in words))
      for name, kind, v, words in (("GPL-3.0", GPL, "3", ()), ("GPL-2.0", GPL, "2", ()), ("LGPL-3.0", LGPL, "3", ("lesser",)), ("LGPL-2.1", LGPL, "2.1", ("lesser",)), ("AGPL-3.0", AGPL, "3", ("affero",)))],
    *[Notice(name, f"This {what} is " + GNU_WORDS.format(kind, v), need=(v, *words), never=tuple(w for w in KIN if w not in words))
      for name, what, kind, v, words in (("GPL-3.0", "program", GPL, "3", ()), ("GPL-2.0", "program", GPL, "2", ()), ("LGPL-3.0", "library", LGPL, "3", ("lesser",)), ("LGPL-2.1", "library", LGPL, "2.1", ("lesser",)), ("AGPL-3.0", "program", AGPL, "3", ("affero",)))],
    Notice("BSD-3-Clause", BSD_WORDS + BSD_NAMES, need=("endorse",)),
    Notice("BSD-2-Clause", BSD_WORDS, never=("endorse",), after=45),
    Notice("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", need=("mozilla", "2.0")),
    Notice("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", need=("eclipse", "2.0")),
    Notice("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", need=("unencumbered",)),
    Notice("CC-BY-4.0", "Licensed under CC BY 4.0.", need=("cc", "by", "4.0")),
    Notice("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", need=("cc", "by-nc", "4.0")),
    Notice("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", need=("cc", "by-sa", "4.0")),
    Notice("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", need=("attribution", "4.0")),
    Notice("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", need=("attribution-noncommercial", "4.0")),
    Notice("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", need=("attribution-sharealike", "4.0")),
    Notice("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Notice("all-rights-reserved", "All rights reserved."),
]
COVERAGE = 0.8
#: A notice of LONG words or more may have twice as many foreign words in between, a shorter one half as many.
LONG = 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of one longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned (position in a, position in b), in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = Counter(a[a0:a1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if once[w] == 1}
        twice = Counter(w for w in b[b0:b1] if w in place)
        anchors = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if twice.get(w) == 1]
        kept = [anchors[i] for i in increasing([x for x, _ in anchors])]
        if not kept:
            continue
        last_a, last_b = a0, b0
        for x, y in [*kept, (a1, b1)]:
            todo.append((last_a, x, last_b, y))
            if x < a1:
                found.append((x, y))
            last_a, last_b = x + 1, y + 1
    return sorted(found)


def triggers(templates: list[Notice]) -> str:
    """Pattern of words of which every notice holds one: of each template so many that a notice can't do without all,
    those with digits and the longest first."""
    chosen = set()
    for notice in templates:
        counts = Counter(words_of(notice.text))
        if notice.need:  # no notice is without these
            chosen.add(max(notice.need, key=lambda w: (len(w), w)))
            continue
        spare = (1 - COVERAGE) * sum(counts.values()) + 1e-9
        for w in sorted(counts, key=lambda w: (w.isalpha(), -len(w), w)):
            if spare < 0:
                break
            chosen.add(w)
            spare -= counts[w]
    return r"(?iu)\b(?:" + "|".join(re.escape(w) for w in sorted(chosen)) + r")\b"


def spans(template: list[str]) -> int:
    """Most words of a stretch."""
    return len(template) * 3 + 4 if len(template) >= LONG else len(template) * 3 // 2 + 4


def trimmed(pairs: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """Aligned words without those at the ends that stand further off than they are worth, as long as `least` are left."""
    first, last = 0, len(pairs) - 1
    while last - first >= least:
        head, tail = pairs[first + 1][0] - pairs[first][0], pairs[last][0] - pairs[last - 1][0]
        if max(head, tail) <= 3:
            break
        if head >= tail:
            first += 1
        else:
            last -= 1
    return pairs[first : last + 1]


class Templates:
    def __init__(self, templates: list[Notice]):
        self.all = [(t.name, words_of(t.text)) for t in templates]
        self.rules = templates
        self.sets = [frozenset(words) for _, words in self.all]
        self.of: dict[str, list[int]] = {}
        for i, words in enumerate(self.sets):
            for w in words:
                self.of.setdefault(w, []).append(i)

    def holds(self, words: list[str], start: int, pairs: list[tuple[int, int]], k: int) -> bool:
        """Whether an alignment covers enough, with the words that tell the notice from its kin."""
        template, rule = self.all[k][1], self.rules[k]
        if len(pairs) < COVERAGE * len(template):
            return False
        if rule.need and not {*rule.need} <= {template[j] for _, j in pairs}:
            return False
        stretch = words[start + pairs[0][0] : start + pairs[-1][0] + 1 + rule.after]
        return not rule.never or not any(w in rule.never for w in stretch)

    def aligned(self, words: list[str], start: int, end: int, k: int) -> list[tuple[int, int]] | None:
        """The notice in a stretch, or none: in its first words, where another notice behind can't hide anchors, else in
        the whole stretch. What is found is aligned once more with just the words that it may lack at its ends."""
        template = self.all[k][1]
        for size in (len(template) * 5 // 4 + 1, end - start):
            pairs = align(words[start : min(start + size, end)], template)
            if not pairs or len(pairs) < COVERAGE * len(template):
                continue
            for some in (trimmed(pairs, COVERAGE * len(template)), pairs):
                if self.holds(words, start, some, k):
                    first, last = some[0][0], some[-1][0] + 1
                    head, tail = some[0][1], len(template) - 1 - some[-1][1]
                    if head or tail:
                        at = max(0, first - head)
                        more = [(at + i, j) for i, j in align(words[start + at : min(start + last + tail, len(words))], template)]
                        if len(more) > len(some) and self.holds(words, start, more, k):
                            return more
                    return some
        return None

    def notices(self, positions: list[int], words: list[str], k: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
        """Alignments that cover enough of the template, with the word that each is counted from; the next one is
        looked for just behind the last word of the one before. A stretch begins with a word of the template, is not
        longer than spans(), and holds enough different words of it."""
        template = self.all[k][1]
        span, need = spans(template), len(self.sets[k]) - (1 - COVERAGE) * len(template) - 1e-9
        seen: Counter = Counter()
        lo = hi = 0
        while lo < len(positions):
            start = positions[lo]
            while hi < len(positions) and positions[hi] < start + span:
                seen[words[positions[hi]]] += 1
                hi += 1
            found = self.aligned(words, start, min(start + span, len(words)), k) if len(seen) >= need else None
            after = bisect_right(positions, start + found[-1][0]) if found else lo + 1
            if found:
                yield found, start
            for p in positions[lo:min(after, hi)]:
                w = words[p]
                seen[w] -= 1
                if not seen[w]:
                    del seen[w]
            lo, hi = after, max(hi, after)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, words) of the notices in a text; the best cover wins where they overlap."""
        words = words_of(text)
        positions: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for k in self.of.get(w, ()):
                positions.setdefault(k, []).append(i)
        found = []
        for k, at in positions.items():
            name, template = self.all[k]
            for pairs, start in self.notices(at, words, k):
                first, last = start + pairs[0][0], start + pairs[-1][0]
                found.append((len(pairs) / len(template), len(template), name, first, last - first + 1))
        out: list = []
        for cover, size, name, first, n in sorted(found, key=lambda x: (-x[0] * x[1], x[3], x[2])):
            if all(first + n <= f or f + m <= first for _, _, f, m in out):
                out.append((name, cover, first, n))
        return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: list[Notice | tuple[str, str]] | None = None) -> DataFrame:
    """One row per notice: doc_id, license, coverage, first_word, words.

    A name is given only if the words that tell it from its kin (versions, `lesser`, the clause on names) are aligned.
    Very long texts are scanned whole. Null, empty and notice-free texts have no row; repeated rows are scanned each; where notices overlap, the one that
    covers more template words wins, then the first; an empty table gives no rows; further columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    given = [t if isinstance(t, Notice) else Notice(*t) for t in templates or TEMPLATES]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(given)
        for f in frames:
            out = [(d, *hit) for d, t in zip(f["doc_id"], f["text"], strict=True) for hit in known.scan(t)]
            yield pd.DataFrame(out, columns=["doc_id", "license", "coverage", "first_word", "words"])

    rows = docs.select("doc_id", "text").where(F.col("text").rlike(triggers(given)))
    return rows.mapInPandas(run, "doc_id long, license string, coverage double, first_word int, words int")
