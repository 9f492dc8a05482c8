"""Notices by name: near twins, foreign words, notices one behind the other, and recall against brute force."""

import random

import pytest

from tidemark.llm import licenses
from tidemark.llm.decontaminate import common_subsequence

KNOWN = licenses.Templates(licenses.TEMPLATES)
DISCLAIMER = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'


def names(text):
    return [h[0] for h in KNOWN.scan(text)]


@pytest.mark.parametrize("notice", licenses.TEMPLATES, ids=lambda t: f"{t.name}-{len(t.text)}")
def test_each_notice_has_its_own_name(notice):
    assert names("Some words before. " + notice.text + " And words behind it.") == [notice.name]


GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
LGPL21 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."


def test_near_twins():
    assert names(GPL2) == ["GPL-2.0"] and names(GPL2.replace("version 2", "version 3")) == ["GPL-3.0"]
    assert names(LGPL21) == ["LGPL-2.1"] and names(LGPL21.replace("2.1", "3")) == ["LGPL-3.0"]
    assert names(GPL2.replace("General", "Affero General").replace("version 2", "version 3")) == ["AGPL-3.0"]
    assert names(licenses.BSD_WORDS + DISCLAIMER) == ["BSD-2-Clause"]
    assert names(licenses.BSD_WORDS + licenses.BSD_NAMES + DISCLAIMER) == ["BSD-3-Clause"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and names("Licensed under CC BY 4.0") == ["CC-BY-4.0"]


def test_foreign_words_and_repeats():
    words = licenses.MIT_WORDS.split()
    spread = " ".join(w + (" foreign words" if i % 2 else "") for i, w in enumerate(words))
    assert names(spread) == ["MIT"]
    short = "Released under the MIT License."
    assert names(" ".join([short] * 5)) == ["MIT"] * 5
    assert names(("x " * 3000 + short) * 3) == ["MIT"] * 3
    assert names("") == [] and names("a license of MIT was released, under which the") == []


def test_recall_against_brute_force():
    """Notices with words taken out and put in: whatever has enough of its template in order is found, by its name."""
    r = random.Random(8)
    tried = found = 0
    for _ in range(400):
        t = r.choice([x for x in licenses.TEMPLATES if len(x.text.split()) > 8])
        words = licenses.words_of(t.text)
        told = [w for w in words if w in t.need or r.random() > 0.1]
        for _ in range(r.randint(0, len(words) // 4)):
            told.insert(r.randrange(len(told)), r.choice(["and", "the", "foreign", "word", "x1"]))
        number = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
        share = common_subsequence([number[w] for w in words], [number.get(w, 0) for w in told]) / len(words)
        text = " ".join(["before"] * r.randint(0, 40) + told + ["behind"] * r.randint(0, 40))
        if share >= 0.84:  # beyond rounding at the edge
            tried += 1
            found += t.name in names(text)
    assert tried > 150 and found >= 0.95 * tried, (tried, found)
