import itertools
import random
import re
import time

import pytest

from foldwright.llm import licenses

from .fixtures import EDGES, edge_table, empty_table, prose

KNOWN = licenses.prepared()


def test_longest_increasing_run_equals_brute_force():
    draw = random.Random(2)
    for _ in range(200):
        pairs = list(enumerate(draw.sample(range(20), draw.randrange(9))))
        got = licenses._increasing(pairs)
        best = max((len(c) for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n) if all(a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(a[1] < b[1] for a, b in zip(got, got[1:])) and set(got) <= set(pairs)


def test_alignment_is_in_order_and_equal():
    draw = random.Random(3)
    for _ in range(200):
        a, b = ([f"w{draw.randrange(8)}" for _ in range(draw.randrange(30))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert licenses.align(list("abcde"), list("abcde")) == [(i, i) for i in range(5)]
    assert licenses.align("x a b c y".split(), "p a q c r".split()) == [(1, 1), (3, 3)]


@pytest.mark.parametrize("name,k", [(n, k) for n, texts in licenses.TEMPLATES.items() for k in range(len(texts))])
def test_every_template_is_found_whole_and_edited(name, k):
    text = licenses.TEMPLATES[name][k]
    for edited in (text, text.upper(), re.sub(r"\s", "\n  ", text)):
        (got, number, coverage, start, stop), = licenses.find(f"{prose(1, 200)} {edited} {prose(2, 200)}", KNOWN)
        assert (got, number, coverage) == (name, k, 1.0)
        assert licenses.words(f"{prose(1, 200)} {edited} {prose(2, 200)}"[start:stop])[0][0] == licenses.words(text)[0][0]
    items = text.split()
    if len(items) > 20:
        needed = licenses.NEEDED.get(name, ())
        deciding = {i for i, w in enumerate(items) if any(x in needed for x, _, _ in licenses.words(w))}
        changed = " ".join("other" if i % 9 == 4 and i not in deciding else w for i, w in enumerate(items))
        assert [h[0] for h in licenses.find(f"{prose(1, 50)} {changed} {prose(2, 50)}", KNOWN)] == [name]
        for i in deciding:  # without a deciding word the name isn't given
            lost = " ".join("other" if j == i else w for j, w in enumerate(items))
            assert (name, k) not in [h[:2] for h in licenses.find(lost, KNOWN)]


@pytest.mark.parametrize(
    "text,names",
    [
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under CC BY 3.0.", []),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-only"]),
        ("This work is licensed under the GNU General Public License, version 3.0.", ["GPL-3.0-only"]),
        ("This work is licensed under the GNU General Public License, version 3 or later.", ["GPL-3.0-or-later"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1-only"]),
        ("This work is licensed under the GNU Library General Public License, version 2.", []),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0-only"]),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            ["AGPL-3.0-or-later"],
        ),
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
            "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            ["LGPL-2.1-or-later"],
        ),
        ("This work is licensed under the GNU General Public License, version 2, or at your option any later version.", ["GPL-2.0-or-later"]),
        ("// SPDX-License-Identifier: MIT\n", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: LGPL-2.1-only", ["LGPL-2.1-only"]),
        ("SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA-4.0"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: Proprietary", []),
        ("Released under CC0 1.0 Universal.", ["CC0-1.0"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n1. Definitions.", ["Apache-2.0"]),
        (
            "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
            "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble\n",
            ["GPL-3.0-only"],
        ),
        (
            "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright (C) 1991, 1999 Free Software Foundation, Inc.\n51 Franklin Street\n"
            "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
            ["LGPL-2.1-only"],
        ),
    ],
)
def test_relatives_get_their_own_name(text, names):
    for whole in (text, f"{prose(1, 20)} {text} {prose(2, 20)}", f"{text}\n{text}"):
        assert [h[0] for h in licenses.find(whole, KNOWN)] == names * (2 if whole.count(text) == 2 else 1)


def test_many_notices_are_found_in_linear_time():
    one = "Released under the MIT License."
    start = time.time()
    assert len(licenses.find("\n".join([one] * 20_000), KNOWN)) == 20_000
    assert time.time() - start < 30


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def brute_names(text):
    """The licenses whose template some window of the text covers, deciding words included, by plain subsequences."""
    items = [w for w, _, _ in licenses.words(text)]
    out = set()
    for t in KNOWN.templates:
        n, least = len(t.items), licenses._least(t.items, licenses.COVERAGE)
        for a in range(len(items)) if len(set(t.items) & set(items)) >= least * len(t.counts) / n - 1 else []:
            for b in range(a + least, min(len(items), a + n + 2) + 1):
                window = items[a:b]
                if sum(w in t.counts for w in window) >= least and t.barred.isdisjoint(window) and t.behind.isdisjoint(items[b : b + licenses.BEHIND]) and {t.items[p] for p in t.needed} <= set(window):
                    if common(window, t.items) >= least:
                        out.add(t.name)
    return out


def test_repeated_notices_are_found_each():
    one = "Released under the MIT License."
    assert [h[3] for h in licenses.find(f"{one}\n{one} {prose(1, 40)} {one}", KNOWN)] == [m.start() for m in re.finditer(one, f"{one}\n{one} {prose(1, 40)} {one}")]


@pytest.mark.parametrize("n", [3, 5])
@pytest.mark.parametrize("name,k", [(n, k) for n, texts in licenses.TEMPLATES.items() for k in range(len(texts))])
def test_adjacent_copies_are_found_each(name, k, n):
    one = licenses.TEMPLATES[name][k]
    for text in ("\n".join([one] * n), f"{prose(1, 30)} {' '.join([one] * n)} {prose(2, 30)}"):
        got = licenses.find(text, KNOWN)
        assert [(h[0], h[1], h[2]) for h in got] == [(name, k, 1.0)] * n
        first = text.index(one)
        starts = [first + j * (len(one) + 1) for j in range(n)]
        assert all(a <= h[3] < h[4] <= a + len(one) for a, h in zip(starts, got))


def test_a_notice_with_one_changed_word():
    for changed in ("Released under the MIT licence.", "Released under an MIT License.", "Published under the MIT License."):
        for n in (1, 3):
            got = licenses.find(f"{prose(1, 30)} {' '.join([changed] * n)} {prose(2, 30)}", KNOWN)
            assert [(h[0], h[2]) for h in got] == [("MIT", 0.8)] * n
    assert licenses.find("Released under the GNU licence.", KNOWN) == []


def test_prose_about_licenses_is_left_alone():
    assert licenses.find("The license of this work was granted under the terms of a public version of the software by the author.", KNOWN) == []


def test_edges(spark):
    got = licenses.scan(edge_table(spark)).collect()
    assert len(got) == len(EDGES) and all(r["found"] == [] for r in got)
    assert licenses.scan(empty_table(spark)).count() == 0


def test_query(spark, data):
    """Every license that some window covers is found, or lies under one with more words; nothing else is."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = licenses.op3_license_scans(spark, data).collect()
    assert len(rows) == len(texts) and any(r["licenses"] for r in rows)
    for r in rows:
        got = set(filter(None, r["licenses"].split(",")))
        text = texts[r["doc_id"]]
        covered = brute_names(text) if len(text) < 20_000 or got else set()
        assert got <= covered and bool(got) == bool(covered) and (r["n_found"] > 0) == bool(got)
        for name in covered - got:
            family = name.split("-")[0]
            assert any(g.split("-")[0] == family for g in got)
