"""License texts found by patience alignment.

A template and a stretch of a document are aligned on words that are unique in both; of those anchors the longest
increasing run stays, and the gaps between anchors are aligned the same way. Coverage is the share of the template's
words that are aligned. Words that tell a license from its relatives must be among them, and words of a relative must
not stand in between.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from foldwright.llm.common import per_row, read

#: Openings or whole texts of public licenses and the usual one-line notices, by SPDX name.
TEMPLATES = {
    "CC0-1.0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under "
        "CC0 1.0 Universal.",
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
        "or non-commercial, and by any means.",
    ],
}

#: Families whose licenses share their words, with versions and with the terms of Creative Commons.
GNU = {"GPL": ("General", ("2.0", "3.0")), "LGPL": ("Lesser General", ("2.1", "3.0")), "AGPL": ("Affero General", ("3.0",))}
TERMS = {"NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
COMMONS = ((), ("NC",), ("SA",), ("ND",), ("NC", "SA"), ("NC", "ND"))
#: When versions of these came out, as their full texts begin.
DATES = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
#: Words that must be aligned where a template of that license has them.
NEEDED = {
    "CC0-1.0": ("cc0",), "Apache-2.0": ("apache", "2"), "MIT": ("mit",), "MPL-2.0": ("mozilla", "2"), "Unlicense": ("unencumbered",), "BSD-3-Clause": ("neither", "endorse"),
}

for _kind, (_title, _versions) in GNU.items():
    for _version in _versions:
        _number = _version.removesuffix(".0")
        _notice = f"This work is licensed under the GNU {_title} Public License, version {_number}"
        _program = (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_title} Public License as "
            "published by the Free Software Foundation,"
        )
        _whole = (
            f"GNU {_title} Public License Version {_number}, {DATES[f'{_kind}-{_version}']} Copyright (C) Free Software Foundation, Inc. "
            "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
        )
        TEMPLATES[f"{_kind}-{_version}-only"] = [f"{_notice}.", f"{_program} version {_number} of the License.", _whole]
        TEMPLATES[f"{_kind}-{_version}-or-later"] = [
            f"{_notice} or any later version.",
            f"{_program} either version {_number} of the License, or (at your option) any later version.",
        ]
        NEEDED[f"{_kind}-{_version}-only"] = (*_title.lower().split(), _number)
        NEEDED[f"{_kind}-{_version}-or-later"] = (*_title.lower().split(), _number, "later")
#: Words that must not stand in the stretch that is aligned; the Lesser license calls what it covers a library.
BARRED = {name: {"lesser", "affero"} - set(NEEDED[name]) for name in NEEDED if name.split("-")[0] in GNU}
for _name in BARRED:
    if not _name.startswith("LGPL"):
        BARRED[_name].add("library")
#: Words that must not stand among the BEHIND words after the stretch.
BEHIND, BARRED_BEHIND = 8, {name: {"later"} for name in BARRED if name.endswith("-only")}
for _terms in COMMONS:
    _name = "-".join(("CC-BY", *_terms, "4.0"))
    TEMPLATES[_name] = [
        f"Licensed under CC {'-'.join(('BY', *_terms))} 4.0.",
        f"This work is licensed under a Creative Commons {'-'.join(('Attribution', *(TERMS[t] for t in _terms)))} 4.0 International License.",
    ]
    _all = {x.lower() for t in TERMS.items() for x in t}
    _own = {x.lower() for t in _terms for x in (t, TERMS[t])}
    NEEDED[_name] = (*sorted(_own), "by", "attribution", "4")
    BARRED[_name] = _all - _own

#: The machine-readable notice of each license, all of whose words must be there.
TAGS = {name: f"SPDX-License-Identifier: {name}" for name in TEMPLATES}

#: Coverage from which a template counts as found.
COVERAGE = 0.8

_WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places: code points, end exclusive. A number's last ".0" doesn't count."""
    return [(m.group().lower().removesuffix(".0"), *m.span()) for m in _WORD.finditer(text)]


def _unique(items: list[str], low: int, high: int) -> dict[str, int]:
    """Words that occur once in ``items[low:high]``, and where."""
    once: dict[str, int] = {}
    for i in range(low, high):
        once[items[i]] = -1 if items[i] in once else i
    return {w: i for w, i in once.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, whose second increases: patience sorting with back links."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        tops[at : at + 1] = [b]
        piles[at : at + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions of two word lists, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = _unique(left, a, b), _unique(right, c, d)
        anchors = _increasing(sorted((i, theirs[w]) for w, i in ours.items() if w in theirs))
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if p + 1 < q and r + 1 < s]
    return sorted(found)


class Template(NamedTuple):
    """A template's words, how often it has each, the places that must be aligned, and words barred between and behind them."""

    name: str
    number: int
    items: list[str]
    counts: dict[str, int]
    needed: frozenset[int]
    barred: frozenset[str]
    behind: frozenset[str]


class Known(NamedTuple):
    templates: list[Template]
    vocabulary: frozenset[str]


def prepared() -> Known:
    out = []
    for name, texts in TEMPLATES.items():
        for k, text in enumerate([*texts, TAGS[name]]):
            items = [w for w, _, _ in words(text)]
            needed = frozenset(p for p, w in enumerate(items) if k == len(texts) or w in NEEDED.get(name, ()))
            barred = (frozenset(x.get(name, ())) for x in (BARRED, BARRED_BEHIND))
            out.append(Template(name, k, items, {w: items.count(w) for w in items}, needed, *barred))
    return Known(out, frozenset(w for t in out for w in t.items))


def _least(template: list[str], share: float) -> int:
    """How many of a template's words ``share`` asks for."""
    return ceil(share * len(template) - 1e-9)


def _stretches(items: list[str], places: dict[str, list[int]], template: list[str], share: float) -> list[tuple[int, int]]:
    """Where in a document a template may lie: around the places of its rarest word there, as far as it is long.

    Each place gives a stretch of the template's length, in which a copy among others stands alone, and one with room for
    added words. A template covered to ``share`` holds at least one of any of its words that make up more than the rest; so the
    rarest words up to that number are tried, each place of theirs once.
    """
    missing = len(template) - _least(template, share)
    rare = sorted(set(template), key=lambda w: (len(places.get(w, ())), w))
    held, out = 0, set()
    slack = len(template) // 4 + 2
    for w in rare:
        for p in (p for p, x in enumerate(template) if x == w):
            for room in (0, slack):
                out |= {(max(0, i - p - room), min(len(items), i - p + len(template) + room)) for i in places.get(w, ())}
        held += template.count(w)
        if held > missing:
            break
    return sorted(out)


def _apart(hits: list[tuple]) -> list[tuple]:
    """Of hits that overlap, the one with more aligned words, of equal ones the shorter; in text order."""
    starts: list[int] = []
    chosen: list[tuple] = []
    for hit in sorted(hits, key=lambda h: (-h[0], -h[3], h[5] - h[4], h[4], h[1], h[2])):
        at = bisect_left(starts, hit[4])  # those chosen lie apart, so only the two neighbours can touch it
        if (at == 0 or chosen[at - 1][5] <= hit[4]) and (at == len(starts) or hit[5] <= starts[at]):
            starts.insert(at, hit[4])
            chosen.insert(at, hit)
    return chosen


def find(text: str, known: Known, share: float = COVERAGE) -> list[tuple[str, int, float, int, int]]:
    """``(license, template, coverage, start, stop)`` of what a whole text holds, in text order.

    Repeated notices are found each. Of templates whose stretches overlap, the one with more aligned words stays,
    of equal ones the shorter stretch.
    """
    read_words = words(text)
    items = [w for w, _, _ in read_words]
    places: dict[str, list[int]] = {}
    for i, w in enumerate(items):
        if w in known.vocabulary:
            places.setdefault(w, []).append(i)
    hits = []
    for name, k, template, counts, needed, barred, behind in known.templates:
        least = _least(template, share)
        if sum(n for w, n in counts.items() if w in places) < least or not all(template[p] in places for p in needed):
            continue
        for a, b in _stretches(items, places, template, share):
            pairs = align(items[a:b], template)
            # Far words may be anchors too: the run of pairs that lies within twice the template's length and is longest.
            low, best = 0, (0, 0, 0)
            for high in range(len(pairs)):
                while pairs[high][0] - pairs[low][0] > 2 * len(template):
                    low += 1
                best = max(best, (high - low + 1, -low, high))
            n, low, high = best[0], -best[1], best[2]
            if n < least or not needed <= {q for _, q in pairs[low : high + 1]}:
                continue
            first, last = a + pairs[low][0], a + pairs[high][0]
            if barred.isdisjoint(items[first : last + 1]) and behind.isdisjoint(items[last + 1 : last + 1 + BEHIND]):
                hits.append((n, name, k, n / len(template), read_words[first][1], read_words[last][2]))
    return [h[1:] for h in _apart(hits)]


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", share: float = COVERAGE) -> DataFrame:
    """The columns ``keep`` and ``found``, an array of ``(license, template, coverage, start, stop)`` in text order.

    Every row's whole text is read, in one pass without a shuffle. Null and empty texts have an empty array; rows with a
    null id are kept; repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    known = prepared()
    kind = "array<struct<license: string, template: int, coverage: double, start: bigint, stop: bigint>>"
    names = ("license", "template", "coverage", "start", "stop")
    return per_row(docs, text_col, list(keep), f"found {kind}", lambda text: ([dict(zip(names, x)) for x in find(text, known, share)],))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents"))
    return rows.selectExpr(
        "doc_id",
        "array_join(array_distinct(transform(found, x -> x.license)), ',') as licenses",
        "cast(size(found) as bigint) as n_found",
        "coalesce(array_max(transform(found, x -> x.coverage)), 0D) as coverage",
        "array_join(transform(found, x -> concat_ws(':', x.license, x.start, x.stop)), ',') as spans",
    )
