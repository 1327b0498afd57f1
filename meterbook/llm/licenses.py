"""License scan: winnowed template fingerprints, then banded alignment, then rare words.

A match is the best local alignment of words that reaches ``coverage`` of a template.
Templates are cut into overlapping groups of three words; of every four successive
groups the one of smallest hash goes into an inverted index. A document's groups that
are in the index give template, place and so a diagonal. Around each cluster of
diagonals a banded local alignment of words decides how much of the template is
there, and where. Of templates too short to be winnowed every pair of words is in the
index, and the band is as wide as a local alignment can leave its diagonal.

What is left is looked for by words, to show that nothing was lost: of any template
words one more than may miss, one is in every match, so the rarest serve. Where the words
around one of them hold enough of the template's, they are aligned without a band.
``found_by`` tells which of the two found a match.

Defined cases: a null or empty text has no match. Repeated documents each get their
own rows. Overlapping matches of different templates are all reported, but of the
``VARIANTS`` of one notice those with fewest differing words. Spans are code points of
the whole text, end exclusive.
"""

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_rows, prepare

GROUP, WINDOW, BAND = 3, 4, 12
COVERAGE = 0.75
#: Templates of up to so many words have every pair of words in the index.
SHORT = 12
#: Words taken last as rare ones; a matter of speed only.
_COMMON = set("a all an and any as at be by for from in is it not of on or that the this to under version with work you 0 1 2 3 4".split())
_WORD = re.compile(r"[^\W_]+")
#: Public notices, as their publishers word them.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software.""",
    "mit-line": "Released under the MIT License.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied.""",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "all-rights": "All rights reserved.",
    "lgpl-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version. This library is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
    "lgpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
    "lgpl-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    **{f"cc-{c.lower()}": f"Licensed under CC {c} 4.0." for c in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{
        f"cc-{c.lower()}-name": f"This work is licensed under a Creative Commons {name} 4.0 International License."
        for c, name in {
            "BY": "Attribution",
            "BY-SA": "Attribution-ShareAlike",
            "BY-ND": "Attribution-NoDerivatives",
            "BY-NC": "Attribution-NonCommercial",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
            "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
}
_CC = ("cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")
#: Templates that differ in the name of the license alone: of those that overlap, the closest holds.
VARIANTS = (
    ("gpl", "lgpl-2.1", "lgpl-3", "agpl"),
    ("gpl-line", "lgpl-line", "agpl-line"),
    _CC,
    tuple(f"{name}-name" for name in _CC),
)
_VARIANT = {name: group for group, names in enumerate(VARIANTS) for name in names}


def tokens(text: str) -> list[str]:
    """The words, each lowered by itself: lowering can lengthen a text and part its words."""
    return [word.lower() for word in _WORD.findall(text)]


def _hash(group: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest("\0".join(group))


def winnow(words: list[str]) -> set[int]:
    """Places of the groups kept: the last smallest of every window, and one at least.

    A group found more than once in the words names no place and is taken last.
    """
    hashes = [_hash(tuple(words[i : i + GROUP])) for i in range(max(0, len(words) - GROUP + 1))]
    if len(hashes) <= WINDOW:
        return {hashes.index(min(hashes))} if hashes else set()
    windows, often = range(len(hashes) - WINDOW + 1), Counter(hashes)
    return {min(range(i, i + WINDOW), key=lambda j: (often[hashes[j]] > 1, hashes[j], -j)) for i in windows}


class Index:
    """Inverted indexes from group of words to (template, place) and from rare word to templates."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.templates = {name: tokens(text) for name, text in (templates or TEMPLATES).items()}
        self.need = {name: max(1, math.ceil(coverage * len(words))) for name, words in self.templates.items()}
        self.groups: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        self.pairs: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        self.rare: dict[str, list[str]] = defaultdict(list)
        used = Counter(word for words in self.templates.values() for word in set(words))
        for name, words in self.templates.items():
            if len(words) > SHORT:
                for at in winnow(words):
                    self.groups[tuple(words[at : at + GROUP])].append((name, at))
            for at in range(len(words) - 1 if len(words) <= SHORT else 0):
                self.pairs[tuple(words[at : at + 2])].append((name, at))
            rarest = sorted(words, key=lambda w: (w in _COMMON, used[w], -len(w)))
            for word in set(rarest[: len(words) - self.need[name] + 1]):
                self.rare[word].append(name)
        self.first = {group[0] for group in [*self.groups, *self.pairs]}

    def anchors(self, words: list[str]) -> dict[str, list[tuple[int, int]]]:
        """By template: (place in the text, place in the template)."""
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        first, groups, pairs = self.first, self.groups, self.pairs
        for at in [i for i, w in enumerate(words) if w in first]:
            group = tuple(words[at : at + GROUP])
            for name, place in groups.get(group, ()):
                found[name].append((at, place))
            for name, place in pairs.get(group[:2], ()):
                found[name].append((at, place))
        return found

    def places(self, words: list[str]) -> dict[str, list[int]]:
        """By template: the places of its rare words."""
        found: dict[str, list[int]] = defaultdict(list)
        rare = self.rare
        for at, word in [(i, w) for i, w in enumerate(words) if w in rare]:
            for name in rare[word]:
                found[name].append(at)
        return found


def band(length: int) -> int:
    """How far a copy may leave its diagonal: less for short templates, which may follow each other."""
    return min(BAND, max(1, length // 3))


def clusters(anchors: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """(smallest diagonal, largest, last text place) of anchors that one copy could make."""
    low = high = last = None
    for at, place in sorted(anchors):
        diagonal = at - place
        if low is not None and at - last <= length and min(abs(diagonal - low), abs(diagonal - high)) <= band(length):
            low, high, last = min(low, diagonal), max(high, diagonal), at
            continue
        if low is not None:
            yield low, high, last
        low = high = diagonal
        last = at
    if low is not None:
        yield low, high, last


def align(text: list[str], template: list[str], low: int, high: int, need: int = 0) -> tuple[int, int, int] | None:
    """(matched words, first text word, one past the last) of the best local alignment.

    Cells whose diagonal lies between ``low`` and ``high`` only, ends with at least
    ``need`` matched words only. A match scores 2, a differing, missing or added word
    costs 1; ties prefer the earliest end.
    """
    width, size = high - low + 1, len(text)
    none = (0, 0, 0)
    row = [none] * (width + 2)  # (score, matched words, first text word) by diagonal
    best, out = 0, None
    for j, word in enumerate(template):
        new = [none] * (width + 2)
        for k in range(max(0, -j - low), min(width, size - j - low)):
            i = j + low + k
            hit = text[i] == word
            s, m, f = row[k + 1]
            f = f if s > 0 else i
            s, m = (s + 2, m + 1) if hit else (s - 1, m)
            missing, extra = row[k + 2], new[k]  # a template word is missing, a text word is extra
            if missing[0] - 1 > s:
                s, m, f = missing[0] - 1, missing[1], missing[2]
            if extra[0] - 1 > s:
                s, m, f = extra[0] - 1, extra[1], extra[2]
            if s <= 0:
                continue
            new[k + 1] = (s, m, f)
            if s > best and m >= need:
                best, out = s, (m, f, i + 1)
        row = new
    return out


def stretches(places: list[int], before: int, behind: int, size: int) -> Iterator[tuple[int, int]]:
    """The parts of a text so far before or behind one of the rising places."""
    start = end = None
    for at in places:
        if end is None or at - before > end:
            if end is not None:
                yield start, end
            start = max(0, at - before)
        end = min(size, at + behind + 1)
    if end is not None:
        yield start, end


def dense(text: list[str | None], template: list[str], need: int, start: int, end: int) -> list[int]:
    """Ends of the windows of three templates' length that hold ``need`` of its words."""
    wanted, inside = Counter(template), Counter()
    size, held, out = 3 * len(template), 0, []
    for i in range(start, end):
        if (word := text[i]) in wanted:
            inside[word] += 1
            held += inside[word] <= wanted[word]
        if i - size >= start and (word := text[i - size]) in wanted:
            held -= inside[word] <= wanted[word]
            inside[word] -= 1
        if held >= need:
            out.append(i)
    return out


def windowed(
    text: list[str | None], template: list[str], need: int, anchors: list[tuple[int, int]] | None, start: int, end: int
) -> tuple[int, int, int] | None:
    """``align`` of a window, around the diagonals of the anchors in it; places are those of the text."""
    low, high = -len(template), end - start
    if anchors is not None:
        inside = anchors[bisect_left(anchors, (start, 0)) : bisect_left(anchors, (end, 0))]
        if not inside:
            return None
        # A match scores 2 and all else costs 1, so no alignment leaves a diagonal by more.
        slack, diagonals = 2 * len(template), [at - start - place for at, place in inside]
        low, high = max(low, min(diagonals) - slack), min(high, max(diagonals) + slack)
    got = align(text[start:end], template, low, high, need)
    return got and (got[0], start + got[1], start + got[2])


def leader(
    text: list[str | None], template: list[str], need: int, anchors: list[tuple[int, int]] | None, start: int, end: int
) -> tuple[int, int, int] | None:
    """An alignment that is better than all that overlap it, near the start.

    No alignment is as long as three templates, so a window of six holds whatever
    overlaps one in its first half. One further behind is looked at with its surroundings.
    """
    reach = 3 * len(template)
    got = None
    for at in range(start, max(start + 1, end - reach), reach):
        stop = min(end, at + 2 * reach)
        if got := windowed(text, template, need, anchors, at, stop):
            break
    for _ in range(2 * len(template)):  # each step scores higher
        if got is None or (at <= max(start, got[1] - reach) and min(end, got[2] + reach) <= stop):
            return got
        at, stop = max(start, got[1] - reach), min(end, got[2] + reach)
        better = windowed(text, template, need, anchors, at, stop)
        if better is None or better == got:
            return got
        got = better
    return got


def aligned(
    text: list[str | None], template: list[str], need: int, places: list[int], anchors: list[tuple[int, int]] | None = None
) -> Iterator[tuple[int, int, int]]:
    """(matched words, first text word, one past the last) of alignments around the places.

    A match scores 2 and everything else costs 1, so no alignment is as long as three
    templates. Of overlapping alignments the best stays. With anchors, alignments are
    banded around them. The time is that of the text's length, whatever it repeats.
    """
    reach = 3 * len(template)
    for near in stretches(places, reach, reach, len(text)):
        parts = [(max(near[0], start), end) for start, end in stretches(dense(text, template, need, *near), reach, 0, near[1])]
        while parts:
            start, end = parts.pop()
            got = leader(text, template, need, anchors, start, end) if end - start >= need else None
            if got:
                yield got
                parts += [(got[2], end), (start, got[1])]


def closest(found: dict[str, set[tuple[int, int, int]]], index: Index) -> list[tuple[str, int, int, int]]:
    """(template, matched words, first word, end), without those a closer variant overlaps."""
    every = [(name, *got) for name, of in found.items() for got in of]
    if len(every) < 2:
        return every

    def differing(match: tuple[str, int, int, int]) -> int:
        name, matched, first, last = match
        return len(index.templates[name]) + last - first - 2 * matched

    rivals: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    kept = []
    for match in sorted(every, key=differing):
        name, _, first, last = match
        group, cost = _VARIANT.get(name), differing(match)
        if group is not None:
            if any(c < cost and start < last and first < end for c, start, end in rivals[group]):
                continue
            rivals[group].append((cost, first, last))
        kept.append(match)
    return kept


def traced(text: str | None, index: Index) -> list[tuple[str, int, int, int, int, str]]:
    """(template, start, end, matched words, template words, found by) in one text, by start."""
    if not text:
        return []
    words = tokens(text)
    found: dict[str, set[tuple[int, int, int]]] = defaultdict(set)
    for name, anchors in index.anchors(words).items():
        template, need = index.templates[name], index.need[name]
        if len(template) <= SHORT:
            found[name].update(aligned(words, template, need, [at for at, _ in anchors], anchors))
            continue
        for low, high, _ in clusters(anchors, len(template)):
            got = align(words, template, low - band(len(template)), high + band(len(template)), need)
            if got:
                found[name].add(got)
    indexed = {(name, *got) for name, of in found.items() for got in of}
    for name, places in index.places(words).items():
        left: list[str | None] = words
        if found[name]:
            left = list(words)
            for _, first, last in found[name]:
                left[first:last] = [None] * (last - first)
            places = [at for at in places if left[at] is not None]
        found[name].update(aligned(left, index.templates[name], index.need[name], places))
    if not any(found.values()):
        return []
    spans = [m.span() for m in _WORD.finditer(text)]  # the words of ``tokens``, one for one
    out = {
        (match[0], spans[match[2]][0], spans[match[3] - 1][1], match[1], len(index.templates[match[0]]),
         "index" if match in indexed else "words")
        for match in closest(found, index)
    }
    return sorted(out, key=lambda m: (m[1], m[0], m[2]))


def matches(text: str | None, index: Index) -> list[tuple[str, int, int, int, int]]:
    """``traced`` without what found the match."""
    return [match[:5] for match in traced(text, index)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, template, start, end, matched, words, found_by, coverage; one row per match.

    The templates are a fixed list; nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        index = Index(templates, coverage)
        for doc_id, text in rows:
            for match in traced(text, index):
                yield doc_id, *match

    schema = "doc_id long, template string, start int, end int, matched int, words int, found_by string"
    found = map_rows(columns(docs, doc_id="long", text="string"), work, schema)
    return found.withColumn("coverage", F.round(F.col("matched") / F.col("words"), 6))
