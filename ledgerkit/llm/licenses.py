"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are sequences of words (letters and digits, lower case). Hashes of ``GRAM`` words are
winnowed: of every ``SPAN`` consecutive ones the smallest stays, so a run of ``GRAM`` + ``SPAN`` - 1 equal words
always shares a fingerprint. An inverted index over the templates' fingerprints gives, for each text, hits
on diagonals (place in the text minus place in the template). Hits of a template on near diagonals
form a candidate region; there, an alignment of words restricted to a band around the diagonals counts
the template's matched words. Every candidate is aligned.

A match reports the template, its ``coverage`` (matched words over the template's words), and the
character span of the text from the first to the last matched word. Matches under ``MIN_COVERAGE`` of a
template are not licenses. Templates of fewer than ``STRICT`` words differ by a word or two, so all their
words must follow each other as they do in the template (sentences of it may be apart), and the last one
must not go on (``MIT-0`` is not ``MIT``). In the notices of ``TELLING`` the words that name the license must
follow each other. Where matches of different templates overlap, only the one with the most matched
words stays, at a tie the one with the higher coverage.

Long templates (whole license texts) are indexed and aligned in parts of about ``PART`` words, ``LONG_PART`` for
texts of ``LONG`` words. Found parts of a template that follow each other in its order are one match, whose
coverage counts the words of the whole template; so a cut text is found by the parts it still has, with the
coverage that is left, as long as one part reaches ``MIN_COVERAGE`` of its own words. A part of which less
remains (at the cut) adds nothing to coverage and span.

The templates are a parameter: a list of (name, text) that is sent to the tasks, so it must be small
(``MAX_TEMPLATE_CHARS`` in all; more raises an error). Defined results: a null or empty text and an empty
template match nothing; templates with fewer words than a gram use their whole word sequence as one
gram; the same license twice in one text gives two matches, matches of one template never overlap; equal
templates are each reported; repeated documents are reported each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

GRAM, SPAN = 3, 4
BAND = 12  # words that may be added or lost on the way
MIN_COVERAGE = 0.6
STRICT = 10
PART, LONG_PART, LONG = 40, 120, 400
MAX_TEMPLATE_CHARS = 4_000_000

# The opening lines by which the licenses ask to be recognised, short notices, and the
# whole texts of ``license_texts`` (named ``…-text``; without their appendices, which hold the notices).
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("Apache-2.0-short", "Licensed under the Apache License, Version 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY", "Creative Commons Attribution License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work"),
    ("SPDX-MIT", "SPDX-License-Identifier: MIT"),
    ("SPDX-Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT-short", "Released under the MIT License"),
    ("GPL-3.0-short", "licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0-short", "Licensed under CC BY-NC 4.0"),
    ("All-rights-reserved", "Copyright. All rights reserved."),
    *[(f.name.removesuffix(".txt") + "-text", f.read_text("utf-8"))
      for f in sorted((files(__package__) / "license_texts").iterdir(), key=lambda f: f.name)],
]
# Words by which a notice differs from those of other licenses.
TELLING = {
    "Apache-2.0": "apache license version 2 0", "GPL": "gnu general public license",
    "MPL-2.0": "mozilla public license v 2 0", "CC-BY-4.0": "creative commons attribution 4 0",
}
_GOES_ON = re.compile(r"-\w|\.\d")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], size: int) -> list[int]:
    """Hashes of all runs of ``size`` words."""
    return [zlib.crc32(" ".join(words[i:i + size]).encode()) for i in range(len(words) - size + 1)]


def winnow(hashes: list[int], span: int = SPAN) -> list[int]:
    """Places of the smallest hash, the last at a tie, of every ``span`` consecutive ones."""
    out, last = [], -1
    for i in range(max(1, len(hashes) - span + 1) if hashes else 0):
        window = hashes[i:i + span]
        low = min(window)
        at = i + len(window) - 1 - window[::-1].index(low)
        if at != last:
            out.append(at)
            last = at
    return out


class Index:
    """Inverted index from fingerprint to (template, place)."""

    def __init__(self, templates: list[tuple[str, str]]):
        if sum(len(t) for _, t in templates) > MAX_TEMPLATE_CHARS:
            raise ValueError("too many templates to send to every task")
        self.names = [n for n, _ in templates]
        self.words = [words_of(t or "") for _, t in templates]
        # Per template the runs of its words, as places, that must be found side by side.
        self.runs: list[list[range]] = []
        for (name, text), words in zip(templates, self.words, strict=True):
            runs, telling = [], TELLING.get(name, "").split()
            if len(words) < STRICT:
                at = 0
                for sentence in re.split(r"\.\s", text or ""):
                    size = len(words_of(sentence))
                    runs.append(range(at, at + size))
                    at += size
            elif telling:
                runs = [range(i, i + len(telling)) for i in range(len(words)) if words[i:i + len(telling)] == telling][:1]
            self.runs.append(runs)
        # Parts: (template, first word) and the words; most templates are one part.
        self.parts: list[tuple[int, int, list[str]]] = []
        for number, words in enumerate(self.words):
            n = max(1, round(len(words) / (LONG_PART if len(words) >= LONG else PART)))
            cuts = [i * len(words) // n for i in range(n + 1)]
            self.parts += [(number, a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.vocabulary = {w for words in self.words for w in words}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, list[int]] = defaultdict(list)
        for number, (_, _, words) in enumerate(self.parts):
            if len(words) >= GRAM + SPAN - 1:
                hashes = grams(words, GRAM)
                for at in winnow(hashes):
                    self.places[hashes[at]].append((number, at))
            elif words:  # too short to be sure of a shared fingerprint: every gram is one
                size = min(GRAM, len(words))
                self.short[size].append(number)
                for at, value in enumerate(grams(words, size)):
                    self.places[value].append((number, at))

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        known = [w in self.vocabulary for w in words]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        sizes = {GRAM, *self.short}
        # Fingerprints consist of template words, so only runs of those can carry one. All their
        # grams are looked up: a superset of the text's own winnowed ones, found without windows.
        at = 0
        while at < len(words):
            if not known[at]:
                at += 1
                continue
            end = at
            while end < len(words) and known[end]:
                end += 1
            for size in sizes:
                if end - at >= size:
                    for i, value in enumerate(grams(words[at:end], size), at):
                        for number, place in self.places.get(value, ()):
                            hits[number].append((i - place, i))
            at = end
        aligned: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for part in sorted(hits):
            number, _, template = self.parts[part]
            found = []
            for low, high in self._regions(hits[part], len(template)):
                if len(template) < STRICT:
                    found += self._exact(number, words, low, high)
                elif self._may_reach(template, words, low, high):
                    found.append(align(template, words, low, high))
            best: list[list[int]] = []
            for places in sorted(p for p in found if self._counts(number, template, p, words, spans, text)):
                if best and places[0] <= best[-1][-1]:  # bands may meet the same words twice
                    best[-1] = max(best[-1], places, key=len)
                else:
                    best.append(places)
            aligned[number] += [(part, p) for p in best]
        out = [(number, places) for number, found in aligned.items() for places in self._chains(found)]
        return [{"template": self.names[number], "coverage": len(p) / len(self.words[number]),
                 "start": spans[p[0]][0], "end": spans[p[-1]][1]} for number, p in self._best(out)]

    @staticmethod
    def _may_reach(template: list[str], words: list[str], low: int, high: int) -> bool:
        """Whether the region holds enough of the template's words in any order."""
        there = Counter(words[max(0, low - BAND):high + BAND + len(template)])
        return sum(min(n, there[w]) for w, n in Counter(template).items()) >= MIN_COVERAGE * len(template)

    def _chains(self, found: list[tuple[int, list[int]]]) -> Iterator[list[int]]:
        """Matched places of runs of parts in the template's order; what lies between may be lost or changed."""
        places: list[int] = []
        last = -1
        for part, mine in sorted(found, key=lambda f: (f[1], f[0])):
            missing = self.parts[part][1] - self.parts[last][1] - len(self.parts[last][2]) if places else 0
            if places and part > last and mine[0] - places[-1] <= missing + 2 * BAND + len(self.parts[last][2]):
                places += [p for p in mine if p > places[-1]]
            else:
                if places:
                    yield places
                places = list(mine)
            last = part
        if places:
            yield places

    def _exact(self, number: int, words: list[str], low: int, high: int) -> Iterator[list[int]]:
        """Places of all words of a short template, sentence by sentence."""
        template = self.words[number]
        for first in range(max(0, low - BAND), high + BAND + 1):
            places: list[int] = []
            for run in filter(len, self.runs[number]):
                wanted = template[run[0]:run[-1] + 1]
                tries = range(places[-1] + 1, places[-1] + BAND + 2) if places else (first,)
                at = next((i for i in tries if words[i:i + len(wanted)] == wanted), None)
                if at is None:
                    break
                places += range(at, at + len(wanted))
            if len(places) == len(template):
                yield places

    def _counts(self, number: int, template: list[str], places: list[int], words: list[str],
                spans: list[tuple[int, int]], text: str) -> bool:
        """Whether the matched words are enough, and those that tell the template apart side by side."""
        if len(template) < STRICT:
            return not _GOES_ON.match(text, spans[places[-1]][1])
        if len(places) < MIN_COVERAGE * len(template):
            return False
        for run in self.runs[number]:
            wanted = template[run[0]:run[-1] + 1]
            if not any(words[i:i + len(wanted)] == wanted for i in range(places[0], places[-1] + 1)):
                return False
        return True

    def _best(self, found: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
        """Of overlapping matches the best one; equal templates are each kept."""
        kept: list[tuple[int, list[int]]] = []
        for number, places in sorted(found, key=lambda f: (-len(f[1]), len(self.words[f[0]]), f[1], f[0])):
            if all(places[0] > p[-1] or places[-1] < p[0] or places == p and self.words[number] == self.words[n]
                   for n, p in kept):
                kept.append((number, places))
        return sorted(kept, key=lambda f: (f[0], f[1]))

    @staticmethod
    def _regions(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        """Smallest and largest diagonal of each group of near hits."""
        out: list[list[int]] = []
        for diagonal, _ in sorted(hits):
            if out and diagonal - out[-1][1] <= BAND and diagonal - out[-1][0] <= max(BAND, size):
                out[-1][1] = diagonal
            else:
                out.append([diagonal, diagonal])
        return [(a, b) for a, b in out]


def align(template: list[str], words: list[str], low: int, high: int) -> list[int]:
    """Places in ``words`` matched by the longest common subsequence within the band of diagonals."""
    left, right = low - BAND, high + BAND
    width = right - left + 1
    previous = [0] * (width + 1)
    rows = []
    for i, word in enumerate(template):
        row = [0] * (width + 1)
        best = 0
        for d in range(width):  # words[i + left + d] against template[i]
            j = i + left + d
            up = previous[d + 1] if d + 1 <= width else 0  # template word left out: diagonal + 1
            best = max(best, up)
            if 0 <= j < len(words) and words[j] == word:
                best = max(best, previous[d] + 1)
            row[d] = best
        row[width] = best
        rows.append(row)
        previous = row
    found = []
    i, d = len(template) - 1, width - 1
    while i >= 0 and d >= 0:
        value = rows[i][d]
        if value == 0:
            break
        above = rows[i - 1] if i else [0] * (width + 1)
        j = i + left + d
        if d and rows[i][d - 1] == value:
            d -= 1
        elif 0 <= j < len(words) and words[j] == template[i] and above[d] + 1 == value:
            found.append(j)
            i -= 1
        else:
            i, d = i - 1, min(d + 1, width - 1)
    # The search prefers early places; a word moves up to its last occurrence before the next one.
    for k in range(1, len(found)):
        word = words[found[k]]
        found[k] = next(j for j in range(found[k - 1] - 1, -1, -1) if words[j] == word)
    return found[::-1]


_MATCH = T.ArrayType(T.StructType([
    T.StructField("template", T.StringType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per license found: id, template, coverage, start, end."""
    chosen = TEMPLATES if templates is None else templates
    Index(chosen)  # refuses too many templates here, not in a task
    held: list[Index] = []

    @arrow_udf(_MATCH)
    def find(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        if not held:
            held.append(Index(chosen))
        return pa.array([held[0].scan(t.as_py()) for t in texts], to_arrow_type(_MATCH))

    return docs.select(F.col(id_col), F.explode(find(F.col(text_col).cast("string"))).alias("_m")).select(id_col, "_m.*")
