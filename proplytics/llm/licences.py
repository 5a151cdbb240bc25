"""Licence notices in texts: Dice coefficient over word bigrams against licence templates.

A candidate is a window of words that begins and ends with a bigram of the template, wherever sentences or lines end. A template of b bigrams and a run of a can only reach a Dice coefficient of t if
t / (2 - t) <= a / b <= (2 - t) / t; these bounds, and the bigrams of a run that occur in any template, prune before sets are compared.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The wording of public licences and of their usual notices.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_GNU = (("AGPL-3.0", "Affero General", "3"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"))
_CC = (("CC-BY-4.0", "BY", "Attribution"), ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"),
       ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"), ("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. ")
#: Notice variants, standard file headers and the BSD conditions.
NOTICES = (
    *((n, f"licensed under the GNU {kind} Public License{form}") for n, kind, v in _GNU for form in (f", version {v}", f" v{v}.0" if "." not in v else f" v{v}")),
    *((n, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the "
          f"Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for n, kind, v in _GNU),
    *((n, f"licensed under CC {code} 4.0") for n, code, _ in _CC),
    *((n, f"licensed under a Creative Commons {words} 4.0 International License") for n, _, words in _CC),
    ("CC0-1.0", "released under CC0 1.0 Universal"),
    ("MIT", "under the MIT License"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("MPL-2.0", "licensed under the Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                            "this software without specific prior written permission."),
)

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    """Pairs of neighbouring words of a normalised text; a single word is a pair with nothing."""
    return set(zip(words, words[1:])) if len(words) != 1 else {(words[0], "")}


def normalised(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    """Finds the templates that runs of sentences come close to."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        sets = sorted(((name, bigrams(normalised(text))) for name, text in templates if normalised(text)), key=lambda x: (len(x[1]), x[0]))
        self.sets, self.least = sets, least
        self.sizes = [len(s) for _, s in sets]
        self.known = set().union(*(s for _, s in sets)) if sets else set()
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, pairs) in enumerate(sets):
            for pair in pairs:
                self.holders.setdefault(pair, []).append(k)
        self.longest = self.sizes[-1] * (2 - least) / least if sets else 0

    def near(self, run: set) -> tuple[float, str] | None:
        """(Dice, licence) of the closest template within the size bounds; ties go to the first name."""
        low = bisect_left(self.sizes, len(run) * self.least / (2 - self.least) - 1e-9)
        high = bisect_right(self.sizes, len(run) * (2 - self.least) / self.least + 1e-9)
        found = [(-dice(run, s), name) for name, s in self.sets[low:high]]
        best = min(found, default=(0.0, ""))
        return (-best[0], best[1]) if -best[0] >= self.least else None

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first, last) by licence: the closest run of each, the earliest of equals; places in code points."""
        if not text or not self.sets:
            return []
        parts, at = [], 0
        for gap in _BREAK.finditer(text):
            parts.append((at, gap.start()))
            at = gap.end()
        parts.append((at, len(text)))
        words = [normalised(text[a:b]) for a, b in parts]
        hits = [sum(pair in self.known for pair in zip(w, w[1:])) for w in words]
        best: dict[str, tuple[float, int, int]] = {}
        for i, own in enumerate(hits):
            if not own:  # a closest run does not begin with a sentence that has nothing of a template
                continue
            run, known = [], 0
            for j in range(i, len(parts)):
                run = run + words[j]
                known += hits[j] + 1  # one pair across the break
                size = max(1, len(run) - 1)
                if size > 2 * self.longest:  # repeated pairs make sets smaller than runs
                    break
                if hits[j] and 2 * known >= self.least * (known + self.sizes[0]):
                    pairs = bigrams(run)
                    shared = len(pairs & self.known)
                    if len(pairs) <= self.longest and 2 * shared >= self.least * (len(pairs) + min(shared, self.sizes[0])):
                        found = self.near(pairs)
                        if found and (found[1] not in best or found[0] > best[found[1]][0]):
                            best[found[1]] = (found[0], parts[i][0], parts[j][1])
        return sorted((name, score, a, b) for name, (score, a, b) in best.items())


    def windows(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first, last) of every hit by place: of windows that overlap the closest, then the longest, then the earliest."""
        words = [w.lower() for w in _WORD.findall(text)] if text else []
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            for k in self.holders.get(pair, ()):
                places.setdefault(k, []).append(i)
        found = []
        for k, at in places.items():
            name, pairs = self.sets[k]
            size, need = len(pairs), max(1, math.ceil(len(pairs) * self.least / (2 - self.least) - 1e-9))
            most = int(size * (2 - self.least) / self.least + 1e-9)
            for x in range(len(at) - need + 1):
                if at[x + need - 1] - at[x] >= most:  # too few pairs of the template within reach
                    continue
                seen, shared, to = set(), 0, at[x]
                for y in range(x, len(at)):
                    if at[y] - at[x] >= most:
                        break
                    pair = (words[at[y]], words[at[y] + 1])
                    shared += pair not in seen
                    seen.update(zip(words[to : at[y] + 1], words[to + 1 : at[y] + 2]))
                    to = at[y] + 1
                    score = 2 * shared / (len(seen) + size)
                    if shared >= need and score >= self.least:
                        found.append((-score, at[x] - at[y], at[x], at[y] + 1, name))
        if not found:
            return []
        taken, chosen = bytearray(len(words)), []
        for score, _, a, b, name in sorted(found):
            if not any(taken[a : b + 1]):
                taken[a : b + 1] = b"\1" * (b + 1 - a)
                chosen.append((a, b, name, -score))
        spans = [m.span() for m in _WORD.finditer(text)]
        return [(name, score, spans[a][0], spans[b][1]) for a, b, name, score in sorted(chosen)]


def licence_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + NOTICES, least: float = 0.85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licence, dice, first, last: for every row the windows of words that come as close as ``least`` to a template, all that do not overlap.

    A window counts for its closest template only. Templates of one word are in no window. Whole texts are scanned; null and empty texts have none; equal rows are reported each;
    empty tables give no rows. ``templates`` (name, text) may name a licence more than once.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            at, found = [], []
            for i, body in enumerate(batch.column(1)):
                for one in scanner.windows(body.as_py()):
                    at.append(i)
                    found.append(one)
            names, scores, first, last = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "licence", "dice", "first", "last"])

    return rows.mapInArrow(run, f"doc_id {kind}, licence string, dice double, first long, last long")
