"""License scans by patience alignment.

Where a text shares runs of three words with a license template, the words around are aligned with it: common words at both ends pair off,
then words that occur once in the text's stretch and once in the template are anchors, of which the longest increasing subsequence stays;
the gaps between anchors are aligned the same way. The share of template words that found a partner is the coverage.

In a stretch with several copies no word need occur once. So a long one is also aligned window by window: shared runs, by their places in text and
template, say where a copy would start and end, and windows of up to STRETCH templates are laid from each start and up to each end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches
from palimpsest.llm.seeds import Seeds, tokens

#: Words of a seed, least coverage, and how many times the template's length a match may stretch over.
SEED_WORDS, COVERAGE, STRETCH = 3, 0.8, 1.5
#: By how much more of its template one license must cover to stand for another's match.
MARGIN = 0.02

#: Fixed values: (license, template, words of the template).
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0-or-later",
        "notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("MIT", "line", "Released under the MIT License"),
    (
        "MIT",
        "text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("BSD-2-Clause", "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("MPL-2.0", "notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("GPL-2.0-or-later", "notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("LGPL-2.1-or-later", "notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    ("AGPL-3.0-or-later", "notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    ("Unlicense", "text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def increasing(numbers: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(numbers)
    for k, x in enumerate(numbers):
        pile = bisect_left(tops, x)
        before[k] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(x)
            piles.append(k)
        else:
            tops[pile], piles[pile] = x, k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, ascending in both, by patience alignment."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = [(place[w], k) for k, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        kept = [anchors[k] for k in increasing([x for x, _ in anchors])]
        if not kept:
            continue
        pairs += kept
        ends = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:], strict=False)]
    return sorted(pairs)


def distinct(found: list[dict]) -> list[dict]:
    """Matches without those that another one explains better: licenses that share most of their words match where either stands.

    Of two licenses whose matches lie over each other, in four fifths of the one's words and three fifths of the other's, the first goes if the other
    has a coverage that is greater by MARGIN, or one that isn't less, of more words.
    """

    def explained(b: dict) -> bool:
        for a in found:
            both = min(a["last_word"], b["last_word"]) - max(a["first_word"], b["first_word"]) + 1
            if a["license"] != b["license"] and (a["coverage"] >= b["coverage"] + MARGIN or a["coverage"] >= b["coverage"] and a["words"] > b["words"]):
                if 5 * both >= 4 * (b["last_word"] - b["first_word"] + 1) and 5 * both >= 3 * (a["last_word"] - a["first_word"] + 1):
                    return True
        return False

    return [b for b in found if not explained(b)]


class Scanner:
    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE):
        self.templates, self.coverage = templates, coverage
        if short := [name for name, _, t in templates if len(tokens(t)) < SEED_WORDS]:
            raise ValueError(f"templates of fewer than {SEED_WORDS} words: {short}")
        self.seeds = Seeds([tokens(t) for _, _, t in templates], SEED_WORDS)
        self.places: list[dict[tuple[int, ...], list[int]]] = []
        for line in self.seeds.patterns:
            places = defaultdict(list)
            for k in range(len(line) - SEED_WORDS + 1):
                places[tuple(line[k : k + SEED_WORDS])].append(k)
            self.places.append(places)

    def _stretch(self, line: list[int], template: list[int]) -> tuple[int, int, int]:
        """(words aligned, first word, last word) of the alignment's part that isn't stretched too far."""
        pairs = align(line, template)
        most, best, lo = int(STRETCH * len(template)), (0, 0, 0), 0
        for hi, (x, _) in enumerate(pairs):
            while x - pairs[lo][0] >= most:
                lo += 1
            if hi - lo + 1 > best[0]:
                best = (hi - lo + 1, pairs[lo][0], x)
        return best

    def _refined(self, numbers: np.ndarray, at: int, count: int, first: int, last: int, template: list[int]) -> tuple[int, int, int]:
        """An alignment of words `first` to `last` after `at`, done again on these and a few more as long as that pairs more words: the fewer words of
        neighbouring copies there are, the more words occur once. As (words aligned, first word, last word) in all of numbers."""
        x, y = at + first, at + last
        while 0 < count < len(template):
            for around in (0, SEED_WORDS):
                a = max(0, x - around)
                more, u, v = self._stretch(numbers[a : y + 1 + around].tolist(), template)
                if more > count:
                    count, x, y = more, a + u, a + v
                    break
            else:
                break
        return count, x, y

    def _windows(self, numbers: np.ndarray, which: int, at: list[int]) -> list[tuple[int, int]]:
        """(first word, end) of the windows in which the seeds `at` may have a copy, without those that lack the words for one."""
        template, line = self.seeds.patterns[which], numbers.tolist()
        size, most = len(template), int(STRETCH * len(template))
        starts, ends, last = set(), set(), set()
        for place in at:
            now = {place - k for k in self.places[which][tuple(line[place : place + SEED_WORDS])]}
            starts |= now - last  # a run of seeds keeps its start
            last = now
        last = set()
        for place in reversed(at):
            now = {place - k + size for k in self.places[which][tuple(line[place : place + SEED_WORDS])]}
            ends |= now - last
            last = now
        spans = {(x, x + n) for x in starts for n in (size, most)} | {(x - n, x) for x in ends for n in (size, most)}
        ordered = sorted(ends)
        for x in starts:
            spans |= {(x, y) for y in ordered[bisect_left(ordered, x + int(self.coverage * size)) : bisect_left(ordered, x + most + 1)]}
        needed, seen, out = Counter(template), set(), []
        for a, b in sorted({(max(0, a), min(len(line), b)) for a, b in spans}):
            if b - a < self.coverage * size or (words := numbers[a:b].tobytes()) in seen:
                continue
            seen.add(words)  # a line repeated many times is looked at once
            if sum((Counter(line[a:b]) & needed).values()) >= self.coverage * size:
                out.append((a, b))
        return out

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the templates found in it, each with its best match, by template order; without those that another license explains better."""
        out: list[list[dict]] = [[] for _ in texts]
        numbered, found = self.seeds.find([tokens(t) for t in texts])
        for (n, which), at in sorted(found.items()):
            template = self.seeds.patterns[which]
            size = len(template)
            best, lo = None, 0
            for k in range(len(at)):
                if k + 1 < len(at) and at[k + 1] - at[k] <= size:
                    continue
                # seeds that lie closer than a template's length are one stretch; long ones go through in overlapping parts
                first, last = max(0, at[lo] - size), min(len(numbered[n]), at[k] + SEED_WORDS + size)
                for start in range(first, max(first + 1, last - size), 2 * size):
                    count, x, y = self._stretch(numbered[n][start : min(last, start + 4 * size)].tolist(), template)
                    if count >= self.coverage * size:
                        if best is None or count > best[0]:
                            best = (count, start + x, start + y)
                if best is None or best[0] < size:
                    line = numbered[n][first:last]
                    for a, b in self._windows(line, which, [x - first for x in at[lo : k + 1]]):
                        count, x, y = self._stretch(line[a:b].tolist(), template)
                        if best is None or count + SEED_WORDS > best[0]:
                            count, x, y = self._refined(line, a, count, x, y, template)
                        if count >= self.coverage * size and (best is None or count > best[0]):
                            best = (count, first + x, first + y)  # a greater count has been refined
                            if count == size:
                                break
                lo = k + 1
            if best:
                name, kind, _ = self.templates[which]
                out[n].append({"license": name, "template": kind, "coverage": best[0] / size, "words": best[0], "first_word": best[1], "last_word": best[2]})
        return [distinct(x) for x in out]


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """A row for each template found in a row of docs: (doc_id, license, template, coverage, words, first_word, last_word), its best match in the text.

    Words are lower-cased runs of letters and digits, numbered from 0. Null and empty texts, and texts without licenses, have no row.
    Very long texts are scanned whole. Where two licenses match the same words, as those of one family do, the one that covers its template better is told,
    both if neither does. Repeated rows are each reported; an empty table gives no rows; other columns are ignored. Templates of fewer than three words are
    never found: ValueError.
    """
    bounded_batches(docs.sparkSession)
    scanner = Scanner(templates, coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.string()), ("coverage", pa.float64()), ("words", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    @F.arrow_udf("array<struct<license:string,template:string,coverage:double,words:int,first_word:int,last_word:int>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for k in range(0, len(texts), 500):
            rows += scanner.scan(texts.slice(k, 500).to_pylist())
        return pa.array(rows, kind)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found(F.col(text))).alias("of"))
    return rows.select("doc_id", "of.*")
