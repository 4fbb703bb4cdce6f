"""License scans by conditional compression.

Documents with a word of licensing are found by a JVM pattern. In them, runs of
words around such words are candidate blocks. Windows of a block, as long as a
license wording and half of it more, are compressed alone and with the wording as
zstandard raw dictionary; what the dictionary saves ranks all wordings in all
windows of the block. The winners are confirmed in the order of their rank: a
wording stands in its window if few words differ and none of its decisive words
(name, version, terms) is among them, and no wording of a higher rank stands there.

Blocks are counted in words and take no notice of lines, so hard-wrapped notices
are read like others. A block is bounded, so very long texts give many blocks and
not a long one; neighbouring blocks overlap by the longest wording.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import once_per_worker
from duelframe.session import ship

# fixed values: wordings of public licenses, as (license, decisive words, wording)
WORDINGS: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0 compliance",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT license."),
    ("MIT", "permission granted free charge sublicense",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions:"),
    ("GPL-3.0", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "gnu general public 3 later",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser general public 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero general public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "creative commons attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "creative commons attribution-noncommercial 4.0",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0 1.0", "Released under CC0 1.0 Universal."),
    ("BSD-3-Clause", "redistribution source binary",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "mozilla public 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "permission use copy modify distribute fee",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "free unencumbered public domain", "This is free and unencumbered software released into the public domain."),
    ("MIT", "permission granted free charge sublicense substantial warranty merchantability",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
     'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
     "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
     "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
CUES = (
    r"(?i)licen[sc]e|copyright|permission\W+is|permission\W+to\W+use|redistribut|unencumbered|creative\W+commons|\bCC0\b|\bCC\W+BY\b|spdx|"
    r"general\W+public|public\W+domain"
)
#: The most words that a block holds; it takes as many on either side of a cue as the longest occurrence of a wording.
MOST_WORDS = 512
#: The share of a wording's words that may differ, and the share of what it saves on itself that it must save in a window.
DIFFERING = 0.15
LEAST_SAVING = 0.2

#: A word may go on in the next line after a hyphen.
WORD = re.compile(r"(?<![\w.\-+/])[\w.\-+/]*(?:(?<=\w-)[ \t]*\n[ \t]*(?=\w)[\w.\-+/]*)*\w")
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Match:
    license: str
    start: int
    end: int
    reduction: float
    missing: int
    added: int


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [SPACE.sub("", m[0]).lower() for m in found], [m.span() for m in found]


class Scanner:
    """Compares blocks with the wordings; compressors are kept per wording."""

    def __init__(self, wordings: tuple[tuple[str, str, str], ...] = WORDINGS):
        import zstandard as zstd

        self._plain = zstd.ZstdCompressor(level=3, write_content_size=False)
        self._wordings = []
        for name, decisive, wording in wordings:
            words, _ = words_at(wording)
            raw = " ".join(words).encode()
            shared = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            packer = zstd.ZstdCompressor(level=3, dict_data=shared, write_content_size=False)
            own = len(self._plain.compress(raw)) - len(packer.compress(raw))
            self._wordings.append((name, tuple(words_at(decisive)[0]), words, packer, own))
        self._cue = re.compile(CUES)
        self._reach = max(len(w[2]) + int(DIFFERING * len(w[2])) for w in self._wordings)

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Runs of words around cues, as character spans; long runs are cut with an overlap."""
        cues = self._cue.finditer(text)
        cue = next(cues, None)
        before: deque[tuple[int, int]] = deque(maxlen=self._reach)  # the last words, while no run is open
        run: list[tuple[int, int]] = []
        left = 0
        for m in WORD.finditer(text):
            if cue and cue.start() < m.end():  # a cue starts in this word
                if not run:
                    run.extend(before)
                    before.clear()
                left = 2 * self._reach  # up to where the words before the next cue would start
                while cue and cue.start() < m.end():
                    cue = next(cues, None)
            if left:
                run.append(m.span())
                left -= 1
                if len(run) >= MOST_WORDS and left:
                    yield run[0][0], run[-1][1]
                    run = run[-self._reach :]
            elif cue is None:
                break
            if not left:
                if run:
                    yield run[0][0], run[-1][1]
                    before.extend(run)
                    run = []
                else:
                    before.append(m.span())
        if run:
            yield run[0][0], run[-1][1]

    def ranked(self, words: list[str], step: int | None = None) -> list[tuple[int, float, int, int, int]]:
        """(bytes saved, share of the wording's own saving, wording, first word, end) of windows, the largest saving first.

        A window begins every half wording (or every ``step`` words), and holds half a wording more than an
        occurrence, so that each occurrence lies in one window whole.
        """
        plain: dict[tuple[int, int], tuple[bytes, int]] = {}
        out = []
        for k, (_, _, wording, packer, own) in enumerate(self._wordings):
            size = len(wording)
            stride = step or max(1, size // 2)
            width = size + int(DIFFERING * size) + max(1, size // 2)
            for start in range(0, max(1, len(words) - int(size * (1 - DIFFERING)) + 1), stride):
                end = min(start + width, len(words))
                if (start, end) not in plain:
                    raw = " ".join(words[start:end]).encode("utf-8", "replace")
                    plain[start, end] = raw, len(self._plain.compress(raw))
                raw, alone = plain[start, end]
                saved = alone - len(packer.compress(raw))
                if saved >= LEAST_SAVING * own:
                    out.append((saved, saved / own, k, start, end))
        return sorted(out, key=lambda c: (-c[0], -c[1], c[2], c[3]))

    def matches(self, text: str | None, step: int | None = None) -> list[Match]:
        """Confirmed wordings of a text in order.

        In a block wordings are confirmed by rank; one does not stand where a winner does. Of neighbouring
        blocks, which overlap, the occurrence with fewer differing words stays, then the longer one.
        """
        found: list[tuple[float, int, Match]] = []
        for first, last in self.blocks(text or ""):
            block = text[first:last]
            words, spans = words_at(block)
            taken = bytearray(len(words))
            for _, _, k, low, high in self.ranked(words, step):
                name, decisive, wording = self._wordings[k][:3]
                low, high = max(0, low - len(wording)), high + len(wording)  # a window may begin or end inside an occurrence
                for start, end, missing, added in occurrences(words[low:high], wording, decisive):
                    start, end = low + start, low + end
                    if any(taken[start:end]):
                        continue
                    taken[start:end] = b"\x01" * (end - start)
                    found.append(((missing + added) / len(wording), -len(wording), Match(
                        name, first + spans[start][0], first + spans[end - 1][1], self.reduction(words[start:end], k), missing, added)))
        kept: list[Match] = []
        for _, _, match in sorted(found, key=lambda f: (f[0], f[1], -f[2].reduction, f[2].start, f[2].license)):
            if all(match.end <= m.start or m.end <= match.start for m in kept):
                kept.append(match)
        return sorted(kept, key=lambda m: m.start)

    def reduction(self, words: list[str], k: int) -> float:
        """Share of the compressed size that a wording saves as dictionary."""
        raw = " ".join(words).encode("utf-8", "replace")
        return round(1 - len(self._wordings[k][3].compress(raw)) / len(self._plain.compress(raw)), 6)


def possible(present: set[str], wording: list[str], decisive: tuple[str, ...]) -> bool:
    """Whether words hold all decisive ones and as many of a wording as an occurrence must; no occurrence lacks that."""
    return present.issuperset(decisive) and sum(w in present for w in wording) >= len(wording) - int(DIFFERING * len(wording))


def occurrences(words: list[str], wording: list[str], decisive: tuple[str, ...]) -> Iterator[tuple[int, int, int, int]]:
    """Places (first word, end, missing words, added words) where a wording stands with few differences, without overlap."""
    allowed = int(DIFFERING * len(wording))
    first = set(wording[: allowed + 1])
    at = 0
    while at < len(words):
        if words[at] in first:
            section = words[at : at + len(wording) + allowed]
            if possible(set(section), wording, decisive):
                same = [b for b in SequenceMatcher(None, wording, section, autojunk=False).get_matching_blocks() if b.size]
                matched = sum(b.size for b in same)
                end = same[-1].b + same[-1].size if same else 0
                missing, added = len(wording) - matched, end - matched
                aligned = {wording[b.a + i] for b in same for i in range(b.size)}
                if same and same[0].b == 0 and missing + added <= allowed and all(d in aligned for d in decisive):
                    yield at, at + end, missing, added
                    at += end
                    continue
        at += 1


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, license, start, end, wording, reduction, missing_words, added_words), one row per confirmed wording.

    ``start`` and ``end`` count characters of the whole text. Texts that are
    null, empty or without a license give no row; repeated rows give theirs
    each time; ties of overlapping wordings go to the larger reduction, then to
    the first by license name. An empty table gives no rows; other columns are not read.
    """
    ship(__name__)
    kind = docs.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = once_per_worker("licenses", None, Scanner)
        for batch in batches:
            rows = [
                (k, m.license, m.start, m.end, text[m.start : m.end], m.reduction, m.missing, m.added)
                for k, text in enumerate(batch["text"]) for m in scanner.matches(text)
            ]
            out = pd.DataFrame(rows, columns=["k", "license", "start", "end", "wording", "reduction", "missing_words", "added_words"])
            out.insert(0, "id", batch["id"].iloc[out["k"]].to_numpy())
            yield out.drop(columns="k")

    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").rlike(CUES))
    found = picked.mapInPandas(
        scan, f"id {kind}, license string, start long, end long, wording string, reduction double, missing_words long, added_words long"
    )
    return found.withColumnRenamed("id", id_column)
