"""Operator 3, license scans by conditional compression.

Candidate blocks are runs of neighbouring lines that hold a cue word of license texts or, beside such a
line, seven tenths of words of notices, as hard-wrapped texts do. Each block is
compressed by zstandard alone and with each template as raw dictionary; the relative size reduction
ranks the templates. The winner, and any template tied with it, is confirmed by exact wording: its
normalised words are aligned with the block's and the words missing from the block are listed; a
template is confirmed if no word of its name is missing and at most ``percent`` of its other words are.
A template is refused in favour of one that is confirmed too and explains more words of the block.

A block can hold several notices: the wording of every template, whatever its rank, is also aligned around
each place of its name's rarest word. Of overlapping occurrences the one that explains most words stays.
A block's only license has the block's span; several have those of their own words.

Defined results. Null or empty text: no block. Rows are independent: repeated rows give the same
result each, a null doc_id is carried along. Ties between templates go to the one with more matched
words, then to the first name. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from docloom.llm.common import arrow_map, slices

CUE = re.compile(r"(?i)licen[cs]e|copyright|\bspdx\b|permission is hereby|redistribution and use|without warranty|public domain|creative commons|\bcc[ -](?:by|0)|all rights reserved")
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

#: The wording of notices, with the words that name the license.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache 2.0",
    ),
    "MIT": ("Released under the MIT License.", "mit"),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND",
        "permission hereby granted sublicense",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        "gnu general public 3",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "redistribution retain disclaimer",
    ),
    "ISC-text": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission fee granted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.", "cc0 1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    "all-rights-reserved": ("Copyright. All rights reserved.", "all rights reserved"),
}
PERCENT = 25
Compressors = tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]


def _of_notice(line: str) -> bool:
    """Whether most words of a line are words of notices, as in the lines of a hard-wrapped one."""
    words = WORD.findall(line.lower())
    return bool(words) and 10 * sum(w in _VOCABULARY for w in words) >= 7 * len(words)


def blocks(text: str) -> list[tuple[int, int]]:
    """Code-point ranges of the lines with a cue and the neighbouring lines in the words of notices; adjacent ones are one block."""
    out: list[tuple[int, int]] = []
    end = -1
    for m in CUE.finditer(text):
        if m.start() < end:
            continue
        lo = text.rfind("\n", 0, m.start()) + 1
        while lo > end + 1 and _of_notice(text[(before := text.rfind("\n", 0, lo - 1) + 1) : lo - 1]):
            lo = before
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        while end < len(text):
            after = text.find("\n", end + 1)
            after = len(text) if after < 0 else after
            if not _of_notice(text[end + 1 : after]):
                break
            end = after
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((lo, end))
    return out


def compressors() -> Compressors:
    """One without a dictionary, and one with each template as raw dictionary. They can't be sent to another process: each task makes its own."""
    made = {}
    for name, (wording, _) in TEMPLATES.items():
        d = zstandard.ZstdCompressionDict(wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made[name] = zstandard.ZstdCompressor(level=12, dict_data=d, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(level=12, write_content_size=False), made


_VOCABULARY = frozenset(w for t, _ in TEMPLATES.values() for w in WORD.findall(t.lower()))
_WORDINGS = {k: (WORD.findall(t.lower()), frozenset(n.split())) for k, (t, n) in TEMPLATES.items()}


def wording(name: str, words: list[str]) -> tuple[int, list[str]]:
    """Matched words of the template, in order, and those missing from the block."""
    own, _ = _WORDINGS[name]
    match = difflib.SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks()
    held = [False] * len(own)
    for m in match:
        held[m.a : m.a + m.size] = [True] * m.size
    return sum(held), [w for w, h in zip(own, held, strict=True) if not h]


def _passages(block: str, least: int = 4000) -> Iterator[tuple[int, str]]:
    """A long block as overlapping passages around its cues, so that alignment stays cheap; all cues are met."""
    if len(block) <= least:
        yield 0, block
        return
    reach = least // 2
    end = -1
    for m in CUE.finditer(block):
        if m.start() >= end:
            lo, end = max(0, m.start() - reach // 2), m.start() + reach
            yield lo, block[lo : end + reach]


def judge(block: str, percent: int = PERCENT, tools: Compressors | None = None) -> tuple[str | None, float, list[str]]:
    """(confirmed license or None, best relative size reduction, its missing words)."""
    plain, with_template = tools or compressors()
    best: tuple = (None, 0.0, [])
    matched_best = -1
    for _, passage in _passages(block):
        low = passage.lower()
        data, words = low.encode("utf-8", "replace"), WORD.findall(low)
        alone = len(plain.compress(data))
        ranked = sorted(((1 - len(c.compress(data)) / alone, name) for name, c in with_template.items()), key=lambda x: (-x[0], x[1]))
        top = ranked[0][0]
        best = best if best[0] or best[1] >= top else (None, top, [])
        for gain, name in ranked:
            if gain <= 0 or gain < 0.5 * top:
                break
            own, must = _WORDINGS[name]
            if not must <= set(words):
                continue
            matched, missing = wording(name, words)
            if 100 * len(missing) <= percent * len(own) and not must & set(missing) and matched > matched_best:
                best, matched_best = (name, gain, missing), matched
    return best


def occurrences(block: str, percent: int = PERCENT, tools: Compressors | None = None) -> list[tuple[int, int, str, float, list[str]]]:
    """(start, end, license, relative size reduction, missing words) of the confirmed notices, none overlapping another."""
    plain, with_template = tools or compressors()
    # Lower case of a few letters is longer than they are.
    low = block.lower() if len(block.lower()) == len(block) else "".join(c.lower() if len(c.lower()) == 1 else c for c in block)
    places = [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
    at: dict[str, list[int]] = {}
    for i, (w, _, _) in enumerate(places):
        at.setdefault(w, []).append(i)
    found = []
    for name, (own, must) in _WORDINGS.items():
        if not must <= at.keys():
            continue
        anchor = min(sorted(must), key=lambda w: len(at[w]))
        own_at = [i for i, w in enumerate(own) if w == anchor]
        for p in at[anchor]:
            lo = max(0, p - own_at[-1] * 5 // 4 - 3)
            near = [w for w, _, _ in places[lo : p + (len(own) - own_at[0]) * 5 // 4 + 3]]
            if not must <= set(near):
                continue
            match = difflib.SequenceMatcher(None, own, near, autojunk=False).get_matching_blocks()[:-1]
            held = {i for m in match for i in range(m.a, m.a + m.size)}
            missing = [w for i, w in enumerate(own) if i not in held]
            if 100 * len(missing) <= percent * len(own) and not must & set(missing):
                found.append((-len(held), name, lo + match[0].b, lo + match[-1].b + match[-1].size, missing))
    taken = bytearray(len(places))
    out = []
    for _, name, first, end, missing in sorted(found):
        if any(taken[first:end]):
            continue
        taken[first:end] = b"\1" * (end - first)
        start, stop = places[first][1], places[end - 1][2]
        data = low[start:stop].encode("utf-8", "replace")
        out.append((start, stop, name, 1 - len(with_template[name].compress(data)) / len(plain.compress(data)), missing))
    return sorted(out)


def find_licenses(text: str | None, percent: int = PERCENT, tools: Compressors | None = None) -> list[tuple[int, int, str | None, float, list[str]]]:
    """The licenses of each block; a block without one has a row with None."""
    out = []
    found = blocks(text) if text else []
    if found and not tools:
        tools = compressors()
    for lo, hi in found:
        block = text[lo:hi]
        best, many = judge(block, percent, tools), occurrences(block, percent, tools)
        if len(many) > 1:
            out += [(lo + a, lo + b, *rest) for a, b, *rest in many]
            words = {w for a, b, *_ in many for w in WORD.findall(block[a:b].lower())}
            # A notice with much between its words is found in the whole block only.
            if best[0] and not _WORDINGS[best[0]][1] <= words:
                out.append((lo, hi, *best))
        elif many and not best[0]:
            out.append((lo, hi, *many[0][2:]))
        else:
            out.append((lo, hi, *best))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: blocks, confirmed licenses, their spans, the best reduction, missing words."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors()
        for part in slices(batches):
            found = [find_licenses(t, percent, tools) for t in part.column(1).to_pylist()]
            n_blocks = [len(blocks(t)) if t else 0 for t in part.column(1).to_pylist()]
            sure = [[b for b in f if b[2]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(n_blocks, pa.int64()),
                    pa.array([len(s) for s in sure], pa.int64()),
                    pa.array([",".join(sorted({b[2] for b in s})) for s in sure], pa.string()),
                    pa.array([",".join(f"{b[2]}:{b[0]}:{b[1]}" for b in s) for s in sure], pa.string()),
                    pa.array([max((b[3] for b in f), default=None) for f in found], pa.float64()),
                    pa.array([" ".join(w for b in s for w in b[4]) for s in sure], pa.string()),
                ],
                names,
            )

    names = ["id", "n_blocks", "n_licenses", "licenses", "spans", "best_reduction", "missing_words"]
    schema = f"id {kind}, n_blocks long, n_licenses long, licenses string, spans string, best_reduction double, missing_words string"
    return arrow_map(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)
