"""License scans by conditional compression.

Candidate blocks are runs of lines with license vocabulary. A template has its place in a block
where the block holds its wording, found in windows of the template's size. What stands there,
and not the text around it, is compressed by itself and with each template whose place it is as a raw zstandard
dictionary, which must shorten it. Templates are ranked by the bytes of their place that they save less those that
they leave, so of those that meet the one which accounts for most of the text wins; exact differences in wording confirm it and decide
between equals. What it leaves over is searched again, so a block gives all its licenses. Where the words around a block can hold more
than it showed, as in a notice that is wrapped to short lines, they are judged with it. All of it happens where a document
is read, without a shuffle; equal blocks are judged once a worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import documents, id_and_text, slices

# Wordings of public licenses and of their usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
#: Identifiers of the SPDX list: license, and its other identifiers and common short names.
_NAMES = (
    ("MIT", (), ()),
    ("BSD-2-Clause", (), ()),
    ("BSD-3-Clause", (), ()),
    ("ISC", (), ()),
    ("Apache-2.0", (), ()),
    ("GPL-2.0", ("GPL-2.0-only", "GPL-2.0-or-later"), ("GPLv2",)),
    ("GPL-3.0", ("GPL-3.0-only", "GPL-3.0-or-later"), ("GPLv3",)),
    ("LGPL-2.1", ("LGPL-2.1-only", "LGPL-2.1-or-later"), ("LGPLv2.1", "LGPL v2.1")),
    ("LGPL-3.0", ("LGPL-3.0-only", "LGPL-3.0-or-later"), ("LGPLv3",)),
    ("AGPL-3.0", ("AGPL-3.0-only", "AGPL-3.0-or-later"), ("AGPLv3",)),
    ("MPL-2.0", (), ()),
    ("EUPL-1.2", (), ("EUPL v1.2",)),
    ("CC-BY-4.0", (), ()),
    ("CC-BY-SA-4.0", (), ()),
    ("CC-BY-NC-4.0", (), ()),
    ("CC0-1.0", (), ()),
    ("Unlicense", (), ()),
)
_TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", _GPL.format(v=2)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GPL.format(v=3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", _GPL.format(v=3).replace("General", "Lesser General")),
    ("AGPL-3.0", _GPL.format(v=3).replace("General", "Affero General")),
    ("MPL-2.0", _MPL),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "This document is confidential and proprietary; no part may be reproduced without written permission."),
    ("LGPL-2.1", _GPL.format(v="2.1").replace("General", "Lesser General").replace("program is free software: you", "library is free software; you")),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2."),
    ("MIT", "The MIT License"),
    ("MIT", "MIT License"),
    ("MIT", "MIT licensed"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    *_TEXTS,
    *((name, f"SPDX-License-Identifier: {own}") for name, others, _ in _NAMES for own in (name, *others)),
    *((name, own) for name, _, short in _NAMES for own in short),
    *((name, f"{start} {own}") for name, others, short in _NAMES for own in (name, *others, *short) for start in ("License:", "Licensed under", "Licensed under the")),
)
#: Lines with one of these make candidate blocks.
CUES = re.compile(r"licen[sc]|copyright|permission|redistribut|warrant|sublicens|proprietary|all\s+rights\s+reserved|public\s+domain|creative\s+commons|\bCC0?[ -]?BY\b|\bSPDX\b|conditions|liab|merchantab|apache|gnu\s|mozilla|\b[AL]?GPL ?v|\bEUPL\b", re.I)
#: Every cue holds one of these, which are found faster.
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "proprietary", "reserved", "domain", "commons", "cc by", "cc-by", "ccby", "cc0 by", "cc0-by", "cc0by", "spdx", "conditions", "liab", "merchantab", "apache", "gnu", "mozilla", "gpl", "eupl")
#: Lines without a cue between two with one that still belong to a block. What a block cuts off is looked for around it.
GAP = 2
#: Code points of a block up to which a worker keeps what it found.
KEPT_CHARS = 4000
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
#: A winner must shorten its place by this share and hold this share of the template's words in order.
REDUCTION, WORDING = 0.15, 0.9
LEVEL = 9
#: Windows are so many times as long as the template and begin at every length of it. A wording
#: drawn out over more than the longest cannot reach REDUCTION.
REACH = (3, 8)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def framed(text: str) -> str:
    """A wording as it is compressed: lower-cased, with single spaces, as capitals and the breaks of lines are no
    differences; a bare name within words, as a few bytes are less than what the format adds to them."""
    flat = " ".join(text.lower().split())
    return flat if len(flat) >= 16 else f"licensed under the {flat}"


@lru_cache(maxsize=1)
def _compressors() -> tuple:
    plain = zstandard.ZstdCompressor(level=LEVEL)
    raw = [zstandard.ZstdCompressionDict(framed(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, text in TEMPLATES]
    return plain, [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in raw]


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _template_words() -> list[tuple[list[str], Counter, set[str]]]:
    """Words of each template, their counts and those with digits."""
    words = [wording(t) for _, t in TEMPLATES]
    return [(w, Counter(w), {x for x in w if any(c.isdigit() for c in x)}) for w in words]


def differences(block: list[str], template: list[str]) -> tuple[float, list[str], list[str]]:
    """Share of the template's words that the block has in order; words missing and words put within."""
    same = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return 0.0, template, []
    held = {i for m in same for i in range(m.a, m.a + m.size)}
    inside = {i for m in same for i in range(m.b, m.b + m.size)}
    first, last = same[0].b, same[-1].b + same[-1].size
    return len(held) / len(template), [w for i, w in enumerate(template) if i not in held], [block[i] for i in range(first, last) if i not in inside]


@lru_cache(maxsize=1)
def _least() -> list[int]:
    """Bytes that are left of each template when it stands in its own dictionary."""
    return [len(c.compress(framed(text).encode())) for c, (_, text) in zip(_compressors()[1], TEMPLATES, strict=True)]


def _reduction(text: str, i: int) -> tuple[float, float]:
    """Share by which template i shortens a text, and its rank by that: the bytes of the text, without what frames it,
    that the template saves, less those that it does not tell."""
    data = framed(text).encode("utf-8", "replace")
    plain, with_template = _compressors()
    left = len(with_template[i].compress(data))
    share = 1 - left / len(plain.compress(data))
    return share, share * len(" ".join(text.split()).encode("utf-8", "replace")) - (left - _least()[i])


@lru_cache(maxsize=1)
def _by_word() -> dict[str, list[int]]:
    """Templates by words of which a text must have one to hold enough of the template: for each the words
    that fewest templates have, so many that a text without them lacks too much."""
    spread = Counter(w for _, own, _ in _template_words() for w in own)
    out: dict[str, list[int]] = {}
    for i, (words, own, numbers) in enumerate(_template_words()):
        left = 0
        for w in sorted(own, key=lambda w: (w not in numbers, spread[w], w)):
            out.setdefault(w, []).append(i)
            left += own[w]
            if w in numbers or len(words) - left < WORDING * len(words):
                break
    return out


def _holds(counts: Counter, i: int) -> bool:
    """Whether words of these counts can hold enough of template i."""
    words, own, numbers = _template_words()[i]
    return numbers <= counts.keys() and sum(min(n, counts[w]) for w, n in own.items()) >= WORDING * len(words)


def _places(words: list[str], i: int) -> Iterator[tuple]:
    """(first word, last word + 1, share, missing, extra) wherever words hold the wording of template i."""
    template, _, numbers = _template_words()[i]
    step = len(template)
    for size in (r * step for r in REACH):
        for at in range(0, max(len(words) - size + step, 1), step):
            part = words[at : at + size]
            if not _holds(Counter(part), i):
                continue
            share, missing, extra = differences(part, template)
            if share >= WORDING and not numbers & set(missing):
                same = [m for m in SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if m.size]
                yield at + same[0].b, at + same[-1].b + same[-1].size, share, missing, extra
        if len(words) <= size:
            break


def judge_all(block: str) -> tuple[tuple, ...]:
    """(first line, last line + 1, license, reduction, share of the wording, missing words, extra
    words) of each license of a block, in order. Of those that meet the one that ranks highest by compression wins,
    then the best fit, then the longest template, then the order of TEMPLATES. An SPDX expression has a license for each identifier."""
    return tuple(hit for _, hit in (_kept(block) if len(block) <= KEPT_CHARS else _judged(block)))


@lru_cache(maxsize=20_000)
def _kept(block: str) -> tuple:
    return _judged(block)


def _more_identifiers(block: str) -> Iterator[tuple[int, tuple]]:
    """(place, hit) of each identifier of an SPDX expression after its first."""
    for m in _SPDX.finditer(block):
        line = block.count("\n", 0, m.start())
        ids = [x for x in re.findall(r"[A-Za-z0-9.+-]+", m[1].split("*/")[0])]
        joined = [b for a, b in zip(ids, ids[1:], strict=False) if a.upper() in ("OR", "AND")]
        for own in joined:
            for i, hit in _kept(f"SPDX-License-Identifier: {own}"):
                yield i, (line, line + 1, *hit[2:])


def _judged(block: str) -> tuple[tuple[int, tuple], ...]:
    """judge_all with the template of each license."""
    found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
    words = [x for x, _, _ in found]
    hits, spans = [], [(0, len(words))]
    while spans:
        lo, hi = spans.pop()
        own, places = words[lo:hi], set()
        counts = Counter(own)
        for i in sorted({i for w in counts.keys() & _by_word().keys() for i in _by_word()[w]}):
            if _holds(counts, i):
                n = len(_template_words()[i][0])
                for first, last, share, missing, extra in _places(own, i):
                    reduction, rank = _reduction(block[found[lo + first][1] : found[lo + last - 1][2]], i)
                    if reduction >= REDUCTION:
                        # Words put within count against a template as much as missing ones: a place drawn out over
                        # other notices comes after all that hold little but the template.
                        fit = share - len(extra) / n
                        places.add((fit >= WORDING, rank, fit, n, -i, -first, last, reduction, share, tuple(missing), tuple(extra)))
        taken = np.zeros(len(own), bool)
        for _, _, _, _, i, first, last, reduction, share, missing, extra in sorted(places, reverse=True):
            i, first = -i, -first
            if taken[first:last].any():
                continue
            begin, end = found[lo + first][1], found[lo + last - 1][2]
            taken[first:last] = True
            lines = block.count("\n", 0, begin), block.count("\n", 0, end) + 1
            hits.append((lo + first, i, (*lines, TEMPLATES[i][0], reduction, share, list(missing), list(extra))))
        if taken.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([1], taken, [1])).astype(int)))
            spans += [(lo + int(a), lo + int(z)) for a, z in edges.reshape(-1, 2)]
    own = [(i, hit) for _, i, hit in sorted(hits, key=lambda x: x[0])]
    if " OR " in block or " AND " in block:
        own = sorted([*own, *_more_identifiers(block)], key=lambda x: x[1][0])
    return tuple(own)


def judge(block: str) -> tuple | None:
    """(license, reduction, share of the wording, missing words, extra words) of the first license of a block, or None."""
    found = judge_all(block)
    return found[0][2:] if found else None


def cued(text: str | None) -> bool:
    """Whether a text holds a cue."""
    if not text:
        return False
    folded = text.casefold()
    return any(x in folded for x in STEMS) and CUES.search(text) is not None


def blocks(text: str | None) -> list[tuple[int, int, str]]:
    """(first line, last line + 1, text) of each candidate block of a text, whole lines."""
    if not cued(text):
        return []
    lines, found = text.split("\n"), []
    for i in (i for i, x in enumerate(lines) if CUES.search(x)):
        if found and i - found[-1][1] <= GAP:
            found[-1][1] = i + 1
        else:
            found.append([i, i + 1])
    return [(a, b, "\n".join(lines[a:b])) for a, b in found]


@lru_cache(maxsize=1)
def _around() -> int:
    """Words around a cue that can belong to its notice: twice the longest run of a template's words without one."""
    most = 0
    for _, text in TEMPLATES:
        cued = [i for i, m in enumerate(_WORD.finditer(text)) if any(c.start() < m.end() and m.start() < c.end() for c in CUES.finditer(text))]
        at = [-1, *cued, len(wording(text))]
        most = max(most, *(b - a for a, b in zip(at, at[1:], strict=False)))
    return 2 * most


@lru_cache(maxsize=1)
def _within() -> list[set[int]]:
    """For each template itself and those that it contains."""
    lined = [" " + " ".join(w) + " " for w, _, _ in _template_words()]
    return [{j for j, b in enumerate(lined) if b in a} for a in lined]


def licenses_of(text: str | None) -> list[tuple]:
    """What judge_all finds in a whole text, with lines of the text.

    Blocks of lines with cues are judged first, as equal ones are judged once. A notice may be wrapped so that
    lines without a cue cut it in two: where the words around the cues can hold a template that the
    blocks did not show, or words that it lacks, they are judged together.
    """
    if not cued(text):
        return []
    lined = blocks(text)
    ends = np.cumsum([0, *(len(x) + 1 for x in text.split("\n"))])
    found = list(_WORD.finditer(text))
    begins = np.array([m.start() for m in found])
    # Words around each cue, and the blocks that these touch, as stretches of the text.
    reach, stretches = _around(), []
    for m in CUES.finditer(text):
        i = int(np.searchsorted(begins, m.start(), "right")) - 1
        a, z = max(0, i - reach), min(len(found) - 1, i + reach)
        if found:
            stretches.append((found[a].start(), found[z].end()))
    stretches += [(int(ends[a]), int(ends[z]) - 1) for a, z, _ in lined]
    merged: list[list[int]] = []
    for a, z in sorted(stretches):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    out = []
    for a, z in merged:
        own = [(first, block) for first, last, block in lined if a <= ends[first] and ends[last] - 1 <= z]
        shown = [(i, (first + hit[0], first + hit[1], *hit[2:])) for first, block in own for i, hit in (_kept(block) if len(block) <= KEPT_CHARS else _judged(block))]
        known = {j for i, _ in shown for j in _within()[i]}
        counts = Counter(wording(text[a:z]))
        near = {i for w in counts.keys() & _by_word().keys() for i in _by_word()[w]} - known
        # A notice of which a block holds nearly all has its other words outside.
        if any(hit[5] for _, hit in shown) or any(_holds(counts, i) for i in near):
            line = text.count("\n", 0, a)
            shown = [(i, (line + hit[0], line + hit[1], *hit[2:])) for i, hit in _judged(text[a:z])]
        out += [hit for _, hit in shown]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license that a document holds: (id, line_start, line_end, license, reduction, wording, missing, extra).

    Lines count from 0, line_end is exclusive; they are those of the wording found, however its lines are
    wrapped. A block or line may hold several; of those that meet, the one wins that ranks highest by conditional
    compression of its place, of equals the best fit, the longest template, then the first listed. A text of any length is read as a whole; only blocks of bounded length are
    kept for equal ones. A null or empty text has no rows, an empty table none; repeated rows and null ids
    each give their own. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for id_, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows += [(id_, *hit) for hit in licenses_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    names = ["id", "line_start", "line_end", "license", "reduction", "wording", "missing", "extra"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, line_start long, line_end long, license string, reduction double, wording double, missing array<string>, extra array<string>")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    found = scan_licenses(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "line_start", "line_end", "license", F.round("reduction", 6).alias("reduction"), F.round("wording", 6).alias("wording"), F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra"))
