"""License scans by conditional compression.

Candidate blocks are stretches of words around each license cue, up to a template's length on both sides and across line
ends; then lines with a cue that no such stretch touches, and runs of such lines of which none is confirmed alone.  A
block is compressed alone and with each template as a raw zstandard dictionary; templates are ranked by the size they save.  The
winner is confirmed by exact wording differences: the words of the block and the template are aligned, and the block
counts if at most ``most_changed`` of the template's words are missing or changed and every distinguishing word
(numbers, versions and names) is there.

Rows: null and empty texts have no block; ties of saved size go to the template with fewer differences, then by name;
repeated rows each give theirs; empty tables give no rows; other columns never matter.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches

_CUE = re.compile(r"licen[sc]|copyright|\(c\)|warrant|permission is|redistribut|public domain|all rights reserved|lizenz|licencia", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*")

#: Wordings of license statements, by SPDX name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": ("Copyright. All rights reserved.", "All rights reserved."),
}

#: Words that every license statement shares; all others must be met exactly.
_COMMON = frozenset("this work is are licensed released under the a of and or to in into as by with license version v you may not use file except compliance terms subject international source code form".split())


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str | None) -> list[tuple[int, list[str]]]:
    """(number of the first line, lines) of the runs of consecutive cue lines of a whole text."""
    out: list[tuple[int, list[str]]] = []
    if not text or not _CUE.search(text):
        return out
    last = -2
    for k, line in enumerate(text.split("\n")):
        if _CUE.search(line):
            if k == last + 1:
                out[-1][1].append(line)
            else:
                out.append((k, [line]))
            last = k
    return out


def own_words(template: list[str]) -> set[str]:
    """The words of a statement that must be met exactly: all but the common ones; of a text longer than a sentence none,
    as its other words tell it from all others."""
    return {w for w in template if w not in _COMMON} if len(template) <= 40 else set()


class Scanner:
    """Compressors with one template each as raw dictionary."""

    def __init__(self, templates: dict[str, tuple[str, ...]], level: int = 3) -> None:
        self.plain = zstandard.ZstdCompressor(level=level)
        self.named = []
        for name, texts in templates.items():
            for t in texts:
                raw = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.named.append((name, words(t), zstandard.ZstdCompressor(level=level, dict_data=raw, write_dict_id=False)))

    def rank(self, block: str) -> list[tuple[float, str, list[str]]]:
        """Templates by the share of the block's compressed size they save, best first."""
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, name, t) for name, t, c in self.named), key=lambda x: (-x[0], x[1]))

    def confirm(self, block: str, template: list[str], most_changed: float) -> tuple[int, int] | None:
        """(template words missing or changed, words of the best stretch of the block beyond them) or None."""
        found = words(block)
        match = difflib.SequenceMatcher(None, template, found, autojunk=False).get_matching_blocks()
        same = sum(m.size for m in match)
        inside = [m for m in match if m.size]
        if not inside or len(template) - same > most_changed * len(template):
            return None
        if not own_words(template).issubset(found):
            return None
        return len(template) - same, inside[-1].b + inside[-1].size - inside[0].b - same


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(TEMPLATES)


def identify(block: str, scanner: Scanner, least_saved: float, most_changed: float) -> tuple[str, float, int, int] | None:
    """(license, saved, missing, extra) of a block, or None.  Templates that save ``least_saved`` are tried in order of
    what they save until one is confirmed; among equal savings the fewest differences win."""
    best = None
    for saved, name, template in scanner.rank(block):
        if saved < least_saved or best and saved < best[1]:
            break
        told = scanner.confirm(block, template, most_changed)
        if told:
            best = min(filter(None, (best, (name, saved, *told))), key=lambda x: (-x[1], x[2] + x[3], x[0]))
    return best


def stretches(text: str, scanner: Scanner, least_saved: float, most_changed: float) -> list[tuple[int, int, str, float, int, int]]:
    """(first line, last line, license, saved, missing, extra) of the statements around the cues of a whole text: words
    aligned with a template, with at most ``most_changed`` of its words missing and as many beyond them, every
    distinguishing word inside, and ``least_saved`` of the stretch's own size saved.  Of stretches that overlap, the one
    with the most words met counts."""
    spans = [m.span() for m in _WORD.finditer(text)]
    found = [text[a:b].lower() for a, b in spans]
    starts = [a for a, _ in spans]
    cues = sorted({max(0, bisect.bisect_right(starts, m.start()) - 1) for m in _CUE.finditer(text)})
    met: dict[tuple[int, int, str], tuple] = {}
    for name, template, packer in scanner.named:
        n, own = len(template), own_words(template)
        slack = max(1, int(most_changed * n))
        todo = [(max(0, c - n - slack), min(len(found), c + n + slack + 1)) for c in cues]
        seen = set()
        while todo:
            lo, hi = todo.pop()
            if (lo, hi) in seen or hi - lo < n - slack or not own.issubset(found[lo:hi]):
                continue
            seen.add((lo, hi))
            parts = [m for m in difflib.SequenceMatcher(None, template, found[lo:hi], autojunk=False).get_matching_blocks() if m.size]
            if not parts:
                continue
            a, b, same = lo + parts[0].b, lo + parts[-1].b + parts[-1].size, sum(m.size for m in parts)
            if n - same > most_changed * n or b - a - same > slack or not own.issubset(found[a:b]):
                continue
            data = text[spans[a][0] : spans[b - 1][1]].encode("utf-8", "replace")
            saved = 1 - len(packer.compress(data)) / len(scanner.plain.compress(data))
            if saved >= least_saved:
                met[a, b, name] = (n - 2 * (n - same) - (b - a - same), saved, n - same, b - a - same)
            todo += [(lo, a), (b, hi)]
    out, taken = [], set()
    for (a, b, name), (_, saved, missing, extra) in sorted(met.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        if taken.isdisjoint(range(a, b)):
            taken.update(range(a, b))
            first = text.count("\n", 0, spans[a][0])
            out.append((first, first + text.count("\n", spans[a][0], spans[b - 1][1]), name, saved, missing, extra))
    return sorted(out)


def scan(text: str | None, scanner: Scanner, least_saved: float = 0.15, most_changed: float = 0.2) -> Iterator[tuple[int, str, float, int, int]]:
    """(line, license, saved, missing, extra) of every confirmed block: the stretches around cues, then each other cue
    line, or a run of them as a whole where no line of it is confirmed."""
    runs = blocks(text)
    told = stretches(text, scanner, least_saved, most_changed) if runs else []
    held = {k for first, last, *_ in told for k in range(first, last + 1)}
    found = [(first, *rest) for first, _, *rest in told]
    for first, lines in runs:
        alone = [(first + k, *got) for k, line in enumerate(lines) if first + k not in held and (got := identify(line, scanner, least_saved, most_changed))]
        if not alone and len(lines) > 1 and held.isdisjoint(range(first, first + len(lines))) and (got := identify(" ".join(lines), scanner, least_saved, most_changed)):
            alone = [(first, *got)]
        found += alone
    yield from sorted(found)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per confirmed block: doc_id, line, license, saved, missing, extra."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates) if templates else _scanner()
        for b in batches:
            rows = [(i, *found) for i, t in zip(b["doc_id"], b["text"], strict=True) for found in scan(t, scanner)]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "license", "saved", "missing", "extra"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, line long, license string, saved double, missing long, extra long")
