"""License scan by conditional compression.

Candidate blocks are the words about a cue: for each template a few of its words of which one must
stand in every notice that its wording would bear out, whatever words are changed, wrapped or
spaced otherwise. A block of any length is cut into overlapping windows of words. A window is
compressed plain and once with each template as a raw zstandard dictionary; the template that
saves most is the best explanation. The winner is confirmed by wording: nearly all of its words
stand there in order, and none of the words that tell licences apart (names, versions, anything
with a digit) differs. If they do, the next in rank is asked. What a confirmed notice explains is
masked, and the rest of the window is compressed and ranked again, until no template saves a byte.
What is left then goes through narrower windows likewise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import table

#: (identifier, wording) of the notices looked for; fixed wording of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
)
#: Words that must not differ, beside those with a digit.
NAMES = frozenset("apache mit bsd isc gnu general lesser affero mozilla eclipse boost creative commons attribution sharealike noncommercial noderivatives cc by nc sa nd cc0 unencumbered public".split())
#: Names that ordinary text has too.
COMMON = frozenset("general public creative by".split())
SHARE = 0.85
#: Levels below search too little for matches as short as a notice; a dictionary as short as one is indexed in part only, so it holds its template thrice.
LEVEL = 12
REPEATED = 3
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def most_missing(template: list[str]) -> int:
    """How many of a template's words a notice may lack."""
    return int((1 - SHARE) * len(template) + 1e-9)


def cues_of(template: list[str]) -> list[str]:
    """Words of which at least one stands in every notice that bears the template out.

    A name may not differ, so one is enough; else one word more than may be missing. Long words
    are rarer in other text.
    """
    most, names = most_missing(template), [w for w in template if w in NAMES - COMMON]
    pool = names if names and most else template
    return sorted(set(pool), key=lambda w: (-len(w), w))[: 1 if names or not most else most + 1]


_WORDS = [words(t) for _, t in TEMPLATES]
_NORMAL = [" ".join(w) for w in _WORDS]
LONGEST = max(len(w) for w in _WORDS)
CUES = frozenset(c for t in _WORDS for c in cues_of(t))
#: Words about a cue, of a window, and from one window to the next: the overlap holds every template.
REACH = LONGEST + 2
WINDOW = 2 * REACH
STEP = REACH
#: Sizes of windows and steps from one to the next. What wide windows leave is ranked again in narrow
#: ones, where other wording that is like a short notice can't hide what its template saves.
SCALES = ((WINDOW, STEP), (32, 16), (16, 8))


def windows(block: list[str], size: int = WINDOW, step: int = STEP) -> Iterator[tuple[int, list[str]]]:
    """(first word, words) of a block's overlapping windows; a block of up to ``size`` words is one."""
    for at in range(0, max(1, len(block) - (size - step)), step):
        yield at, block[at : at + size]


class Scanner:
    """One compressor without and one with each template as its dictionary."""

    def __init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        dicts = [zstandard.ZstdCompressionDict(" ".join([t] * REPEATED).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for t in _NORMAL]
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for d in dicts]

    def ranked(self, window: list[str]) -> list[tuple[float, int]]:
        """(share of bytes saved, template) for all templates, those that save most first, ties by place."""
        data = " ".join(window).encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(data))
        saved = [(plain - len(c.compress(data)), k) for k, c in enumerate(self.given)]
        return [(s / plain, k) for s, k in sorted(saved, key=lambda x: (-x[0], x[1]))]

    def explained(self, window: list[str], longest: int = LONGEST) -> Iterator[tuple[int, float, int, int, int]]:
        """(template, share of bytes saved, differing words, first word, end) of each notice, the best explanation of what is left first.

        Only templates of up to ``longest`` words count.
        """
        left = list(window)
        while True:
            own = set(left)
            for saved, k in self.ranked(left):
                if saved <= 0:
                    return
                if len(_WORDS[k]) <= longest and (found := placed(left, _WORDS[k], own)):
                    break
            else:
                return
            missing, a, b = found
            yield k, saved, missing, a, b
            left[a:b] = [""] * (b - a)  # places stay, and nothing reaches across

    def confirmed(self, block: list[str]) -> list[tuple[str, float, int, int, int]]:
        """(identifier, share of bytes saved, differing words, first word, end) of each notice that the block's wording bears out.

        Of a notice that two windows see, one whole and one in part, the whole one counts.
        """
        left, out = list(block), []
        for size, step in SCALES:
            found = set()
            for at, window in windows(left, size, step):
                if not CUES.isdisjoint(window):
                    found |= {(d, a - b, a + at, b + at, TEMPLATES[k][0], s) for k, s, d, a, b in self.explained(window, step)}
            for d, _, a, b, name, s in sorted(found):
                if not any(name == x[0] and a < x[4] and x[3] < b for x in out):
                    out.append((name, s, d, a, b))
            for *_, a, b in out:
                left[a:b] = [""] * (b - a)
        return sorted(out)


def placed(block: list[str], template: list[str], words_of_block: set[str]) -> tuple[int, int, int] | None:
    """(words of the template that the block lacks where it fits best, first word, end); None if it isn't borne out anywhere."""
    most, size = most_missing(template), len(template) + 2
    own = set(template)
    if len(own - words_of_block) > most:
        return None
    count, best = [0, *accumulate(w in own for w in block)], None
    for at in range(len(block)):  # only places with enough of the template's words can bear it out
        if count[min(at + size, len(block))] - count[at] < len(template) - most:
            continue
        fit = _fit(block[at : at + size], template)
        if fit is not None and fit[0] <= most and (best is None or fit[0] < best[0]):
            best = (fit[0], at + fit[1], at + fit[2])
            if not best[0]:
                break
    return best


def _fit(window: list[str], template: list[str]) -> tuple[int, int, int] | None:
    """(words of the template that the window lacks, first word in common, end of the last); None if words that tell licences apart differ."""
    same = SequenceMatcher(None, window, template, autojunk=False)
    missing, first, last = 0, None, 0
    for tag, a, b, c, d in same.get_opcodes():
        if tag == "equal":
            first, last = a if first is None else first, b
            continue
        ends = tag == "delete" and b == len(window)  # words after the notice
        if tag in ("replace", "insert"):
            missing += d - c
        if not ends and any(w in NAMES or any(x.isdigit() for x in w) for w in (*window[a:b], *template[c:d])):
            return None
    return None if first is None else (missing, first, last)


def _missing(window: list[str], template: list[str]) -> int | None:
    fit = _fit(window, template)
    return None if fit is None else fit[0]


def blocks(text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """(words, their places in code points) of each candidate block of a text: what stands within REACH words of a cue."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return []
    found = list(_WORD.finditer(text))
    own = [m.group().lower() for m in found]
    spans: list[list[int]] = []
    for k in (k for k, w in enumerate(own) if w in CUES):
        if spans and k - REACH <= spans[-1][1]:
            spans[-1][1] = k + REACH + 1
        else:
            spans.append([max(0, k - REACH), k + REACH + 1])
    return [(own[a:b], [m.span() for m in found[a:b]]) for a, b in spans]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_blocks, licenses, n_exact, saved, spans) for every row of ``docs``.

    ``licenses`` are the confirmed identifiers, sorted and comma-joined; ``n_exact`` those
    without any differing word; ``saved`` the largest share of bytes that a confirmed template saved;
    ``spans`` lists identifier:start:end of the notices in order of place (code points, end
    exclusive). Texts of any length are scanned whole. Null, empty and silent texts
    have no blocks. Repeated rows each give a row. Other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for b in batches:
            out = []
            for text in b["text"]:
                text, found, exact, saved = text or "", set(), set(), 0.0
                spans, own = [], blocks(text)
                for block, places in own:
                    for name, share, differing, first, end in sorted(scanner.confirmed(block), key=lambda x: x[3:]):
                        found.add(name)
                        exact |= {name} if not differing else set()
                        saved = max(saved, share)
                        spans.append(f"{name}:{places[first][0]}:{places[end - 1][1]}")
                out.append((len(own), ",".join(sorted(found)), len(exact), saved, ",".join(spans)))
            names = ["n_blocks", "licenses", "n_exact", "saved", "spans"]
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInPandas(run, f"id {kind}, n_blocks bigint, licenses string, n_exact bigint, saved double, spans string")
    return out.withColumnRenamed("id", id_col).withColumn("saved", F.round("saved", 6))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
