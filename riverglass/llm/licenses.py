"""License scans: normalised passages against licence templates, by the Dice coefficient over word bigrams."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, pieces, table, tidied

#: Least Dice coefficient of a match.
LEAST = Fraction(8, 10)

#: The notices by which texts name their licence, and the core paragraphs of the licences themselves.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "Proprietary": ("All rights reserved.",),
}
#: Licences under which a text can't be freely used.
RESTRICTED = frozenset({"GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-SA-4.0", "Proprietary"})

_WORDS = re.compile(r"[^\W_]+").findall
_BLANK = re.compile(r"\n[ \t\r\x0b\x0c]*(?:\n[ \t\r\x0b\x0c]*)+")


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    """Distinct pairs of neighbouring words, with an edge before the first and after the last; none without words."""
    return set(zip(["", *words], [*words, ""], strict=True)) if words else set()


def words_of(text: str) -> list[str]:
    """Normalised: lower-cased runs of letters and digits."""
    return _WORDS(text.lower())


class Scanner:
    """Templates by their bigrams. Size bounds: Dice >= t needs a template of t/(2-t) to (2-t)/t times the passage's bigrams."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: Fraction):
        self.least, self.templates, self.sequences, self.by_bigram = least, [], [], defaultdict(list)
        for name, texts in sorted(templates.items()):
            for k, text in enumerate(texts):
                grams = bigrams(words_of(text))
                if grams:
                    for g in grams:
                        self.by_bigram[g].append(len(self.templates))
                    self.templates.append((name, k, len(grams)))
                    self.sequences.append((len(words_of(text)), grams))
        self.ratio = least / (2 - least)
        sizes = [n for *_, n in self.templates]
        self.smallest, self.largest = (min(sizes), max(sizes)) if sizes else (1, 0)

    def scan(self, words: list[str]) -> list[tuple[str, int, Fraction]]:
        """(licence, template, Dice) of the nearest template that reaches the least, or nothing; ties go by name."""
        if len(words) + 1 < self.ratio * self.smallest:
            return []
        grams = bigrams(words)
        if not self.ratio * self.smallest <= len(grams) <= self.largest / self.ratio:
            return []
        shared: dict[int, int] = defaultdict(int)
        for g in grams & self.by_bigram.keys():
            for k in self.by_bigram[g]:
                shared[k] += 1
        out = []
        for k, n in shared.items():
            name, number, size = self.templates[k]
            if self.ratio * len(grams) <= size <= len(grams) / self.ratio and 2 * n >= self.least * (size + len(grams)):
                out.append((name, number, Fraction(2 * n, size + len(grams))))
        return sorted(out, key=lambda m: (-m[2], m[0], m[1]))[:1]


    def windows(self, words: list[str]) -> list[tuple[str, int, Fraction]]:
        """(licence, first word, Dice) of windows with as many words as a template. Of windows that overlap only the nearest counts.

        Dice >= t needs ratio * size shared bigrams, of which the edges give two: that many must be in the text, and in the window.
        """
        pairs = list(zip(words, words[1:], strict=False))
        shared: dict[int, int] = defaultdict(int)
        for g in self.by_bigram.keys() & set(pairs):
            for k in self.by_bigram[g]:
                shared[k] += 1
        found = []
        for k, n in shared.items():
            (name, number, size), (length, grams) = self.templates[k], self.sequences[k]
            need = self.ratio * size - 2
            if n < need or length > len(words):
                continue
            hits = [0, *itertools.accumulate(p in grams for p in pairs)]
            for at in range(len(words) - length + 1):
                if hits[at + length - 1] - hits[at] >= need:
                    own = bigrams(words[at : at + length])
                    dice = Fraction(2 * len(own & grams), len(own) + size)
                    if dice >= self.least:
                        found.append((-dice, name, number, at, at + length))
        taken: list[tuple[str, int, Fraction]] = []
        free = [True] * len(words)
        for dice, name, _, at, end in sorted(found):
            if all(free[at:end]):
                free[at:end] = [False] * (end - at)
                taken.append((name, at, -dice))
        return sorted(taken, key=lambda m: (m[1], m[0]))


def passages(text: str | None) -> Iterator[tuple[str, int, str]]:
    """(kind, number, passage): lines, paragraphs of several lines between blank ones, and the whole text if it has several paragraphs."""
    text = text or ""
    yield from (("line", k, line) for k, line in enumerate(text.split("\n")))
    if "\n" in text:
        paragraphs = _BLANK.split(text)
        yield from (("paragraph", k, p) for k, p in enumerate(paragraphs) if "\n" in p)
        if len(paragraphs) > 1:
            yield "text", 0, text


def scan(documents: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, *, least: Fraction = LEAST) -> DataFrame:
    """(doc_id, license, restricted, dice, kind, number, n_matches): the licences that each document names.

    Every line, every paragraph and the whole text are compared, normalised to lower-cased words, with each
    template that the size bounds leave. Licences that none of them names are looked for in windows of the text's
    words, each as long as a template (kind "window", number: its first word), so a notice inside a longer line or
    wrapped in a comment is found; of a document's matches with a licence the best one is told: the
    highest Dice coefficient, then line before paragraph before text, then the first. The templates go to the
    workers with the function; their number is fixed.

    Null and empty texts match nothing, null ids stay null, repeated rows give their rows each, very long
    texts are read whole, empty tables give no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            for b in pieces(batch):
                out = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    best: dict[str, tuple] = {}
                    count: dict[str, int] = defaultdict(int)
                    for order, (kind, number, passage) in enumerate(passages(text)):
                        for name, _, dice in scanner.scan(words_of(passage)):
                            count[name] += 1
                            if name not in best or dice > best[name][0]:
                                best[name] = (dice, order, kind, number)
                    named = set(best)
                    for name, number, dice in scanner.windows(words_of(text or "")):
                        if name not in named:
                            count[name] += 1
                            if name not in best or dice > best[name][0]:
                                best[name] = (dice, 0, "window", number)
                    out += [(doc, name, name in RESTRICTED, round(float(d), 6), kind, number, count[name]) for name, (d, _, kind, number) in sorted(best.items())]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "license", "restricted", "dice", "kind", "number", "n_matches"])

    return lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidied(run), "doc_id bigint, license string, restricted boolean, dice double, kind string, number bigint, n_matches bigint")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
