"""Licences of files: TF-IDF cosine to templates, then inheritance from directories.

The whole text is compared with full licence texts and with notices, every run of lines with
notices, by the cosine of sparse TF-IDF vectors; idf is over the full texts and over the
notices, and a word of none has the highest. Runs have up to LINES lines, or as many as hold
twice the words of the longest notice, so that a narrowly wrapped notice is one run. A text
that is a licence as a whole is a licence file of its directory; a run that is one is the
file's own header. A template of up to SHORT words counts only where no longer one matches:
"All rights reserved." stands in many licences. A file with neither takes the licence file of
its nearest ancestor directory, by joins on paths.

Texts are only compared where they can match: of each notice enough of its heaviest words
are `telling` that the others together stay under the threshold (Cauchy-Schwarz), so a run
without any of them cannot reach it; and the squared weights of the words that a text or run
has at all must reach the threshold's square. That leaves few runs and changes no result.

Directories are joined as one row each: the licence of a directory is an aggregate, its
ancestors a handful of rows, and files meet the directory's result under a salt, so a
directory with a third of all files is no group in one task.

Defined results: a null or wordless text is no licence; a null path has no directory and
inherits nothing; of equal scores the first template's name, of equal licence files in one
directory the best, then the first path; rows that repeat a path are judged one by one;
other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log, sqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import pinned
from ._words import PUNCTUATION, hash_of, word_chunks

THRESHOLD = 0.7
LINES = 4
SHORT = 3
SALTS = 32

#: The notices by which common licences ask to be named.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Reproduction without written permission is prohibited."],
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text: str) -> Counter:
    return Counter(w.lower() for w in _WORD.findall(text))


@cache
def full_texts() -> dict[str, list[str]]:
    """Whole licences by name, for whole files; read by the driver."""
    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted(Path(__file__).with_name("licenses").glob("*.txt"))}


class Templates:
    def __init__(self, templates: dict[str, list[str]], threshold: float, whole: dict[str, list[str]] | None = None):
        texts = [(name, _terms(t)) for name, forms in templates.items() for t in forms]
        seen = Counter(w for _, t in texts for w in t)
        self.unseen = log(1 + len(texts)) + 1
        self.idf = {w: log((1 + len(texts)) / (1 + n)) + 1 for w, n in seen.items()}
        self.threshold, self.forms, telling = threshold, [], set()
        for name, t in texts:
            v = {w: n * self.idf[w] for w, n in t.items()}
            norm = sqrt(sum(x * x for x in v.values()))
            self.forms.append((name, {w: x / norm for w, x in v.items()}))
            rest = 1.0
            for w, x in sorted(self.forms[-1][1].items(), key=lambda p: (-p[1], p[0])):
                if rest < threshold * threshold * 0.999:
                    break
                telling.add(w)
                rest -= x * x
        self.telling = telling
        self.reach = 2 * max((t.total() for _, t in texts), default=0)
        self.short = [t.total() <= SHORT for _, t in texts]
        #: word -> (form, weight in it), and its squared weights in all forms
        self.post = {w: [(k, form[w]) for k, (_, form) in enumerate(self.forms) if w in form] for w in self.idf}
        self.words = sorted(self.post)
        self.squares = np.array([[form.get(w, 0.0) ** 2 for _, form in self.forms] for w in self.words], np.float32).reshape(len(self.words), len(texts))
        self.whole = Templates(whole, threshold) if whole else None
        place = np.array([hash_of(w) for w in self.words], np.uint64)
        self.order = np.argsort(place)
        self.hashes = place[self.order]

    def possible(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each text, given by its words' fingerprints, whether the words that it has can reach the threshold."""
        out = np.zeros(len(counts), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            row, word = np.repeat(np.arange(len(counts)), counts)[hit], self.order[at[hit]]
            starts = np.searchsorted(row, np.arange(0, len(counts) + 256, 256))
            for k, low in enumerate(range(0, len(counts), 256)):
                some = slice(starts[k], starts[k + 1])
                has = np.zeros((min(256, len(counts) - low), len(self.words)), np.float32)
                has[row[some] - low, word[some]] = 1
                out[low : low + 256] = (has @ self.squares).max(1) >= self.threshold**2 * 0.999
        return out if self.whole is None else out | self.whole.possible(hashes, counts)

    def _top(self, dots: list[float], norm: float) -> tuple[float, str | None]:
        """The best of the forms: a short one only where no longer one reaches the threshold."""
        scores = [x / norm for x in dots]
        long = max((k for k in range(len(dots)) if not self.short[k]), key=scores.__getitem__, default=None)
        k = long if long is not None and scores[long] >= self.threshold else max(range(len(dots)), key=scores.__getitem__)
        return min(1.0, scores[k]), self.forms[k][0]

    def best(self, t: Counter) -> tuple[float, str | None]:
        """The highest cosine and its template's name."""
        dots, square = [0.0] * len(self.forms), 0.0
        for w, n in t.items():
            x = n * self.idf.get(w, self.unseen)
            square += x * x
            for k, y in self.post.get(w, ()):
                dots[k] += x * y
        return self._top(dots, sqrt(square)) if square else (0.0, None)

    def scan(self, text: str) -> tuple[str | None, float, str | None]:
        """(licence, score, "file" or "header"); nothing below the threshold."""
        lines = [_terms(x) for x in text.split("\n")]
        total = Counter()
        for t in lines:
            total.update(t)
        found = [self.best(total)] + ([self.whole.best(total)] if self.whole else [])
        score, name = max(found, key=lambda s: s[0])
        if score >= self.threshold:
            return name, score, "file"
        lines = [t for t in lines if t]
        at = [i for i, t in enumerate(lines) if not self.telling.isdisjoint(t)]
        size = [t.total() for t in lines]
        lows = set()
        for i in at:
            n, low = size[i], i
            while low >= 0 and (i - low < LINES or n <= self.reach):
                lows.add(low)
                low -= 1
                n += size[low] if low >= 0 else 0
        known = [not self.post.keys().isdisjoint(t) for t in lines]
        top, short = (0.0, None), (0.0, None)
        for low in sorted(lows):
            # A run that begins or ends with a line without any word of a notice is no better than the run without it.
            if not known[low]:
                continue
            high, n = low, 0
            while high < len(lines) and (high - low < LINES or n + size[high] <= self.reach):
                n += size[high]
                high += 1
            if not self._enough(lines[low:high]):
                continue
            dots, square, run, tells = [0.0] * len(self.forms), 0.0, Counter(), False
            for i in range(low, high):
                for w, c in lines[i].items():
                    x, o = self.idf.get(w, self.unseen), run[w]
                    square += x * x * c * (2 * o + c)
                    run[w] = o + c
                    for k, y in self.post.get(w, ()):
                        dots[k] += c * x * y
                tells = tells or not self.telling.isdisjoint(lines[i])
                if tells and known[i]:
                    norm = sqrt(square)
                    for k, x in enumerate(dots):
                        if x >= self.threshold * norm:
                            s = (min(1.0, x / norm), self.forms[k][0])
                            if self.short[k]:
                                short = s if s[0] > short[0] else short
                            else:
                                top = s if s[0] > top[0] else top
        top = top if top[1] is not None else short
        return (top[1], top[0], "header") if top[1] is not None else (None, 0.0, None)

    def _enough(self, lines: list[Counter]) -> bool:
        mass, seen, least = [0.0] * len(self.forms), set(), self.threshold**2 * 0.999
        for t in lines:
            for w in t:
                if w in self.post and w not in seen:
                    seen.add(w)
                    for k, y in self.post[w]:
                        mass[k] += y * y
        return max(mass) >= least


def scanned(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """files without text, with own_license, own_score and own_kind ("file", "header" or null)."""
    rules = Templates(templates or TEMPLATES, threshold, None if templates else full_texts())
    kept = [c for c in files.columns if c not in ("text", "own_license", "own_score", "own_kind")]
    extra = [("own_license", T.StringType(), pa.string()), ("own_score", T.DoubleType(), pa.float64()), ("own_kind", T.StringType(), pa.string())]
    schema = T.StructType([*(files.schema[c] for c in kept), *(T.StructField(k, t) for k, t, _ in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column("text"), PUNCTUATION):
                part = batch.slice(words.low, words.high - words.low)
                found = [(None, 0.0, None)] * part.num_rows
                texts = part.column("text")
                for i in np.flatnonzero(rules.possible(words.hashes, words.counts)):
                    found[i] = rules.scan(texts[int(i)].as_py())
                values = [pa.array(list(x), t) for x, (_, _, t) in zip(zip(*found), extra)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *values], [*kept, *(k for k, _, _ in extra)])

    return files.select(*kept, "text").mapInArrow(run, schema)


def _directory(path):
    """The part before the last slash; the root is ''."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def licensed(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text, ...) without text, with license, score, origin (file, header, inherited, none) and licensed_by, the directory; columns of these names are replaced."""
    kept = [c for c in files.columns if c not in ("text", "license", "score", "origin", "licensed_by")]
    # One struct of all columns, so that no name of theirs meets one of ours.
    packed = files.select(F.struct(*kept).alias("__row"), "path", "text")
    own = pinned(scanned(packed, templates, threshold).withColumn("__dir", _directory(F.col("path"))))
    of_dirs = (
        own.where("own_kind = 'file' AND path IS NOT NULL")
        .groupBy(F.col("__dir").alias("above"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("license"))).alias("x"))
        .select("above", F.col("x.license").alias("dir_license"), (-F.col("x.s")).alias("dir_score"))
    )
    # Each directory with all its ancestors, itself included.
    parts = F.split("__dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = own.select("__dir").where("__dir IS NOT NULL").distinct().select("__dir", F.explode(F.array_distinct(ups)).alias("above"))
    nearest = dirs.join(of_dirs, "above").groupBy("__dir").agg(F.max_by(F.struct("above", "dir_license", "dir_score"), F.length("above")).alias("x"))
    nearest = nearest.select("__dir", "x.*").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("path", "own_license", "own_score"), F.lit(SALTS)).cast("int")
    out = own.withColumn("__salt", salt).join(nearest, ["__dir", "__salt"], "left")
    mine = F.col("own_kind").isNotNull()
    return out.select(
        *(F.col("__row")[c].alias(c) for c in kept),
        F.when(mine, F.col("own_license")).otherwise(F.col("dir_license")).alias("license"),
        F.when(mine, F.col("own_score")).otherwise(F.coalesce("dir_score", F.lit(0.0))).alias("score"),
        F.coalesce("own_kind", F.when(F.col("dir_license").isNotNull(), "inherited"), F.lit("none")).alias("origin"),
        F.when(~mine, F.col("above")).alias("licensed_by"),
    )
