"""Licence scans by a trained paragraph classifier with template comparison.

A paragraph is a line that holds words, or a window of words laid over lines up to a
blank one, for notices are wrapped over lines or stand inside long ones. It is a sparse
vector of word uni-, bi- and trigrams. A multinomial logistic regression, trained here
on variants of licence notices, on paragraphs of other licences and on ordinary
paragraphs of the corpus, gives every paragraph the probability of each licence family,
besides `unknown` (a licence, but none of the families) and `none`. Probabilities are
calibrated by a temperature fitted on whole templates, other licences and ordinary
paragraphs that the model asked had not seen. A predicted family is confirmed by
comparison with its templates: enough of a template's bigrams must occur in the
paragraph. A family that isn't confirmed, or not probable enough, is `unknown`.

All paragraphs are scored: the model is linear, so running sums of the weights of a
text's n-grams give the score of any stretch of words.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import held_out

NONE, UNKNOWN = "none", "unknown"

#: Notices by family; a paragraph of several pieces is joined by spaces.
TEMPLATES: dict[str, list[list[str]]] = {
    "MIT": [
        ["Released under the MIT License."],
        ["Licensed under the MIT license."],
        ["This project is available under the terms of the MIT License."],
        ["The MIT License (MIT)"],
        ["SPDX-License-Identifier: MIT"],
        ["MIT-licensed"],
        ["Permission is hereby granted, free of charge,", "to any person obtaining a copy of this software", "and associated documentation files"],
    ],
    "Apache-2.0": [
        ["Licensed under the Apache License, Version 2.0."],
        ["Licensed under the Apache License, Version 2.0 (the License);", "you may not use this file except in compliance", "with the License."],
        ["Apache License Version 2.0, January 2004"],
        ["Released under the Apache 2.0 license."],
        ["SPDX-License-Identifier: Apache-2.0"],
        ["Apache-2.0-licensed"],
    ],
    "GPL-3.0": [
        ["This work is licensed under the GNU General Public License, version 3."],
        ["Licensed under the GNU GPL v3."],
        ["This program is free software: you can redistribute it", "under the terms of the GNU General Public License", "as published by the Free Software Foundation, version 3."],
        ["SPDX-License-Identifier: GPL-3.0-only"],
        ["GNU General Public License Version 3, 29 June 2007"],
    ],
    "GPL-2.0": [
        ["This work is licensed under the GNU General Public License, version 2."],
        ["Licensed under the GNU GPL v2."],
        ["SPDX-License-Identifier: GPL-2.0-only"],
        ["GNU General Public License Version 2, June 1991"],
    ],
    "LGPL": [
        ["Licensed under the GNU Lesser General Public License."],
        ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
        ["SPDX-License-Identifier: LGPL-2.1-or-later"],
    ],
    "AGPL-3.0": [
        ["Licensed under the GNU Affero General Public License, version 3."],
        ["SPDX-License-Identifier: AGPL-3.0-only"],
    ],
    "BSD": [
        ["Released under the BSD License."],
        ["Licensed under the 3-clause BSD license."],
        ["Use of this source code is governed by a BSD-style license."],
        ["Redistribution and use in source and binary forms,", "with or without modification, are permitted", "if the following conditions are met"],
        ["SPDX-License-Identifier: BSD-3-Clause"],
        ["SPDX-License-Identifier: BSD-2-Clause"],
        ["BSD-licensed"],
    ],
    "MPL-2.0": [
        ["This file is subject to the terms of the Mozilla Public License, version 2.0."],
        ["Licensed under the Mozilla Public License 2.0."],
        ["SPDX-License-Identifier: MPL-2.0"],
    ],
    "ISC": [["Released under the ISC License."], ["Licensed under the ISC license."], ["SPDX-License-Identifier: ISC"]],
    "CC-BY": [
        ["Licensed under CC BY 4.0."],
        ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
        ["SPDX-License-Identifier: CC-BY-4.0"],
    ],
    "CC-BY-SA": [
        ["Licensed under CC BY-SA 4.0."],
        ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    ],
    "CC-BY-NC": [
        ["Licensed under CC BY-NC 4.0."],
        ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    ],
    "CC0": [["Dedicated to the public domain under CC0 1.0."], ["To the extent possible under law, the author has waived all copyright."]],
    "Unlicense": [["This is free and unencumbered software", "released into the public domain."], ["SPDX-License-Identifier: Unlicense"]],
}

#: Licences of no family above: they teach the class `unknown`.
OTHER = [
    "All rights reserved. No part of this text may be copied without written permission of the owner.",
    "This software is proprietary and confidential; any unauthorized copying is prohibited.",
    "Licensed under the terms of a commercial agreement with the vendor.",
    "This work may be used for evaluation only under the Example Community License.",
    "Released under a custom licence; see the file COPYING for its terms.",
    "You may redistribute this material for research only; commercial use needs a license.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the Eclipse Public License, version 2.0.",
    "Licensed under the Artistic License 2.0.",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "Copyright the authors. Permission to use is granted to licensees only.",
    "Copyright 2020 Jane Doe. You may use and distribute this file under the conditions below.",
    "Use of this program requires a licence from the company; ask the vendor for its terms.",
    "This product is distributed under the terms of the Common Public Licence.",
    "Permission to use, copy, modify and distribute this software is granted provided that the above copyright notice appears in all copies.",
    "The contents of this file may be used only in compliance with the Sun Industry Standards Source License.",
    "Provided as is, without warranty of any kind, express or implied; in no event shall the authors be liable.",
    "Usage is subject to the end user license agreement.",
    "You must not sublicense, sell or rent this work without consent of the copyright holder.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the zlib license, see LICENSE.txt.",
    "This code may be used pursuant to the terms of the Academic Free License.",
    "Lizenziert unter den Bedingungen der Deutschen Freien Softwarelizenz.",
    "Ce logiciel est distribué sous la licence CeCILL.",
    "Este programa se distribuye bajo una licencia propia; se prohíbe la copia.",
]

#: Sentences that speak of related things and are no licence.
NEAR = [
    "We met the public in general and released version 2 of the free work under pressure.",
    "The driver was licensed in June and the file was under the table.",
    "Use of this source is common; conditions are met in international trade.",
    "Home Login Sign in Privacy policy Terms of service Contact",
    "The terms of the agreement between the two countries were published in January.",
    "To the.",
    "In the public, for the work of the author.",
    "See the file.",
    "He studied at MIT and wrote a history of the license trade.",
    "The Apache pilots kept their licence plates in the office.",
    "An article about the BSD community and the Mozilla browser was published in version 2 of the journal.",
    "The general public may visit the GNU enclosure; dogs must be kept under control.",
    "Her driving license was free of charge and valid in the European Union.",
    "Creative people share common ideas and international attribution matters to them.",
    "Permission to enter is given at the door to any person with a ticket.",
    "A software program is a file; the source of a river is not.",
    "The author and the owner of the house signed the written agreement.",
]

#: Words in, and between the starts of, the windows that are laid over paragraphs.
#: A notice of 15 words or fewer is whole in one of the first, of 32 in one of the second.
WINDOWS = ((20, 5), (40, 8))
#: Bigrams of a template that a paragraph must hold at least, unless the template has fewer.
SHARED = 3
#: Paragraphs scored at once.
BLOCK = 1 << 14


def paragraph_words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the bounds of the paragraphs' words, each paragraph's text and its line."""
    data, off = B.flat(pc.utf8_lower(pc.fill_null(strings, "")))
    starts, ends, wb = B.letter_words(data, off)
    h = B.span_hash(data, starts, ends)
    if not len(h):
        none = np.empty(0, np.int64)
        return h, np.zeros(1, np.int64), none, none
    row = B.row_of(wb)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts] - breaks[off[row]]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    return h, np.append(first, len(h)), row[first], line[first]


def ngrams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word that has as many after it."""
    value = B.mix(h)
    for d in range(1, size):
        value = B.pair_hash(value[:-1], h[d:])
    return value


def _of_texts(texts: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> list[np.ndarray]:
    """All n-grams of each text, taken as one paragraph."""
    h, bounds, row, _ = paragraph_words(pa.array([" ".join(t.split()) for t in texts], pa.string()))
    out = [np.empty(0, B.U64)] * len(texts)
    for i, a, b in zip(row.tolist(), bounds, bounds[1:]):
        out[i] = np.concatenate([out[i], *(ngrams(h[a:b], n) for n in sizes if b - a >= n)])
    return out


@dataclass
class LicenseModel:
    classes: list[str]
    vocabulary: np.ndarray  # sorted n-gram hashes
    weight: np.ndarray  # (vocabulary, classes)
    bias: np.ndarray
    templates: list[tuple[int, np.ndarray]]  # class, bigrams
    temperature: float = 1.0
    #: Expected calibration error on what each fold's model had not seen.
    calibration_error: float = 0.0
    #: Least probability of a family, and of any licence at all.
    probable: float = 0.5
    certain: float = 0.8
    alike: float = 0.6

    def sums(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each n-gram size the words at which a known n-gram begins, and the
        running sums of their weights, beginning with 0."""
        seen = np.zeros(1 << 16, bool)
        seen[(self.vocabulary >> B.U64(48)).astype(np.int64)] = True
        out = []
        for size in (1, 2, 3):
            value = ngrams(h, size) if len(h) >= size else np.empty(0, B.U64)
            at = np.flatnonzero(seen[(value >> B.U64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocabulary, value[at]), max(0, len(self.vocabulary) - 1))
            known = self.vocabulary[place] == value[at]
            total = np.zeros((int(known.sum()) + 1, len(self.classes)))
            np.cumsum(self.weight[place[known]], axis=0, out=total[1:])
            out.append((at[known], total))
        return out

    def logits(self, sums: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the stretches of words a to b, and what n-grams of two and three
        words add to them."""
        out, phrases = np.zeros((2, len(a), len(self.classes)))
        grams = np.zeros(len(a))
        for size, (at, total) in zip((1, 2, 3), sums):
            until = np.maximum(b - size + 1, a)
            part = total[np.searchsorted(at, until)] - total[np.searchsorted(at, a)]
            out += part
            if size > 1:
                phrases += part
            grams += until - a
        return out / np.sqrt(np.maximum(grams, 1))[:, None] + self.bias, phrases

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        e = logits / self.temperature
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def likeness(self, k: int, two: np.ndarray) -> float:
        """The greatest share of one of the family's templates that is among the bigrams,
        0 where that is too little to go by."""
        best = 0.0
        for c, t in self.templates:
            if c == k:
                shared = int(np.isin(t, two).sum())
                if shared >= min(SHARED, len(t)):
                    best = max(best, shared / len(t))
        return best

    def scan(self, strings: pa.Array) -> list[tuple[int, int, str, float, float]]:
        """Text number, line, class, probability and likeness of each licence notice."""
        h, bounds, text, line = paragraph_words(strings)
        if not len(h):
            return []
        a, b = spans(bounds, text, line)
        sums = self.sums(h)
        found: list[tuple[int, int, int, float]] = []
        for i in range(0, len(a), BLOCK):
            x, y = a[i : i + BLOCK], b[i : i + BLOCK]
            logits, phrases = self.logits(sums, x, y)
            p = self.probabilities(logits)
            none = self.classes.index(NONE)
            k = p.argmax(1)
            # One word says too little: mit is German, a name may be anybody's.
            speaks = phrases[np.arange(len(k)), k] > np.maximum(phrases[:, none], 0)
            found += [(int(x[j]), int(y[j]), int(k[j]), float(p[j, k[j]])) for j in np.flatnonzero((k != none) & speaks & (1 - p[:, none] >= self.certain))]
        return self._settled(h, bounds, text, line, found)

    def _settled(self, h: np.ndarray, bounds: np.ndarray, text: np.ndarray, line: np.ndarray, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, str, float, float]]:
        """One row for each notice that the stretches found show. Of confirmed ones that
        overlap the most alike counts; what is left of stretches that touch one another
        is one notice of an unknown licence."""
        confirmed, unknown = [], []
        own = {k: np.unique(np.concatenate([t for c, t in self.templates if c == k])) for k in {f[2] for f in found} if any(c == k for c, _ in self.templates)}
        for x, y, k, p in found:
            two = ngrams(h[x:y], 2) if y - x > 1 else np.empty(0, B.U64)
            like = self.likeness(k, two) if k in own else 0.0
            if like >= self.alike and p >= self.probable:
                there = x + np.flatnonzero(np.isin(two, own[k]))
                confirmed.append((like, p, int(there[0]), int(there[-1]) + 2, k))
            else:
                unknown.append((x, y, p, like))
        of = lambda word: int(np.searchsorted(bounds, word, "right")) - 1
        taken: list[tuple[int, int]] = []
        out = []
        for like, p, x, y, k in sorted(confirmed, key=lambda c: (-c[0], -c[1], c[2], c[3])):
            if not _overlaps(taken, x, y):
                insort(taken, (x, y))
                out.append((x, self.classes[k], p, like))
        run: list[tuple[int, int, float, float]] = []
        lines = set(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        for span in [*sorted(s for s in unknown if not _overlaps(taken, s[0], s[1])), None]:
            if run and (span is None or span[0] >= max(s[1] for s in run) or text[of(span[0])] != text[of(run[0][0])]):
                best = max(run, key=lambda s: (s[:2] in lines, s[2], -s[0]))
                out.append((best[0], UNKNOWN, best[2], best[3]))
                run = []
            if span is not None:
                run.append(span)
        return sorted((int(text[of(x)]), int(line[of(x)]), name, p, like) for x, name, p, like in out)


def _overlaps(taken: list[tuple[int, int]], x: int, y: int) -> bool:
    """Whether x to y meets one of the sorted stretches, which don't meet each other."""
    i = bisect_left(taken, (y, -1))
    return i > 0 and taken[i - 1][1] > x


def spans(bounds: np.ndarray, text: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every line, and of the windows over lines up to a blank one."""
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (line[1:] - line[:-1] > 1)]))
    begin, end = bounds[first], np.append(bounds[first[1:]], bounds[-1])
    a, b = [bounds[:-1]], [bounds[1:]]
    for size, step in WINDOWS:
        n = -(-np.maximum(end - begin - size, 0) // step) + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin, n) + nth * step
        a.append(at)
        b.append(np.minimum(at + size, np.repeat(end, n)))
    return np.concatenate(a), np.concatenate(b)


def variants(text: str, rng: np.random.Generator, filler: list[str], n: int) -> list[str]:
    """The text with words lost, replaced, or set among other words."""
    out = [text]
    words = text.split()
    for _ in range(n - 1):
        loss = rng.random() * 0.15
        w = [x if rng.random() > loss else (filler[rng.integers(len(filler))] if rng.random() < 0.5 else "") for x in words]
        before = [filler[i] for i in rng.integers(len(filler), size=rng.integers(0, 8))]
        after = [filler[i] for i in rng.integers(len(filler), size=rng.integers(0, 12))]
        out.append(" ".join(x for x in [*before, *w, *after] if x))
    return out


FOLDS = 3


def fit(ordinary: list[str], seed: int = 23, each: int = 20) -> LicenseModel:
    """Train on variants of the templates and on ordinary paragraphs, taken as `none`
    unless most of a template occurs in them. For the calibration every template,
    sentence and ordinary paragraph is left out, with all its variants, by one of three
    models, which then are asked about it."""
    rng = np.random.default_rng(seed)
    classes = [NONE, UNKNOWN, *TEMPLATES]
    known = [(classes.index(name), " ".join(parts)) for name, all_ in TEMPLATES.items() for parts in all_]
    templates = [(c, np.unique(g)) for (c, _), g in zip(known, _of_texts([t for _, t in known], (2,))) if len(g)]
    clean = [t for t, g in zip(ordinary, _of_texts(ordinary, (2,))) if all(np.isin(b, g).mean() < 0.5 for _, b in templates)]
    filler = [w for t in clean for w in t.split()] or "some words of ordinary text that say nothing about terms of use and were written by hand".split()
    texts, y, fold = [], [], []

    def add(c: int, n: int, variations: list[str]) -> None:
        texts.extend(variations)
        y.extend([c] * len(variations))
        fold.extend([n % FOLDS] * len(variations))

    nth = dict.fromkeys(range(len(classes)), 0)
    for c, t in [*known, *((1, t) for t in OTHER)]:
        add(c, nth[c], variants(t, rng, filler, each))
        nth[c] += 1
    for n, t in enumerate(NEAR):
        add(0, n, variants(t, rng, filler, each))
    for n, t in enumerate(clean):
        add(0, n, [t])
    # Single words, word lists and repetition, long and short.
    for n in range(900):
        few = rng.integers(len(filler), size=rng.integers(1, 6))
        size = rng.integers(1, 40)
        add(0, n, [" ".join(filler[i] for i in (rng.integers(len(filler), size=size) if n % 2 else rng.choice(few, size)))])
    y, fold = np.array(y), np.array(fold)
    features = _of_texts(texts)
    model = _fitted(classes, templates, [features[i] for i in range(len(y))], y, rng)
    asked, wanted = [], []
    for f in range(FOLDS):
        seen = np.flatnonzero(fold != f)
        part = _fitted(classes, templates, [features[i] for i in seen], y[seen], rng)
        unseen = np.flatnonzero(fold == f)
        asked.append(np.stack([part.weight[k].sum(0) / np.sqrt(max(1, len(features[i]))) + part.bias for i in unseen for k in [_known(part.vocabulary, features[i])]]))
        wanted.append(y[unseen])
    e, right = np.concatenate(asked), np.concatenate(wanted)
    loss = {}
    for t in np.geomspace(0.3, 8, 50):
        z = e / t
        z = z - z.max(1, keepdims=True)
        loss[t] = float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), right]).mean())
    model.temperature = min(loss, key=loss.get)
    p = model.probabilities(e)
    sure, hit = p.max(1), p.argmax(1) == right
    bins = np.minimum((sure * 10).astype(int), 9)
    model.calibration_error = float(sum(abs(hit[bins == k].mean() - sure[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins)))
    return model


def _known(vocabulary: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the n-grams that the vocabulary has."""
    at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
    return at[vocabulary[at] == grams]


def _fitted(classes: list[str], templates: list[tuple[int, np.ndarray]], features: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int = 15) -> LicenseModel:
    """Weights by stochastic gradient descent over n-grams that occur three times."""
    vocabulary, counts = np.unique(np.concatenate([np.unique(f) for f in features]), return_counts=True)
    vocabulary = vocabulary[counts >= 3]
    known = [_known(vocabulary, f) for f in features]
    scale = np.array([1 / np.sqrt(max(1, len(f))) for f in features], np.float32)
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    share = np.bincount(y, minlength=len(classes))
    cost = np.sqrt(share.max() / np.maximum(share, 1)).astype(np.float32)
    for epoch in range(epochs):
        rate = 8.0 / (1 + 0.2 * epoch)
        for pick in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            at = np.concatenate([known[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(known[i]) for i in pick])
            e = np.zeros((len(pick), len(classes)), np.float32)
            np.add.at(e, owner, w[at])
            e = e * scale[pick, None] + b
            e = np.exp(e - e.max(1, keepdims=True))
            e /= e.sum(1, keepdims=True)
            e[np.arange(len(pick)), y[pick]] -= 1
            e *= (cost[y[pick]] / len(pick))[:, None]
            np.add.at(w, at, -rate * (e * scale[pick, None])[owner])
            b -= 0.1 * rate * e.sum(0)
        w *= 1 - 1e-5 * rate * len(y) / 64
    return LicenseModel(classes, vocabulary, w, b, templates)


def train(docs: DataFrame, sample: int = 300, paragraphs: int = 1500) -> LicenseModel:
    """Fit with ordinary text: at most `paragraphs` stretches of 40 words of at most
    `sample` documents, drawn by a hash of their ids from those not held out, at places
    spread over the whole of each. Only they reach the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    drawn = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    each = max(1, paragraphs // sample)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            out = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                lines = [w for line in t.split("\n") if (w := line.split())]
                for k in range(min(each, len(lines))):
                    w = lines[k * len(lines) // each]
                    at = zlib.crc32(f"{doc} {k}".encode()) % max(1, len(w) - 39)
                    out.append((doc, k, " ".join(x for x in w[at : at + 40] if len(x) <= 100)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "k", "line"])

    found = rows.join(F.broadcast(drawn), "doc_id").mapInArrow(pieces, "doc_id long, k long, line string")  # `sample` ids
    lines = found.groupBy("doc_id", "k").agg(F.min("line").alias("line")).orderBy("doc_id", "k").collect()
    return fit([r.line for r in lines if r.line.strip()])


SCAN = "doc_id long, paragraph long, family string, probability double, likeness double"


def license_scan(docs: DataFrame, sample: int = 300) -> DataFrame:
    """Every licence notice: doc_id, paragraph (the line where it begins, from 0), family,
    probability of the most likely class, likeness to that family's nearest template.

    Input: doc_id, text; other columns are ignored. Family is `unknown` where no family
    is confirmed. Of overlapping confirmed notices the most alike counts, then the more
    probable, then the first. Null and empty texts hold no paragraph; repeated rows give
    repeated results; a text of any length is read whole; an empty table gives no rows,
    and ordinary text then isn't learned."""
    model = train(docs, sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            hits = [(ids[t], line, family, p, like) for t, line, family, p, like in model.scan(batch.column("text"))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*hits) if hits else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "paragraph", "family", "probability", "likeness"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCAN)
