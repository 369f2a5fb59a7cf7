"""Licence scans: a trained paragraph classifier, run with built-in functions only.

A paragraph is a run of lines that speak of licences, so a notice broken into short lines is read as one; a
blank line ends it, as do two lines on without a telling word. Paragraphs become sets of word 1- and 2-grams. A
multinomial logistic regression over the grams that tell licences apart gives each licence family, and an
unknown class, a probability; a temperature is fitted on templates and corpus lines that took no part in the
fit. A prediction is confirmed if a template of the family is contained in the paragraph. Training runs on the
driver over the templates and a bounded sample of corpus lines; every paragraph of the corpus is then
classified by one JVM-side projection.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corpus lines, at most about, from which the unknown class is learned.
SAMPLE_PARAGRAPHS = 2000
CONTAINED = 0.6
UNKNOWN = "unknown"

#: Customary notices and sentences of the licences themselves.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This software is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "This program is distributed under the terms of the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License v3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the 3-Clause BSD License.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
}
#: Sentences that speak of licences but grant none.
LOOK_ALIKES = [
    "A driver's license is required to rent a car.", "The license of the restaurant was revoked last year.", "All rights reserved.",
    "Version 2.0 of the program was released in May.", "Free software is popular.", "The general public was not admitted.",
    "She works under a license of the city.", "Terms and conditions apply.", "Copyright by the author.", "The source code is short.",
    "This work is new.", "Released under a new name.", "He was granted permission to use the hall.", "Apache helicopters were seen.",
    "He studied at MIT.", "The foundation published version 3 of its report.", "Creative commons rooms are open.",
]


def _words_py(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split("[^a-z0-9.]+", text.lower())) if w]


def _grams_py(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _words(paragraph: Column) -> Column:
    split = F.split(F.lower(paragraph), "[^a-z0-9.]+")
    return F.filter(F.transform(split, lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def _ngrams(words: Column, n: int) -> Column:
    """The word n-grams of an array; the whole sequence if it is shorter.

    Each gram is read by index, and the short ones at the end are cut off at once: a slice for each
    gram would copy the whole array every time.
    """
    grams = F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))
    return F.slice(grams, 1, F.greatest(F.size(words) - F.lit(n - 1), F.lit(1)))


@dataclass
class LicenceModel:
    classes: list[str]  # the unknown class last
    vocabulary: list[str]
    rare: list[str]  # the words of which each gram has one at least
    weights: np.ndarray  # grams by classes
    bias: np.ndarray
    temperature: float

    def probabilities(self, paragraph: str) -> np.ndarray:
        place = {g: i for i, g in enumerate(self.vocabulary)}
        at = [place[g] for g in _grams_py(_words_py(paragraph)) if g in place]
        z = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _fit(x: np.ndarray, y: np.ndarray, k: int, *, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    target = np.eye(k)[y]
    share = target.sum(axis=0)
    weight = (1 / np.maximum(share, 1))[y] / k  # each class weighs the same
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) * weight[:, None]
        dw, db = x.T @ d + ridge * w / k, d.sum(axis=0)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
    return w, b


def train(negatives: list[str], *, templates: dict[str, list[str]] | None = None, copies: int = 12, seed: int = 0) -> LicenceModel:
    """negatives: paragraphs of the corpus; those that contain a template are left out."""
    templates = templates or TEMPLATES
    rng = np.random.default_rng(seed)
    known = [_grams_py(_words_py(t)) for ts in templates.values() for t in ts]
    other = [p for p in negatives if (g := _grams_py(_words_py(p))) and max(len(g & k) / len(k) for k in known) < 0.4] + LOOK_ALIKES
    common: dict[str, int] = {}
    for p in other:
        for w in set(_words_py(p)):
            common[w] = common.get(w, 0) + 1
    limit = max(3, 0.005 * len(other))
    rare = {w for ts in templates.values() for t in ts for w in _words_py(t) if common.get(w, 0) <= limit}
    vocabulary = sorted({g for k in known for g in k if any(w in rare for w in g.split())})
    place = {g: i for i, g in enumerate(vocabulary)}
    classes = [*templates, UNKNOWN]

    def examples(notices: list[tuple[list[str], int]], plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[tuple[list[str], int]] = []
        for words, c in notices:
            out.append((words, c))
            for _ in range(copies):
                kept = [w for w in words if rng.random() > 0.08] or words
                padding = _words_py(other[int(rng.integers(len(other)))])[: int(rng.integers(0, 12))]
                out.append((padding + kept if rng.random() < 0.5 else kept + padding, c))
        out += [(_words_py(p), len(templates)) for p in plain]
        for p in LOOK_ALIKES:  # these are few and matter
            out += [(_words_py(p), len(templates))] * 10
        for _ in range(600):  # loose words of licences don't make one
            out.append((vocabulary[int(rng.integers(0, len(vocabulary)))].split()[:1], len(templates)))
        x = np.zeros((len(out), len(vocabulary)))
        for i, (words, _) in enumerate(out):
            x[i, [place[g] for g in _grams_py(words) if g in place]] = 1
        return x, np.array([c for _, c in out])

    notices = [(_words_py(t), c, i) for c, ts in enumerate(templates.values()) for i, t in enumerate(ts)]
    most = {c: i for _, c, i in notices}
    # Held out: the last template of each family that has several, whole, and every fifth line of the corpus.
    held = [(w, c) for w, c, i in notices if i and i == most[c]]
    x, y = examples([(w, c) for w, c, i in notices if not i or i != most[c]], [p for i, p in enumerate(other) if i % 5])
    w, b = _fit(x, y, len(classes))
    x, y = examples(held, other[::5])
    weight = (1 / np.maximum(np.bincount(y, minlength=len(classes)), 1))[y]

    def loss(temperature: float) -> float:
        z = (x @ w + b) / temperature
        z -= z.max(axis=1, keepdims=True)
        return float((weight * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])).mean())

    temperature = min(np.geomspace(0.2, 5, 60), key=loss)
    w, b = _fit(*examples([(w, c) for w, c, _ in notices], other), len(classes))
    return LicenceModel(classes, vocabulary, sorted(rare), w, b, float(temperature))


def _literal(values: list, kind: str = "array<string>") -> Column:
    """One foldable constant: a long list of literals would make the plan large."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sample_paragraphs(docs: DataFrame, *, text: str = "text", rows: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """About ``rows`` distinct lines at most, chosen by hash; equal lines count once, so a hot one can't fill it."""
    lines = F.split(F.col(text).cast("string"), "\n")
    total = docs.agg(F.sum(F.size(lines))).first()[0] or 0
    share = min(1.0, rows / max(1, total))
    taken = docs.select(F.explode(lines).alias("p")).where(F.pmod(F.xxhash64("p", F.lit(11)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return sorted(r["p"] for r in taken.where("trim(p) <> ''").distinct().collect())


#: Marks inside a joined text: after a telling line's number, before a plain line, in place of what parts two paragraphs.
TOLD, PLAIN, PART = "\x01", "\x02", "\x03"


def _runs(text: Column, rare: Column) -> Column:
    """The paragraphs of a text as "number of the first line, TOLD, lines": runs of lines with a telling word, also
    across one plain line. A line's marks of its own are taken for spaces.

    A line is judged by its neighbours alone, so that no pattern runs over several lines.
    """
    lines = F.split(F.translate(text, TOLD + PLAIN + PART, "   "), "\n", -1)

    def mark(line: Column, i: Column, tells: Column) -> Column:
        between = F.coalesce(F.get(tells, i - 1) & F.get(tells, i + 1), F.lit(False))
        told = F.when(F.get(tells, i), F.concat(i.cast("string"), F.lit(TOLD), line))
        return told.when(between & (F.trim(line) != ""), F.concat(F.lit(PLAIN), line)).otherwise(F.lit(PART))

    def parts(each: Column) -> Column:
        tells = F.transform(each, lambda line: F.arrays_overlap(_words(line), rare))
        marked = _let(tells, lambda t: F.array_join(F.transform(each, lambda line, i: mark(line, i, t)), "\n"))
        return F.transform(F.filter(F.split(marked, PART), lambda x: F.contains(x, F.lit(TOLD))), lambda x: F.btrim(x, F.lit("\n")))

    return _let(lines, parts)


def scan(docs: DataFrame, model: LicenceModel, *, text: str = "text", doc_id: str = "doc_id", contained: float = CONTAINED,
         templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed), one row for each paragraph whose
    most probable class is a licence family.

    ``paragraph`` is the number of its first line, from 0. ``similarity`` is the largest share of a family's
    template's 3-grams that the paragraph contains. A line without a telling word is of the unknown class by
    itself, so it is passed over unscored. Null and empty texts have no row; texts are read whole. Ties of
    classes go to the one listed first. Repeated rows and null ids are reported row by row. docs' other columns
    aren't carried, so none can clash; an empty table gives an empty one.
    """
    templates = templates or TEMPLATES
    k = len(model.classes)
    vocabulary = _literal(model.vocabulary)
    flat = _literal([float(v) for v in model.weights.reshape(-1)], "array<double>")
    bias = _literal([float(v) for v in model.bias], "array<double>")
    pieces = [[sorted({" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) for w in map(_words_py, ts)] for ts in templates.values()]
    known = _literal(pieces, "array<array<array<string>>>")

    def places(words: Column) -> Column:
        grams = F.array_intersect(vocabulary, F.concat(words, _ngrams(words, 2)))
        return F.transform(grams, lambda g: F.array_position(vocabulary, g))

    def logits(at: Column) -> Column:
        def one(c: Column) -> Column:
            added = F.aggregate(at, F.element_at(bias, (c + 1).cast("int")), lambda a, i: a + F.element_at(flat, ((i - 1) * k + c + 1).cast("int")))
            return added / F.lit(model.temperature)

        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), one)

    def chosen(z: Column) -> Column:
        return _let(
            F.array_max(z),
            lambda top: F.struct(
                F.array_position(z, top).cast("int").alias("best"),
                (1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("probability"),
            ),
        )

    def share(words: Column, best: Column) -> Column:
        return _let(
            _ngrams(words, 3),
            lambda own: F.array_max(F.transform(F.element_at(known, best), lambda t: F.size(F.array_intersect(t, own)) / F.size(t))),
        )

    def found(words: Column, paragraph: Column) -> Column:
        def licence(c: Column) -> Column:
            best = c.getField("best")
            fields = F.struct(
                paragraph.cast("int").alias("paragraph"),
                F.element_at(_literal(model.classes), best).alias("family"),
                F.round(c.getField("probability"), 6).alias("probability"),
                share(words, best).alias("similarity"),
            )
            return F.when(best < k, fields)

        return _let(places(words), lambda at: _let(_let(logits(at), chosen), licence))

    # All in one generator: a filter above a projection would be pushed below it, with the word array
    # written out again inside every lambda that names it.
    runs = _runs(F.col(text).cast("string"), _literal(model.rare))
    lines = lambda run: F.regexp_replace(run, f"(?:\\d+{TOLD})|{PLAIN}", "")
    each = F.transform(runs, lambda run: _let(_words(lines(run)), lambda words: found(words, F.substring_index(run, TOLD, 1))))
    hits = F.filter(each, lambda x: x.isNotNull())
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode_outer(hits).alias("hit")).where("hit is not null")
    return out.select("doc_id", "hit.*", (F.col("hit.similarity") >= contained).alias("confirmed"))


def scan_licences(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return scan(docs, train(sample_paragraphs(docs, text=text)), text=text, doc_id=doc_id)
