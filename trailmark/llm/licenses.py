"""Licence notices in texts, found paragraph by paragraph with a trained classifier.

A logistic regression over sparse word n-grams (one to three words, those of the templates) gives the probability of
each licence family and of ``unknown``.  It is fitted by proximal gradient steps, so most weights are exactly zero, on
variants of the templates (words dropped, swapped and put in) and on paragraphs of a bounded sample of documents; a
temperature fitted on variants held back calibrates the probabilities.  A prediction is confirmed if the paragraph has
most word pairs of some template of the family.

Paragraphs are lines, their sentences, and sentences and pairs of sentences that go on over successive lines, as in
wrapped notices; each line gives one finding for each family.  A paragraph without
any n-gram of non-zero weight has the probabilities of the bias, which are those of ``unknown``; texts that lack every
word of such n-grams are passed over by that rule, which changes no result.

Defined results: null and empty texts have no paragraphs; repeated rows have their findings once each; an empty table
gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"
#: Most documents whose paragraphs are used as examples of no licence.
NEGATIVES = 600
LINES = 60
VARIANTS = 60
LEAST_P = 0.5
LEAST_ALIKE = 0.6

# Customary notices of well-known licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["Licensed under the GNU Affero General Public License.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.", "This document is confidential and proprietary and may not be reproduced without permission."],
}
NO_NOTICES = [
    "The driver showed the officer a valid licence.",
    "The latest version of the report was released on Monday.",
    "The work of the general public is free of charge.",
    "Apache helicopters and the Mozilla team were in the news.",
    "She studied at MIT and then moved to Berkeley.",
    "Permission to land was granted under the following conditions.",
]
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else (c if c >= 128 else 32) for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a text, ASCII lowered, punctuation as space."""
    return text.lower().translate(_PLAIN).split()


def ngrams(ws: list[bytes]) -> set[bytes]:
    return {b" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)}


def pairs(ws: list[bytes]) -> set[bytes]:
    return {b" ".join(ws[i : i + 2]) for i in range(len(ws) - 1)}


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    index: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    heat: float
    cues: frozenset[bytes]
    templates: list[tuple[int, frozenset[bytes]]]

    def probabilities(self, ws: list[bytes]) -> np.ndarray:
        at = [self.index[g] for g in ngrams(ws) if g in self.index]
        z = (self.bias + self.weights[at].sum(0)) / self.heat
        p = np.exp(z - z.max())
        return p / p.sum()

    def alike(self, family: int, ws: list[bytes]) -> float:
        """The largest share of a template's word pairs that the paragraph has."""
        own = pairs(ws)
        return max(len(t & own) / len(t) for f, t in self.templates if f == family)

    def find(self, ws: list[bytes]) -> tuple[str, float, float, bool] | None:
        """Family, probability, likeness and whether the templates confirm it; None for unknown."""
        if self.cues.isdisjoint(ws):
            return None
        p = self.probabilities(ws)
        k = int(p.argmax())
        if self.families[k] == UNKNOWN or p[k] < LEAST_P:
            return None
        alike = self.alike(k, ws)
        return self.families[k], float(p[k]), alike, alike >= LEAST_ALIKE


def _variants(ws: list[bytes], filler: list[bytes], rng: random.Random, n: int) -> list[list[bytes]]:
    out = [ws]
    for _ in range(n):
        v = [w for w in ws if rng.random() > 0.08]
        for _ in range(rng.randrange(0, 12)):
            v.insert(rng.choice((0, len(v), rng.randrange(len(v) + 1))), rng.choice(filler))
        if len(v) > 3 and rng.random() < 0.3:
            i = rng.randrange(len(v) - 1)
            v[i], v[i + 1] = v[i + 1], v[i]
        out.append(v)
    return out


def train(paragraphs: list[bytes], seed: int = 11, steps: int = 400, sparse: float = 2e-4) -> Model:
    """The classifier; ``paragraphs`` are examples of ordinary text (those that hold a template's pairs are left out)."""
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    templates = [(k, frozenset(pairs(words(t.encode())))) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f]]
    plain = [ws for x in paragraphs if (ws := words(x)) and not any(len(t & pairs(ws)) >= 0.5 * len(t) for _, t in templates)]
    plain += [words(x.encode()) for x in NO_NOTICES for _ in range(10)]
    filler = [w for ws in plain[:500] for w in ws[:20]] or [b"the"]
    examples = [(v, k) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f] for v in _variants(words(t.encode()), filler, rng, VARIANTS)]
    examples += [(ws, len(families) - 1) for ws in plain]
    wanted = {g for f in TEMPLATES.values() for t in f for g in ngrams(words(t.encode()))}
    index = {g: i for i, g in enumerate(sorted(wanted))}
    rng.shuffle(examples)
    x = np.zeros((len(examples), len(index)), np.float32)
    y = np.array([k for _, k in examples])
    for i, (ws, _) in enumerate(examples):
        x[i, [index[g] for g in ngrams(ws) if g in index]] = 1
    cut = len(examples) * 4 // 5
    # What is common in ordinary paragraphs says nothing of licences.
    x[:, x[y == len(families) - 1].mean(0) > 0.01] = 0
    goal = np.eye(len(families), dtype=np.float32)[y]
    share = (1 / np.bincount(y[:cut], minlength=len(families)).clip(1))[y[:cut]].astype(np.float32)[:, None] / len(families)
    w, b = np.zeros((len(index), len(families)), np.float32), np.zeros(len(families), np.float32)
    b[-1] = 2.0
    rate = 6.0
    for _ in range(steps):
        z = x[:cut] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = share * (p - goal[:cut])
        w -= rate * (x[:cut].T @ slope)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
        b -= rate * slope.sum(0)
    b[-1] = max(b[-1], b[:-1].max() + 1)  # without evidence: unknown
    z = x[cut:] @ w + b
    def loss(heat: float) -> float:
        s = z / heat
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[cut:]] - np.log(np.exp(s).sum(1))).mean())

    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss) if len(z) else 1.0
    used = {g: i for g, i in index.items() if np.abs(w[i]).sum() > 0}
    common = {g: int(n) for g, n in zip(sorted(wanted), x[y == len(families) - 1].sum(0), strict=True)}
    cues = frozenset(min(g.split(b" "), key=lambda a: (common.get(a, 0), -len(a), a)) for g in used)
    rows = sorted(used.values())
    return Model(families, {g: rows.index(i) for g, i in used.items()}, w[rows], b, heat, cues, templates)


def notices(text: bytes, m: Model) -> list[tuple[int, tuple, bytes]]:
    """(line, finding, notice), one for each line and family.

    Lines and their sentences come first.  Then sentences, and pairs of them, that go on over successive lines with
    words are looked at as one; what is found there stands at its first line, in place of unconfirmed findings of the
    family in its lines, and is left out if one of these lines has the family already.
    """
    best: dict[tuple[int, str], tuple[tuple, bytes]] = {}

    def note(k: int, found: tuple, part: bytes) -> None:
        at = k, found[0]
        if at not in best or (found[3], found[1]) > (best[at][0][3], best[at][0][1]):
            best[at] = found, part.strip()

    # (line, sentence or part of one, its words) of successive lines with words
    block: list[tuple[int, bytes, list[bytes]]] = []

    def settle() -> None:
        if block and block[0][0] != block[-1][0]:
            # Sentences over several lines, with the lines of their first and last words.
            whole: list[tuple[int, int, bytes, list[bytes]]] = []
            goes_on = False
            for k, part, ws in block:
                if goes_on:
                    first, _, head, own = whole[-1]
                    whole[-1] = first, k, head + b"\n" + part, own + ws
                else:
                    whole.append((k, k, part, ws))
                goes_on = part.rstrip()[-1:] not in (b".", b"!", b"?")
            pairs_ = [(a[0], b[1], a[2] + b"\n" + b[2], a[3] + b[3]) for a, b in zip(whole, whole[1:], strict=False)]
            for first, last, part, ws in whole + pairs_:
                if first == last or not (found := m.find(ws)):
                    continue
                here = [(k, found[0]) for k in range(first, last + 1) if (k, found[0]) in best]
                if here and (not found[3] or any(best[at][0][3] for at in here)):
                    continue
                for at in here:
                    del best[at]
                note(first, found, part)
        block.clear()

    for k, line in enumerate(text.split(b"\n")):
        parts = [(part, words(part)) for part in re.split(rb"(?<=[.!?])\s+", line)]
        ws = [w for _, own in parts for w in own]
        if not ws:
            settle()
            continue
        block.extend((k, part, own) for part, own in parts if own)
        alone = [(part, f) for part, own in parts if (f := m.find(own))] if len(parts) > 1 else []
        for part, found in alone:
            note(k, found, part)
        # What only the line as a whole resembles says less than what its sentences are.
        if (found := m.find(ws)) and (found[3] or not any(f[3] for _, f in alone)):
            note(k, found, line)
    settle()
    return [(k, *x) for (k, _), x in sorted(best.items())]


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            at, out = [], []
            for i, x in enumerate(batch.column(1).cast(pa.large_binary())):
                text = x.as_py()
                if not text or m.cues.isdisjoint(words(text)):
                    continue
                for k, found, part in notices(text, m):
                    at.append(i)
                    out.append((k, *found, part.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "paragraph", "family", "probability", "likeness", "confirmed", "notice"])

    return run


def examples(df: DataFrame, id_col: str, text_col: str, most: int = NEGATIVES, lines: int = LINES) -> list[bytes]:
    """Lines of at most ``most`` documents, at most ``lines`` of each: the first by hashes of ids and of lines, so always the same."""
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(most)
    split = F.filter(F.split("text", "\n"), lambda x: x != "")
    first = F.slice(F.array_sort(F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, lines)
    return [r["x"].encode() for r in rows.select(F.explode(first).alias("l")).select("l.x").toLocalIterator()]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = NEGATIVES) -> DataFrame:
    """One row per line and family of a notice: id, paragraph, family, probability, likeness, confirmed, notice."""
    model = df.sparkSession.sparkContext.broadcast(train(examples(df, id_col, text_col, most)))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    more = [T.StructField("paragraph", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("likeness", T.DoubleType()), T.StructField("confirmed", T.BooleanType()), T.StructField("notice", T.StringType())]
    return rows.mapInArrow(_scan(model), T.StructType([rows.schema["id"], *more])).withColumnRenamed("id", id_col)
