"""Licence scans: a trained paragraph classifier, with templates to confirm it.

A multinomial logistic regression over sparse word n-grams tells the licence families and "other"
apart. It is trained in numpy from variants of the templates - cut, thinned out, among foreign
words - and from a bounded sample of the corpus's paragraphs as "other". A temperature fitted on
held-out variants calibrates its probabilities, and the probability below which a family stays
"unknown" is such that of held-out other paragraphs a thousandth pass at most. A family counts
where one of its templates occurs in the paragraph with a quarter of its words in edits or fewer.

Paragraphs are lines; longer ones than PIECE words are read in overlapping pieces of so many, and
all in overlapping windows of the sizes of SHORT as well, so that a notice amid other words tells.
The templates are held against a window and the words of its paragraph around it.

Defined results: null and empty texts have no paragraphs and so no rows; repeated rows are
reported as often as they occur; without a corpus to sample, the templates alone train the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import pick, row_groups, text_bytes
from tamarack.llm.decontaminate import edit_distance, grams, values, word_values

OTHER, UNKNOWN = "other", "unknown"
SAMPLE_DOCS, SAMPLE_LINES, VARIANTS, STEPS, SEED = 400, 4000, 30, 150, 29
PIECE, SHORT, MOST_EDITS, PASS = 60, (12, 30), 0.25, 0.001
CHUNK_BYTES = 1 << 21

# Notices by which works say that they are under a licence.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This document is confidential and may not be reproduced without the prior written permission of the copyright holder."],
}


def pieces(words: np.ndarray) -> list[np.ndarray]:
    if len(words) <= PIECE:
        return [words]
    return [words[a : a + PIECE] for a in range(0, len(words) - PIECE // 2, PIECE // 2)]


def windows(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph, first word and end of the pieces and the shorter windows of the paragraphs begin:end."""
    length, each = end - begin, np.arange(len(begin))
    found = []
    for size, step in (*((n, n // 4) for n in SHORT), (PIECE, PIECE // 2)):
        least = size - step if size == PIECE else size
        count = np.where(length > size, -(-(length - least) // step) + (size != PIECE), size == PIECE)
        of = np.repeat(each, count)
        first = begin[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        if size != PIECE:  # the last one ends with the paragraph
            first = np.minimum(first, end[of] - size)
        found.append(np.stack([of, first, np.minimum(first + size, end[of])]))
    return tuple(np.concatenate(found, 1))


@dataclass
class Model:
    families: list[str]
    keys: np.ndarray  # ascending hashes of the templates' n-grams
    weights: np.ndarray  # n-gram x class
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def features(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known n-grams of the rows, the row of each, and its value."""
        text = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        size = np.array([max(1, 3 * len(r) - 3) for r in rows], float)
        found, of = [], []
        for q in (1, 2, 3):
            g = grams(text, q)
            if not len(g):
                continue
            at = np.searchsorted(self.keys, g)
            hit = np.flatnonzero((self.keys[np.minimum(at, len(self.keys) - 1)] == g) & (owner[: len(g)] == owner[q - 1 :]))
            found.append(at[hit])
            of.append(owner[hit])
        place, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, of))
        return place, row, 1 / np.sqrt(size[row])

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        place, row, value = self.features(rows)
        out = np.tile(self.bias, (len(rows), 1))
        np.add.at(out, row, self.weights[place] * value[:, None])
        return out / self.temperature

    def window_logits(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """logits() of words[start:stop], from running sums of the weights of the known n-grams."""
        out = np.zeros((len(start), len(self.families)))
        for q in (1, 2, 3):
            g = grams(words, q)
            at = np.searchsorted(self.keys, g)
            hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == g)
            total = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(self.weights[at[hit]], 0)])
            low = np.searchsorted(hit, start)
            out += total[np.maximum(np.searchsorted(hit, stop - q + 1), low)] - total[low]
        return (self.bias + out / np.sqrt(np.maximum(1, 3 * (stop - start) - 3))[:, None]) / self.temperature

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.shares(self.logits(rows))

    def shares(self, z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def template_values() -> dict[str, list[np.ndarray]]:
    return {family: [values(t.encode()) for t in texts] for family, texts in TEMPLATES.items()}


def variants(rng: np.random.Generator, other: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """Of the templates, among as many words of paragraphs that are none as windows and pieces can hold."""
    rows, classes = [], []
    text = np.concatenate([*other, np.zeros(0, np.uint64)])

    def foreign(n):
        if len(text) <= n or rng.random() < 0.5:
            return rng.integers(0, 1 << 63, n, np.uint64)
        a = int(rng.integers(len(text) - n))
        return text[a : a + n]

    for k, texts in enumerate(template_values().values(), 1):
        for words in texts:
            for i in range(VARIANTS):
                w = words
                if i and len(w) > 12 and rng.random() < 0.5:  # a part of a long notice
                    n = int(rng.integers(max(8, len(w) // 2), len(w) + 1))
                    a = int(rng.integers(len(w) - n + 1))
                    w = w[a : a + n]
                if i and len(w) > 5:
                    w = w[rng.random(len(w)) > 0.08]
                if i and rng.random() < 0.8:
                    size = int(rng.choice([len(w) + 5, *SHORT, PIECE]))
                    room = int(rng.integers(max(size - len(w), 0) + 1))
                    before = int(rng.integers(room + 1))
                    w = np.concatenate([foreign(before), w, foreign(room - before)])
                rows.append(w)
                classes.append(k)
    return rows, classes


def train(other: list[np.ndarray]) -> Model:
    """From the templates' variants, and paragraphs that are none."""
    rng = np.random.default_rng(SEED)
    texts = template_values()
    keys = np.unique(np.concatenate([grams(w, q) for ws in texts.values() for w in ws for q in (1, 2, 3)]))
    families = [OTHER, *texts]
    model = Model(families, keys, np.zeros((len(keys), len(families))), np.zeros(len(families)))
    every = [w for ws in texts.values() for w in ws]
    other = [r for r in other if len(r) and not any(_holds(w, r) for w in every if np.isin(w, r).mean() > 0.7)]
    rows, classes = variants(rng, other)
    for n in SHORT:  # a window of each
        other = [*other, *(r[a : a + n] for r in other if len(r) > n for a in [int(rng.integers(len(r) - n + 1))])]
    words = np.unique(np.concatenate(every))
    salad = [rng.choice(words, int(rng.integers(2, 20))) for _ in range(300)]  # licence words in no order
    foreign = [rng.integers(0, 1 << 63, int(rng.integers(1, 40)), np.uint64) for _ in range(300)]
    rows, y = [*rows, *other, *salad, *foreign], np.array([*classes, *[0] * (len(other) + len(salad) + len(foreign))])
    held = rng.random(len(rows)) < 0.25
    fit = np.flatnonzero(~held)
    place, row, value = model.features([rows[i] for i in fit])
    target = np.eye(len(families))[y[fit]]
    share = np.bincount(y[fit], minlength=len(families)).astype(float)
    weight = (1 / np.maximum(share, 1))[y[fit]][:, None]
    by_row, by_place = np.argsort(row, kind="stable"), np.argsort(place, kind="stable")
    row_starts, place_starts = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (row[by_row], place[by_place]))
    params = np.zeros((len(keys) + 1, len(families)))
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        z = np.tile(params[-1], (len(fit), 1))
        z[row[by_row][row_starts]] += np.add.reduceat((params[place] * value[:, None])[by_row], row_starts)
        e = np.exp(z - z.max(1, keepdims=True))
        pull = (e / e.sum(1, keepdims=True) - target) * weight / len(families)
        grad = np.zeros_like(params)
        grad[place[by_place][place_starts]] = np.add.reduceat((pull[row] * value[:, None])[by_place], place_starts)
        grad[-1] = pull.sum(0)
        grad[:-1] += 1e-6 * params[:-1]
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        params -= 0.2 * mean / (1 - 0.9**step) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    model.weights, model.bias = params[:-1], params[-1]
    check = [rows[i] for i in np.flatnonzero(held)]
    truth = y[held]
    z = model.logits(check)
    losses = []
    for t in (grid := np.geomspace(0.25, 8, 26)):
        scaled = z / t
        losses.append(float((np.log(np.exp(scaled - scaled.max(1, keepdims=True)).sum(1)) + scaled.max(1) - scaled[np.arange(len(truth)), truth]).mean()))
    model.temperature = float(grid[int(np.argmin(losses))])
    p = model.probabilities(check)
    wrong = p[truth == 0, 1:].max(1) if (truth == 0).any() else np.zeros(1)
    model.least = float(max(0.5, np.quantile(wrong, 1 - PASS)))
    return model


def _holds(template: np.ndarray, words: np.ndarray) -> float:
    """1 less the edits per word of the template in its closest occurrence, 0 beyond MOST_EDITS."""
    edits, _ = edit_distance(template, words)
    likeness = 1 - edits / len(template)
    return likeness if likeness >= 1 - MOST_EDITS else 0.0


def settled(places: dict[tuple[str, int, int], tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """Probability and likeness of the families that occur in a paragraph, from where their templates
    do. Templates of several families may be like the same words; there the likest one counts."""
    kept: list[tuple[str, int, int]] = []
    out: dict[str, tuple[float, float]] = {}
    for (likeness, share), (name, a, b) in sorted(((found, place) for place, found in places.items()), reverse=True):
        if not any(name != other and min(b, d) - max(a, c) > min(b - a, d - c) / 2 for other, c, d in kept):
            kept.append((name, a, b))
            out[name] = tuple(np.maximum(out.get(name, (0.0, 0.0)), (share, likeness)).tolist())
    return out


def sample(docs: DataFrame) -> list[np.ndarray]:
    """Paragraphs of the SAMPLE_DOCS texts with the smallest hashes, SAMPLE_LINES at most. Hashes alone are
    sorted; the texts follow by a join, equal ones once."""
    order = F.xxhash64("text", F.lit(SEED))
    texts = docs.where(F.col("text").isNotNull()).select(order.alias("h"), "text")
    chosen = texts.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)
    texts = texts.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"), "h")
    lines = lines.where(F.length("line") > 0).select(F.xxhash64("line", "h").alias("h"), "line").orderBy("h", "line").limit(SAMPLE_LINES).collect()
    return [piece for r in lines for piece in pieces(values(r.line.encode()))]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, paragraph (its number, from 0), family, probability, likeness: of every paragraph that
    is likelier a licence than not, a row for each family that occurs in it; family is "unknown" where neither calibrated probability nor a
    template settles one, and likeness that of the family's closest template."""
    source = pick(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    kept = docs.sparkSession.sparkContext.broadcast(train(sample(source)))

    def run(batches):
        model, texts = kept.value, template_values()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_groups(offsets, CHUNK_BYTES):
                own = data[offsets[a] : offsets[b]]
                words, ends, begins = word_values(own, offsets[a : b + 1] - offsets[a])
                if not len(words):
                    continue
                # a paragraph's words have the same text and the same number of line ends before them
                text = np.repeat(np.arange(a, b), np.diff(ends, prepend=0))
                line = np.concatenate([[0], np.cumsum(own == 0x0A)])[begins]
                firsts = np.concatenate([[0], np.cumsum(own == 0x0A)])[offsets[a:b] - offsets[a]]
                cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(line) != 0)) + 1
                begin, end = np.concatenate([[0], cut]), np.append(cut, len(words))
                unknown: dict[tuple[int, int], tuple] = {}
                places: dict[tuple[int, int], dict] = {}
                while len(begin):
                    part, start, stop = windows(begin, end)
                    p = model.shares(model.window_logits(words, start, stop))
                    taken: dict[int, set] = {}
                    for k in np.flatnonzero(p[:, 0] < 0.5).tolist():
                        family = int(p[k, 1:].argmax()) + 1
                        name = model.families[family]
                        first, last = int(begin[part[k]]), int(end[part[k]])
                        of = int(text[first]), int(line[first] - firsts[text[first] - a])
                        far = 2 * max(map(len, texts[name]))
                        low = max(int(start[k]) - far, first)
                        around = words[low : min(int(stop[k]) + far, last)]
                        held = [(1 - edits / len(w), max(low + at - len(w), first), low + at) for w in texts[name] for edits, at in [edit_distance(w, around)] if edits <= MOST_EDITS * len(w)]
                        share = float(p[k, family])
                        if share >= model.least and held:
                            for likeness, *place in held:
                                mine = places.setdefault(of, {})
                                mine[name, *place] = max(mine.get((name, *place), (0.0, 0.0)), (likeness, share))
                                taken.setdefault(int(part[k]), set()).add(tuple(place))
                        else:
                            unknown[of] = max(unknown.get(of, (0.0, 0.0)), (share, max((h[0] for h in held), default=0.0)))
                    # what is left beside a notice is read again without it, as a louder one drowns its neighbour
                    gaps = []
                    for k, found in taken.items():
                        at = int(begin[k])
                        for low, high in [*sorted(found), (int(end[k]), 0)]:
                            if low > at:
                                gaps.append((at, low))
                            at = max(at, high)
                    begin, end = np.array(gaps, np.int64).reshape(-1, 2).T
                best = {(*of, UNKNOWN): found for of, found in unknown.items() if of not in places}
                for of, mine in places.items():
                    best |= {(*of, name): found for name, found in settled(mine).items()}
                if best:
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i for i, *_ in keys])), pa.array([n for _, n, _ in keys], pa.int32()), pa.array([f for *_, f in keys]), pa.array([best[k][0] for k in keys]), pa.array([best[k][1] for k in keys])],
                        ["doc_id", "paragraph", "family", "probability", "likeness"],
                    )

    return source.mapInArrow(run, "doc_id long, paragraph int, family string, probability double, likeness double")
