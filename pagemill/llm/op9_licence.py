"""Licence scan by a trained paragraph classifier.

Paragraphs are scored as units of up to UNIT words, and every word of a text is
in one at least: the lines, and, where a block (what stands between blank lines)
has several lines or a longer one, its overlapping windows of UNIT words, in
which wrapped lines are joined. A unit's features are its word 1- and 2-grams
that licences use, counted, over the root of its length. A softmax regression
over them gives the probabilities of the licence families, of a licence of no
known family, and of none. All units are scored alike; no list of words decides
which ones the model sees.

It is trained here: on the templates below and variations of them (words changed
or left out, set among other words); for licences of no known family, on the
templates with the words that tell their family replaced by other words and by
names that no family has; and, as the class without licence, on whole units of a
bounded sample of the corpus, licence words or not, but for those that resemble
a template, and on mixtures of licence words. Temperature and threshold are set
on a fifth that training does not see: the threshold on the probability of any
licence is at least what all but FALSE_RATE of the corpus's units stay below,
and stands half way, in logits, between that and what all but FALSE_RATE of the
units with a licence reach, where this is higher. Without a template that
confirms it, a unit must also pass what all but MIXED_RATE of the mixtures of
licence words stay below.

A family is confirmed by comparison with its templates: words count by how few
families use them, and a unit (with UNIT words of its block on either side) must
hold CONFIRM of a template's weight in the template's order (longest common
subsequence), and CONFIRM of the words that fewest families share, so that a
licence of another name or version is not taken for it; nor is one whose name
goes on with another family's. A unit has every family so confirmed, compared
with all of them, but those whose naming words stand in a heavier match of
another (BY in BY-SA; of equal ones the first in FAMILIES stays). What passes the
threshold and is confirmed by no template is of the unknown class. `probability`
is that of any licence, as the comparison tells which.

Defined results: a null or empty text has no paragraph and no licence; a very
long text or line is scored in windows, whole; equal paragraphs get equal
results; null ids and repeated rows keep their rows; an empty table gives an
empty result, and an empty sample a model of the templates alone; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

# Families and sentences of their public licence texts and notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPL v2.",
        "Licensed under the GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL v3.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Released under CC0 1.0 Universal, public domain dedication.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ],
}
# End of fixed values.
FAMILIES = tuple(TEMPLATES)
UNKNOWN, NONE = len(FAMILIES), len(FAMILIES) + 1
CLASSES = NONE + 1

UNIT = 64
STEP = UNIT // 2
#: Documents and units of the sample that stands for text without licence.
SAMPLE, SAMPLE_UNITS = 2000, 20_000
VARIATIONS = 24
FALSE_RATE = 0.001
#: Share of the mixtures of licence words that may pass as a licence of no known family.
MIXED_RATE = 0.02
CONFIRM = 0.7
#: Tokens that a task works on at a time, but for a longer text.
AT_ONCE = 200_000

_WORD = re.compile(r"[a-z]+(?:\.?\d+)*|\d+(?:\.\d+)*")
_TOKEN = re.compile(_WORD.pattern + r"|\n")
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


# -- features ---------------------------------------------------------------


@lru_cache(maxsize=1)
def vocabulary() -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the templates' words, and their 2-grams as ascending first * size + second."""
    lines = [words(t) for ts in TEMPLATES.values() for t in ts]
    of = {w: i for i, w in enumerate(sorted({w for x in lines for w in x}))}
    return of, np.array(sorted({of[a] * len(of) + of[b] for x in lines for a, b in zip(x, x[1:])}), np.int64)


def dimensions() -> int:
    return sum(map(len, vocabulary()))


def occurrences(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, feature) of the 1- and 2-grams in a run of word numbers; numbers
    below 0 are other words or breaks. A 2-gram stands where it ends."""
    of, pairs = vocabulary()
    at = np.flatnonzero(ids >= 0)
    second = at[1:][np.diff(at) == 1]
    key = ids[second - 1] * len(of) + ids[second]
    found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    known = pairs[found] == key
    return np.concatenate([at, second[known]]), np.concatenate([ids[at], len(of) + found[known]])


def numbers(tokens: list[str]) -> np.ndarray:
    of, _ = vocabulary()
    return np.fromiter((of.get(t, -1) for t in tokens), np.int64, len(tokens))


# -- templates --------------------------------------------------------------


@lru_cache(maxsize=1)
def weights_of_words() -> dict[str, float]:
    """A word's weight falls with the number of families that use it."""
    families: dict[str, set[str]] = {}
    for f, lines in TEMPLATES.items():
        for w in {w for t in lines for w in words(t)}:
            families.setdefault(w, set()).add(f)
    return {w: float(np.log1p(len(FAMILIES) / len(f))) for w, f in families.items()}


@lru_cache(maxsize=1)
def compared() -> list[list[tuple[list[str], np.ndarray, np.ndarray]]]:
    """For each family (words, weights, names) of its templates; names: which words fewest families share."""
    of = weights_of_words()
    out = []
    for f in FAMILIES:
        own = []
        for t in TEMPLATES[f]:
            w = words(t)
            x = np.array([of[y] for y in w])
            own.append((w, x, x >= x.max() - 1e-9))
        out.append(own)
    return out


def common_order(a: list[str], b: list[str], weight: np.ndarray) -> np.ndarray:
    """For each word of b its place in a in the heaviest common subsequence of both, -1 where it has none."""
    position: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        position.setdefault(w, []).append(j)
    kept = [i for i, w in enumerate(a) if w in position]
    line = np.zeros((len(kept) + 1, len(b) + 1))
    for i, w in enumerate(a[k] for k in kept):
        row = line[i].copy()
        for j in position[w]:
            row[j + 1] = max(row[j + 1], line[i, j] + weight[j])
        line[i + 1] = np.maximum.accumulate(row)
    taken = np.full(len(b), -1)
    i, j = len(kept), len(b)
    while i and j:
        if line[i, j] == line[i, j - 1]:
            j -= 1
        elif line[i, j] == line[i - 1, j]:
            i -= 1
        else:
            taken[j - 1] = kept[i - 1]
            i, j = i - 1, j - 1
    return taken


@dataclass
class Match:
    """How a text holds a template."""

    share: float  # of its weight
    weight: float
    places: frozenset[int]  # of its words in the text
    names: frozenset[int]  # of those that name the family


def longer_name(text: list[str], template: list[str], weight: np.ndarray, place: np.ndarray) -> bool:
    """Whether the text goes on with the name of another family right inside the template's name: between
    two neighbouring words of the template, of which few families use the second and the first or the one
    before it, stand one or two words, all of which are one family's own. So BY-NC-SA is not BY-NC, while MIT or Apache-2.0 is both."""
    of = weights_of_words()
    own, few = float(np.log1p(len(FAMILIES))), float(np.log1p(len(FAMILIES) / 4)) - 1e-9
    for j in range(len(template) - 1):
        if place[j] >= 0 and place[j + 1] >= 0 and max(weight[max(0, j - 1) : j + 1]) >= few and weight[j + 1] >= few:
            between = text[place[j] + 1 : place[j + 1]]
            if 0 < len(between) <= 2 and all(of.get(w, 0.0) >= own - 1e-9 for w in between):
                return True
    return False


def resemblance(text: list[str], family: int) -> Match | None:
    """The family's template that the text holds best; none if it lacks the words that name the family."""
    have = set(text)
    best = None
    for w, weight, names in compared()[family]:
        there = np.array([x in have for x in w])
        if weight[there].sum() < CONFIRM * weight.sum() or there[names].sum() < CONFIRM * names.sum():
            continue  # no order can hold more
        place = common_order(text, w, weight)
        taken = place >= 0
        if taken[names].sum() >= CONFIRM * names.sum() and not longer_name(text, w, weight, place):
            got = Match(float(weight[taken].sum() / weight.sum()), float(weight[taken].sum()), frozenset(place[taken].tolist()), frozenset(place[taken & names].tolist()))
            if best is None or (got.share, got.weight) > (best.share, best.weight):
                best = got
    return best


# -- the model --------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # dimensions + 1 by classes
    temperature: float
    threshold: float  # on the probability of any licence
    unknown: float  # the same for licences that no template confirms

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From sums of the weights of units and their numbers of words."""
        z = (sums / np.sqrt(np.maximum(1, n))[:, None] + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sums(self, feature: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
        """Sums of the weights of each unit's features, each once."""
        unit, feature = np.divmod(np.unique(unit * dimensions() + feature), dimensions())
        out = np.empty((units, CLASSES))
        for k in range(CLASSES):
            out[:, k] = np.bincount(unit, self.weights[feature, k], minlength=units)
        return out

    def of_lines(self, lines: list[str]) -> np.ndarray:
        """Probabilities of lines taken as one unit each."""
        rows, cols, n = _matrix([words(x) for x in lines])
        return self.probabilities(self.sums(cols, rows, len(lines)), n)


def _matrix(units: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, feature) of all occurrences, and the units' numbers of words."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, u in enumerate(units):
        _, f = occurrences(numbers(u))
        f = np.unique(f)
        rows.append(np.full(len(f), i))
        cols.append(f)
    return np.concatenate(rows), np.concatenate(cols), np.array([len(u) for u in units])


def _examples(plain: list[list[str]], rng: np.random.Generator) -> list[tuple[list[str], int]]:
    """Units and classes, plain ones first; plain: units without licence, other words than the templates' being ''."""
    filler = [w for p in plain for w in p] or [""]
    pick = lambda n: [filler[i] for i in rng.integers(len(filler), size=n)]
    value = weights_of_words()
    rare = float(np.log1p(len(FAMILIES) / 2))
    out: list[tuple[list[str], int]] = [(p, NONE) for p in plain]
    for k, f in enumerate(FAMILIES):
        for t in TEMPLATES[f]:
            base = words(t)
            for v in range(VARIATIONS):
                w = list(base)
                for _ in range(int(rng.integers(0, 1 + len(w) // 12)) if v else 0):
                    w[rng.integers(len(w))] = pick(1)[0]
                if v and len(w) > 12 and rng.random() < 0.4:
                    at = int(rng.integers(len(w) - 8))
                    w = w[at:] if rng.random() < 0.5 else w[: at + 8]
                room = max(0, UNIT - len(w))
                before = int(rng.integers(0, 1 + (room if v % 3 == 2 else min(room, 6)))) if v else 0
                after = int(rng.integers(0, 1 + (room - before if v % 3 == 2 else min(room - before, 6)))) if v else 0
                out.append(([*pick(before), *w, *pick(after)], k))
                # the same words under a name, or of a version, that no family has
                if v < VARIATIONS // 2:
                    other = [x if value[x] < rare else (pick(1)[0] if rng.random() < 0.5 else "") for x in base]
                    if sum(value[x] < rare for x in base) >= 4:
                        out.append(([*pick(before), *other, *pick(after)], UNKNOWN))
    # licence words without a licence teach that words alone are not enough: some of
    # a template's words out of their order, among others
    lines = [words(t) for ts in TEMPLATES.values() for t in ts]
    for _ in range(len(plain) // 4 + 1000):
        base = lines[rng.integers(len(lines))]
        some = [w for w in base if rng.random() < 0.4] or base[:1]
        w = [*some[:UNIT], *pick(int(rng.integers(0, 3 + 2 * len(some))))]
        out.append(([w[i] for i in rng.permutation(len(w))[:UNIT]], NONE))
    return out


def fit(plain: list[list[str]], seed: int = 0, rounds: int = 80) -> Model:
    """plain: the words of units without licence."""
    rng = np.random.default_rng(seed)
    data = _examples(plain, rng)
    at = rng.permutation(len(data))
    cut = len(at) * 4 // 5
    y = np.array([data[i][1] for i in at])
    rows, cols, n = _matrix([data[i][0] for i in at])
    scale = 1 / np.sqrt(np.maximum(1, n))
    train = rows < cut
    tr, tc, ts = rows[train], cols[train], scale[rows[train]]
    share = np.bincount(y[:cut], minlength=CLASSES)
    weight = np.minimum(20, cut / CLASSES / np.maximum(1, share))[y[:cut]][:, None] / cut
    dim = dimensions()
    w, g2 = np.zeros((dim + 1, CLASSES)), np.full((dim + 1, CLASSES), 1e-6)
    for _ in range(rounds):  # full-batch AdaGrad
        z = np.stack([np.bincount(tr, ts * w[tc, k], minlength=cut) for k in range(CLASSES)], axis=1) + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(cut), y[:cut]] -= 1
        p *= weight
        for k in range(CLASSES):
            g = np.bincount(tc, ts * p[tr, k], minlength=dim + 1) + 1e-6 * w[:, k]
            g[-1] = p[:, k].sum()
            g2[:, k] += g * g
            w[:, k] -= 0.5 * g / np.sqrt(g2[:, k])
    raw = Model(w, 1.0, 0.0, 0.0)
    held = rows >= cut
    sums, size, truth = raw.sums(cols[held], rows[held] - cut, len(y) - cut), n[cut:], y[cut:]
    loss = lambda t: -np.log(np.maximum(Model(w, t, 0, 0).probabilities(sums, size)[np.arange(len(truth)), truth], 1e-12)).mean()
    t = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    some = np.clip(1 - Model(w, t, 0, 0).probabilities(sums, size)[:, NONE], 1e-9, 1 - 1e-9)
    logit = np.log(some / (1 - some))
    real = at[cut:] < len(plain) if plain else truth == NONE
    low = np.quantile(logit[real], 1 - FALSE_RATE) if real.any() else 0.0
    high = np.quantile(logit[truth != NONE], FALSE_RATE) if (truth != NONE).any() else low
    threshold = max(low, (low + high) / 2)
    mixtures = (truth == NONE) & ~real
    unknown = max(threshold, np.quantile(logit[mixtures], 1 - MIXED_RATE)) if mixtures.any() else threshold
    return Model(w, t, *(float(1 / (1 + np.exp(-x))) for x in (threshold, unknown)))


# -- scanning ---------------------------------------------------------------


@dataclass
class Found:
    family: int
    probability: float
    confirmation: float


def judge(model: Model, q: np.ndarray, text: list[str]) -> list[Found]:
    """What a unit of probabilities q is; text: its words and those round it.

    Every family that a template confirms, by its place in FAMILIES, but for one
    whose naming words all stand in a heavier match of another family. Their
    probability is that of any licence, as it is the comparison that tells which.
    """
    any_licence = float(1 - q[NONE])
    if any_licence < model.threshold:
        return []
    got = {i: m for i in range(UNKNOWN) if (m := resemblance(text, i)) is not None and m.share >= CONFIRM}
    within = lambda i, m: any(j != i and m.names <= o.places and (o.weight, -j) > (m.weight, -i) for j, o in got.items())
    out = [Found(i, any_licence, m.share) for i, m in got.items() if not within(i, m)]
    return out or ([Found(UNKNOWN, any_licence, 0.0)] if any_licence >= model.unknown else [])


def scan_texts(model: Model, texts: list[str]) -> list[list[tuple[int, int, Found]]]:
    """For each text (block, line, result) of its units with a licence; line -1: a window of the block."""
    tokens: list[str] = []
    text_of_block: list[int] = []
    ends: list[int] = []
    for i, t in enumerate(texts):
        for b in _BLANK.split(t.lower()):
            tokens += _TOKEN.findall(b)
            tokens.append("\n")
            text_of_block.append(i)
            ends.append(len(tokens))
    out: list[list[tuple[int, int, Found]]] = [[] for _ in texts]
    if not tokens:
        return out
    ids = numbers(tokens)
    is_break = np.fromiter((t == "\n" for t in tokens), bool, len(tokens))
    ids[is_break] = -2
    place, feature = occurrences(ids)
    # 2-grams over a line's end count in windows: the run without breaks
    word_at = np.flatnonzero(~is_break)
    block = np.searchsorted(np.array(ends), word_at, side="right")
    line = (np.cumsum(is_break) - is_break)[word_at]
    rank = np.cumsum(~is_break) - 1  # of a token among the words

    # lines of up to UNIT words
    lines = int(line[-1]) + 1 if len(line) else 0
    n = np.bincount(line, minlength=lines)
    p = model.probabilities(model.sums(feature, line[rank[place]], lines), n)
    first_word = np.searchsorted(line, np.arange(lines))
    hits = np.flatnonzero((1 - p[:, NONE] >= model.threshold) & (n > 0) & (n <= UNIT))
    for x in hits.tolist():
        lo, hi = first_word[x], first_word[x] + n[x]
        b = int(block[lo])
        out[text_of_block[b]] += [(b, x, f) for f in judge(model, p[x], [tokens[j] for j in word_at[lo:hi]])]
    # windows: two cells of STEP words each, in blocks that a single short line does not make
    size = np.bincount(block, minlength=len(ends))
    start = np.cumsum(size) - size
    one_line = np.zeros(len(ends), bool)
    if len(word_at):
        some = np.flatnonzero(size)
        one_line[some] = (line[start[some]] == line[start[some] + size[some] - 1]) & (size[some] <= UNIT)
    run = ids[word_at]
    wide = ~one_line[block]
    breaks = np.flatnonzero(np.diff(block)) + 1
    gapped = np.insert(run, breaks, -2)
    own = np.cumsum(np.insert(np.ones(len(run), np.int64), breaks, 0)) - 1
    place, feature = occurrences(gapped)
    place = own[place]
    keep = wide[place]
    place, feature = place[keep], feature[keep]
    cells_of = -(-size // STEP)
    cell_start = np.cumsum(cells_of) - cells_of
    cell = cell_start[block] + (np.arange(len(run)) - start[block]) // STEP
    cells = int(cells_of.sum())
    n = np.bincount(cell, minlength=cells)
    block_of_cell = np.repeat(np.arange(len(ends)), cells_of)
    pair = np.append(block_of_cell[1:] == block_of_cell[:-1], np.zeros(min(1, cells), bool))
    first = np.append(np.ones(min(1, cells), bool), ~pair[:-1])
    # window c is cell c and the next of its block
    here = cell[place]
    back = (here > 0) & pair[here - 1]
    p = model.probabilities(model.sums(np.append(feature, feature[back]), np.append(here, here[back] - 1), cells), n + np.where(pair, np.roll(n, -1), 0))
    hits = np.flatnonzero((1 - p[:, NONE] >= model.threshold) & (pair | first) & ~one_line[block_of_cell])
    for c in hits.tolist():
        b = int(block_of_cell[c])
        lo = int(start[b] + (c - cell_start[b]) * STEP)
        lo, hi = max(int(start[b]), lo - UNIT), min(int(start[b] + size[b]), lo + 2 * UNIT)
        out[text_of_block[b]] += [(b, -1, f) for f in judge(model, p[c], [tokens[j] for j in word_at[lo:hi]])]
    return out


def summary(units: list[tuple[int, int, Found]]) -> tuple[int, int, str, float, float]:
    """(n_licensed, n_unknown, families, probability, confirmation) of a text's units: a line
    counts once, whatever it holds; a block's windows where none of its lines has their family, once for each."""
    of_lines: dict[int, set[int]] = {}
    for b, x, f in units:
        if x >= 0:
            of_lines.setdefault(b, set()).add(f.family)
    known = [f for _, x, f in units if x >= 0 and f.family != UNKNOWN]
    unknown = sum(f.family == UNKNOWN for _, x, f in units if x >= 0)
    windows: dict[tuple[int, int], Found] = {}
    for b, x, f in units:
        if x < 0 and f.family not in of_lines.get(b, ()):
            if (b, f.family) not in windows or windows[b, f.family].confirmation < f.confirmation:
                windows[b, f.family] = f
    known += [f for f in windows.values() if f.family != UNKNOWN]
    # a window is unknown where nothing in its block is known
    settled = set(of_lines) | {b for (b, k) in windows if k != UNKNOWN}
    unknown += sum(k == UNKNOWN and b not in settled for b, k in windows)
    licensed = len({(b, x) for b, x, f in units if x >= 0 and f.family != UNKNOWN}) + sum(k != UNKNOWN for _, k in windows)
    return licensed, unknown, ",".join(sorted({FAMILIES[f.family] for f in known})), max((f.probability for f in known), default=0.0), max((f.confirmation for f in known), default=0.0)


def sampled_units(docs: DataFrame, sample: int = SAMPLE, units: int = SAMPLE_UNITS) -> list[list[str]]:
    """Words of `units` units at most of `sample` documents, both chosen by hash; words
    that no template has are ''. Units that hold half of a template's weight are left out."""
    few = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(few), "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = weights_of_words()
        for b in batches:
            for t in b.column("text"):
                out = set()
                for block in _BLANK.split(t.as_py()):
                    w = words(block)
                    out |= {tuple(x) for x in map(words, block.split("\n")) if 0 < len(x) <= UNIT}
                    out |= {tuple(w[i : i + UNIT]) for i in range(0, max(1, len(w) - STEP), STEP) if w}
                plain = [u for u in out if not any(resembles(u, k) for k in range(len(FAMILIES)))]
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(x if x in of else "-" for x in u) for u in plain], pa.string())], ["unit"])

    got = own.mapInArrow(run, "unit string").distinct().orderBy(F.xxhash64("unit"), "unit").limit(units).toArrow()
    return [["" if x == "-" else x for x in u.split(" ")] for u in got.column("unit").to_pylist()]


def resembles(unit: tuple[str, ...], family: int) -> bool:
    """Whether a unit has half of the weight of a template of the family, and half of the
    words that name it, whatever their order."""
    have = set(unit)
    for w, weight, names in compared()[family]:
        there = np.array([x in have for x in w])
        if weight[there].sum() >= 0.5 * weight.sum() and there[names].sum() >= 0.5 * names.sum():
            return True
    return False


def train(docs: DataFrame, sample: int = SAMPLE, units: int = SAMPLE_UNITS) -> Model:
    """The model, with units of a sample of docs as the class without licence."""
    return fit(sampled_units(docs, sample, units))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs (lines that are not blank), n_licensed, n_unknown, families,
    probability, confirmation for every row; the last three of paragraphs of known families."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(ids: list, texts: list[str]) -> pa.RecordBatch:
            got = [summary(u) for u in scan_texts(shared.value, texts)]
            n = [sum(not x.isspace() for x in t.split("\n") if x) for t in texts]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], ["doc_id", "n_paragraphs", "n_licensed", "n_unknown", "families", "probability", "confirmation"])

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column("doc_id"), b.column("text")):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= 5 * AT_ONCE:
                    yield batch(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield batch(ids, texts)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, n_paragraphs int, n_licensed long, n_unknown long, families string, probability double, confirmation double")


def op9_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents, paragraph by paragraph."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
