"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Each line of a text is a paragraph, and so is a run of lines between blank lines where a notice is wrapped over several
of them. Sparse logistic regression over word unigrams and bigrams names its licence family
or `unknown`; it is trained on disturbed copies of the templates and on a bounded sample of paragraphs of the corpus, and
its probabilities are calibrated on copies that it wasn't trained on. A prediction is confirmed if a template of that
family is found in the paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share

#: Fixed texts: short notices by which works are put under well-known licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
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
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
UNKNOWN = "unknown"
#: Paragraphs of the corpus that train the unknown class, disturbed copies of each template, steps of the fit.
SAMPLE, COPIES, STEPS = 2000, 40, 400
#: Least share of a template's bigrams that confirms, and least calibrated probability that names a family.
CONFIRMS, NAMES = 0.7, 0.5
_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
#: Bytes that can't be in a word, those of other letters among them, separate words.
_CUT = bytes(b if b < 128 and (chr(b).isalnum() or b == 0x2E) else 32 for b in range(256))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(own: list[str]) -> set[str]:
    return {*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))}


@dataclass
class Model:
    families: list[str]
    index: dict[str, int]  # feature: row of the weights
    weights: np.ndarray
    bias: np.ndarray
    sharpness: float
    alert: frozenset[str]  # words without which no feature can occur

    def __post_init__(self):
        self.alert_bytes = frozenset(w.encode() for w in self.alert)

    def probabilities(self, own: list[str]) -> np.ndarray:
        rows = [self.index[f] for f in features(own) if f in self.index]
        z = self.sharpness * (self.bias + self.weights[rows].sum(0))
        p = np.exp(z - z.max())
        return p / p.sum()


def _disturbed(template: str, other: list[list[str]], rng: np.random.Generator) -> list[str]:
    """A copy with words lost or changed, often inside other text."""
    own = [w for w in words(template) if rng.random() > 0.06]
    pool = [w for p in other for w in p] or ["x"]
    own = [pool[rng.integers(len(pool))] if rng.random() < 0.04 else w for w in own]
    extra = lambda: other[rng.integers(len(other))][: rng.integers(0, 12)] if other and rng.random() < 0.4 else []
    return [*extra(), *own, *extra()]


def fit(paragraphs: list[str], seed: int = 0) -> Model:
    """Trains on the templates and on sampled paragraphs, which stand for unknown ones unless they hold a template."""
    rng = np.random.default_rng(seed)
    known = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    plain = [w for p in paragraphs if (w := words(p)) and max(_found(t, w) for _, t in known) < CONFIRMS]
    families = [UNKNOWN, *TEMPLATES]
    common = {w for w, n in Counter(w for p in plain for w in set(p)).items() if n > 0.002 * len(plain)}
    alert = frozenset(w for _, t in known for w in words(t) if w not in common)
    names = sorted({f for _, t in known for f in features(words(t)) if any(w in alert for w in f.split(" "))})
    index = {f: i for i, f in enumerate(names)}
    rows = [(families.index(f), _disturbed(t, plain, rng)) for f, t in known for _ in range(COPIES)] + [(0, p) for p in plain]
    # words of licences out of their order, so that single words don't make a licence
    pool = sorted(alert)
    rows += [(0, [pool[i] for i in rng.integers(len(pool), size=rng.integers(1, 4))] + (plain[rng.integers(len(plain))][:8] if plain else [])) for _ in range(COPIES * len(families))]
    at = [np.array([index[f] for f in features(w) if f in index], int) for _, w in rows]
    y = np.array([f for f, _ in rows])
    held = rng.random(len(rows)) < 0.25
    r, c = np.repeat(np.arange(len(rows)), [len(a) for a in at]), np.concatenate(at) if at else np.zeros(0, int)
    x = np.zeros((len(rows), len(names)), np.float32)
    x[r, c] = 1
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    xt, target = x[~held], np.eye(len(families))[y[~held]]
    for _ in range(STEPS):
        z = xt @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(xt)
        w -= 8.0 * (xt.T @ g + 1e-5 * w)
        b -= 8.0 * g.sum(0)
    # calibration: the sharpness that makes the copies held back likeliest
    z = x[held] @ w + b
    loss = lambda s: float((np.log(np.exp(s * (z - z.max(1, keepdims=True))).sum(1)) - s * (z[np.arange(len(z)), y[held]] - z.max(1))).mean())
    sharp = min(np.geomspace(0.25, 4, 33), key=loss) if held.any() else 1.0
    return Model(families, index, w, b, float(sharp), alert)


#: Lines that a notice in other words may be wrapped over, and the evidence that each further line must add.
STRETCH, LINE_PRICE = 12, 1.0


def _found(template: str, own: list[str]) -> float:
    """Share of the template's word bigrams that the words hold."""
    t = words(template)
    pairs = list(zip(t, t[1:]))
    have = set(zip(own, own[1:]))
    return sum(p in have for p in pairs) / max(1, len(pairs))


#: Templates as (family, text, bigrams, words in which they may be spread), and the places of each bigram's templates.
_KNOWN = [(f, t, len({*zip(words(t), words(t)[1:])}), 2 + int(1.4 * len(words(t)))) for f, ts in TEMPLATES.items() for t in ts]
_HOLDERS: dict[tuple[str, str], list[int]] = {}
for _i, _k in enumerate(_KNOWN):
    for _pair in {*zip(words(_k[1]), words(_k[1])[1:])}:
        _HOLDERS.setdefault(_pair, []).append(_i)


def notices(model: Model, own: list[str]) -> list[tuple]:
    """(first word, end, family, probability, template, similarity) of every notice in the words, without overlaps.

    A notice is a stretch that holds CONFIRMS of a template's bigrams; of overlapping ones the most similar counts, and
    the classifier names its family.
    """
    hits: dict[int, list] = {}
    for i, pair in enumerate(zip(own, own[1:])):
        for k in _HOLDERS.get(pair, ()):
            hits.setdefault(k, []).append((i, pair))
    found = []
    for k, h in hits.items():
        _, _, n, reach = _KNOWN[k]
        i = 0
        while i < len(h):
            seen, j, end = {}, i, 0
            while j < len(h) and h[j][0] < h[i][0] + reach:
                if h[j][1] not in seen:
                    end = h[j][0] + 2
                seen[h[j][1]] = j
                j += 1
            if len(seen) < CONFIRMS * n:
                i += 1
                continue
            while seen[h[i][1]] > i and h[seen[h[i][1]]][0] < end:  # a stray bigram before the notice
                i += 1
            found.append((len(seen) / n, n, -h[i][0], end, k))
            while i < len(h) and h[i][0] < end - 1:
                i += 1
    taken, out = set(), []
    for share, _, start, end, k in sorted(found, reverse=True):
        if taken.isdisjoint(range(-start, end)):
            taken.update(range(-start, end))
            p = model.probabilities(own[-start:end])
            if (best := int(p.argmax())) and p[best] >= NAMES:
                family, template = model.families[best], _KNOWN[k][1]
                if family != _KNOWN[k][0]:
                    share, template = max((_found(t, own[-start:end]), t) for t in TEMPLATES[family])
                out.append((-start, end, family, float(p[best]), template, share))
    return sorted(out)


def scan_text(model: Model, text: str) -> Iterator[tuple]:
    """(paragraph, start, length, family, probability, template, similarity, confirmed) of each paragraph and family named.

    A paragraph's number is that of its first line. A line is a paragraph; lines over which a notice is wrapped count
    with the whole run of lines between blank ones, or by themselves where a run of more than STRETCH lines holds one in
    other words than a template's. A paragraph with several licences gives a row for each.
    """
    # a text without any word that a feature needs is unknown throughout; cut at other characters, words may end in dots
    quick = text.lower().encode("utf-8", "surrogatepass").translate(_CUT).split()
    if model.alert_bytes.isdisjoint(quick) and model.alert_bytes.isdisjoint(w.strip(b".") for w in quick if w[-1:] == b"." or w[:1] == b"."):
        return
    start, run = 0, []
    for k, line in enumerate([*text.split("\n"), ""]):
        if line.strip():
            run.append((k, start, line, words(line)))
        elif run:
            yield from _scan_run(model, run)
            run = []
        start += len(line) + 1


def _scan_run(model: Model, run: list[tuple]) -> Iterator[tuple]:
    """scan_text() of a run of lines: a row for the whole run for each family of wrapped notices, and rows of the other lines."""
    own = [w for r in run for w in r[3]]
    if model.alert.isdisjoint(own):
        return
    line_of = [i for i, r in enumerate(run) for _ in r[3]]
    wrapped, inside, covered = {}, {}, set()
    for a, b, *notice in notices(model, own):
        first, last = line_of[a], line_of[b - 1]
        if first == last:
            inside.setdefault(first, []).append(notice)
        else:
            covered.update(range(first, last + 1))
            if notice[3] > wrapped.get(notice[0], (None,) * 3 + (-1,))[3]:
                wrapped[notice[0]] = notice
    for family, p, template, share in wrapped.values():
        yield run[0][0], run[0][1], run[-1][1] + len(run[-1][2]) - run[0][1], family, p, template, share, share >= CONFIRMS
    lines, single = [r[3] for r in run], {}
    for i, line_words in enumerate(lines):
        if i not in covered and not model.alert.isdisjoint(line_words):
            single[i] = _classified(model, line_words)
    kept = {i for i, c in single.items() if c and c[3] >= CONFIRMS} | set(inside)
    for first, last, (family, p, template, share) in _stretches(model, lines, single, covered | kept):
        covered.update(range(first, last + 1))
        a, b = (0, len(run) - 1) if len(run) <= STRETCH else (first, last)  # a short run is a paragraph as a whole
        yield run[a][0], run[a][1], run[b][1] + len(run[b][2]) - run[a][1], family, p, template, share, share >= CONFIRMS
    for i, (k, start, line, _) in enumerate(run):
        named = set()
        if i not in covered and single.get(i):
            named.add(single[i][0])
            yield k, start, len(line), *single[i], single[i][3] >= CONFIRMS
        for family, p, template, share in inside.get(i, ()):
            if family not in named:
                named.add(family)
                yield k, start, len(line), family, p, template, share, share >= CONFIRMS


def _classified(model: Model, own: list[str]) -> tuple[str, float, str, float] | None:
    """Family, probability, template and similarity of the words, or None if they are unknown."""
    p = model.probabilities(own)
    best = int(p.argmax())
    if not best or p[best] < NAMES:
        return None
    family = model.families[best]
    score, template = max((_found(t, own), -i) for i, t in enumerate(TEMPLATES[family]))
    return family, float(p[best]), TEMPLATES[family][-template], score


def _stretches(model: Model, lines: list[list[str]], single: dict[int, tuple | None], taken: set[int]) -> list[tuple]:
    """(first line, last line, classification) of notices in other words than a template's, wrapped over several lines.

    The classifier reads each stretch of two to STRETCH lines that begins and ends with a line of licence words. Its
    evidence is how much likelier the family is than `unknown`; a stretch counts if that exceeds that of each of its
    lines alone by LINE_PRICE for each further line, the clearest first.
    """
    evidence = lambda p: float(np.log(p[1:].max() + 1e-300) - np.log(p[0] + 1e-300))
    free = [i for i in single if i not in taken]
    alone = {i: evidence(model.probabilities(lines[i])) for i in free}
    found = []
    for x, i in enumerate(free):
        for j in free[x + 1 :]:
            if j - i >= STRETCH or not taken.isdisjoint(range(i, j + 1)):
                break
            own = [w for line in lines[i : j + 1] for w in line]
            e = evidence(model.probabilities(own)) - LINE_PRICE * (j - i)
            if e > max(alone[k] for k in free if i <= k <= j) and (c := _classified(model, own)):
                found.append((-e, i, j, c))
    out, used = [], set()
    for _, i, j, c in sorted(found, key=lambda f: f[:3]):
        if used.isdisjoint(range(i, j + 1)):
            used.update(range(i, j + 1))
            out.append((i, j, c))
    return sorted(out, key=lambda f: f[:2])


def train(docs: DataFrame, text: str = "text") -> Model:
    """fit() with a bounded sample of the corpus' different lines, those with the smallest hashes of all texts' lines."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(x).between(1, 2000))
    own = docs.select(lines.alias("lines"))
    n = own.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    drawn = own.select(F.explode("lines").alias("p")).withColumn("_share", hash_share(F.col("p"), 4)).filter(F.col("_share") < 3 * SAMPLE / max(1, n))
    drawn = drawn.groupBy("p", "_share").count().orderBy("_share", "p").limit(SAMPLE)
    return fit(sorted(r[0] for r in drawn.collect()))


SCHEMA = "paragraph int, start long, length int, family string, probability double, template string, similarity double, confirmed boolean"


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and SCHEMA: a row for each paragraph of each text that is put into a licence family.

    Null and empty texts and those without licences give no row; repeated rows give repeated results; ids may be null;
    texts of any length are read whole; of templates that fit alike the longer counts; other columns are left out,
    whatever their names; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows, at = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for r in scan_text(m, t) if t else ():
                    rows.append(r)
                    at.append(i)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")

