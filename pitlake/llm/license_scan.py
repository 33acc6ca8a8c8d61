"""Licence scan with a trained paragraph classifier.

A logistic regression over sparse word uni- and bigrams tells licence families, an own class for licence-like text of no known family, and plain
text. It is trained here: notices with words dropped, added and cut, against a bounded sample of corpus paragraphs. Temperature and threshold are
calibrated on whole notices that a fold's training has not seen, those of unknown licences among them; below the threshold a family is the unknown class
unless a template supports it (``SUPPORT``). What no template supports is a licence only from the level on that, of the corpus paragraphs left out of training,
one in a thousand at most reaches. A template agrees as far as it holds the passage and the passage holds it, if the passage has a word that
only this family uses, where the template has one, and no word that narrows the licence beyond the template (share alike, no derivatives, lesser).
From ``LEAST_SIMILARITY`` on the prediction is confirmed.

Weights are sparse, so a paragraph without any word that speaks for a licence cannot win over plain text; such paragraphs are passed over
exactly, not by a guess. Paragraphs are lines; long ones are read in overlapping windows to their end, so nothing is cut off. Every window that is not
plain text counts: overlapping windows of one family are one passage, others are passages of their own, and all of them are returned.

Cases: a null or empty text has no licence (family null); repeated rows get equal results; equal probabilities go to the family named first, equal
paragraphs to the earlier one; an empty table gives an empty result and trains on built-in negatives alone; other columns are not read. A very long text is read window by window.

Bounds of the training sample: ``most`` documents, one line of each drawn by hash among its lines with text, of that its first ``SAMPLE_CHARS`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import as_bytes, row_batches

# Short forms of public licence notices.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program."),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0."),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary."),
}
# Identifiers and short tags; trained with their words whole, since one word alone names the licence.
TAGS = {
    "Apache-2.0": ("SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0", "License: Apache 2.0", "Apache-2.0", "Apache License 2.0"),
    "MIT": ("SPDX-License-Identifier: MIT", "License: MIT", "MIT License", "The MIT License (MIT)", "Licensed under MIT"),
    "BSD": ("SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD-3-Clause", "License: BSD", "BSD-3-Clause", "BSD 2-Clause License"),
    "GPL": ("SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "License: GPL-2.0", "License: GPL v3", "License: GPLv3", "License: GPLv2", "GPL-3.0-only", "GPL-2.0-or-later"),
    "LGPL": ("SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "License: LGPL v3", "License: LGPLv3", "License: LGPLv2.1", "LGPL-2.1-or-later"),
    "AGPL": ("SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "License: AGPL v3", "License: AGPLv3", "AGPL-3.0-or-later"),
    "MPL-2.0": ("SPDX-License-Identifier: MPL-2.0", "License: MPL-2.0", "License: MPL 2.0", "MPL-2.0"),
    "CC-BY": ("SPDX-License-Identifier: CC-BY-4.0", "License: CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"),
    "CC-BY-SA": ("SPDX-License-Identifier: CC-BY-SA-4.0", "License: CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "CC-BY-NC": ("SPDX-License-Identifier: CC-BY-NC-4.0", "License: CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0"),
    "CC0": ("SPDX-License-Identifier: CC0-1.0", "License: CC0 1.0", "License: CC0", "CC0-1.0"),
    "Unlicense": ("SPDX-License-Identifier: Unlicense", "License: Unlicense", "The Unlicense"),
}
# Names that stand in a sentence of another language, and such sentences.
SPOKEN_NAMES = {
    "Apache-2.0": "Apache 2.0", "MIT": "MIT", "BSD": "BSD", "GPL": "GPL v3", "LGPL": "LGPL v3", "AGPL": "AGPL v3", "MPL-2.0": "MPL 2.0", "CC-BY": "CC BY 4.0", "CC-BY-SA": "CC BY-SA 4.0",
    "CC-BY-NC": "CC BY-NC 4.0", "CC0": "CC0 1.0", "Unlicense": "Unlicense",
}
SPOKEN = ("Veröffentlicht unter der {}-Lizenz.", "Publié sous licence {}.", "Publicado bajo la licencia {}.")
for _family, _name in SPOKEN_NAMES.items():
    TAGS[_family] += tuple(sentence.format(_name) for sentence in SPOKEN)
UNKNOWN_TAGS = ("CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", *(sentence.format("CC BY-ND 4.0") for sentence in SPOKEN), "SPDX-License-Identifier: LicenseRef-Vendor", "License: proprietary", "License: commercial", "SPDX-License-Identifier: NONE", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib")
UNKNOWN_NOTICES = (
    "All rights reserved.",
    "Copyright by the authors. All rights reserved.",
    "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "Licensed under the terms of our customer agreement.",
    "Use of this software is subject to a commercial license agreement.",
    "Proprietary and confidential. No part may be reproduced without permission of the copyright holder.",
    "You may use this font under the vendor license.",
    "This dataset is licensed for academic research only.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This package may be redistributed under the terms of the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This database is made available under the Open Database License.",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
)
# Words that narrow or change a licence whose other words stay the same.
NARROWING = frozenset("nd noderivatives noderivs sa sharealike nc noncommercial lesser affero library".split())
# Sentences that use the same words and are no notices.
PLAIN_SENTENCES = (
    "She renewed her driving license at the town hall.", "The pub lost its license to sell drinks after the trial.", "He was granted permission to leave the country.",
    "The general public was free to visit the foundation.", "The court spoke about the rights of the author.", "A public domain is a wide and open field.",
    "The software was sold in two versions last year.", "A version of the story was released under another name.", "The work of the commons committee is done.",
    "They distributed copies of the program at the door.", "The library is free for any person with a card.", "The source of the river is in the mountains.",
    "The following conditions were good for sailing.", "They may not use this road in winter.", "The creative director left the company by four.",
    "She studied at MIT and took the train home.", "Er kam mit dem Zug und fuhr mit dem Boot.", "The clause of the contract was read by two or three people only.", "They met a later train at 2.0 miles.",
)
PLAIN, UNKNOWN = "plain", "unknown"
CLASSES = (PLAIN, *NOTICES, UNKNOWN)

SAMPLE_PARAGRAPHS = 1000
VARIANTS = 30
WINDOW, STRIDE = 60, 30
SAMPLE_CHARS = 16 * WINDOW
SUPPORT = 0.5
ROUNDS = 150
FOLDS, FOLD_ROUNDS = 3, 60
RUN_GAP = 6
LEAST_SIMILARITY = 0.8
SPARSITY = 5e-4
NOT_ALONE = frozenset({"mit"})  # also a common German word: it speaks for a licence only beside another word
TOKEN = re.compile(r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


def grams(words: Sequence[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Model:
    """Plain values only: a few thousand weights, sent to every task with the function."""

    weights: dict[str, np.ndarray]  # gram -> weight per class, grams with any weight
    bias: np.ndarray
    cues: frozenset[str]  # words without which no class beats plain text
    threshold: float
    level: float  # least probability of not being plain text
    temperature: float
    templates: dict[str, list[tuple[tuple[str, ...], frozenset[str]]]]  # words, and those that no other family uses

    def scores(self, words: Sequence[str]) -> np.ndarray:
        total = self.bias.copy()
        for g in grams(words):
            if (w := self.weights.get(g)) is not None:
                total += w
        return total

    def predict(self, words: Sequence[str]) -> tuple[str, float]:
        """Family (or unknown, or plain) and its calibrated probability."""
        if self.cues.isdisjoint(words):
            return PLAIN, 1.0
        s = self.scores(words) / self.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(p.argmax())
        name, sure, licence = CLASSES[best], float(p[best]), float(1 - p[0])
        if name == PLAIN or (name != UNKNOWN and (sure >= self.threshold or self.similarity(name, words) >= SUPPORT)):
            return name, sure
        if licence < self.level:
            return PLAIN, float(p[0])
        return UNKNOWN, sure if name == UNKNOWN else licence

    def similarity(self, family: str, words: Sequence[str]) -> float:
        """Agreement of the words with the family's nearest template, both ways; see ``agreement``."""
        return max((agreement(words, *t) for t in self.templates.get(family, ())), default=0.0)


def agreement(words: Sequence[str], template: Sequence[str], own: frozenset[str] = frozenset()) -> float:
    """The smaller of two shares: of the template's grams that a run of the words holds, and of the run's words that the template holds.

    A run reaches from one pair of neighbouring words of the template to another, with at most ``RUN_GAP`` words between two pairs. A run with a narrowing
    word on it or beside it that the template lacks agrees in nothing, nor does one without any of the words ``own`` to the family, if the template has some.
    """
    held, single = grams(template), set(template)
    at = [i for i, (a, b) in enumerate(zip(words, words[1:], strict=False)) if f"{a} {b}" in held]
    best, start = 0.0, 0
    for k, i in enumerate(at):
        if k + 1 < len(at) and at[k + 1] - i <= RUN_GAP:
            continue
        run = words[at[start]:i + 2]
        around = words[max(0, at[start] - 1):i + 4]
        start = k + 1
        if not (NARROWING & set(around)) - single and (not own or own & set(run)):
            best = max(best, min(len(grams(run) & held) / len(held), sum(w in single for w in run) / len(run)))
    return best


def variants(notice: str, filler: Sequence[str], rng: np.random.Generator, n: int) -> Iterator[list[str]]:
    words = words_of(notice)
    yield words
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.08] or words
        before, after = (list(rng.choice(filler, rng.integers(0, 12))) for _ in range(2))
        yield before + kept + after


def tagged(tag: str, filler: Sequence[str], rng: np.random.Generator, n: int) -> Iterator[list[str]]:
    """A tag alone and between other words."""
    words = words_of(tag)
    yield words
    for _ in range(n - 1):
        before, after = (list(rng.choice(filler, rng.integers(0, 24))) for _ in range(2))
        yield before + words + after


def fit(samples: Sequence[Sequence[str]], labels: np.ndarray, names: Sequence[str], rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Multinomial logistic regression over the n-grams ``names`` by accelerated proximal gradient; the absolute penalty makes weights exactly zero."""
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(samples), len(names)), np.float32)
    for row, words in enumerate(samples):
        x[row, [place[g] for g in grams(words) if g in place]] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[labels]
    balance = (1 / np.maximum(1, y.sum(axis=0)))[labels][:, None] / len(CLASSES)
    balance = balance / balance.sum()
    w, b = np.zeros((len(names), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    ahead, ahead_b, momentum = w, b, 1.0
    step = 4 / max(1.0, float((balance * (x * x).sum(axis=1, keepdims=True)).sum()))
    for _ in range(rounds):
        s = x @ ahead + ahead_b
        s = np.exp(s - s.max(axis=1, keepdims=True))
        gap = (s / s.sum(axis=1, keepdims=True) - y) * balance
        moved = ahead - step * (x.T @ gap)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSITY, 0)
        new_b = ahead_b - step * gap.sum(axis=0)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, ahead_b = new + (momentum - 1) / following * (new - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new, new_b, following
    used = np.nonzero(np.abs(w).sum(axis=1) > 0)[0]
    return {names[i]: w[i].astype(np.float64) for i in used}, b.astype(np.float64)


def cue_words(weights: dict[str, np.ndarray], common: dict[str, int]) -> frozenset[str]:
    """For every gram that speaks for some class against plain text, its word that is rarest in plain text."""
    return frozenset(min(g.split(" "), key=lambda w: (common.get(w, 0), w)) for g, w in weights.items() if (w[1:] > w[0]).any())


def family_templates() -> dict[str, list[tuple[tuple[str, ...], frozenset[str]]]]:
    listed = {family: [tuple(words_of(n)) for n in (*notices, *TAGS[family])] for family, notices in NOTICES.items()}
    unknown = {w for n in (*UNKNOWN_NOTICES, *UNKNOWN_TAGS) for w in words_of(n)}
    out = {}
    for family, templates in listed.items():
        others = unknown.union(*(t for f, ts in listed.items() if f != family for t in ts))
        out[family] = [(t, frozenset(t) - others) for t in templates]
    return out


def calibrated(scores: np.ndarray, truth: np.ndarray, corpus: np.ndarray) -> tuple[float, float, float]:
    """(temperature, threshold, level) from scores of notices and paragraphs that training has not seen; ``corpus`` marks the corpus paragraphs.

    The temperature has the best likelihood; families at or above the threshold are right in 95 of 100 cases, unknown licences counting as wrong.
    """
    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    z = np.exp(scores / temperature - (scores / temperature).max(axis=1, keepdims=True))
    p, right = z.max(axis=1) / z.sum(axis=1), z.argmax(axis=1) == truth
    family = (z.argmax(axis=1) > 0) & (z.argmax(axis=1) < len(CLASSES) - 1)
    levels = [t for t in np.arange(0.3, 0.96, 0.05) if (keep := family & (p >= t)).any() and right[keep].mean() >= 0.95]
    licence = 1 - np.exp(scores[corpus, 0] / temperature - (scores[corpus] / temperature).max(axis=1)) / z[corpus].sum(axis=1)
    level = float(np.quantile(licence, 0.999)) if len(licence) else 0.0
    return temperature, float(min(levels, default=0.95)), min(0.9, max(0.5, level))


def build(negatives: Sequence[str], seed: int = 3) -> Model:
    """Train on notices, built-in sentences and ``negatives`` (a bounded sample of corpus paragraphs); calibrate on whole notices left out in turn."""
    rng = np.random.default_rng(seed)
    templates = family_templates()
    every = [frozenset(grams(words_of(n))) for ns in (*NOTICES.values(), UNKNOWN_NOTICES) for n in ns]
    tags = [frozenset(grams(words_of(t))) for ts in (*TAGS.values(), UNKNOWN_TAGS) for t in ts]
    plain = [words_of(p)[:WINDOW] for p in negatives]
    plain = [p for p in plain if p and max(len(grams(p) & t) / len(t) for t in every) < 0.3 and not any(len(t) > 1 and t <= grams(p) for t in tags)]
    filler = sorted({w for p in plain for w in p} | {w for s in PLAIN_SENTENCES for w in words_of(s)})
    # (words, class, fold): all variants of a notice are in one fold, and so are those of a plain sentence; tags stay in training
    data: list[tuple[list[str], int, int]] = [(p, 0, i % FOLDS) for i, p in enumerate(plain)]
    data += [(v, 0, i % FOLDS) for i, s in enumerate(PLAIN_SENTENCES) for v in variants(s, filler, rng, VARIANTS)]
    place = 0
    for i, family in enumerate(CLASSES[1:], 1):
        for notice in NOTICES.get(family, UNKNOWN_NOTICES):
            data += [(v, i, place % FOLDS) for v in variants(notice, filler, rng, VARIANTS)]
            place += 1
        for tag in TAGS.get(family, UNKNOWN_TAGS):
            data += [(v, i, -1) for v in tagged(tag, filler, rng, VARIANTS // 2)]
    names = sorted(set().union(*every, *tags, *(grams(words_of(s)) for s in PLAIN_SENTENCES)) - NOT_ALONE)

    def trained(rows: Sequence[tuple[list[str], int, int]], rounds: int) -> Model:
        weights, bias = fit([r[0] for r in rows], np.array([r[1] for r in rows]), names, rounds)
        bias[0] = max(bias[0], bias[1:].max() + 1.0)  # without evidence a paragraph is plain text
        return Model(weights, bias, frozenset(), 0.0, 0.0, 1.0, templates)

    scores, truth, corpus = [], [], []
    paragraphs = len(plain)
    for fold in range(FOLDS):
        part = trained([r for r in data if r[2] != fold], FOLD_ROUNDS)
        left_out = [r for r in data if r[2] == fold]
        corpus += [i < paragraphs for i, r in enumerate(data) if r[2] == fold]
        scores += [part.scores(r[0]) for r in left_out]
        truth += [r[1] for r in left_out]
    model = trained(data, ROUNDS)
    model.temperature, model.threshold, model.level = calibrated(np.array(scores), np.array(truth), np.array(corpus, bool))
    common: dict[str, int] = {}
    for p in plain:
        for w in set(p):
            common[w] = common.get(w, 0) + 1
    model.cues = cue_words(model.weights, common)
    return model


def sample_paragraphs(docs: DataFrame, most: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """One line each of at most ``most`` documents, both drawn by hash: a bounded training sample, the same in every run."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    line = F.substring(F.try_element_at(lines, (F.pmod(F.xxhash64(F.lit("line"), "doc_id"), F.greatest(F.size(lines), F.lit(1))) + 1).cast("int")), 1, SAMPLE_CHARS)
    # of many documents only the low hashes compete, so that all tasks together send a small multiple of the sample to the driver
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    some = docs.where(draw <= min(1.0, 4 * most / max(1, docs.count())))
    return [r["line"] for r in some.select(draw.alias("h"), line.alias("line")).where("line <> ''").orderBy("h", "line").limit(most).collect()]


def passages(text: str, model: Model) -> list[tuple[str, float, float, int]]:
    """(family, probability, similarity, code point where its window starts) of every passage that is not plain text, in text order.

    Overlapping windows of one family are one passage, told by its clearest window.
    """
    found, at = [], 0
    for line in text.split("\n"):
        words = words_of(line)
        if not model.cues.isdisjoint(words):
            places = None
            reached: dict[str, tuple[int, int]] = {}  # family -> its passage and its last window
            for start in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE):
                part = words[start:start + WINDOW]
                family, sure = model.predict(part)
                if family == PLAIN:
                    continue
                if start and places is None:
                    places = [m.start() for m in TOKEN.finditer(line)]
                this = (family, sure, model.similarity(family, part), at + (places[start] if start else 0))
                place, last = reached.get(family, (-1, -WINDOW))
                if start - last < WINDOW:
                    if (this[2], this[1]) > (found[place][2], found[place][1]):
                        found[place] = this
                else:
                    place = len(found)
                    found.append(this)
                reached[family] = (place, start)
        at += len(line) + 1
    return found


FIELDS = "family string, probability double, similarity double, confirmed boolean, start long, n_passages long, families array<string>"
PASSAGE = {"family": "string", "probability": "double", "similarity": "double", "start": "bigint"}


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: its clearest licence passage (confirmed before unconfirmed, then by probability), the count and the families found, and ``passages``, all of them in text order."""
    known = build(sample_paragraphs(docs)) if model is None else model
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                 pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("start", pa.int64())]))]
        for batch in row_batches(batches):
            out = []
            for data in batch.column(1).to_pylist():
                found = passages(data.decode("utf-8", "replace"), known)
                if found:
                    family, sure, near, start = max(found, key=lambda f: (f[2] >= LEAST_SIMILARITY, f[1], -f[3]))
                    out.append((family, sure, near, near >= LEAST_SIMILARITY, start, len(found), sorted({f[0] for f in found}), [dict(zip(PASSAGE, f, strict=True)) for f in found]))
                else:
                    out.append((None, None, None, False, None, 0, [], []))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], ["doc_id", *[f.split()[0] for f in FIELDS.split(", ")], "passages"])

    listed = ", ".join(f"{n}: {t}" for n, t in PASSAGE.items())
    return docs.select("doc_id", as_bytes("text")).mapInArrow(run, f"doc_id {kind}, {FIELDS}, passages array<struct<{listed}>>")
