import numpy as np
import pytest

from pitlake.llm import license_scan as scan

PLAIN = ["The river was high and the people of the town waited for the boat.", "Der Fluss war hoch und die Leute warteten.", "Le livre est sur la table et il pleut."] * 20


@pytest.fixture(scope="module")
def model():
    return scan.build(PLAIN)


def test_held_out_accuracy(model):
    rng, right, n = np.random.default_rng(99), 0, 0
    filler = scan.words_of(" ".join(PLAIN))
    for family, notices in scan.NOTICES.items():
        for notice in notices:
            for words in list(scan.variants(notice, filler, rng, 12))[1:]:
                n, right = n + 1, right + (model.predict(words)[0] == family)
    assert right / n > 0.93


def test_notices_are_named_and_confirmed(model):
    for family, notices in scan.NOTICES.items():
        for notice in notices:
            words = scan.words_of(notice)
            assert model.predict(words)[0] == family and model.similarity(family, words) == 1.0
    for text in PLAIN + list(scan.PLAIN_SENTENCES):
        assert model.predict(scan.words_of(text))[0] == scan.PLAIN


def test_words_passed_over_could_not_win(model):
    for text in PLAIN:
        words = scan.words_of(text)
        if model.cues.isdisjoint(words):
            assert model.scores(words).argmax() == 0
    assert model.bias.argmax() == 0


def test_scan(spark, model):
    docs = [(1, "Intro line.\nReleased under the MIT License.\nMore."), (2, None), (3, ""), (4, "plain words " * 500 + "licensed under the apache license, version 2.0 " + "more words " * 500),
            (5, "All rights reserved."), (1, "Intro line.\nReleased under the MIT License.\nMore."), (None, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY 4.0.\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert (got[1].family, got[1].confirmed, got[1].start, got[1].n_passages) == ("MIT", True, 12, 1)
    assert got[2].family is None and got[3].family is None and got[4].family == "Apache-2.0" and got[4].confirmed
    assert got[5].family == "unknown" and not got[5].confirmed and got[None].family == "CC-BY-NC" and got[6].families == ["CC-BY", "MIT"]


def test_every_passage_of_a_flattened_text(spark, model):
    text = "Released under the MIT License. " + "plain words " * 200 + scan.NOTICES["GPL"][1] + " more words" * 100 + " Released under the MIT License."
    (got,) = scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert {"MIT", "GPL"} <= set(got.families) and got.n_passages == len(got.passages)
    assert [p.family for p in got.passages if p.similarity >= scan.LEAST_SIMILARITY] == ["MIT", "GPL", "MIT"]
    at = {p.family: p.start for p in got.passages}
    assert abs(at["GPL"] - text.index("This program is free")) < 400 and got.passages[0].start == 0


def test_tags_are_named(model):
    held = {"GPL": ("// SPDX-License-Identifier: GPL-3.0-only", "# SPDX-License-Identifier: GPL-2.0+", "This package: GPL-2.0-only"), "Apache-2.0": ("/* SPDX-License-Identifier: Apache-2.0 */", "Distributed under the Apache License 2.0"),
            "BSD": ("SPDX-License-Identifier: BSD-4-Clause", "license = BSD-2-Clause"), "LGPL": ("SPDX-License-Identifier: LGPL-2.0-or-later",), "AGPL": ("SPDX-License-Identifier: AGPL-1.0-only",),
            "MIT": ("* SPDX-License-Identifier: MIT",), "CC-BY-SA": ("SPDX-License-Identifier: CC-BY-SA-3.0",), "MPL-2.0": ("license: MPL-2.0",)}
    for family, texts in held.items():
        for text in texts:
            assert [f[0] for f in scan.passages(text, model)] == [family], text
    for text in ("She went to MIT last year.", "Er ging mit ihr zum Fluss.", "There was only one person left, or two."):
        assert not scan.passages(text, model), text


def test_empty_trains_and_scans(spark):
    assert scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licences_outside_the_families_are_never_confirmed_ones(model):
    """None of these sentences is trained: other wordings of unknown licences, and licences named nowhere in the module."""
    texts = ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.", "Licensed under the EUPL, the European Union Public Licence.",
             "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Released under CC BY-ND 3.0.",
             "Licensed under the Common Development and Distribution License, version 1.0.", "Licensed under the Microsoft Public License.", "Licensed under the Academic Free License version 3.0.",
             "This software is released under the PostgreSQL License.", "Licensed under the Open Software License 3.0.",
             "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.")
    for text in texts:
        found = scan.passages(text, model)
        assert {f[0] for f in found} == {"unknown"}, (text, found)


def test_agreement_counts_both_ways():
    words = scan.words_of
    template = words("Licensed under CC BY 4.0.")
    assert scan.agreement(words("Our texts: Licensed under CC BY 4.0. Have fun with them all."), template) == 1.0
    assert scan.agreement(words("Licensed under CC BY-ND 4.0."), template) == 0 and scan.agreement(words("Licensed under CC BY 4.0 SA."), template) == 0
    assert 0 < scan.agreement(words("Licensed under CC"), template) < scan.LEAST_SIMILARITY  # a part of the template is no agreement
    mozilla = words("Licensed under the Mozilla Public License 2.0.")
    assert scan.agreement(words("Licensed under the Other Public License 2.0."), mozilla, frozenset({"mozilla"})) == 0
    assert scan.agreement([], template) == 0 and scan.agreement(words("one"), template) == 0


def test_notices_in_other_languages(model):
    for family, text in (("MIT", "Diese Bibliothek steht unter der MIT-Lizenz."), ("GPL", "Ce logiciel est distribué sous licence GPL v3."), ("Apache-2.0", "Este programa se publica bajo la licencia Apache 2.0.")):
        assert [f[0] for f in scan.passages(text, model)] == [family], text


def test_sample_takes_any_line_with_text(spark):
    docs = spark.createDataFrame([(i, f"\nfirst{i}\n \nlast{i}\n") for i in range(60)] + [(99, None), (98, "\n \n"), (None, "alone")], "doc_id long, text string")
    got = scan.sample_paragraphs(docs)
    assert len(got) == 61 and {x.rstrip("0123456789") for x in got} == {"first", "last", "alone"} and len(scan.sample_paragraphs(docs, 5)) == 5


def test_a_text_of_several_hundred_windows(model):
    text = " ".join(f"word{i}" for i in range(9000)) + " " + scan.NOTICES["MPL-2.0"][0] + " " + " ".join(f"more{i}" for i in range(9000))
    (got,) = [f for f in scan.passages(text, model) if f[2] >= scan.LEAST_SIMILARITY]
    assert got[0] == "MPL-2.0" and abs(got[3] - text.index("This Source")) < 600
