import random
from collections import defaultdict

import pytest

from pitlake.llm import mixing

WORDS = ["alpha", "beta", "gamma", "delta"]


def corpus(n=600, seed=2):
    rng, docs = random.Random(seed), []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))
        text += rng.choice(["", " number 12345", " | a | b", " Licensed under CC BY 4.0."])
        docs.append((i, rng.choice(["hot"] * 6 + ["a", "b", "c", None]), rng.choice(["en", "en", "de", "fr"]), text))
    return docs + [(n, "a", "en", None), (n + 1, "only", None, ""), (5, "hot", "en", "alpha"), (5, "hot", "en", "alpha")]


SCHEMA = "doc_id long, source string, lang string, text string"


def topic(text):
    text = text or ""
    if any(m in text for m in ("icensed under", "nder the MIT License", "ll rights reserved")):
        return "licensed"
    if any(m in text for m in (" | ", "$$$", "###", "&&&", "%%%", "***")):
        return "markup"
    return "records" if any(text[i:i + 3].isdigit() for i in range(len(text) - 2)) else "prose"


def brute(docs, shares=None):
    cells = defaultdict(int)
    for _, source, lang, text in docs:
        cells[source, lang, topic(text)] += len((text or "").split())
    total = sum(cells.values())
    weight = {c: n / total for c, n in cells.items()}
    targets = []
    for axis, name in enumerate(mixing.AXES):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[axis]] += n
        raised = {v: (shares[name].get(v, 0) if shares and name in shares else n ** mixing.TEMPERATURES[name]) for v, n in sums.items() if n}
        targets.append({v: r / sum(raised.values()) for v, r in raised.items()})
    for _ in range(200):
        for axis in range(3):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[axis]] += w
            weight = {c: w * targets[axis].get(c[axis], 0) / sums[c[axis]] if sums[c[axis]] else 0 for c, w in weight.items()}
    ratio = {c: weight[c] / cells[c] for c in cells if cells[c]}
    return targets, {c: ratio[c] / max(ratio.values()) if c in ratio else 1.0 for c in cells}


@pytest.mark.parametrize("shares", [None, {"lang": {"en": 0.2, "de": 0.5, "fr": 0.3, "xx": 9.0}}])
def test_probabilities_equal_brute_force_and_meet_targets(spark, shares):
    docs = corpus()
    got = mixing.sampled(spark.createDataFrame(docs, SCHEMA).repartition(4), shares=shares).collect()
    assert len(got) == len(docs)
    targets, want = brute(docs, shares)
    expected = [defaultdict(float) for _ in range(3)]
    for r in got:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], abs=1e-4)
        for axis, value in enumerate((r.source, r.lang, r.topic)):
            expected[axis][value] += r.probability * r.tokens
    for axis in range(3):
        whole = sum(expected[axis].values())
        for value, share in targets[axis].items():
            assert expected[axis][value] / whole == pytest.approx(share, abs=1e-3)


def test_draw_is_stable_and_mix_takes_the_same(spark):
    docs = [(*d, "x", 1) for d in corpus()]
    df = spark.createDataFrame(docs, SCHEMA + ", cell string, probability int")
    taken = mixing.sampled(df.drop("cell", "probability")).where("taken")
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in taken.collect())
    assert sum(r.doc_id == 5 for r in got.collect()) in (0, 1, 2, 3)


def test_one_rare_source_and_language_do_not_thin_the_corpus(spark):
    docs = [(i, "ab"[i % 2], ("en", "de", "fr")[i % 3], "alpha beta " * 400) for i in range(1200)] + [(9000, None, "rare", "gamma " * 6)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = mixing.sampled(df).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.rate * r.tokens for r in got) == pytest.approx(mixing.KEPT * total, rel=1e-6)
    rare = next(r for r in got if r.doc_id == 9000)
    assert rare.taken and rare.copies >= int(rare.rate) > 1 and rare.probability == 1.0
    raised = {s: sum(r.tokens for r in got if r.lang == s) ** mixing.TEMPERATURES["lang"] for s in ("en", "de", "fr", "rare")}
    assert rare.rate * rare.tokens / (mixing.KEPT * total) == pytest.approx(raised["rare"] / sum(raised.values()), rel=0.01)
    mixed = mixing.mix(df).collect()
    assert sum(r.doc_id == 9000 for r in mixed) == rare.copies and len(mixed) == sum(r.copies for r in got) > 0.6 * len(docs)


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.sampled(df).count() == 0 and mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, "a", "en", None), (2, None, None, " ")], SCHEMA)
    assert mixing.mix(blank).count() == 2
