from itertools import permutations

import pytest

from pitlake.llm import filter_audit

LETTERS = "ABCDE"


def failed(doc_id, text, rows):
    """Letters of the contract's filters that a document fails, told word by word."""
    text = text or ""
    words = text.encode().split()
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    judged = [(doc_id, lang or "", failed(doc_id, text, rows)) for doc_id, text, lang in rows]
    out = {}
    for part in {p for _, p, _ in judged}:
        here = [(d, f) for d, p, f in judged if p == part]
        for order in map("".join, permutations(LETTERS)):
            left = list(here)
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                earlier = set(order[:step - 1])
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f and bool(f & earlier) for _, f in here), sum(f == {letter} for _, f in here),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    shapley = {}
    for (part, order, step), values in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + values[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows():
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", "short", "Short UPPER", long, long.replace("w", "W"), long + " #", "a " * 300, "a\tb\x0bc\xa0d " * 80 + "|", " ".join(f"é{i}" for i in range(200)), long + " End"]
    out = [(i, texts[i % len(texts)], ["en", "de", None][i % 3]) for i in range(60)]
    return out + [(4, long, "en"), (4, long, "en"), (None, long, "fr"), (None, None, "fr"), (7, "another text of an id that is there", "de"), (-3, "short", "en")]


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 60, 3)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 1)]


def test_audit_equals_brute_force(spark):
    docs = rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, mask int, part string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, labels).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    want = brute(docs, LABELS)
    assert len(got) == len(found) == len({lang for _, _, lang in docs}) * 600
    assert found == want
    assert [f.dataType.simpleString() for f in filter_audit.audit(df.limit(0), labels).schema] == ["string", "string", "int"] + ["bigint"] * 7


def test_empty_tables_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "Ab " * 400_000, "en"), (2, "Ab " * 400_000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    cells = {(r.part, r.mask, r.n) for r in filter_audit.mask_cells(docs, labels).collect()}
    assert cells == {("en", 2 + 4, 1), ("en", 2 + 4 + 16, 1)}


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "x", "en"), (3, "y", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in filter_audit.audit(docs, labels, {"X": lambda t: t == "x"}, "D").collect()}
    assert got == {("XD", 1): (1, 2, 0, 1, 3), ("XD", 2): (1, 0, 1, 0, 1), ("DX", 1): (2, 1, 0, 1, 1), ("DX", 2): (1, 1, 1, 0, 3)}
    with pytest.raises(ValueError):
        filter_audit.orders(filter_audit.mask_cells(docs, labels), "ABCDEFG")
