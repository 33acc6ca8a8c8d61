import hashlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pitlake.llm import exact_dedup
from tests.conftest import rows

DOCS = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (9, "SAME TEXT"), (3, None), (4, ""), (None, "x"), (5, "É"), (6, "é"), (None, None)]


def lowered(text):
    return (text or "").encode().lower()


def brute(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[lowered(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups_equal_brute_force_with_nulls_ties_and_repeats(spark):
    got = exact_dedup.exact_groups(spark.createDataFrame(DOCS, "doc_id long, text string"), capacity=2).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(DOCS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({lowered(t) for _, t in DOCS}) and all(r.doc_id == r.keep_id for r in kept)


def test_heavy_group_over_many_partitions(spark):
    docs = [(i, "hot" if i % 3 == 0 else f"text {i % 400}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_groups(df, capacity=9).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(docs)
    keyed = df.select("doc_id", exact_dedup.text_digest("text").alias("digest")).selectExpr("monotonically_increasing_id() as uid", "*")
    heavy = exact_dedup.heavy_winners(keyed, 9).collect()
    assert [r.group_size for r in heavy] == [1000]


def test_deduplicate_keeps_other_columns_even_with_clashing_names(spark):
    docs = [(i, t, f"u{n}", n) for n, (i, t) in enumerate(DOCS)]
    df = spark.createDataFrame(docs, "doc_id long, text string, uid string, digest long")
    got = exact_dedup.deduplicate(df, capacity=2)
    assert got.columns == df.columns and got.count() == len({lowered(t) for _, t in DOCS})
    assert rows(got.where("doc_id = 9"), "doc_id", "text") == [(9, "SAME TEXT")]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).count() == 0 and exact_dedup.deduplicate(df).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=30), max_size=10), st.integers(1, 6))
def test_summary_bound(blocks, capacity):
    found, true = exact_dedup.summarise(blocks, capacity), Counter(v for b in blocks for v in b)
    assert len(found) <= capacity
    for value, n in true.items():
        assert n - sum(true.values()) / (capacity + 1) <= found.get(value, 0) <= n
