import random
from itertools import combinations

import numpy as np
import xxhash

from pitlake.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(docs, radius=2):
    fps = [plain_fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    docs, words = [], [f"w{i}" for i in range(300)]
    for i in range(n):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 40, 400]))
        docs.append((i, " ".join(base)))
        if len(base) == 400:
            for k in range(3):  # near copies: a few words differ
                other = list(base)
                for _ in range(k):
                    other[rng.randrange(400)] = rng.choice(words)
                docs.append((1000 + 10 * i + k, " ".join(other).upper()))
    return docs + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5003, "one"), (None, "one"), (None, "lonely row")]


def groups(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_groups_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    assert groups(simhash.near_groups(df)) == want
    assert any(c != d for d, _, c in want if d is not None)


def test_text_rules():
    for text in ("A b\x1fC\x0bd", "É é É", "x" * 10, "a b c d e", "\x0c", "w " * 5000):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_links_equal_brute_force_at_finer_tiles_and_small_tiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (4, 2))]
    values = sorted({int(b) for b in base} | set(near) | {0, -1, 1, 3, 7, -2})
    want = {(i, j) for i, j in combinations(range(len(values)), 2) if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 2}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in want:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    expected = {values[i]: values[root(i)] for i in range(len(values)) if root(i) != i}
    for segments, tile_rows in ((4, 1024), (8, 3), (4, 2)):
        monkeypatch.setattr(simhash, "segments_for", lambda n, s=segments: s)
        df = spark.createDataFrame([(v,) for v in values], "fp long")
        got = simhash.stars(simhash.links(df, len(values), tile_rows=tile_rows))
        assert {r.u: r.v for r in got.collect()} == expected


def test_neighbour_counts():
    assert len(simhash.half_neighbours(4, 2)) == 21 and len(simhash.half_neighbours(8, 2)) == 73


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def varied(base, n_changes, rng):
    out = list(base)
    for i in rng.sample(range(len(base)), n_changes):
        out[i] = f"new{rng.random()}"
    return out


def near_corpus(seed=8):
    """Groups of copies that share well over 0.8, texts that share clearly less, short texts, and the odd cases."""
    rng, docs = random.Random(seed), []
    for g in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(rng.choice([120, 400, 1500]))]
        docs.append((1000 * g, " ".join(base), "group", g))
        docs += [(1000 * g + k, " ".join(varied(base, max(1, len(base) // 150), rng)).upper(), "group", g) for k in range(1, 4)]
        docs.append((1000 * g + 500, " ".join(varied(base, len(base) // 10, rng)), "alone", 100 + g))
    docs += [(90_000, None, "blank", 200), (90_001, " ", "blank", 200), (90_002, "two words", "alone", 201), (90_003, "two words", "alone", 201), (None, "two words", "alone", 201)]
    return docs


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = near_corpus()
    rng = random.Random(1)
    df = spark.createDataFrame([(d, t, g, n, 2) for d, t, g, n in rng.sample(docs, len(docs))], "doc_id long, text string, source string, fp int, uid int").repartition(4)
    want = {}
    for doc_id, _, _, group in docs:
        if doc_id is not None:
            want[group] = min(doc_id, want.get(group, doc_id))
    for tile_rows in (1 << 14, 7):
        got = simhash.near_dedup(df, tile_rows=tile_rows)
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(want.values())
    assert all(jaccard(docs[5 * g][1], docs[5 * g + 1][1]) > 0.85 and jaccard(docs[5 * g][1], docs[5 * g + 4][1]) < 0.65 for g in range(25))


def test_near_dedup_decides_by_exact_similarity_near_the_limit(spark):
    rng, docs, want = random.Random(21), [], []
    for g in range(90):
        base = [f"g{g}w{i}" for i in range(400)]
        for k in range(500):  # a copy whose similarity comes close to 0.75 ... 0.85
            other = " ".join(varied(base, 4 + k % 20, rng))
            if abs(jaccard(" ".join(base), other) - (0.75 + 0.1 * g / 89)) < 0.01:
                break
        docs += [(2 * g, " ".join(base)), (2 * g + 1, other)]
        want += [2 * g] if jaccard(" ".join(base), other) >= 0.8 else [2 * g, 2 * g + 1]
    short = [" ".join(f"s{i}" for i in range(n)) for n in (8, 9)]  # 4 of 5 shingles
    docs, want = docs + [(900, short[0]), (901, short[1])], want + [900]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for tile_rows in (1 << 14, 1):
        assert sorted(r.doc_id for r in simhash.near_dedup(df, tile_rows=tile_rows).collect()) == sorted(want)
    assert 100 < len(want) < 170


def test_wide_fingerprint_follows_similarity():
    rng = random.Random(3)
    for changes in (4, 8, 40):
        base = [str(rng.randrange(10**6)) for _ in range(600)]
        other = " ".join(varied(base, changes, rng))
        j = jaccard(" ".join(base), other)
        x, y = (np.frombuffer(simhash.wide_fingerprint(t.encode())[0], np.uint64) for t in (" ".join(base), other))
        expected = np.arccos(2 * j / (1 + j)) / np.pi * 512
        assert abs(int(np.bitwise_count(x ^ y).sum()) - expected) < 40


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(df).count() == 0 and simhash.near_dedup(df).count() == 0
