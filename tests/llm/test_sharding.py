from collections import Counter, defaultdict

from pitlake.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot int"


def corpus(n=4000):
    return [(i, f"text {i}" * (i % 5), "x", 1) for i in range(n)] + [(7, "again", None, None)] * 900 + [(None, None, None, None), (None, "é", None, None)]


def test_assignment(spark):
    docs = corpus()
    got = sharding.assign(spark.createDataFrame(docs, SCHEMA).repartition(5), 16).collect()
    assert len(got) == len(docs) and {r.law for r in got} == {"key"}
    slots, of_key = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of_key[r.doc_id].add((r.shard, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len(places) == 1 for places in of_key.values())
    moved = [g for places in of_key.values() for s, g in places if s != g]
    assert set(moved) == {16} and 0.6 < len(moved) / (len(of_key) / 17) < 1.5
    spread = Counter(s for places in of_key.values() for s, _ in places)
    assert max(spread.values()) < 1.4 * len(of_key) / 16 and min(spread.values()) > 0.6 * len(of_key) / 16


def test_size_and_checksum(spark):
    import zlib

    docs = [(1, None, None, None), (2, "", None, None), (3, "é漢", None, None)]
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.assign(spark.createDataFrame(docs, SCHEMA), 16).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (6, zlib.crc32("é漢".encode()))}


def test_changed_weight_moves_rows_only_through_its_subtree(spark):
    before = sharding.base_tree(16)
    after = [sharding.Leaf(leaf.region, leaf.rack, leaf.shard, 3.0 if leaf.shard == 5 else leaf.weight) for leaf in before]
    df = spark.range(6000).select("id", sharding.descend("id", before).alias("a"), sharding.descend("id", after).alias("b"))
    region = {leaf.shard: leaf.region for leaf in before}
    rack = {leaf.shard: leaf.rack for leaf in before}
    moved = [(r.a, r.b) for r in df.where("a <> b").collect()]
    assert moved and all(b == 5 or rack[b] == rack[5] and rack[a] != rack[5] or region[b] == region[5] != region[a] for a, b in moved)


def test_weights_set_shares(spark):
    leaves = [sharding.Leaf("a", "x", 0, 1.0), sharding.Leaf("a", "y", 1, 2.0), sharding.Leaf("b", "z", 2, 5.0), sharding.Leaf("b", "z", 3, 0.0)]
    got = Counter(r[0] for r in spark.range(8000).select(sharding.descend("id", leaves)).collect())
    assert set(got) == {0, 1, 2} and abs(got[2] - 5000) < 250 and abs(got[1] - 2000) < 250


def test_slices_give_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 16)
    got = sharding.assign(spark.createDataFrame(corpus(500), SCHEMA).repartition(3), 16).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA), 16).count() == 0
