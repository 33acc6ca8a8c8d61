import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pitlake.llm import packing
from pitlake.llm.queries import tokenizer_path

ODD = [None, "", " ", "It's THE don't <|endoftext|>x", "İstanbul ΣΑΣ", "é a\x1fb ​́q a\x85b 12345,67 ''s 'S ''ll ﬁ ª", "\n\n", "日本語 テスト", "a" * 5000, "z \U0001f600 z"]


def corpus(n=200, seed=1):
    rng = random.Random(seed)
    docs = [(i, t) for i, t in enumerate(ODD)]
    for i in range(n):
        docs.append((100 + i, " ".join(rng.choice(["the", "Reshon,", "ther.", "Éoi", "x1y2", "und"]) for _ in range(rng.choice([1, 10, 100, 700, 5000])))))
    return docs + [(100, docs[-1][1]), (None, "no id")]


def test_pieces_hold_every_id_once(spark):
    docs = corpus()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), tokenizer_path(), block_tokens=60_000).withColumn("crc", packing.ids_crc32()).collect()
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length > 0 and r.crc == zlib.crc32(bytes(r.ids))
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, texts in want.items():
        if len(texts) > 1:
            continue
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in pieces]).tolist() == texts[0] and {r.doc_tokens for r in pieces} == {len(texts[0])}
    assert sum(r.length for r in got) == sum(len(t) for ts in want.values() for t in ts)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]])) and sum(r.length for r in pieces) <= 2048
    assert sum(r.length for r in got) > 0.97 * 2048 * len(by_sequence)


@pytest.mark.parametrize("seed", range(6))
def test_place_fills_all_but_one_sequence_and_balances_cost(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, rng.integers(1, 400))
    pieces = packing.place(lengths, 2048)
    used, held = defaultdict(int), defaultdict(int)
    for item, start, size, at in pieces:
        assert start == held[item]
        held[item] += size
        used[at] += size
    assert [held[i] for i in range(len(lengths))] == lengths.tolist()
    assert max(used.values()) <= 2048 and len(used) == -(-int(lengths.sum()) // 2048)


def test_small_cache_gives_the_same_ids():
    small, tokenizer = packing.ChunkEncoder(tokenizer_path(), most=4), Tokenizer.from_file(tokenizer_path())
    for _, text in corpus(20):
        assert np.frombuffer(small(text or ""), "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
