import os
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from pitlake.llm import exact_dedup, mixing, packing, quality_rules
from pitlake.llm.queries import tokenizer_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def near_brute(docs):
    """Smallest doc_id of each group of texts linked by sharing at least 0.8 of their distinct five-word shingles."""
    sets = []
    for _, text in docs:
        words = text.lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(docs[k][0] for k in range(len(docs)) if group[k] == g) for g in set(group))


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    step = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    cleaned = step["quality"](spark, docs, SF).cache()
    judged = {d: quality_rules.judge(r.text or "") for d, r in rows.items()}
    assert {r.doc_id: r.text for r in cleaned.collect()} == {d: j[9] for d, j in judged.items() if j[6]}
    assert cleaned.columns == docs.columns

    single = step["exact_dedup"](spark, cleaned, SF).cache()
    best = {}
    for r in cleaned.collect():
        best[r.text.encode().lower()] = max(r.doc_id, best.get(r.text.encode().lower(), -1))
    assert sorted(r.doc_id for r in single.collect()) == sorted(best.values())

    apart = step["near_dedup"](spark, single, SF).cache()
    assert sorted(r.doc_id for r in apart.collect()) == near_brute([(r.doc_id, r.text.encode()) for r in single.collect()])

    # Each document comes out as often as its rate says, its row unchanged; test_mixing.py restates the rates.
    mixed = step["mixing"](spark, apart, SF).cache()
    assert mixed.columns == docs.columns
    rates = {r.doc_id: r.copies for r in mixing.sampled(apart).collect()}
    texts = {r.doc_id: tuple(r) for r in apart.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(rates) == set(texts) and times == Counter({d: n for d, n in rates.items() if n})
    assert all(tuple(r) == texts[r.doc_id] for r in mixed.collect())

    # Every id of every drawn copy lies in exactly one piece, and no sequence is longer than it may be.
    tokenizer = Tokenizer.from_file(tokenizer_path())
    packed = step["packing"](spark, mixed, SF).collect()
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in packed:
        pieces[r.doc_id][r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, n in times.items():
        ids = tokenizer.encode(texts[doc_id][docs.columns.index("text")] or "", add_special_tokens=False).ids + [1]
        held = Counter()
        for (start, length, crc), k in pieces[doc_id].items():
            assert zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == crc
            held.update({i: k for i in range(start, start + length)})
        assert held == Counter({i: n for i in range(len(ids))})
    for placed in sequences.values():
        ends = [0]
        for offset, length in sorted(placed):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= packing.LENGTH
    assert set(pieces) == set(times) and corpus_pipeline.run(spark, SF).count() == len(packed)


def test_near_stage_equals_brute_force_over_exact_similarity(spark):
    single = exact_dedup.deduplicate(quality_rules.clean(spark.read.parquet(f"{SF}/documents.parquet"))).cache()
    docs = [(r.doc_id, {tuple(r.text.encode().lower().split()[i:i + 5]) for i in range(max(1, len(r.text.encode().split()) - 4))}) for r in single.collect()]
    group = list(range(len(docs)))
    for i, (_, a) in enumerate(docs):
        for j, (_, b) in enumerate(docs[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    want = sorted(min(d for k, (d, _) in enumerate(docs) if group[k] == g) for g in set(group))
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, single, SF)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(docs)


def test_entry_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[-2:] == ["False", "False"], said.stderr
