import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pitlake.llm import gru_lm as lm

DOCS = [(i, f"The cat {i % 5} sat on the mat.\nLe chat {i % 7} est la " * (i % 4)) for i in range(120)] + [(200, None), (201, ""), (202, "unseen\x0bwords É é"), (3, "the cat"), (3, "the cat"), (None, "the mat")]


def brute(docs):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(((d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 9)) for d, t in docs), key=str)


@pytest.mark.parametrize("head_words", [lm.HEAD_WORDS, 8])
def test_counts_and_base_equal_brute_force(spark, head_words):
    got = lm.score(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), head_words).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got), key=str) == brute(DOCS)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def network(seed=0, lanes=3):
    rng = np.random.default_rng(seed)
    size = lm.CLASSES + lm.SUFFIXES + lm.CLASSES * lm.CLASS_WORDS
    params = lm.initial(np.log(np.full(size, 1 / size)), seed=seed)
    for name in ("c", "o"):
        params[name] = rng.normal(0, 0.5, params[name].shape).astype(np.float32)
    return lm.Network(params, lanes)


def test_probabilities_add_up_to_one():
    net = network()
    everything = np.arange(lm.CLASSES * lm.CLASS_WORDS + lm.SUFFIXES)
    state = np.tile(np.append(np.random.default_rng(1).normal(size=lm.HIDDEN), 1)[:, None].astype(np.float32), (1, len(everything)))
    said = net.outputs(state, everything)
    assert math.isclose(np.exp(said).sum(), 1, abs_tol=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    inputs, targets = rng.integers(0, 1056, (5, 3)), rng.integers(0, 1056, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0], fresh[2, 1] = True, True
    mask = np.ones((5, 3), bool)
    mask[4, 2] = False
    net, taken = network(), {}
    net.state = net.state.astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.adam = lambda grads, rate: taken.update(grads)
    net.learn(inputs, targets, fresh, mask, 0.0)

    def loss():
        net.state = np.zeros((lm.HIDDEN, 3), np.float64)
        states = net.forward(inputs, fresh, False)[0]
        said = net.outputs(states, targets.ravel())
        return -(said * mask.ravel()).sum() / mask.sum()

    for name in ("w", "x", "c", "o"):
        at = np.unravel_index(np.abs(taken[name]).argmax(), taken[name].shape)
        keep, step = net.p[name][at], 0.01
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert (up - down) / (2 * step) == pytest.approx(taken[name][at], rel=0.05)


def streamed(documents, lanes, steps):
    net, total = network(lanes=lanes), Counter()
    for kept, inputs, targets, fresh, mask, keys in lm.Lanes(iter(documents), lanes, steps):
        net.keep(kept)
        said = net.outputs(net.forward(inputs, fresh, False)[0], targets.ravel())
        for key, value, real in zip(keys.ravel(), said, mask.ravel(), strict=True):
            if real:
                total[int(key)] += value
    return total


def test_state_is_carried_whatever_the_windows():
    rng = np.random.default_rng(3)
    documents = [(k, rng.integers(0, 1056, n)) for k, n in enumerate([1, 2, 70, 33, 5, 64, 200, 1, 9])]
    want = streamed(documents, 1, 500)
    for lanes, steps in ((4, 8), (2, 1), (20, 33)):
        got = streamed(documents, lanes, steps)
        assert all(got[k] == pytest.approx(want[k], rel=1e-4) for k, _ in documents) and len(got) == len(documents)


def test_training_beats_the_base_on_held_out_documents(spark):
    docs = [(i, ("alpha beta gamma delta " if i % 2 else "uno dos tres cuatro ") * 250) for i in range(700)]
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).where("held_out").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_empty_and_no_training_rows(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm.score(spark.createDataFrame([(held, "only held out")], "doc_id long, text string")).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and row.score < 0
