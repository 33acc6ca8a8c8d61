import random
from fractions import Fraction

import numpy as np
import pytest

from pitlake.llm import whitening


def brute(rows, components=4):
    """Plain float covariance and exact integers over the distinct fixed-point vectors."""
    x_of = {}
    for at, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            x_of[at] = tuple(int(np.floor(256 * np.float64(c))) for c in v)
    fit = np.array(sorted(set(x_of.values())), float)
    n = len(fit)
    sums = [sum(int(c) for c in column) for column in fit.T]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    out = {}
    for at, x in x_of.items():
        for k in range(min(components, len(values))):
            e, u = values[-1 - k], vectors[:, -1 - k]
            out[at, k + 1] = (sum((n * c - s) ** 2 for c, s in zip(x, sums)), float((np.array(x) - fit.mean(0)) @ u / np.sqrt(e)), e / values.sum())
    return n, out


@pytest.mark.parametrize("rows_per_block", [1, 63, 64, 1000])
def test_scatter_is_exact(rows_per_block):
    rng = np.random.default_rng(rows_per_block)
    for low, high in ((-40, 90), (0, 1), (-(1 << 62), 1 << 62), (7, 8)):
        x = rng.integers(low, high, (rows_per_block, 5))
        x[:, 2] = high - 1
        sums, cross = whitening.block_scatter(x)
        wide = x.astype(object)
        assert sums.tolist() == wide.sum(axis=0).tolist() and cross.tolist() == (wide.T @ wide).tolist()


def test_limbs_add_up():
    rng = random.Random(1)
    values = [rng.randrange(-(1 << 170), 1 << 170) for _ in range(50)] + [0, -1, 1 << 64]
    total = [sum(column) for column in zip(*map(whitening.limbs, values))]
    assert sum(v << (32 * k) for k, v in enumerate(total)) == sum(values)


def test_whiten_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 7)) * [1, 2, .5, .3, .1, .1, 3] + .2).astype("float32").tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[3]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [None] * 7), (2003, [float("nan")] * 7), (2004, [1., 2., float("inf"), 0., 0., 0., 0.]), (2005, [1., 2.])]
    clash = [(i, v, "a", 1) for i, v in rows]
    df = spark.createDataFrame(clash, "vec_id long, embedding array<float>, x string, n int").repartition(5)
    n, want = brute([r for r in rows if r[0] != 2005])
    got = whitening.whiten(df).collect()
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    signs = {}
    for r in got:
        deviation, whitened, explained = want[r.vec_id, r.component]
        sign = signs.setdefault(r.component, 1 if whitened * r.whitened >= 0 else -1)
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert r.whitened * sign == pytest.approx(whitened, rel=1e-8, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_covariance_is_centred_as_integers(spark):
    """A large common offset costs no digits."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 4, (200, 3))
    df = spark.createDataFrame([(i, [float(c) + 2.0**40 for c in v]) for i, v in enumerate(base.tolist())], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    fit = np.unique(base, axis=0) * 256
    values = np.sort(np.linalg.eigvalsh(np.cov(fit.T.astype(float), bias=True)))[::-1]
    assert [got[0, k].explained for k in (1, 2, 3)] == pytest.approx((values / values.sum()).tolist(), rel=1e-12)
    assert got[0, 1].identity_error < 1e-6
    n, sums = len(fit), [int(sum(fit[:, d] + (1 << 48))) for d in range(3)]
    assert int(got[5, 1].deviation) == sum((n * (int(base[5, d]) * 256 + (1 << 48)) - sums[d]) ** 2 for d in range(3))


def test_directions_without_variance_have_no_scale(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0]), (None, [3.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 8 and {r.n for r in got} == {3}
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert Fraction(int([r for r in got if r.vec_id == 1][0].deviation)) == 768**2
    single = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in single] == [(1, 0, None, None, None)] * 2


def test_huge_entries_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)
    empty = whitening.whiten(df.where("vec_id < 0"))
    assert empty.collect() == [] and empty.columns == whitening.whiten(df).columns
