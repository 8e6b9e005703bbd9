"""Whitening against a plain version in floating point, and its exact parts against other ways to the same."""

from fractions import Fraction

import numpy as np
import pytest

from foliant.llm import whitening as w


def plain(x, count):
    """(roots, whitened, deviations) by a library's eigenvalues of the integer vectors ``x``."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    dev = [sum(int(n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
    return e, (x - s / n) @ v[:, :count] / np.sqrt(e[:count]), dev


def test_gram():
    r = np.random.default_rng(0)
    for high in (300, 10**9, 2**40):
        a = r.integers(-high, high, (50, 3))
        assert (w.gram(a) == a.astype(object).T @ a.astype(object)).all()


def test_primes():
    got = w.primes_below(1000, 30)
    assert got == [p for p in range(999, 1, -1) if all(p % q for q in range(2, p))][:30]
    assert all(p < 2**31 and pow(3, p - 1, p) == 1 for p in w.primes_below(1 << 31, 2000))


def test_characteristic_polynomial(spark):
    r = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        for sparse in (False, True):  # zeros need other pivots
            a = r.integers(-40, 40, (d + 2, d)).astype(object)
            if sparse:
                a[:, ::2] *= 0
            m = a.T @ a
            # by traces of powers, in fractions
            want, power = [Fraction(1)], np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
            for k in range(1, d + 1):
                power = m @ power
                want.append(-Fraction(int(sum(power[i, i] for i in range(d))), k))
                power = power + np.array([[want[-1] * int(i == j) for j in range(d)] for i in range(d)], object)
            assert w.characteristic(spark, m) == [int(x) for x in reversed(want)]


def test_roots():
    # (t - 1)(t - 2)^3 (t - 10^12)(t - 10^12 - 1) t^2
    poly = [1]
    for root in (1, 2, 2, 2, 10**12, 10**12 + 1, 0, 0):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    got = w.largest_roots(poly, 8)
    assert [t for _, t in got] == [1, 1, 3, 1]
    assert all(abs(a - b) < 1e-40 for a, b in zip([x for x, _ in got], (10**12 + 1, 10**12, 2, 1), strict=True))
    assert w.largest_roots([0, 0, 1], 2) == []
    # an irrational root, to all digits
    (root, times), *_ = w.largest_roots([1, -4, 1], 2)
    with w.decimal.localcontext() as ctx:
        ctx.prec = 80
        assert times == 1 and abs((root - 2) ** 2 - 3) < 1e-58


def test_null_vectors():
    m = np.array([[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 3, 0], [0, 0, 0, 7]], object)
    for root, times in ((7, 1), (3, 2), (1, 1)):
        v = w.null_vectors(m, w.decimal.Decimal(root), times)
        assert np.abs(v.T @ v - np.eye(times)).max() < 1e-15 and np.abs(m.astype(float) @ v - root * v).max() < 1e-15


@pytest.mark.parametrize("path", ["sf0.001", "sf0.1"])
def test_whitened(spark, path):
    table = spark.read.parquet(f"/root/testdata/{path}/embeddings.parquet")
    got = sorted(w.whiten(table).collect())
    rows = sorted((x.vec_id, x.embedding) for x in table.collect())
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    e, white, dev = plain(x, 16)
    assert [(g.vec_id, g.component) for g in got] == [(i, c) for i, _ in rows for c in range(1, 17)]
    mine = np.array([g.whitened for g in got]).reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9
    assert [g.deviation for g in got[::16]] == dev and {g.n for g in got} == {len(np.unique(x, axis=0))}
    assert np.allclose([g.explained for g in got[:16]], e[:16] / e.sum(), rtol=1e-12) and {g.identity_error for g in got}.pop() < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (2, [1.0, -1.0, 0.0]), (2, [1.0, -1.0, 0.0]), (None, [3.0, 2.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n int").selectExpr("*", "vec_id AS x", "vec_id AS component")
    got = sorted(w.whiten(df).collect(), key=repr)
    kept = [(1, [0.5, 1, 2]), (2, [1, -1, 0]), (2, [1, -1, 0]), (7, [9, 9, 9]), (None, [3, 2, 0])]
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(np.int64) + 1_000_000
    e, white, dev = plain(x, 3)
    assert len(got) == 15 and {g.n for g in got} == {4}
    by = {(g.vec_id, g.component): g for g in got}
    for (i, _), row, d in zip(kept, white, dev, strict=True):
        assert by[i, 1].deviation == d and np.allclose([abs(by[i, c].whitened) for c in (1, 2, 3)], np.abs(row), atol=1e-9)
    # variance in two directions only, in none, and no rows at all
    assert w.whiten(df.filter("vec_id IN (1, 2, 7)")).agg({"component": "max"}).first()[0] == 2
    assert w.whiten(df.filter("vec_id = 2")).count() == 0 and w.whiten(df.limit(0)).count() == 0 and w.whiten(df.filter("vec_id = 3")).count() == 0
    assert w.whiten(df, components=2).agg({"component": "max"}).first()[0] == 2
