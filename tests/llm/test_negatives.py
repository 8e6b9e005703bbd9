"""Hard negatives against brute force."""

import numpy as np
import pytest

from foliant.llm import negatives


def plain(rows, anchors=50, low=50, high=95):
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    out = []
    for a in np.flatnonzero(ids % anchors == 0):
        s = x @ x[a]
        p = np.flatnonzero((labels == labels[a]) & (ids != ids[a]))
        for i in p[np.lexsort((ids[p], -s[p]))][:5]:
            g = np.flatnonzero((labels != labels[a]) & (100 * s >= low * s[i]) & (100 * s <= high * s[i]))
            out += [(ids[a], ids[i], k + 1, ids[j], s[i], s[j]) for k, j in enumerate(g[np.lexsort((ids[g], -s[g]))][:3])]
    return sorted(tuple(map(int, r)) for r in out)


def made(rng, kind: str, n: int = 900):
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(9, 6)), n // 9, 0) + rng.normal(size=(n, 6)) * 0.05
    elif kind == "few":  # most rows equal, many ties
        x = rng.integers(-1, 2, (n, 3)) * 1.0
        x[: n // 2] = 1.0
    else:
        x = rng.normal(size=(n, 8)) * rng.exponential(size=(n, 1))
    return [(int(i), int(label), v.tolist()) for i, label, v in zip(rng.permutation(n), rng.integers(0, 3, n), x, strict=True)]


@pytest.mark.parametrize(("kind", "cells", "leaf", "block"), [("clusters", 100, 16, 2048), ("few", 60, 8, 7), ("spread", 200, 16, 30), ("spread", 10**6, 300, 2048)])
def test_all_shapes(spark, monkeypatch, kind, cells, leaf, block):
    for name, v in (("CELL_ROWS", cells), ("LEAF", leaf), ("BLOCK", block), ("FANOUT", 5), ("SAMPLE", 50)):
        monkeypatch.setattr(negatives, name, v)
    rows = made(np.random.default_rng(7), kind)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    known = [(i, (c + 1) % 10 if i % 7 == 0 else c, np.floor(256 * np.array(v)).astype(np.int64)) for i, c, v in rows]
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == plain(known)


def test_siblings_are_eliminated(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 6)) * 1000
    y = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(1600, 6))).astype(np.int64)
    met = []
    meet = negatives.Windows.meet
    monkeypatch.setattr(negatives.Windows, "meet", lambda self, need, rows, ids, label: (met.append(len(need) * len(rows)), meet(self, need, rows, ids, label)))
    x = y[::100]
    win = negatives.Windows(x, np.arange(16) * 100, np.zeros(16, np.int64), np.full(16, negatives.NONE), np.full(16, -negatives.NONE), 5, True)
    order = rng.permutation(1600)
    negatives.search(negatives.Space(float((y.astype(float) ** 2).sum(1).max())), win, np.arange(16), y[order], order, np.zeros(1600, np.int64))
    s = x @ y.T
    s[np.arange(16), np.arange(16) * 100] = negatives.NONE
    assert (win.score == np.sort(s, 1)[:, ::-1][:, :5]).all() and sum(met) < 0.6 * 16 * 1600


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [1.0, 0.25]), (1, 1, [1.0, 0.25]), (2, 2, [0.75]), (3, 3, [0.7, 0.1]), (50, 3, [-1.0, -1.0]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 2, [nan, 1.0]), (8, 2, [1.0, None]), (None, 2, [0.7, 0.2]), (9, 2, [inf, 0.0])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, label int, embedding array<double>, own int").selectExpr("*", "vec_id AS window", "label AS cell", "vec_id AS n")
    got = sorted(map(tuple, negatives.hard_negatives(df).collect()))
    pad = lambda v: np.floor(256 * np.array(v + [0.0] * (2 - len(v)))).astype(np.int64)
    known = {(i, (c + 1) % 10 if i % 7 == 0 else c, tuple(pad(v))) for i, c, v in [r for r in rows[:7]]}
    assert got == plain([(i, c, np.array(v)) for i, c, v in sorted(known)]) and got
    assert negatives.hard_negatives(df.limit(0)).count() == 0 and negatives.hard_negatives(df.filter("label = 1")).count() == 0
    assert negatives.hard_negatives(df, positives=1, negatives=1).count() <= 3
