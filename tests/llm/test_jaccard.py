import random

import pytest

from foliant.llm import jaccard
from foliant.llm.components import components


def brute(rows, threshold=0.8, words=5):
    sets = []
    for i, t in rows:
        w = (t or "").split()
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))) if w else frozenset()))
    classes = {}
    for i, s in sets:
        classes.setdefault(s, []).append(i)
    rep = {s: min((i for i in ids if i is not None), default=None) for s, ids in classes.items()}
    near = {s: [t for t in classes if t != s and rep[t] is not None and s and t and len(s & t) >= threshold * len(s | t)] if rep[s] is not None else [] for s in classes}
    group = {}
    for s in classes:
        seen, todo = {s}, [s]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        group[s] = min((rep[t] for t in seen if rep[t] is not None), default=None)
    return sorted(((i, group[s], len(classes[s]), len(near[s]), rep[s]) for i, s in sets), key=repr)


def texts(n, r):
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(1, 120))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out


def test_links_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = list(enumerate(texts(300, r))) + [(1000, ""), (1001, None), (1002, "two words"), (1003, "two words"), (None, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sum(x[3] for x in want) > 500
    assert sorted(map(tuple, jaccard.linked(df).collect()), key=repr) == want
    assert any(x[1] != x[4] for x in want)
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # clusters over several blocks
    monkeypatch.setattr(jaccard, "NODE", 20)  # nodes that are tied without comparison
    assert sorted(map(tuple, jaccard.linked(df).collect()), key=repr) == want


def test_an_id_with_several_texts(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, two + " more"), (1, one)]
    got = sorted(map(tuple, jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    assert got == [(1, 1, 1, 1, 1), (1, 1, 2, 1, 1), (1, 1, 2, 1, 1), (2, 1, 1, 1, 2), (3, 1, 2, 1, 3), (4, 1, 2, 1, 3)]


def test_prefixes_in_a_node():
    import numpy as np

    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 16, 120)
    labels = np.tile(base, (300, 1))
    for k in range(300):  # very near copies: 2 labels in 100 differ
        at = r.choice(np.arange(6, 120), 2, replace=False)
        labels[k, at] = r.integers(0, 1 << 16, 2)
    labels[299, 4:] = r.integers(0, 1 << 16, 116)  # shares the shortest prefix and nothing else
    near = jaccard.matches(labels.astype(np.uint16), 0, 20, 6, 3, 0.8, 0.999, 60)
    assert near[:299, :299].sum() == 299 * 298 and not near[299].any()
    assert jaccard.matches(labels[:2].astype(np.uint16), 0, 20, 6, 3, 0.8, 0.999, 60).all() == False  # noqa: E712
    assert (jaccard.matches(labels.astype(np.uint16), 0, 20, 6, 3, 0.8, 0.999999, 60) == near).all()


def test_recall_of_the_labels_and_prefixes():
    import numpy as np

    least, r = jaccard.plausible(0.8, 120), random.Random(3)
    assert 50 <= least <= 70
    factors, found = jaccard._factors(120), 0
    for _ in range(300):
        common = {r.getrandbits(64) for _ in range(160)}
        a, b = (np.array(sorted(common | {r.getrandbits(64) for _ in range(20)}), np.uint64) for _ in range(2))
        x, y = (np.frombuffer(jaccard.signature(s, factors), ">u2").reshape(20, 6) for s in (a, b))
        assert (x == y).sum() >= least
        found += bool((x[:, :3] == y[:, :3]).all(1).any())
    assert found == 300


def test_one_of_each_group_stays(spark):
    r = random.Random(6)
    rows = list(enumerate(texts(150, r)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x[0] for x in jaccard.one_of_each(df).collect())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))} for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low = min(root[a], root[b])
                    old = {root[a], root[b]}
                    root = {k: low if v in old else v for k, v in root.items()}
                    changed = True
    assert got == sorted(set(root.values()))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_is_shortened_to_the_target():
    assert jaccard.prefix_depth(0.8, 20, 4, 0.999999) == 3 and jaccard.prefix_depth(0.8, 20, 4, 0.99) == 4
    with pytest.raises(ValueError):
        jaccard.prefix_depth(0.1, 2, 4, 0.99)


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in jaccard.linked(odd_docs).collect()}
    assert (1, 1, 3, 0) in got and (2, 1, 3, 0) in got and (3, 3, 2, 0) in got and (4, 3, 2, 0) in got and (None, None, 1, 0) in got
    assert jaccard.linked(odd_docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3, 5, 6, 7]
