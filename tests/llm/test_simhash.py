"""SimHash fingerprints and components against plain versions."""

import random
import re

import numpy as np
import xxhash

from foliant.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def least_reached(prints: dict, radius: int) -> dict:
    seen, out = set(), {}
    for i in sorted(prints):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                x = todo.pop()
                new = {j for j in prints if j not in group and bin(prints[x] ^ prints[j]).count("1") <= radius}
                group |= new
                todo += new
            seen |= group
            out |= dict.fromkeys(group, i)
    return out


def test_fingerprint():
    r = random.Random(3)
    for t in (None, "", " \t", "One", "one two three", " A b\tC\x0bd ", "É x y\x1fz ú", "a\xa0b c", " ".join(r.choice("abcdef") for _ in range(900))):
        assert simhash.fingerprint(t) == plain(t), t
    text = " ".join(str(k % 5000) for k in range(70_000))  # hashes are counted in parts
    assert simhash.fingerprint(text) == plain(text)


def test_forest_connects_what_all_pairs_do():
    r = np.random.default_rng(5)
    for low in (4, 8):
        base = r.integers(0, 2**63, 60, dtype=np.uint64)
        flips = [np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, low), replace=False))) for _ in range(600)]
        prints = np.unique(np.concatenate([base[r.integers(0, 60, 600)] ^ np.array(flips, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]))
        for one, two in ((prints, None), (prints[::2], prints[1::2])):
            a, b = simhash.near_forest(one, two, 4)
            parent = {int(x): int(x) for x in prints}

            def top(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                assert top(x) != top(y)  # a forest
                parent[top(x)] = top(y)
            pairs = [(x, y) for x in one.tolist() for y in (one if two is None else two).tolist() if bin(x ^ y).count("1") <= 4]
            assert all(top(x) == top(y) for x, y in pairs)
            want = {int(x): int(x) for x in prints}
            for _ in range(70):
                for x, y in pairs:
                    want[x] = want[y] = min(want[x], want[y])
            assert len({top(int(x)) for x in prints}) == len(set(want.values()))


def test_components(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefghij") * r.randrange(1, 3) for _ in range(200)) for _ in range(12)]
    docs = [(k, t) for k, t in enumerate(texts)]
    for k in range(60):  # near copies of some, exact copies of one
        words = texts[k % 4].split()
        words[r.randrange(200)] = f"w{k}"
        docs.append((100 + k, " ".join(words)))
    docs += [(300 + k, texts[5]) for k in range(40)] + [(400, ""), (401, None), (402, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    prints = {i: plain(t) for i, t in docs}
    want = {radius: least_reached(prints, radius) for radius in (4, 9)}
    assert len(set(want[9].values())) < len(set(want[4].values())) < 70
    for radius, block in ((4, 1 << 16), (4, 5), (9, 7)):
        got = {x.doc_id: x for x in simhash.linked(df, radius=radius, block=block).collect()}
        assert {i: int(x.fingerprint, 16) for i, x in got.items()} == prints
        assert {i: x.component_id for i, x in got.items()} == want[radius], (radius, block)


def test_odd_rows(spark, odd_docs):
    rows = simhash.linked(odd_docs.withColumn("print", odd_docs.lang).withColumn("group", odd_docs.lang)).collect()
    assert len(rows) == 9 and sorted((x.doc_id, x.component_id) for x in rows if x.fingerprint == "0" * 16) == [(3, 3), (4, 3)]
    assert sorted(x.component_id for x in rows if x.doc_id in (1, 2)) == [1, 1, 1]
    assert [x.component_id for x in rows if x.doc_id is None] == [None]
    assert simhash.linked(odd_docs.limit(0)).count() == 0
