import hashlib
import random

import pytest

from foliant.llm import substrings


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_interval_expansion_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        length, letters = r.choice([1, 2, 3, 5, 8]), r.choice([b"ab", b"abcd", bytes([0, 255])])
        parts = [bytes(r.choice(letters) for _ in range(r.randrange(20))) for _ in range(r.randrange(1, 8))]
        seen, want = set(), []
        for p in parts:
            found = []
            for i in range(len(p) - length + 1):
                if p[i : i + length] in seen:
                    found.append(i)
                seen.add(p[i : i + length])
            want.append(found)
        assert [x.tolist() for x in substrings.repeats(parts, length)] == want


def test_all_paths_against_brute_force(spark):
    r = random.Random(2)
    words = ["ab", "cde", "é ", "the quick ", " fox", "x" * 30]
    rows = [(i, "".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(70)] + [(500, None), (501, ""), (None, "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (20_000, 1):
        for length, anchor in ((20, 8), (100, 40)):
            got = sorted(map(tuple, substrings.judge(df, length=length, anchor=anchor, hot=hot).collect()), key=repr)
            assert got == brute(rows, length), (hot, length)


@pytest.mark.parametrize("length", [150, 300, 1000])
def test_longer_strings_against_brute_force(spark, length):
    r = random.Random(length)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared, other = word(3 * length), word(length + 7)
    rows = [(1, word(200) + shared), (2, shared), (3, word(50) + shared[length // 2 :] + other), (4, other + shared[: length - 20] + word(length)), (5, "ab" * length), (6, word(length - 1)), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (20_000, 1):
        got = sorted(map(tuple, substrings.judge(df, length=length, hot=hot).collect()), key=repr)
        assert got == brute(rows, length) and sum(x[2] for x in got) > 4 * length


def test_lengths_that_are_not_allowed(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for length, anchor in ((0, 1), (10, 11), (10, 0), (1 << 21, 40)):
        with pytest.raises(ValueError, match="must hold"):
            substrings.judge(df, length=length, anchor=anchor)


def test_chunks_give_the_same_strings():
    import numpy as np

    r = random.Random(8)
    raw = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 10, 300, 1000, 99, 250)]
    starts = np.r_[0, np.cumsum([len(x) for x in raw])][:-1]
    strings = lambda f: sorted((int(d), p, int(a)) for d, lo, hi, a in zip(*f[:4]) for p in range(int(lo), int(hi) + 1))
    whole = strings(substrings._in_chunks(raw, starts, 20, 8))
    assert len(whole) == sum(max(len(x) - 19, 0) for x in raw)
    old, substrings.CHUNK_BYTES = substrings.CHUNK_BYTES, 64
    try:
        assert strings(substrings._in_chunks(raw, starts, 20, 8)) == whole
    finally:
        substrings.CHUNK_BYTES = old


def test_odd_rows(spark, odd_docs):
    got = substrings.judge(odd_docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and got.count() == 9
    assert substrings.judge(odd_docs.limit(0)).count() == 0
    out = substrings.removed(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 9
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_repeated_rows_in_different_partitions(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = word(150)
    docs = [(1, word(400)), (2, word(120) + shared), (3, shared + word(200)), (4, word(50)), (None, word(300))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs + docs[::-1] + docs[:1] + docs[2:], 14), "doc_id long, text string")
    assert df.rdd.getNumPartitions() == 14
    want = {row[0]: row for row in brute(docs, 100)}
    assert want[1][2] == 0 and want[3][2] >= 150
    texts = dict(docs)
    for hot in (20_000, 1):
        got = sorted(map(tuple, substrings.judge(df, hot=hot).collect()), key=repr)
        assert got == sorted((want[x.doc_id] for x in df.collect()), key=repr), hot
        out = substrings.removed(df, hot=hot).collect()
        assert len(out) == 14 and all(len(x.text) == want[x.doc_id][1] - want[x.doc_id][2] for x in out), hot
        assert all(x.text == texts[x.doc_id] for x in out if x.doc_id in (1, 2, 4, None)), hot
