import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliant.llm import fingerprints, mixing, quality, queries, topk, urls


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("quality", "predicted").collect()
    right = sum(r.quality == r.predicted for r in got)
    assert len(got) > 80 and right >= 0.95 * len(got)


def test_quality_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        model = quality.fit(odd_docs, lab)
        rows = quality.score(odd_docs, model).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score(odd_docs.limit(0), model).count() == 0
    assert quality.rejected_removed(odd_docs, model).columns == odd_docs.columns


def test_url_parts_and_rules(spark):
    rows = [("http://A.Example.com/EN/x?y", "a.example.com", "/EN/x", "com/", "allow"), ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"), ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://b.net/es/#f", "b.net", "/es/", "net/es/", "block"), ("http://b.net/de/", "b.net", "/de/", None, "allow"), ("http://com", "com", "", None, "allow"), ("http://notcom/en/", "notcom", "/en/", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("http:///x", "", "/x", None, "allow"), ("ftp://É.com/\n/x", "É.com", "/\n/x", "com/", "allow")]
    pages = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)] + [(1, rows[1][0]), (None, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    want = sorted([(i, *r[1:]) for i, r in enumerate(rows)] + [(1, *rows[1][1:]), (None, "", "", None, "allow")], key=repr)
    for most in (20_000, 0):
        urls.BROADCAST_RULES = most
        got = sorted(map(tuple, urls.judge(pages, urls.rule_table(spark, urls.RULES)).collect()), key=repr)
        assert got == want, most
    urls.BROADCAST_RULES = 20_000
    for bad in ("net/es", "net", ""):
        with pytest.raises(ValueError, match="slash"):
            urls.judge(pages, urls.rule_table(spark, [*urls.RULES, (bad, "block")]))
    assert urls.judge(pages, urls.rule_table(spark, [])).filter("rule IS NOT NULL").count() == 0
    assert urls.judge(pages.limit(0), urls.rule_table(spark, urls.RULES)).count() == 0


def test_fingerprints(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice("abcdefghijk") * r.randrange(1, 4) for _ in range(r.randrange(1, 200)))) for k in range(30)] + [(40, ""), (41, None), (42, rows_text := "same text twice over here"), (43, rows_text), (44, "é😀" * 50)]
    got = {x.doc_id: x for x in fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = [(i, t or "") for i, t in rows]
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1]):
        q = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
    assert got[42].fingerprint == got[43].fingerprint and got[42].near_next == 1.0
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got.values())


def test_signature_feels_order(spark):
    words = [f"w{k}" for k in range(400)]
    swapped = words[200:] + words[:200]
    replaced = words[:380] + [f"v{k}" for k in range(20)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(replaced))], "id long, text string").repartition("id")
    sig = {r.id: r.signature for r in fingerprints.with_signature(rows, "text", "signature").collect()}
    # the same from the words, numbered by occurrence one after another
    again = spark.createDataFrame([(4, "a b a b a b c"), (5, " a\tb a b\na b c ")], "id long, text string")
    assert len({tuple(r.signature) for r in fingerprints.with_signature(again, "text", "signature").collect()}) == 1
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / len(sig[a])
    assert like(1, 3) > like(1, 2) and like(1, 2) < 0.8


def _signature(text):
    """The same by brute force: for each tuple, all k-mers in its ordering, the first ones in the order of the text."""
    import xxhash

    def chain(values, seed=42):
        for v in values:
            if v is not None:
                seed = xxhash.xxh64(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed=seed).intdigest()
        return seed

    words, bits = text.split(), fingerprints.PLACE_BITS
    words += [None] * (fingerprints.K - len(words))
    seen, marks = {}, []
    signed = lambda h: (h + 2**63) % 2**64 - 2**63 >> bits
    for i in range(len(words) - fingerprints.K + 1):
        h = signed(chain(words[i : i + fingerprints.K]))
        nth = seen[h] = seen.get(h, -1) + 1
        import xxhash as x

        marks.append((signed(x.xxh64(nth.to_bytes(4, "little"), seed=chain([h])).intdigest()), i))
    out = []
    for start in fingerprints.starting_points():
        order = sorted(marks, key=lambda m: ((m[0] - (start >> bits)) % 2 ** (64 - bits), m[1]))[: fingerprints.PARTS]
        h = chain([m[0] % 2 ** (64 - bits) for m in sorted(order, key=lambda m: m[1])])
        out.append((h + 2**63) % 2**64 - 2**63)
    return out


def test_signature_against_brute_force(spark):
    r = random.Random(8)
    texts = ["", "one", "two words", "a b a b a b a b", "x " * 50] + [" ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(1, 120))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: x.signature for x in fingerprints.with_signature(df, "text", "signature").collect()}
    for i, t in enumerate(texts):
        assert got[i] == _signature(t), t
    near = {x.doc_id: x for x in fingerprints.compare(df.withColumnRenamed("id", "doc_id")).collect()}
    for i, t in enumerate(texts):
        n = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        a, b, c = _signature(t), _signature(t[: len(t) - q] + n[:q]), _signature(n)
        assert near[i].near_edited == sum(x == y for x, y in zip(a, b)) / 32 and near[i].near_next == sum(x == y for x, y in zip(a, c)) / 32
        assert near[i].fingerprint == "-".join(f"{x % 2**64:016X}" for x in a)


def test_fingerprint_odd_rows(spark, odd_docs):
    rows = fingerprints.compare(odd_docs).collect()
    assert len(rows) == 9 and len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert fingerprints.compare(odd_docs.limit(0)).count() == 0
    alone = fingerprints.compare(odd_docs.filter("doc_id = 6")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_targets_are_a_water_level(spark):
    r = random.Random(4)
    for _ in range(8):
        sizes = {f"s{k:02}" if k else None: r.choice([0, 1, 5, 100, 1000, 40_000]) for k in range(r.randrange(1, 9))}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
        weight = {s: 1 + k % 3 for k, s in enumerate(names)}
        total, full = sum(sizes.values()), set()
        while True:
            rest = total - sum(3 * sizes[s] for s in full)
            free = [s for s in names if s not in full]
            share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            if not over:
                break
            full |= over
        for s in names:
            assert got[s] == pytest.approx(3 * sizes[s] if s in full else share[s])


def test_knapsack_against_all_subsets():
    r = random.Random(2)
    for _ in range(100):
        n = r.randrange(1, 6)
        lengths, counts = r.sample(range(1, 30), n), [r.randrange(1, 4) for _ in range(n)]
        sums = {0}
        for a, c in zip(lengths, counts):
            sums = {s + a * k for s in sums for k in range(c + 1)}
        budget = r.randrange(1, 80)
        take = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(a * t for a, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


def test_mix(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 9 and all(r.taken == r.size * r.copies <= 3 * r.size for r in rows)
    assert sorted(map(tuple, mixing.mix(odd_docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.mixed(odd_docs).count() == sum(r.copies for r in rows)
    r = random.Random(9)
    many = spark.createDataFrame([(k, "w " * r.randrange(1, 90), f"s{k % 4}") for k in range(800)], "doc_id long, text string, source string")
    sums = mixing.mix(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 4 and all(abs(x.taken - x.target) <= 1 for x in sums)


def test_top_k_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    rows = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(400)] + [(k, [0.5] * 8) for k in range(400, 460)] + [(500, None), (None, [1.0] * 8), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (0, None)]
    for name, v in (("CELL_ROWS", 64), ("BLOCK", 16), ("ANNULUS", 8), ("PIVOTS", 5), ("SAMPLE", 50)):
        monkeypatch.setattr(topk, name, v)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = {r.vec_id: r.vector for r in topk.integers(df, "vec_id", "embedding").collect()}
    assert len(exact) == 460
    want = []
    for q in exact:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(exact[q], exact[v])), v) for v in exact if v != q)[:20]
            want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(scored)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id IN (20, 21)")).count() == 1


def test_quality_score_by_hand(spark):
    """The score from the parts: sizes with each dictionary, their normalised difference, and the logistic curve."""
    import math

    import zstandard

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    make = lambda content: zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
    good, bad = make(model.good), make(model.bad)
    for r in docs.limit(60).collect():
        raw = (r.text or "").encode()
        blocks = [raw[k : k + quality.BLOCK] for k in range(0, len(raw), quality.BLOCK)]
        g, b = (sum(len(c.compress(x)) for x in blocks) for c in (good, bad))
        diff = (b - g) / max(g + b, 1)
        z = model.curve[0] + model.curve[1] * diff + model.curve[2] * diff * math.log1p(len(raw))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9
