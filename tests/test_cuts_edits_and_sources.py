"""Exact cuts, synthesis to quota, splits with counts, edits and their spans, source lists from positioned items."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import builds, cuts, edits, reports
from foliant.sources import loaders


@pytest.mark.parametrize("small", [10_000, 3])
def test_cuts_are_those_of_a_sort(spark, monkeypatch, small):
    monkeypatch.setattr(cuts, "SMALL", small)
    r = random.Random(1)
    rows = [(k, r.choice("abbbbc"), r.random()) for k in range(700)]
    df = spark.createDataFrame(rows, "row_id long, label string, hardness double").repartition(5)
    want = {"a": 20, "b": 150, "c": 10_000, "d": 5, "e": 0}
    key = builds.seeded("s", "row_id")
    order = {x.row_id: x.k for x in df.select("row_id", key.alias("k")).collect()}
    got = sorted(x.row_id for x in cuts.least(df, want, "label", key).collect())
    assert got == sorted(i for c, n in want.items() for i in sorted([i for i, y, _ in rows if y == c], key=order.get)[:n])
    assert sorted(x.row_id for x in builds.seeded_cap(df, 33, "s", "row_id").collect()) == sorted(sorted(order, key=order.get)[:33])
    capped = builds.capped_by(df, {"b": 7}, "label", "s", "row_id").groupBy("label").count().collect()
    assert dict(map(tuple, capped))["b"] == 7 and dict(map(tuple, capped))["a"] == sum(y == "a" for _, y, _ in rows)
    assert cuts.least(df.limit(0), want, "label", key).count() == 0 and cuts.least(df, {}, "label", key).count() == 0


@pytest.mark.parametrize("small", [10_000, 2])
def test_hardest_rows_with_ties(spark, monkeypatch, small):
    monkeypatch.setattr(cuts, "SMALL", small)
    r = random.Random(2)
    rows = [(k, r.choice([0.0, 0.25, 0.5, 0.5, 1.25, r.random()])) for k in range(300)]
    df = spark.createDataFrame(rows, "row_id long, hardness double").repartition(4)
    for most, others in ((40, 25), (0, 10), (400, 10)):
        got = builds.hardest(df, most, others, "9", "row_id").collect()
        hard = {x.row_id for x in got if x.pick == "hard"}
        assert hard == {i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:most]}
        rest = {x.row_id for x in got if x.pick == "random"}
        assert not hard & rest and len(rest) == min(others, 300 - len(hard))


def test_clauses_and_templates(spark):
    rows = spark.createDataFrame([("The yield was high in all of it..",), ("DNA was seen.",), ("A thing was there.",), (" ".join(f"w{k}" for k in range(40)),)], "text string")
    assert [x.c for x in rows.select(builds.clause(F.col("text")).alias("c")).collect()] == ["the yield was high in all of it", "DNA was seen", "A thing was there", " ".join(f"w{k}" for k in range(28))]
    every = [t for x in (builds.TEMPLATES, builds.UNSEEN_TEMPLATES) for ts in x.values() for t in ts]
    assert len(every) == len(set(every)) == 43 and all(t.count("{clause}") == 1 for t in every)


def test_synthesis_to_quota(spark):
    pool = spark.createDataFrame([(f"r{k}", f"The sample number {k} was kept in a cold place for some days.") for k in range(30)] + [("short", "Too short.")], "row_id string, text string")
    seen = pool.select(builds.text_key().alias("key"))
    need = {"novelty": 12, "numeric": 60, "publication": 0}
    made = builds.synthesized(pool, seen, need, builds.TEMPLATES, "1").collect()
    assert {c: sum(x.label == c for x in made) for c in need} == need
    assert len({x.text.lower() for x in made}) == len(made) and all(any(x.text == t.replace("{clause}", x.text) or t.split("{clause}")[0] in x.text for t in builds.TEMPLATES[x.label]) for x in made)
    again = builds.synthesized(pool.repartition(7), seen, need, builds.TEMPLATES, "1").collect()
    assert sorted(made) == sorted(again)
    assert builds.synthesized(pool, seen, {"novelty": 500}, builds.TEMPLATES, "1").count() <= 93  # three rounds of a pool of 31
    taken = spark.createDataFrame(made).select("key")
    assert not {x.key for x in builds.synthesized(pool, taken, need, builds.TEMPLATES, "1").collect()} & {x.key for x in made}


def test_counts_come_from_the_write(spark, tmp_path):
    rows = spark.createDataFrame([("train", "1", "a"), ("train", "0", "b"), ("test", "1", "c"), ("train", None, "d"), ("other", "1", "e")], "split string, label string, text string")
    got = loaders.write_splits(rows, f"{tmp_path}/x", ["train", "test"], ["0", "1"])
    assert got == {("train", "0"): 1, ("train", "1"): 1, ("test", "0"): 0, ("test", "1"): 1, ("other", "other"): 2}
    assert spark.read.json(f"{tmp_path}/x/rows").count() == 5 and spark.read.json(f"{tmp_path}/x/counts").agg({"n": "sum"}).first()[0] == 5
    bad = rows.withColumn("text", F.expr("raise_error('no')"))
    with pytest.raises(Exception, match="no"):
        loaders.write_splits(bad, f"{tmp_path}/y", ["train"], ["1"])
    assert not os.path.exists(f"{tmp_path}/y/counts")


def test_pair_corpus_frames(spark):
    text = lambda k: f"the number {k} of these sentences is long enough to be kept in it"
    pairs = spark.createDataFrame([(k, text(k), text(k + 500)) for k in range(40)] + [(99, text(3), text(3).upper()), (98, text(4), text(977)), (97, "short", text(5))], "pair_id long, a string, b string")
    rows = builds.pair_corpus(pairs, 25, "1").collect()
    plain = [x for x in rows if not x.wrapped]
    assert {t: sum(x.task == t for x in plain) for t in ("forward", "backward")} == {"forward": 25, "backward": 25}
    assert len({x.input[:200].lower() for x in plain}) == 50
    by = {x.id: x for x in plain}
    framed = [x for x in rows if x.wrapped]
    assert len(framed) == 50 and all(x.input.endswith(by[x.id.removesuffix("/report")].input) and x.split == by[x.id.removesuffix("/report")].split for x in framed)
    back = spark.createDataFrame([(x.input,) for x in framed], "t string").select(builds.unframed("t").alias("t")).collect()
    assert sorted(x.t for x in back) == sorted(x.input for x in plain)


def test_spans_of_applied_edits(spark):
    docs = spark.createDataFrame([(1, "aaa BBB ccc DDD eee"), (2, "one two three four"), (3, "short"), (4, "none here")], "doc_id long, full_text string")
    changes = spark.createDataFrame([(1, "e1", 4, 7, "LONGER-ONE"), (1, "e2", 12, 15, "XY"), (2, "o1", 0, 7, "ONE"), (2, "o2", 4, 13, "BAD"), (3, "x", 2, 999, "ZZ"), (3, "y", -1, 2, "ZZ"), (2, "n", 14, 18, None)], "doc_id long, edit_id string, start_offset int, end_offset int, replacement string")
    revised = {x.doc_id: (x.revised, x.applied, x.skipped) for x in edits.apply_edits(docs, changes).collect()}
    assert revised == {1: ("aaa LONGER-ONE ccc XY eee", 2, 0), 2: ("ONE three four", 1, 2), 3: ("short", 0, 2), 4: ("none here", 0, 0)}
    for x in edits.applied_spans(docs, changes).collect():
        assert revised[x.doc_id][0][x.new_start : x.new_end] == x.replacement
    spans = spark.createDataFrame([(1, 0, 3), (1, 4, 7), (1, 8, 11), (1, 16, 19), (2, 8, 13), (2, 14, 18), (4, 0, 4)], "doc_id long, start_offset int, end_offset int")
    texts = {x.doc_id: x.full_text for x in docs.collect()}
    moved = edits.mapped_spans(spans, docs, changes).collect()
    assert [x.new_start for x in moved if (x.doc_id, x.start_offset) == (1, 4)] == [None]
    kept = [x for x in moved if x.new_start is not None]
    assert len(kept) == 6 and all(revised[x.doc_id][0][x.new_start : x.new_end] == texts[x.doc_id][x.start_offset : x.end_offset] for x in kept)


def test_many_random_edits(spark):
    r = random.Random(6)
    docs, changes = [], []
    for d in range(30):
        docs.append((d, "".join(r.choice("abc ") for _ in range(80))))
        for k in range(12):
            s = r.randrange(78)
            changes.append((d, f"{k:02}", s, s + r.randrange(1, 9), "X" * r.randrange(6)))
    got = {x.doc_id: x.revised for x in edits.apply_edits(spark.createDataFrame(docs, "doc_id long, full_text string"), spark.createDataFrame(changes, "doc_id long, edit_id string, start_offset int, end_offset int, replacement string")).collect()}
    for d, t in docs:
        at, out = 0, ""
        for _, _, s, e, x in sorted([c for c in changes if c[0] == d], key=lambda c: (c[2], c[3], c[4])):
            if s >= at and e <= len(t):
                out, at = out + t[at:s] + x, e
        assert got[d] == out + t[at:]


def test_highlights(spark):
    r = random.Random(8)
    docs = [(d, "x" * 60) for d in range(20)] + [(50, ""), (51, "y" * 9)]
    spans = [(d, s, s + r.randrange(0, 12), f"f{k:02}") for d in range(20) for k in range(10) for s in [r.randrange(-3, 58)]]
    got = {}
    for x in edits.highlights(spark.createDataFrame(spans, "doc_id long, start_offset int, end_offset int, finding_id string"), spark.createDataFrame(docs, "doc_id long, full_text string")).collect():
        got.setdefault(x.doc_id, []).append((x.start_offset, x.end_offset, x.finding_id))
    assert got[51] == [(0, 9, None)] and 50 not in got
    for d in range(20):
        want, at = [], 0
        for _, s, e, i in sorted([x for x in spans if x[0] == d and 0 <= x[1] < x[2] <= 60], key=lambda x: (x[1], -x[2], x[3])):
            if s >= at:
                want += [(at, s, None)] * (s > at) + [(s, e, i)]
                at = e
        want += [(at, 60, None)] * (at < 60)
        assert sorted(got[d]) == want


def test_protected_tokens(spark):
    text = "The α-phase of gan and SiO2 (AB12/x) by NASA at 3.5 × 10 -3 and 12% [1, 2] (Smith et al., 2015)."
    df = spark.createDataFrame([(text, "The phase of gan at 12%")], "a string, b string")
    row = df.select(edits.protected_tokens("a").alias("p"), edits.restored("a", "b").alias("r")).first()
    assert {"α", "gan", "SiO2", "AB12/x", "NASA", "3.5 × 10 -3", "12%", "[1, 2]", "(Smith et al., 2015)"} <= set(row.p)
    assert row.r.startswith("The phase of gan at 12% (α, ") and "12%" not in row.r[30:]


def test_source_list(spark):
    page4 = [("ORIGINALITY REPORT", 32, 728), ("8", 32, 688), ("%", 52, 688), ("SIMILARITY INDEX", 32, 675), ("PRIMARY SOURCES", 32, 651), ("1", 37, 620), ("1", 564, 617), ("%", 578, 617), ("www.example.com", 62, 626), ("Internet Source", 62, 616), ("2", 37, 580), ("<", 552, 576), ("1", 564, 576), ("%", 578, 576), ('"Handbook of Things", Wiley, 2019', 62, 586), ("Publication", 62, 575)]
    more = [("3", 37, 60), ("Submitted to Some", 62, 66), (" University", 160, 65), ("7", 564, 57), ("%", 578, 57), ("2", 37, 30), ("A second entry of number two", 62, 36)]
    page5 = [("Student Paper", 62, 700), ("4", 37, 650), ("A title without", 62, 656), ("a share or a label", 62, 640), ("5", 37, 600), ("12", 552, 600), ("%", 578, 600)]
    rows = [("r", 1, "paper.docx", 257.0, 617.0), ("r", 2, "1", 176.0, 596.0), ("r", 3, "1", 461.0, 671.0), ("s", 1, "1", 37.0, 620.0), ("s", 1, "No such report", 62.0, 626.0)]
    rows += [("r", p, t, float(x), float(y)) for p, items in ((4, page4 + more), (5, page5)) for t, x, y in items] + [("r", 4, None, 62.0, 500.0)]
    df = spark.createDataFrame(rows, "report_id string, page int, str string, x double, y double")
    for parts in (1, 5):
        got = {x.number: (x.title, x.url, x.pct, x.source_type) for x in reports.source_list(df.repartition(parts)).collect()}
        assert got == {
            1: ("www.example.com", "https://www.example.com", 1.0, "internet"), 2: ('"Handbook of Things", Wiley, 2019', None, 0.5, "publication"),
            3: ("Submitted to Some University", None, 7.0, "student_paper"), 4: ("A title without a share or a label", None, 0.0, "unknown"),
        }


def test_rouge_by_bits():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        want = 2 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0
        assert builds.rouge_l(" ".join(a), " ".join(b)) == want
    long = " ".join(str(k % 997) for k in range(20_000))
    assert builds.rouge_l(long, long) == 1.0




def test_made_sentences_are_drawn_as_from_all_that_could_be_made(spark):
    """What is drawn first is as if all had been made, texts that come twice and seen ones left out; little is written of a large pool."""
    from foliant.operators import corpus

    texts = [f"The yield {k // 3} of the third device was lower than that of the others{'.' * (k % 3)}" for k in range(5000)]
    pool = builds.stored(spark.createDataFrame([(f"{k}-1", t) for k, t in enumerate(texts)], "row_id string, text string"), "pool")
    every = builds._made(pool, {"numeric": builds.TEMPLATES["numeric"]}, "1").withColumn("key", builds.text_key())
    seen = every.filter(F.crc32("text") % 3 == 0).select("key")
    fresh = corpus.first_of_each(every, "key", "row_id").filter(F.crc32("text") % 3 > 0).withColumn("_k", builds.seeded("1", "row_id"))
    want = [r["row_id"] for r in fresh.orderBy("_k").limit(40).collect()]
    written, keep = [], builds.stored
    try:
        builds.stored = lambda df, name: written.append(out := keep(df, name)) or out
        made = builds.synthesized(pool, seen, {"numeric": 40, "novelty": 0}, builds.TEMPLATES, "1").collect()
    finally:
        builds.stored = keep
    assert sorted(r["row_id"] for r in made) == sorted(want) and len(want) == 40
    assert written[0].count() < 4000 < every.count() == 15000
    # a share that is too small is drawn again
    few, builds.DRAWN = builds.DRAWN, 1
    try:
        again = builds.synthesized(pool, seen, {"numeric": 40}, builds.TEMPLATES, "1").collect()
    finally:
        builds.DRAWN = few
    assert sorted(r["row_id"] for r in again) == sorted(want)
