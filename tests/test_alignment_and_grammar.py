"""Alignment against brute force, folds against plain loops, golden cases of grammar review and gates."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import alignment, builds, findings, gates, grammar, parse, reports


def triples(text):
    w = alignment.normal(text).split()
    return {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))}


def brute(passage, whole, sentences, threshold=0.78):
    """The best of all sentences with three words in common, of pairs with the next, and of all windows around each, by the functions' own likeness."""
    best = (-1, -1, 0.0)
    for k, (a, b) in enumerate(sentences):
        if not triples(passage) & triples(whole[a:b]):
            continue
        end = sentences[k + 1][1] if k + 1 < len(sentences) else b
        lo, hi = max(0, a - alignment.MARGIN), min(len(whole), end + alignment.MARGIN)
        s, e, v = alignment.best_span(passage.strip(), whole[lo:hi], [(a - lo, b - lo), (a - lo, end - lo)])
        if (v, -(lo + s), -(lo + e)) > (best[2], -best[0], -best[1]):
            best = (lo + s, lo + e, v)
    return best if best[2] >= threshold else (-1, -1, 0.0)


def test_alignment_against_brute_force(spark):
    r = random.Random(4)
    words = "river plain stone water light wind field house north south early later under above green small".split()
    docs, flags, want = [], [], {}
    for d in range(6):
        sentences = [" ".join(r.choice(words) for _ in range(r.randrange(6, 14))).capitalize() + "." for _ in range(8)]
        whole, spans, at = " ".join(sentences), [], 0
        for s in sentences:
            spans.append((at, at + len(s)))
            at += len(s) + 1
        docs.append((d, whole))
        for k in range(8):
            passage = sentences[k].split()
            passage[r.randrange(len(passage))] = "changed"
            flags.append((d, k, " ".join(passage)))
        flags += [(d, 100, sentences[3]), (d, 101, "nothing of this kind stands in any text at all"), (d, 102, "short")]
        for _, k, t in flags[-11:]:
            if t in whole and len(t) >= 15:
                want[d, k] = (whole.index(t), whole.index(t) + len(t), 1.0)
            else:
                want[d, k] = brute(t, whole, spans) if len(t) >= 15 else (-1, -1, 0.0)
    out = alignment.align(spark.createDataFrame(flags, "doc_id long, flag_id long, text string"), spark.createDataFrame(docs, "doc_id long, full_text string"))
    got = {(x.doc_id, x.flag_id): (x.paper_start, x.paper_end, x.score) for x in out.collect()}
    assert set(got) == set(want)
    for k, (a, b, v) in want.items():
        assert got[k][:2] == (a, b) and got[k][2] == pytest.approx(v, abs=1e-8), k
    assert sum(v[2] > 0 for v in want.values()) > 40
    found = alignment.aligned_only(out).count()
    assert found == sum(v[2] > 0 for v in want.values())


def test_likeness_is_the_column_s(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("abc de") for _ in range(r.randrange(1, 60))), "".join(r.choice("abc de") for _ in range(r.randrange(1, 60)))) for _ in range(60)] + [("abcdef", "abcxef"), ("the same", "the same"), ("part", "a part of it")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.trim(T.normalize_match("a")).alias("a"), T.normalize_match("b").alias("b"))
    for x in rows.select("a", "b", T.similarity("a", "b").alias("s")).collect():
        assert alignment.likeness(x.a, x.b) == pytest.approx(x.s, abs=1e-9), (x.a, x.b)
    for a, _ in pairs:
        assert spark.createDataFrame([(a,)], "a string").select(T.normalize_match("a")).first()[0] == alignment.normal(a)


def test_chunks_and_passages_against_loops(spark):
    r = random.Random(6)
    texts = []
    for _ in range(12):
        s = ["".join(r.choice("abcdefg ") for _ in range(r.choice([5, 12, 40, 90, 200, 700]))).strip().capitalize() + "." for _ in range(40)]
        if r.random() < 0.5:
            s.insert(20, "Acknowledgements to all who helped us with this.")
        texts.append(" ".join(s))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")
    held = {}
    for x in parse.sentences(docs).collect():
        held.setdefault(x.doc_id, []).append((x.sentence_index, x.start_offset, x.end_offset, x.text))
    chunks, passages = [], []
    for d, rows in held.items():
        start = end = None
        for _, s, e, _t in sorted(rows):
            if start is None:
                start, end = s, e
            elif e - start > 300:
                chunks.append((d, start, end))
                start, end = s, e
            else:
                end = e
        chunks.append((d, start, end))
        held_back = []

        def flush():
            joined = " ".join(t for _, _, _, t in held_back)
            if len(joined) >= 180:
                passages.append((d, held_back[0][1], held_back[-1][2], joined))
            held_back.clear()

        for row in sorted(rows):
            t = row[3].strip()
            if len(t) < 20 or t.lower().startswith(("references", "acknowledg", "bibliography")):
                flush()
                continue
            if held_back and held_back[-1][1] // 3000 != row[1] // 3000:
                flush()
            held_back.append(row)
            if sum(len(x[3].strip()) for x in held_back) >= 550:
                flush()
        flush()
    assert sorted(map(tuple, grammar.chunks(docs, 300).collect())) == sorted(chunks)
    got = gates.passages(docs).select("doc_id", "start_offset", "end_offset", "text").collect()
    assert sorted(map(tuple, got)) == sorted(passages) and passages


def test_grammar_noise_and_merging(spark):
    text = 'The colour are wrong here and SiO2 is 5 nm thick. John Smith said “it are odd” once. We recieve many thigns.'
    docs = spark.createDataFrame([(1, text)], "doc_id long, full_text string")
    rows = []
    for word, rule, category, offers in (("are wrong", "AGREEMENT", "GRAMMAR", ["is wrong"]), ("The colour", "DIALECT", "BRITISH_ENGLISH", ["color"]), ("SiO2", "MORFOLOGIK", "TYPOS", []), ("John Smith", "MORFOLOGIK", "TYPOS", []), ("recieve", "MORFOLOGIK", "TYPOS", ["receive", "relieve"]), ("many thigns", "COUNT", "GRAMMAR", []), ("We recieve", "VERB", "GRAMMAR", ["x"])):
        rows.append((1, text.index(word), len(word), rule, category, category.title(), "say", offers))
    rows += [(1, text.index("are odd"), 7, "AGREEMENT", "GRAMMAR", "Grammar", "quoted", []), (1, 5, 0, "X", "GRAMMAR", "Grammar", "empty", []), (1, 500, 3, "X", "GRAMMAR", "Grammar", "outside", [])]
    matches = spark.createDataFrame(rows, "doc_id long, start_offset int, length int, rule_id string, category_id string, category_name string, message string, replacements array<string>")
    found = grammar.review(matches, docs)
    got = sorted((x.text, x.rule_id, x.replacement) for x in found.collect())
    sentence = "We recieve many thigns."
    assert got == sorted([("The colour are wrong here and SiO2 is 5 nm thick.", "AGREEMENT", None), ("recieve", "MORFOLOGIK", "receive"), (sentence, "COUNT", None), (sentence, "VERB", None)])
    merged = {x.text: x for x in grammar.merged(found).collect()}
    assert len(merged) == 3 and merged[sentence].n_merged == 2 and merged["recieve"].replacement == "receive"
    drop = spark.createDataFrame([(1, text.index("recieve"), text.index("recieve") + 7, False)], "doc_id long, start_offset int, end_offset int, keep boolean")
    assert {x.text for x in grammar.decided(grammar.merged(found), drop).collect()} == set(merged) - {"recieve"}
    assert grammar.decided(grammar.merged(found), drop, reviewed=0).count() == 3


def test_payloads_shrink(spark):
    docs = spark.createDataFrame([(1, "x" * 5000)], "doc_id long, full_text string")
    rows = spark.createDataFrame([(1, f"f{k}", "ai", "ai_flagged", k * 10, k * 10 + 5, "y" * 100, False) for k in range(20)], "doc_id long, finding_id string, kind string, category string, start_offset int, end_offset int, text string, is_informational boolean")
    assert findings.payloads(rows, docs).count() == 20
    # 20, 14, 10 spans of about 900 characters each
    assert findings.payloads(rows, docs, budget=10_000).count() == 10
    assert findings.payloads(rows, docs, budget=10).count() == 4


def test_report_flags(spark):
    text = "Match overview 12% Journal of Things\n1. A first passage of the report that is long enough.\n2. A first passage of the report that is long enough.\n0. Another passage that is long enough to count 5% Submitted to X\n7. Short"
    rows = spark.createDataFrame([(1, text)], "report_id long, text string")
    got = sorted((x.text, x.number) for x in reports.similarity_flags(rows, reports.source_rows(rows)).filter("number IS NOT NULL").collect())
    assert [t for t, _ in got] == ["A first passage of the report that is long enough.", "Another passage that is long enough to count"]


def test_measures_of_rewrites():
    assert builds.bleu("a b c d e", "a b c d e") == pytest.approx(1.0) and builds.bleu("a b c", "a b c") == 0 and builds.bleu("a b c d", "e f g h") == 0
    assert builds.bleu("a b c d e f", "a b c d x f") == pytest.approx((5 / 6 * 3 / 5 * 2 / 4 * 1 / 3) ** 0.25)
    assert builds.rouge_l("a b c d", "a c d") == pytest.approx(6 / 7) and builds.rouge_l("", "a") == 0


def test_csv_loaders(spark, tmp_path):
    from foliant.sources import loaders

    (tmp_path / "one_train.csv").write_text('text,label\n"a\nb",1\nc,0\n')
    (tmp_path / "two_test.csv").write_text("text,label\nd,1\n")
    rows = sorted(map(tuple, loaders.labelled_csv(spark, f"file://{tmp_path}/one_train.csv", "text", "label", "s").collect()))
    assert rows == [("a\nb", 0, "s"), ("c", 1, "s")]
    assert sorted(map(tuple, loaders.csv_folder(spark, f"file://{tmp_path}", "text", "label").collect())) == [("a\nb", 1, "train"), ("c", 0, "train"), ("d", 1, "test")]
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in loaders.json_lines(spark, f"file://{tmp_path}/rows.jsonl", "a int").collect()) == [1, 2]


def test_short_passages(spark):
    from foliant.operators import overlap

    docs = spark.createDataFrame([(1, "Some text about rivers and plains here."), (2, "nothing")], "doc_id long, body string")
    items = spark.createDataFrame([(1, "ABOUT rivers and"), (2, "about riv"), (3, "some text about rivers and plains here.")], "item_id long, passage string")
    want = [(1, 1, 10, 26), (1, 3, 0, 39)]
    assert sorted(map(tuple, overlap.contained(docs, items).collect())) == want
    try:
        overlap.SHORT_PASSAGES = 0
        assert sorted(map(tuple, overlap.contained(docs, items).collect())) == want
    finally:
        overlap.SHORT_PASSAGES = 500


def _plain_range(text, passage):
    """Character by character: each kept character with the place that it comes from."""
    wanted, out, gap = alignment.normal(passage), [], False
    for k, raw in enumerate(text):
        for c in raw.lower().translate(alignment._PLAIN):
            if c == "'" or "a" <= c <= "z" or "0" <= c <= "9":
                if gap and out:
                    out.append((" ", k))
                gap = False
                out.append((c, k))
            else:
                gap = True
    at = "".join(c for c, _ in out).find(wanted) if wanted else -1
    if at < 0:
        return -1, -1
    end = out[at + len(wanted) - 1][1] + 1
    while end < len(text) and not text[end].isspace() and not (text[end].isascii() and text[end].isalnum()) and text[end] not in "ﬁﬂﬀ":
        end += 1
    return out[at][1], end


def test_raw_ranges(spark):
    r = random.Random(9)
    pieces = ["it ﬁts", "off", "oﬀer", "eﬃcient", " - ", "— ", "‘well’", ", ", "“No”", " A1 ", "é", "x.", "\n", "fl ", "ﬂat", "don't", "?!"]
    rows = [("He said: “Well, it ﬁts,” and left.", "it fits"), ("abc", "xyz"), ("abc", "—"), ("a-b a b", "A B"), ("stuff ﬁnal", "f final"), (None, "a"), ("a", None)]
    for _ in range(300):
        text = "".join(r.choice(pieces) for _ in range(12))
        lo = r.randrange(len(text))
        rows.append((text, text[lo : lo + r.randrange(1, 14)].swapcase().replace("—", " -")))
    rows.append((" ".join(f"w{k}," for k in range(30_000)), " ".join(f"W{k}" for k in range(100, 29_000))))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, t string, p string").withColumn("index", T.match_index("t"))
    got = builds.raw_ranges(df, "index", "p").orderBy("i").collect()
    for x in got:
        assert (x.raw_start, x.raw_end) == _plain_range(x.t or "", x.p or ""), (x.i, x.raw_start)
    assert (got[0].raw_start, got[0].raw_end) == (16, 24)


def test_edit_distance_by_bits():
    r = random.Random(10)
    for _ in range(400):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(1, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert alignment._edit_ratio(a, b) == 1 - row[-1] / max(len(a), len(b))


def test_grammar_review_cuts_from_slices_and_finds_places_by_halving(spark):
    """In a long text a match costs no count of its characters; matches, sentences and recurring words are those of a plain reading."""
    text = " ".join(f"Sentence {k} – was tested {'uniquely' if k == 7 else 'again'} and the wonderfulness of é it." for k in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id long, full_text string")
    words = ["was tested", "wonderfulness", "uniquely"]
    at = [(w, k) for w in words for k in range(len(text)) if text.startswith(w, k)][:150]
    rows = [(1, k, len(w), "PASSIVE" if w == words[0] else "MORFOLOGIK_RULE", "GRAMMAR" if w == words[0] else "TYPOS", "n", "m", ["x"]) for w, k in at]
    matches = spark.createDataFrame([*rows, (1, len(text) - 3, 9, "PASSIVE", "GRAMMAR", "n", "m", ["x"])], "doc_id long, start_offset int, length int, rule_id string, category_id string, category_name string, message string, replacements array<string>")
    found = grammar.review(matches, docs)
    assert "substring(full_text" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.match_start, r.text, r.start_offset, r.end_offset) for r in found.collect()}
    sentences = text.replace(". S", ".|S").split("|")
    starts = [sum(len(x) + 1 for x in sentences[:k]) for k in range(len(sentences))]
    want = set()
    for w, k in at:
        i = max(j for j, s in enumerate(starts) if s <= k)
        if w == words[0]:
            want.add((k, sentences[i], starts[i], starts[i] + len(sentences[i])))
        elif w == words[2]:
            want.add((k, w, k, k + len(w)))
    assert got == want and len(want) == 61
