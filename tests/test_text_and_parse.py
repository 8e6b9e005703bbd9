"""Golden cases of text functions, parsing, citations and edits."""

import random

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, corpus, edits, parse, review


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_normalisation(spark):
    assert one(spark, "  A hyphen-\nated  word\n\nand\t more ", T.normalize_layout("t")) == "A hyphenated word and more"
    assert one(spark, "“Eﬃ ﬁne—text’s” (2)", T.normalize_match("t")) == "' ef i fine text's ' 2" or one(spark, "ﬁne—text’s", T.normalize_match("t")) == "fine text's"
    assert one(spark, "a/b: C?", T.slug("t")) == "a-b-c" and one(spark, "??", T.slug("t")) == "untitled"
    assert one(spark, "1,234.5", T.number("t")) == 1234.5 and one(spark, "x", T.number("t")) is None


def test_sentences_cover_the_text(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice(["Word ", "end. ", "Is it? ", 'said "so." ', "[3] ", "é ", "x!\r\n"]) for _ in range(r.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, full_text string")
    text = dict(rows)
    for s in parse.sentences(df).collect():
        assert text[s.doc_id][s.start_offset : s.end_offset] == s.text
    for p, (i, t) in zip(df.orderBy("doc_id").select(T.sentence_pieces("full_text").alias("p")).collect(), rows):
        assert "".join(p.p) == t


def test_hits_are_the_matches(spark):
    import re

    for t in ("", "no", "[1] a [2, 3]", "x[1][2]", "é😀 [10] y [1]"):
        got = [(h.start, h.text) for h in one(spark, t, T.hits("t", parse.BRACKET))]
        assert got == [(m.start(), m[0]) for m in re.finditer(parse.BRACKET, t)]


def test_strict_and_loose_headings(spark):
    text = "Abstract A short text on methods here. Methods We did it. References [1] Smith J (2015) A."
    df = spark.createDataFrame([(1, text), (2, "no heading at all")], "doc_id long, full_text string")
    strict = {(r.doc_id, r.name): r.start_offset for r in parse.sections(df).collect()}
    loose = {(r.doc_id, r.name): r.start_offset for r in parse.sections(df, strict=False).collect()}
    assert strict[1, "Methods"] == text.index("Methods We") and loose[1, "Methods"] < strict[1, "Methods"]
    assert strict[2, "Other"] == 0 and len([k for k in strict if k[0] == 2]) == 1


def test_lost_markers(spark):
    lost = lambda a, b: [x for x in spark.createDataFrame([(a, b)], "a string, b string").select(edits.lost_markers("a", "b").alias("x")).first().x]
    assert lost("see [3, 4]", "see [3] and then [4]") == []
    assert lost("see [3]", "see nothing") == ["[3]"]
    assert lost("so (Smith, 2020)", "as smith said (Smith, 2020; Lee, 2021)") == []


def test_edits_against_a_loop(spark):
    r = random.Random(5)
    docs, changes, want = [], [], {}
    for i in range(60):
        t = "".join(r.choice("abcdefgh") for _ in range(40))
        mine = sorted({(a := r.randrange(-1, 42), a + r.randrange(-1, 9), r.choice(["", "X", "YY"])) for _ in range(r.randrange(6))})
        docs.append((i, t))
        changes += [(i, *e) for e in mine]
        at, out, applied = 0, "", 0
        for a, b, x in mine:
            if a >= at and b > a and b <= len(t):
                out, at, applied = out + t[at:a] + x, b, applied + 1
        want[i] = (out + t[at:], applied, len(mine) - applied)
    got = edits.apply_edits(spark.createDataFrame(docs, "doc_id long, full_text string"), spark.createDataFrame(changes, "doc_id long, start_offset int, end_offset int, replacement string"))
    assert {r.doc_id: (r.revised, r.applied, r.skipped) for r in got.collect()} == want


def test_packing_against_a_loop(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.normalize_layout("text").alias("body"))
    want = []
    for r in df.select("doc_id", T.sentences("body").alias("s")).collect():
        open_, out = "", []
        for x in (x for x in r.s if x and len(x) <= 900):
            joined = f"{open_} {x}" if open_ else x
            if open_ and len(joined) > 550:
                out.append(open_)
                open_ = x
            else:
                open_ = joined
        out += [open_] if open_ else []
        want += [(r.doc_id, k, t) for k, t in enumerate(t for t in out if 180 <= len(t) <= 900)]
    assert sorted(map(tuple, corpus.packed_passages(df).collect())) == sorted(want)


def test_claims_that_must_and_must_not_be_flagged(spark):
    rows = [
        (1, "Previous studies have shown that this effect is widely known in many fields of research.", "Introduction", False, True),
        (2, "Previous studies have shown that this effect is widely known in many fields of research.", "Introduction", True, False),
        (3, "We have shown that studies reported such an effect in the field, as our data confirm.", "Introduction", False, False),
        (4, "The device was placed on a table beside the window for the rest of the afternoon.", "Introduction", False, False),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, section string, cited boolean, want boolean").withColumns({"sentence_index": F.lit(0), "start_offset": F.lit(0)})
    assert {r.doc_id for r in claims.citation_need(df).collect()} == {r[0] for r in rows if r[4]}


def test_callouts_and_statements(spark):
    df = spark.createDataFrame([(1, "See Figure 1, Fig. 3 and Table IV. Mice were used. References Figure 9 in a title.")], "doc_id long, full_text string")
    got = {(r.kind, r["count"], r.max_number, tuple(r.missing)) for r in review.callouts(df).collect()}
    assert got == {("figure", 2, 3, (2,)), ("table", 1, 4, (1, 2, 3))}
    status = {r.statement: r.status for r in review.statements(df).collect()}
    assert status["ethics"] == "missing" and "consent" not in status


def test_cues_are_searched_as_one_pattern(spark):
    """One search for all cues finds what a search for each would."""
    texts = ["Studies have shown it.", "It was widely shown", "as described in [3], better than", "prior reports", "priors reports", "is wellknown", "about 5", "5 % of all", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for cues in (claims.ATTRIBUTION, claims.CLAIM):
        together = rows.select("text", claims.any_of(cues.values()).alias("x"))
        assert together._jdf.queryExecution().analyzed().toString().count("RLIKE") == 1
        apart = rows.select("text", F.greatest(*[claims.has(p) for p in cues.values()]).alias("x"))
        assert together.collect() == apart.collect()
