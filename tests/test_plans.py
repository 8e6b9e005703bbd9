"""Plans do costly work once: not again in filters that the planner moves below joins and aggregates."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import alignment, biblio, builds, claims, corpus, grammar, models, numbers, parse, review
from foliant.plans import activity_queries, grammar_queries, readiness_queries


def _filters(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter (" in line]


def test_pairs_of_titles_are_not_made_in_filters(spark):
    refs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("ref_index"), F.concat(F.lit("A study of things "), F.col("id") % 3).alias("title"), F.lit("2015").alias("year"), F.lit(None).cast("string").alias("doi"))
    snapshot = spark.createDataFrame([("10.1/a", "A study of things, revised", "2016")], "doi string, title string, year string")
    made = biblio.enriched(refs, snapshot)
    assert not [line for line in _filters(made) if "transform(" in line]
    assert made.filter("enriched").count() == 40


def test_pairs_of_characters_are_made_once_for_a_likeness(spark):
    rows = spark.createDataFrame([("a study of small things", "a study of smaller things"), ("aaaa", "aa"), ("ab", "ba"), ("x" * 150, "x" * 20 + "y" * 130), ("", "a"), ("a", "b")], "a string, b string")
    plan = rows.select(T.dice("a", "b").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") == 2
    found = [r[0] for r in rows.select(F.round(T.dice("a", "b"), 6)).collect()]
    assert found == [0.913043, 0.5, 0.0, 0.127517, 0.0, 0.0]
    least = rows.select(T.similarity("a", "b").alias("s"), T.similarity("a", "b", 0.68).alias("t")).collect()
    assert all(r["s"] == r["t"] or r["s"] < 0.68 and r["t"] == 0 for r in least)


def test_surviving_tokens_are_looked_for_once(spark):
    rows = spark.createDataFrame([(1, "GaN at 5 V", "GaN at V"), (2, "GaN at 5 V", "GaN at 5 V"), (3, "none", "")], "id int, a string, b string")
    made = builds.surviving(rows, "a", "b", 0.85)
    assert sorted((r["id"], r["kept"]) for r in made.collect()) == [(2, 1.0), (3, 1.0)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("AlGaN") == 1


def test_places_are_searched_once_and_texts_are_not_copied_for_each_flag(spark):
    docs = spark.createDataFrame([(1, "One ﬁne day, the ofﬁce — was shut; nobody came to the door at all. Two."), (2, None)], "doc_id long, full_text string")
    flags = spark.createDataFrame([(1, 1, "fine day the office was shut nobody came to th"), (1, 2, "nobody came to the door"), (1, 3, "not there at all, not there at all, not there"), (2, 4, "nobody came to the door"), (3, 5, "nobody came to the door")], "doc_id long, flag_id int, text string")
    made = review.align(flags, docs)
    assert {r["flag_id"]: (r["paper_start"], r["paper_end"]) for r in made.collect()} == {1: (4, 52), 2: (35, 58), 3: (-1, -1), 4: (-1, -1), 5: (-1, -1)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1
    joined = [line for line in plan.split("\n") if "Join " in line]
    assert joined and plan.index("collect_list(") > plan.index(joined[0])  # flags are gathered before they meet the text


def test_word_triples_normalise_a_text_once(spark):
    rows = spark.createDataFrame([("One two, three four.",), ("One",)], "text string")
    made = rows.select(alignment.grams("text").alias("g"))
    assert [len(r["g"]) for r in made.collect()] == [2, 1]
    # within a lambda the text would be normalised for each of the triples
    assert "translate(" not in made._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction", 1)[1].split("xxhash64", 1)[1]
    assert alignment.likeness("abcd", "abcd" * 30, 0.99) == pytest.approx(0.85 + 0.15 * 4 / 120) and alignment.likeness("abcd", "abxd" + "y" * 90, 0.5) == 0


def test_clauses_are_not_made_again_in_filters(spark):
    pool = spark.createDataFrame([("1", "The yield of the third device was lower than all of the others."), ("2", "DNA was found.")], "row_id string, text string")
    assert [r[0] for r in pool.select(builds.clause("text")).collect()] == ["the yield of the third device was lower than all of the others", "DNA was found"]
    made = builds.synthesized(pool, pool.select(F.lit("none").alias("key")), {"novelty": 2}, builds.TEMPLATES, "1")
    assert made.count() == 2
    clauses = []
    keep = builds.stored
    try:
        builds.stored = lambda df, name: clauses.append(name) or keep(df, name)
        builds.synthesized(pool, pool.select(F.lit("none").alias("key")), {"novelty": 2}, builds.TEMPLATES, "1")
    finally:
        builds.stored = keep
    assert clauses == ["clauses"]


ODD = [
    "", " ", "Abstract", "Abstract ", "abstract one. Two", "Abstract A. Abstract B", "Results and discussion here. Results follow", "x. Results and discussion y", "x: 1. Methods y. 12 Results z", "x.  Methods y", "x. 1.  Methods y", "x! 123 Methods y", "Methodology x? Methods y",
    "x. Abstract Introduction y. Introduction z", "x.\nReferences\n[1] A", "ü. Summary 𝒜. Conclusions é. Concluding  remarks x", "1. Methods 2. Methods 3. Results .", "x. Results", "a. 1. Results and discussion b: Discussion c", None,
]


def test_headings_of_all_sections_are_looked_for_in_one_search(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, full_text string")
    made = parse.with_sections(rows)
    plain = [F.when(F.col("full_text").rlike(parse.heading(n, True)), F.struct(F.length(F.regexp_extract("full_text", parse.heading(n, True), 1)).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("n"))) for k, n in enumerate(parse.SECTIONS)]
    expected = rows.select("doc_id", F.array_sort(F.filter(F.array(*plain), lambda x: x.isNotNull())).alias("a"))
    want = {r["doc_id"]: [(x["n"], x["s"]) for x in r["a"]] for r in expected.collect()}
    assert {r["doc_id"]: [(x["name"], x["start_offset"]) for x in r["_sections"] if x["name"] != "Other"] for r in made.collect()} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 3  # one search of the text and one of its beginning, not two for each section


def test_sentences_without_a_cue_are_dropped_before_they_are_rows(spark):
    texts = ["Previous studies have shown that this effect is widely known in many fields of research today. Nothing is here at all, nor there.", "It was roughly 5 samples in all of the places that we saw. MOREOVER, it might possibly perhaps be so, and seemingly it is a thing of the past for all of us in the end of days.", "", "so", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, full_text string")
    key = lambda df: sorted(map(str, df.collect()))
    assert claims.located(docs, claims.CUE).count() == 3 < claims.located(docs).count()
    found = key(claims.prose_findings(claims.located(docs)))
    assert len(found) == 3 and key(claims.prose_findings(claims.located(docs, claims.CUE))) == found


def test_sentences_with_mere_digits_are_no_candidates_for_claims(spark):
    docs = spark.createDataFrame([(1, "It was 1984 there. An accuracy of 91% was seen. It fell by 5 % accuracy (N=40). Heated to 300 K. Flat 12.")], "doc_id long, full_text string")
    assert numbers.candidates(docs).count() == 3
    assert numbers.numeric_claims(numbers.candidates(docs)).count() == numbers.numeric_claims(parse.sentences_with(docs, "[0-9]")).count() == 4


def test_figures_and_tables_are_called_out_in_one_reading(spark):
    docs = spark.createDataFrame([(1, "FIGURE 1 and Fig. 3 give it, Table II too. Tab. 4.\xa0figure 3"), (2, None)], "doc_id long, full_text string")
    made = review.callouts(docs)
    assert sorted((r["kind"], r["count"], r["missing"]) for r in made.collect()) == [("figure", 2, [2]), ("table", 2, [1, 3])]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_technical_tokens_go_before_matches_are_rows(spark):
    docs = spark.createDataFrame([(1, "The sample was heated and DNA was shown at 5 sccm; misspelledwords stand here and misspelledwords there, oncemisspelled.")], "doc_id long, full_text string")
    made = grammar.review(grammar_queries.matches(docs), docs)
    assert sorted((r["rule_id"], r["text"][:14]) for r in made.collect()) == [("BE", "The sample was"), ("BE", "The sample was"), ("MORFOLOGIK_RULE", "oncemisspelled"), ("PASSIVE", "The sample was")]
    assert not [line for line in _filters(made) if "sccm" in line]


def test_submission_checks_read_the_texts_once(spark, sf):
    rows = readiness_queries.checked(spark, sf)
    plan = readiness_queries.deltas(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "full_text" not in plan and "callout_gaps" in rows.columns and rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r[0] for r in review.statements(readiness_queries.papers(spark, sf), ("data",)).select("statement").distinct().collect()} == {"data"}


def test_sentences_are_not_made_in_a_filter_for_chunks(spark):
    docs = spark.createDataFrame([(1, "A first sentence that is long enough for all. " * 4), (2, ""), (3, None), (4, " ")], "doc_id long, body string")
    made = corpus.sentence_chunks(docs)
    assert [(r["doc_id"], r["chunk"]) for r in made.collect()] == [(1, 0)]
    assert not [line for line in _filters(made) if "split(" in line]


def test_cues_are_grouped_by_their_first_letters(spark):
    patterns = [*claims.ATTRIBUTION.values(), claims.NOVELTY, claims.VAGUE_NUMBER, claims.WEAK_REPORT, claims.FORMULAIC, claims.HEDGES]
    plain = rf"(?:^|\W)(?i:{'|'.join(patterns)})"
    texts = ["Previous  studies went on", "the STUDIES have shown", "xmany reports", "a novel method", "Novel approach", "about half of it", "a number of cases", "various\npatients", "in today's world", "it is possible", "ſtudies shown", "may or may  not", "", "none", "As seen in Fig. 3", "results was promising", "(perhaps)", "2moreover"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(F.col("t").rlike(claims.CUE).alias("a"), F.col("t").rlike(plain).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and any(r["a"] for r in got) and not all(r["a"] for r in got)
    assert "(?=[sS])" in claims.CUE
    with pytest.raises(ValueError):
        T.cue(r"(?:word|\d+) more")


def test_texts_are_normalised_in_few_searches(spark):
    texts = ["a-\nb-\nc", "  x\x0b", "one\n\n two\tthree  four ", "x", "", None, "\n", "é –\n ü", "a\r\n b\f", "It’s “ﬁne” — o_k, 𝒜 b'c\x0b d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.col("t")
    for pattern, by in ((r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2"), (r"\n+", " "), ("[ \t ]{2,}|[\t ]", " "), ("^[\\s ]+|[\\s ]+$", "")):
        old = F.regexp_replace(old, pattern, by)
    match = F.lower("t")
    for a, b in (*zip("‘’“”–—", "''''--", strict=True), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        match = F.replace(match, F.lit(a), F.lit(b))
    match = F.trim(F.regexp_replace(F.regexp_replace(match, r"[^\w\s']|_", " "), r"\s{2,}|[^\S ]", " "))
    for new, was, searches in ((T.normalize_layout("t"), old, 2), (T.normalize_match("t"), match, 1)):
        made = rows.select(new.alias("n"), was.alias("w"))
        assert [r["n"] for r in made.collect()] == [r["w"] for r in made.collect()]
        assert rows.select(new.alias("n"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == searches


def test_texts_without_matches_are_not_split(spark):
    rows = spark.createDataFrame([("no mark",), ("[1] and [2]",), ("",), (None,)], "t string").select(T.hits("t", r"\[\d\]").alias("h"))
    assert [None if r["h"] is None else [(x["start"], x["text"]) for x in r["h"]] for r in rows.collect()] == [[], [(0, "[1]"), (8, "[2]")], [], None]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (size(" in plan.split("split(")[0]


def test_the_list_of_references_is_looked_for_once_in_a_parse(spark):
    docs = spark.createDataFrame([(1, "Abstract It is so [1]. References [1] Smith J (2015) A study of things, 12. [2] Jones K (2018) Another study, 7."), (2, None), (3, "References")], "doc_id long, full_text string")
    made = parse.parsed(docs)
    assert {r["doc_id"]: (len(r["references"]), r["style_counts"]["numbered"]) for r in made.collect()} == {1: (2, 2), 2: (0, None), 3: (0, 0)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)^((?:.*?") + plan.count("(?s)^(?:(?:.*?") == 1


def test_edited_sentences_are_located_once(spark, sf):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert scans(activity_queries.w8_segments(spark, sf)) == 2
    assert scans(activity_queries.q5_mapped_sentences(spark, sf)) == 3
    joins = activity_queries.q5_mapped_sentences(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    assert "length(" in joins[-1]  # lengths are taken before the join, texts are not shuffled


def test_pages_are_normalised_where_an_edit_is_looked_up(spark):
    pages = spark.createDataFrame([(1, 1, "One ﬁne day."), (1, 2, "It was shut."), (2, 1, "Nobody came."), (1, 9, "It was shut.")], "doc_id long, page int, text string")
    changes = spark.createDataFrame([(1, "a", 1, "It was  SHUT"), (1, "b", 1, "fine day"), (1, "c", 2, "none"), (3, "d", 1, "One")], "doc_id long, edit_id string, page int, text string")
    made = builds.locate_edits(changes, pages)
    assert {r["edit_id"]: (r["found_page"], r["matched"]) for r in made.collect()} == {"a": (2, 11), "b": (1, 8), "c": (None, None), "d": (None, None)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("hay#") < plan.index("Join Inner") and "lower(text" in plan[plan.index("hay#") : plan.index("Join Inner")]


def test_rows_to_rank_are_written_once(spark):
    rows = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7 + F.col("id") % 2 * 3).cast("double").alias("f"))
    kept, keep = [], models.stored
    try:
        models.stored = lambda df, name: kept.append(name) or keep(df, name)
        made = models.finding_ranker(rows, ["f"], folds=2)
    finally:
        models.stored = keep
    assert kept == ["ranked"] and made.count() == 60


def test_surroundings_of_flags_are_cut_from_slices_once_for_each_document(spark):
    pad = "Some plain words stand here without any meaning at all. " * 12
    text = pad + 'He said "the yield of the device was far above what was known" then. The second yield of the device was far above what was seen before [3] in it. ' + pad + "The third yield of the device was far above what was ever seen. " + pad
    docs = spark.createDataFrame([(1, text), (2, "No flag is here.")], "doc_id long, full_text string")
    spans = ["the yield of the device was far above what was known", "The second yield of the device was far above what was seen", "The third yield of the device was far above what was ever seen.", "this is not there at all in any of the texts", None]
    flags = spark.createDataFrame([(1, k, t, 3.0, None, "unknown", "u") for k, t in enumerate(spans)], "doc_id long, flag_id int, text string, match_pct double, source_title string, source_type string, source_url string")
    none = spark.createDataFrame([], "doc_id long, flag_id int, ref_index int, ref_score double")
    made = review.categorize(review.align(flags, docs), docs, parse.sections(docs), none)
    assert {r["flag_id"]: r["category"] for r in made.collect()} == {0: "properly_quoted", 1: "already_cited", 2: "needs_new_citation", 3: "review_manually", 4: "review_manually"}
    assert "substring(full_text" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_likeness_is_sought_within_a_document_s_row(spark):
    """No row for each word triple; a window that lies within a passage is not missed for its few pairs of characters."""
    docs = spark.createDataFrame([(1, "The yield of the second device was lower than all of the others. It was so in each of the years."), (2, None)], "doc_id long, full_text string")
    flags = spark.createDataFrame([(1, 1, "The yield of the other device was lower than all of the others."), (1, 2, "Nothing of this stands there, in no way."), (2, 3, "Nothing of this stands there, in no way.")], "doc_id long, flag_id int, text string")
    made = alignment.align(flags, docs)
    assert {r["flag_id"]: (r["paper_start"], r["paper_end"]) for r in made.collect()} == {1: (0, 64), 2: (-1, -1), 3: (-1, -1)}
    assert "xxhash64" not in made._jdf.queryExecution().optimizedPlan().toString()
    text, passage = "-- ,, abcdefghij klmnopqrst uvwxyz abcdefg ,, --", "zz abcdefghij klmnopqrst uvwxyz abcdefg"
    start, end, score = alignment.best_span(passage, text, [], 0.985)
    assert alignment.normal(text[start:end]) == passage[3:] and score == pytest.approx(0.85 + 0.15 * 36 / 39)
