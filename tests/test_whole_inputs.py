"""Queries that read all of their input: what stands late in a text counts too."""

from foliant.operators import parse
from foliant.plans import registry
from foliant.sources.manuscripts import manuscripts


def test_late_marks_of_reports_count(spark, tmp_path):
    late = "lorem ipsum " * 400
    texts = {2: late + "Similarity report. Match overview 45% Late source", 6: late + "Turnitin 31% overall similarity", 10: late}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    of = lambda name: [r.asDict() for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert {r["report_id"]: r["kind"] for r in of("p7_fingerprint_whole")} == {2: "similarity", 6: "similarity", 10: "unknown"}
    assert {r["report_id"]: r["overall"] for r in of("p8_overall_whole")} == {2: None, 6: 31, 10: None}
    assert {(r["report_id"], r["pct"], r["title"]) for r in of("p9_source_rows_whole")} == {(2, 45, "Late source"), (6, 31, "overall similarity")}
    assert len(of("j12_flag_sources_whole")) == 9


def test_titles_and_addresses_of_pages(spark, tmp_path):
    page = lambda title, pad: f"<html><head>{'<meta>' * pad}<title>{title}</title></head></html>"
    rows = [(4, "https://doi.org/1", page("x", 0)), (5, None, page("Submitted to Some University", 100)), (6, "", page("Plain", 100)), (8, "http://a.example", "<p>journal</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.source_type for r in registry.QUERIES["p10_source_types_whole"](spark, str(tmp_path)).collect()}
    assert got == {4: "publication", 5: "student_paper", 6: "unknown", 8: "internet"}


def test_every_sentence_is_a_flag_and_a_badge(spark, sf):
    s = parse.sentences(manuscripts(spark, sf))
    sentences, numbered = s.count(), s.filter("sentence_index % 230 < 200").count()
    assert registry.QUERIES["j1_aligned_flags_whole"](spark, sf).count() == sentences
    assert registry.QUERIES["q2_review_similarity_whole"](spark, sf).count() == sentences
    assert registry.QUERIES["a1_match_rate_whole"](spark, sf).agg({"flags": "sum"}).first()[0] == sentences
    assert registry.QUERIES["p14_badges_whole"](spark, sf).count() == numbered
    assert {r.badge_style for r in registry.QUERIES["p13_badge_style_whole"](spark, sf).collect()} == {True, False}
