import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, one-word and long texts, repeated rows, and columns with names that operators use themselves."""
    long = "word " * 30_000 + "x" * 20_000
    rows = [(1, "the same text of a few words here", "en", "a", 1), (1, "the same text of a few words here", "en", "a", 1), (2, "the same text of a few words here", None, None, None), (3, "", "en", "a", 0), (4, None, None, "b", None), (5, "one", "en", None, 3), (None, "no id here at all but some words", "en", "a", 5), (6, long, "en", "b", 9), (7, "é😀 \n\t tabs and lines\r\nhere and there", "fr", "b", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "lang AS id", "source AS key", "doc_id AS size", "lang AS mark", "n_chars AS row", "lang AS bucket", "n_chars AS label")
