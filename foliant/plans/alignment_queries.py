"""Queries over passages that are not in their document word for word."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import alignment, parse
from foliant.plans.parse_queries import MANUSCRIPTS, SENTENCES
from foliant.plans.review_queries import flags
from foliant.sources.manuscripts import manuscripts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def changed(spark, sf_dir):
    """Every sentence as a flag, one word in seven replaced in half of them."""
    f = flags(spark, sf_dir, whole=True).select("doc_id", "flag_id", "text")
    words = F.transform(F.split("text", " "), lambda w, i: F.when(i % 7 == 3, "other").otherwise(w))
    return f.withColumn("text", F.when(F.col("flag_id") % 2 == 1, F.array_join(words, " ")).otherwise(F.col("text")))


@query()
def j1_fuzzy_alignment(spark, sf_dir):
    """Similarity flags aligned exactly or by likeness; those not found stay (J1, J4). Likeness over windows has no SQL; tests hold it against brute force."""
    return alignment.align(changed(spark, sf_dir), manuscripts(spark, sf_dir)).select("doc_id", "flag_id", "paper_start", "paper_end", "score")


@query()
def j2_ai_alignment(spark, sf_dir):
    """The same for flags of machine prose, of which only those found stay."""
    return alignment.aligned_only(alignment.align(changed(spark, sf_dir), manuscripts(spark, sf_dir))).select("doc_id", "flag_id", "paper_start", "paper_end", "score")


@query(f"WITH {MANUSCRIPTS}, {SENTENCES} SELECT doc_id, sentence_index, start_offset, CAST(coalesce(lead(end_offset) OVER (PARTITION BY doc_id ORDER BY sentence_index), end_offset) AS INTEGER) AS next_end FROM sentences")
def w3_sentence_pairs(spark, sf_dir):
    return alignment.sentence_pairs(manuscripts(spark, sf_dir)).select("doc_id", "sentence_index", "start_offset", "next_end")
