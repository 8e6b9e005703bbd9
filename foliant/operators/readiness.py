"""Readiness of a manuscript from its sections and open findings: factors, scores, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import half_up

# Baselines of the three bars, and by kind of finding its most counted findings and the points that each takes.
BASE = {"q1": 58.0, "q2": 66.0, "ieee": 55.0}
PENALTIES = {"novelty_issue": (4, 4.0, 2.0, 3.0), "numerical_inconsistency": (4, 6.0, 3.5, 5.0), "numerical_ambiguity": (5, 3.0, 1.5, 3.5), "publication_issue": (5, 2.5, 1.5, 3.0)}
CORE = ["Abstract", "Introduction", "Methods", "References"]


def facts(sections: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, names, and a count for each category that takes points): one row a document."""
    names = sections.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    counts = findings.groupBy("doc_id").agg(*[F.count_if(F.col("category") == c).alias(c) for c in PENALTIES])
    return names.join(counts.hint("merge"), "doc_id", "left").fillna(0, list(PENALTIES))


def factors(rows: DataFrame) -> DataFrame:
    """(doc_id, factor, q1, q2, ieee): what adds to and takes from the bars, a row each."""
    has = lambda n: F.array_contains("names", n)
    one = lambda c: c.cast("int")
    results = has("Results") | has("Discussion")
    core = sum(one(has(n)) for n in CORE) + one(results)
    missing = len(CORE) - sum(one(has(n)) for n in CORE)
    item = lambda name, when, q1, q2, ieee: F.when(when, F.struct(F.lit(name).alias("factor"), q1.cast("double").alias("q1"), q2.cast("double").alias("q2"), ieee.cast("double").alias("ieee")))
    listed = [
        item("structure-core", core > 0, core * 4, core * 3.2, one(has("Methods")) * 4 + one(results) * 2 + one(has("Abstract"))),
        item("structure-conclusion", has("Conclusion"), F.lit(2), F.lit(2), F.lit(1)),
        item("structure-missing", missing > 0, missing * -8, missing * -5, F.when(has("Methods"), -2).otherwise(-10)),
        item("structure-results", ~results, F.lit(-6), F.lit(-4), F.lit(-3)),
    ]
    for c, (most, a, b, d) in PENALTIES.items():
        n = F.least(F.col(c), F.lit(most))
        listed.append(item(c, F.col(c) > 0, n * -a, n * -b, n * -d))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*listed))).alias("x")).select("doc_id", "x.*")


def scores(factor_rows: DataFrame) -> DataFrame:
    """(doc_id, q1, q2, ieee): baselines and factors, 0 to 100, halves up; q2 is at least q1 and 4 more."""
    sums = factor_rows.groupBy("doc_id").agg(*[(F.lit(b) + F.sum(k)).alias(k) for k, b in BASE.items()])
    sums = sums.withColumn("q2", F.greatest("q2", F.col("q1") + 4))
    bar = lambda k: half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(k)))).cast("int").alias(k)
    return sums.select("doc_id", *[bar(k) for k in BASE])


def breakdown(factor_rows: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, factor, weight, position): a document's weightiest factors, by the sum of what they move."""
    weight = F.abs("q1") + F.abs("q2") + F.abs("ieee")
    ranked = factor_rows.withColumn("weight", F.round(weight, 6)).withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weight"), "factor")))
    return ranked.filter(F.col("position") <= most).select("doc_id", "factor", "weight", "position")
