"""Manuscripts: documents as papers with headings, claims, citations and references.

The driver's documents hold prose without the cues that the analysis looks for,
so each is set between headings and sentences chosen by its id, with a numbered
list of references. Every template's findings are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import normalize_layout

INTRO = [
    "Previous studies have shown that this effect is widely known in many fields of research today.",
    "Previous studies have shown that this effect is widely known in many fields of research [2, 9].",
    "In this work we report that our device has been shown to be better than others of its kind.",
    "To the best of our knowledge this is a novel approach to the treatment of such samples.",
    "The results were promising and the standard methods were used for all of the samples here.",
    "There was a significant increase in the yield of roughly 5 samples under these conditions.",
    "The yield was compared with other values (Smith et al., 2015) and the outcome was recorded.",
]
CLOSE = [
    "Furthermore, it is important to note that the landscape of this field is multifaceted and might possibly perhaps be potentially shaped by a robust framework in seemingly every single case.",
    "The cohort was small and the outcome was stable over all of the days on which it was measured.",
    "Moreover, the yield was higher than before [1] and the trend in Figure 1 was clear to see.",
]
FIGURES = ["Figure 1 and Figure 3 give the yields, and Table II the sizes.", "Fig. 1 and Fig. 2 give the yields, and Table 1 the sizes."]
REFERENCES = [
    '[1] Smith J, Lee K (2015) A study of small things. Journal of Things, 12, doi:10.1000/abc.{n}. [2] Jones K (2018) "Another study of matters". Annals of Matters, 7. [3] Brown L (2004) A third study of stuff. Letters of Stuff, 3.',
    '[1] Smith J (2015) A study of small things. Journal of Things, 12. [2] Jones K (2021) "A study of small things". Annals of Matters, 7. [4] Green M A fourth study without any date. Predatory Open Access Letters, 3.',
    '1. Smith J, Lee K (2015) A study of small things. Journal of Things, 12, doi:10.1000/abc.{n}. 2. Jones K (2018) "Another study of matters". Annals of Matters, 7. 3. Green M, 4th study without any date. Letters of Stuff, 3.',
    'Smith J, Lee K (2015) A study of small things, Journal of Things, 12. Jones K (2018) Another study of matters, Annals of Matters, 7, doi:10.1000/abc.{n}. Green M and others, a study without any date.',
]
#: Sentences with numbers, for the methods and for the results.
METHODS = [
    "Samples were heated to 37 °C and the voltage was 5 V at a learning rate of 0.001.", "Training accuracy reached a value near the end, and a test accuracy of 91% was seen over 50 epochs.",
    "The cohort size of 1200 gave 92% precision and an F1-score of 0.88 for the baseline, at 300 K.", "The temperature of 25 °C was kept (accuracy 91.5 throughout) at -3.5 mV.", "No more is known of it.",
]
RESULTS = [
    "A temperature of 25 °C was kept while the current was 2 mA.", "Our accuracy was 91% and the batch size of 64 was kept, with a learning rate = 1e-4.",
    "We saw 88.5% precision and an F1-score of 0.81 for the proposed model, at 310 K.", "The number of subjects: 40 were left, and the learning rate of 0.01 had an error rate of 3.5%.",
]


def _choice(options: list[str], shift: int = 0) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(F.col("doc_id") + shift, F.lit(len(options))) + 1).cast("int"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores in turn where the input has fewer parts than there are cores (a small file of one row group); larger inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, body, full_text), offsets of everything else counting into full_text."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", normalize_layout("text").alias("body"))
    size = F.concat(F.lit("In total n = "), (40 + F.pmod("doc_id", F.lit(50))).cast("string"), F.lit(" patients were seen, with an accuracy of 91.5 in each."))
    again = F.concat(F.lit("At the end n = "), (40 + F.pmod("doc_id", F.lit(50)) + F.pmod("doc_id", F.lit(3))).cast("string"), F.lit(" patients remained, with an accuracy of "), F.when(F.pmod("doc_id", F.lit(5)) == 0, "88.0").otherwise("91.5"), F.lit(" in each."))
    refs = F.replace(_choice(REFERENCES), F.lit("{n}"), F.col("doc_id").cast("string"))
    parts = [F.lit("Abstract"), _choice(INTRO), F.lit("Introduction"), F.col("body"), F.lit("Methods"), size, _choice(METHODS), F.lit("Results"), again, _choice(RESULTS, 1), _choice(FIGURES), F.lit("Discussion"), _choice(CLOSE), F.lit("References"), refs]
    return docs.select("doc_id", "body", F.concat_ws(" ", *parts).alias("full_text"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_choice(options: list[str], shift: int = 0) -> str:
    return f"list_extract([{', '.join(map(_sql, options))}], CAST((doc_id + {shift}) % {len(options)} + 1 AS BIGINT))"


#: The same in SQL: common table expressions docs (doc_id, body) and manuscripts (doc_id, body, full_text).
SQL = rf"""
docs AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z0-9_])-\n([A-Za-z0-9_])', '\1\2', 'g'), '\n+', ' ', 'g'), '[ \t\x{{00a0}}]+', ' ', 'g'), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g') AS body
  FROM documents),
manuscripts AS (
  SELECT doc_id, body, concat_ws(' ', 'Abstract', {_sql_choice(INTRO)}, 'Introduction', body, 'Methods',
    'In total n = ' || (40 + doc_id % 50) || ' patients were seen, with an accuracy of 91.5 in each.', {_sql_choice(METHODS)}, 'Results',
    'At the end n = ' || (40 + doc_id % 50 + doc_id % 3) || ' patients remained, with an accuracy of ' || CASE WHEN doc_id % 5 = 0 THEN '88.0' ELSE '91.5' END || ' in each.',
    {_sql_choice(RESULTS, 1)}, {_sql_choice(FIGURES)}, 'Discussion', {_sql_choice(CLOSE)}, 'References', replace({_sql_choice(REFERENCES)}, '{{n}}', CAST(doc_id AS VARCHAR))) AS full_text
  FROM docs)"""
