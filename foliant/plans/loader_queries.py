"""Queries over loaders, balance and multi-label evaluation, and the trained baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import builds, corpus, evaluate, models
from foliant.plans.corpus_queries import MEASURES, P, predictions
from foliant.plans.parse_queries import q, read
from foliant.sources import loaders
from foliant.sources.shared import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS INTEGER) AS start_offset, CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS INTEGER) AS end_offset FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def s2_page_offsets(spark, sf_dir):
    """Turns of a conversation as pages of a document."""
    return loaders.with_page_offsets(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start_offset", "end_offset")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE c <= 3 OR n <= 2 OR n > c - 1")
def s3_head_and_tail(spark, sf_dir):
    return loaders.head_and_tail(read(spark, sf_dir, "conversations"), "conv_id", "turn", cap=3).select("conv_id", "turn")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'empty' WHEN length(text) > 8000 THEN 'too_large' WHEN length(text) > 3000 THEN 'large' ELSE 'ok' END AS status FROM documents) GROUP BY status")
def s4_admission(spark, sf_dir):
    return loaders.admission(read(spark, sf_dir, "documents"), 8000, 3000).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'quality' AS head, CAST(quality AS BIGINT) AS label FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS BIGINT) FROM labels WHERE toxic IS NOT NULL")
def s10_long_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return loaders.long_labels(rows, "doc_id", ["quality", "toxic"])


@query("WITH s AS (SELECT CAST('0x' || md5(CAST(d.doc_id AS VARCHAR))[1:8] AS BIGINT) % 100 AS share, coalesce(CAST(quality AS VARCHAR), 'none') AS label FROM documents d LEFT JOIN labels USING (doc_id)) SELECT CASE WHEN share < 80 THEN 'train' WHEN share < 90 THEN 'validation' ELSE 'test' END AS split, label, count(*) AS n FROM s GROUP BY ALL")
def s13_split_counts(spark, sf_dir):
    """Counts by split and label, as the corpus metadata has them."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy(corpus.split_name("doc_id").alias("split"), F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, event_id, ts FROM events WHERE user_id IS NOT NULL) SELECT user_id, event_id, CAST(n AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n <= 3")
def s15_newest_first(spark, sf_dir):
    """The newest records of each user, newest first: the limit is the operator."""
    from pyspark.sql import Window as W

    rows = read(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    return rows.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("position <= 3").select("user_id", "event_id", "position")


@query(f"WITH {P}, n AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM p GROUP BY label)) SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || row_id), row_id) AS r FROM p), n WHERE r <= k")
def l15_balanced_classes(spark, sf_dir):
    """As many rows of each label as the rarer one has, in a seeded order."""
    p = predictions(spark, sf_dir).select("row_id", "label")
    counts = builds.bucket_counts(p, ["label"])
    return builds.quota(p, dict.fromkeys(counts, min(counts.values(), default=0)), ["label"], "3", "row_id").select("row_id", "label")


_HARDNESS = "round(abs(score - label) + CASE WHEN label = 1 AND score < 0.9 THEN 0.25 ELSE 0 END, 6)"


@query(f"""WITH {P}, h AS (SELECT row_id, {_HARDNESS} AS hardness FROM p), r AS (SELECT *, row_number() OVER (ORDER BY hardness DESC, row_id) AS k FROM h), o AS (SELECT *, row_number() OVER (ORDER BY md5('21:' || row_id), row_id) AS j FROM r WHERE k > 50)
SELECT row_id, hardness, 'hard' AS pick FROM r WHERE k <= 50 UNION ALL SELECT row_id, hardness, 'random' FROM o WHERE j <= 30""")
def w9_hardest_rows(spark, sf_dir):
    """The rows that a model gets most wrong, and some of the rest: the numbers are the operator."""
    hard = F.round(F.abs(F.col("score") - F.col("label")) + F.when((F.col("label") == 1) & (F.col("score") < 0.9), 0.25).otherwise(0.0), 6)
    return builds.hardest(predictions(spark, sf_dir).select("row_id", hard.alias("hardness")), 50, 30, "21", "row_id")


@query("WITH s AS (SELECT CAST('0x' || md5(CAST(d.doc_id AS VARCHAR))[1:8] AS BIGINT) % 100 AS share, coalesce(CAST(quality AS VARCHAR), 'none') AS label FROM documents d LEFT JOIN labels USING (doc_id)), c AS (SELECT CASE WHEN share < 80 THEN 'train' WHEN share < 90 THEN 'validation' ELSE 'test' END AS split, label, count(*) AS n FROM s GROUP BY ALL) SELECT split, label, n AS n_read, n AS n_written FROM c")
def s12_written_splits(spark, sf_dir):
    """Splits written as JSON lines, read back, beside the counts that the write itself gave."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").hint("merge"), "doc_id", "left")
    rows = rows.select("doc_id", "text", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("label"), corpus.split_name("doc_id").alias("split"))
    path = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    loaders.write_splits(rows, path, ["train", "validation", "test"], ["0", "1", "none"])
    back = spark.read.schema("doc_id long, text string, label string, split string").json(f"{path}/rows").groupBy("split", "label").agg(F.count("*").alias("n_read"))
    counts = spark.read.schema("split string, label string, n long").json(f"{path}/counts").filter("n > 0")
    return back.join(counts.withColumnRenamed("n", "n_written").hint("merge"), ["split", "label"], "full")


@query(f"""WITH {P}, h AS (SELECT 'quality' AS head, label, score FROM p UNION ALL SELECT 'toxic', CAST(toxic AS INTEGER), 1 - score FROM p JOIN labels ON row_id = doc_id WHERE toxic IS NOT NULL),
c AS (SELECT head, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM h GROUP BY head UNION ALL SELECT 'all', count(*) FILTER (score >= 0.5 AND label = 1), count(*) FILTER (score >= 0.5 AND label = 0), count(*) FILTER (score < 0.5 AND label = 1) FROM h)
SELECT *, {MEASURES} FROM c""")
def a25_multi_label(spark, sf_dir):
    """Each head, and all heads pooled."""
    p = predictions(spark, sf_dir)
    toxic = p.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "toxic"), "row_id").filter("toxic IS NOT NULL")
    heads = p.select(F.lit("quality").alias("head"), "label", "score").unionByName(toxic.select(F.lit("toxic").alias("head"), F.col("toxic").cast("int").alias("label"), (1 - F.col("score")).alias("score")))
    return evaluate.confusion(heads.unionByName(heads.withColumn("head", F.lit("all"))), "head").drop("tn")


@query(f"WITH {P}, m AS (SELECT lang, avg(score) AS mean_score, avg(label) AS mean_label FROM p GROUP BY lang) SELECT lang, mean_score, mean_label, mean_score >= 0.5 AND mean_label >= 0.7 AS passed FROM m")
def a29_score_gate(spark, sf_dir):
    m = predictions(spark, sf_dir).groupBy("lang").agg(F.avg("score").alias("mean_score"), F.avg("label").alias("mean_label"))
    return m.withColumn("passed", (F.col("mean_score") >= 0.5) & (F.col("mean_label") >= 0.7))


@query("SELECT doc_id FROM documents d WHERE doc_id % 10 = 3 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 10 <> 3 AND lower(e.text[1:120]) = lower(d.text[1:120])) UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 <> 3")
def j26_merged_rows(spark, sf_dir):
    """New rows merged into old ones, without those whose key prefix is there already."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    old, new = docs.filter("doc_id % 10 <> 3"), docs.filter("doc_id % 10 = 3")
    return corpus.unseen(new, old, corpus.key_prefix("text", 120)).unionByName(old).select("doc_id")


@query(r"WITH s AS (SELECT doc_id, regexp_replace(trim(text), '\.+$', '') AS t FROM documents) SELECT doc_id, 'It has been reported that ' || array_to_string(string_split_regex(lower(t[1:1]) || t[2:], '\s+')[1:28], ' ') || '.' AS sentence FROM s WHERE t <> ''")
def f22_clauses(spark, sf_dir):
    """A clause of up to 28 words set into a template."""
    t = F.regexp_replace(F.trim("text"), r"\.+$", "")
    rows = read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).filter("t <> ''")
    clause = F.array_join(F.slice(F.split(F.concat(F.lower(F.substring("t", 1, 1)), F.expr("substring(t, 2)")), r"\s+"), 1, 28), " ")
    return rows.select("doc_id", F.concat(F.lit("It has been reported that "), clause, F.lit(".")).alias("sentence"))


PAIR_CAP = 400
_WRAP = f"CASE WHEN CAST('0x' || md5('15t:' || id)[1:8] AS BIGINT) % 2 = 0 THEN replace(replace({q(builds.REPORT_FRAME)}, '{{pct}}', CAST({builds.SHARES}[CAST('0x' || md5('15p:' || id)[1:8] AS BIGINT) % {len(builds.SHARES)} + 1] AS VARCHAR)), '{{src}}', {builds.CUES}[CAST('0x' || md5('15s:' || id)[1:8] AS BIGINT) % {len(builds.CUES)} + 1]) ELSE {q(builds.AI_FRAME)} END || input"


@query(rf"""WITH t AS (SELECT conv_id * 1000 + turn AS pair_id, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
c AS (SELECT pair_id, trim(regexp_replace(a, '\s+', ' ', 'g'))[1:900] AS a, trim(regexp_replace(b, '\s+', ' ', 'g'))[1:900] AS b FROM t), f AS (SELECT * FROM c WHERE length(a) >= 20 AND length(b) >= 20 AND lower(a) <> lower(b)),
e AS (SELECT pair_id || '/forward' AS id, 'forward' AS task, a AS input, b AS target FROM f UNION ALL SELECT pair_id || '/backward', 'backward', b, a FROM f),
d AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY lower(input[1:200]) ORDER BY id) AS n FROM e) WHERE n = 1),
k AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('15:' || id), id) AS n FROM d) WHERE n <= {PAIR_CAP}), s AS (SELECT *, CAST('0x' || md5(id)[1:8] AS BIGINT) % 100 AS share FROM k),
w AS (SELECT id, task, CASE WHEN share < 80 THEN 'train' WHEN share < 90 THEN 'validation' ELSE 'test' END AS split, input, target FROM s)
SELECT id, task, split, FALSE AS wrapped, md5(input) AS input_md5, md5(target) AS target_md5 FROM w UNION ALL SELECT id || '/report', task, split, TRUE, md5({_WRAP}), md5(target) FROM w WHERE length(input) >= 40 AND length(target) >= 40""")
def q15_pair_corpus(spark, sf_dir):
    """Pairs filtered, in both directions, without those that begin alike, capped for each task, split, and framed as a report has them."""
    from pyspark.sql import Window as W

    t = read(spark, sf_dir, "conversations")
    pairs = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("a"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return builds.pair_corpus(pairs, PAIR_CAP, "15").select("id", "task", "split", "wrapped", F.md5("input").alias("input_md5"), F.md5("target").alias("target_md5"))


@query()
def q18_text_baseline(spark, sf_dir):
    """Trained, so there is no oracle; a test asks for its area under the curve."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").filter("quality IS NOT NULL").select(F.col("doc_id").alias("row_id"), "text", F.col("quality").cast("int").alias("label"))
    return models.text_baseline(rows)


@query()
def q19_finding_ranker(spark, sf_dir):
    """Out-of-fold scores from features of the text."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.length("text").cast("double").alias("f_chars"), T.word_count("text").cast("double").alias("f_words"), T.count("text", "[A-Z]").cast("double").alias("f_capitals"), T.count("text", "[^A-Za-z\\s]").cast("double").alias("f_marks"))
    labels = read(spark, sf_dir, "labels").filter("quality IS NOT NULL").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("label"))
    return models.finding_ranker(docs.join(labels, "row_id"), ["f_chars", "f_words", "f_capitals", "f_marks"])
