"""Queries that build corpora from documents and evaluate predictions against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, corpus, evaluate, parse
from foliant.plans.parse_queries import CUTS, MANUSCRIPTS, SENTENCES, bodies, q, read
from foliant.sources.manuscripts import manuscripts

QUERIES: dict = {}
ORACLES: dict = {}
GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _score(docs):
    """A deterministic stand-in for a model's score: the share of plain lower-case letters, stretched."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.length(F.regexp_replace("text", "[^a-zß-ÿ]", "")) / F.greatest(F.length("text"), F.lit(1)) * 4.0 - 2.6)), 3)


def predictions(spark, sf_dir):
    """(row_id, label, score, rules, lang, source): gold labels with two scores."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), _score("text").alias("score"), F.least(F.lit(1.0), F.floor(F.length("text") / 4) / 1000.0).alias("rules"), "lang", "source")
    labels = read(spark, sf_dir, "labels").filter("quality IS NOT NULL").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "row_id")


P = """p AS (SELECT d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS label, round(least(1.0, greatest(0.0, length(regexp_replace(text, '[^a-zß-ÿ]', '', 'g')) / greatest(length(text), 1) * 4.0 - 2.6)), 3) AS score, least(1.0, floor(length(text) / 4) / 1000.0) AS rules, lang, source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL)"""
MEASURES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp > 0 THEN 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) ELSE 0 END AS f05"


def _auc(score: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"SELECT {lead}count(*) AS n, CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 THEN (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) END AS auc FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {lead}{score}) - 1) / 2.0 AS r FROM p) {group}"


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def a15_distribution(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT lang, avg(label) AS accept_rate, count(*) AS n FROM p GROUP BY lang")
def a16_accept_rate(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("lang").agg(F.avg("label").alias("accept_rate"), F.count("*").alias("n"))


@query("WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT 'text' AS feature, avg(CAST(text IS NULL AS INTEGER)) AS missing FROM j UNION ALL SELECT 'quality', avg(CAST(quality IS NULL AS INTEGER)) FROM j UNION ALL SELECT 'toxic', avg(CAST(toxic IS NULL AS INTEGER)) FROM j")
def a17_missing_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.missing_rates(rows, ["text", "quality", "toxic"])


_CONF = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn"


@query(f"WITH {P}, c AS (SELECT lang, {_CONF} FROM p GROUP BY lang) SELECT *, {MEASURES} FROM c")
def a18_confusion(spark, sf_dir):
    return evaluate.confusion(predictions(spark, sf_dir), "lang")


_SWEEP = f"grid AS (SELECT unnest({GRID}) AS t), s AS (SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn FROM p, grid GROUP BY t), m AS (SELECT *, {MEASURES} FROM s)"


@query(f"WITH {P}, {_SWEEP} SELECT * FROM m")
def a19_threshold_sweep(spark, sf_dir):
    return evaluate.sweep(predictions(spark, sf_dir), GRID)


@query(f"WITH {P}, {_SWEEP} SELECT * FROM m ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN recall ELSE precision END DESC, recall DESC, threshold LIMIT 1")
def a19_chosen_threshold(spark, sf_dir):
    return evaluate.chosen(evaluate.sweep(predictions(spark, sf_dir), GRID), 0.9)


def _classes(spark, sf_dir):
    p = predictions(spark, sf_dir)
    gold = F.when(F.col("label") == 1, "good").otherwise("bad")
    return evaluate.one_of_classes(p.withColumns({"gold": gold, "good": F.col("score"), "bad": 1 - F.col("score")}), {"good": 0.4, "bad": 0.7})


_CLASSES = f"{P}, g AS (SELECT row_id, CASE WHEN label = 1 THEN 'good' ELSE 'bad' END AS gold, CASE WHEN score >= 1 - score THEN CASE WHEN score >= 0.4 THEN 'good' ELSE 'none' END ELSE CASE WHEN 1 - score >= 0.7 THEN 'bad' ELSE 'none' END END AS predicted FROM p)"


@query(f"WITH {_CLASSES} SELECT * FROM g")
def a21_deployed_class(spark, sf_dir):
    return _classes(spark, sf_dir).select("row_id", "gold", "predicted")


@query(f"WITH {_CLASSES}, k AS (SELECT unnest(['good', 'bad']) AS class), s AS (SELECT class, count(*) FILTER (gold = class AND predicted = class) AS tp, count(*) FILTER (gold <> class AND predicted = class) AS fp, count(*) FILTER (gold = class AND predicted <> class) AS fn FROM g, k GROUP BY class) SELECT *, {MEASURES} FROM s")
def a22_class_report(spark, sf_dir):
    return evaluate.class_report(_classes(spark, sf_dir), ["good", "bad"])


@query(f"WITH {P} {_auc('score', 'lang')}")
def a23_roc_auc(spark, sf_dir):
    return evaluate.roc_auc(predictions(spark, sf_dir), "lang")


@query(f"WITH {P}, s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM p GROUP BY score), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM s WINDOW w AS (ORDER BY score DESC)) SELECT sum(tp / n * pos) / sum(pos) AS average_precision FROM c")
def a24_average_precision(spark, sf_dir):
    return evaluate.average_precision(predictions(spark, sf_dir))


@query(f"WITH {P} SELECT source, count(*) AS n, CASE WHEN count(*) FILTER (label = 0) > 0 THEN count(*) FILTER (label = 0 AND score >= 0.5) / count(*) FILTER (label = 0) ELSE 0 END AS fp_rate, CASE WHEN count(*) FILTER (label = 1) > 0 THEN count(*) FILTER (label = 1 AND score >= 0.5) / count(*) FILTER (label = 1) ELSE 0 END AS detect_recall FROM p GROUP BY source")
def a26_slices(spark, sf_dir):
    return evaluate.slices(predictions(spark, sf_dir), "source")


@query(r"WITH w AS (SELECT lang, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w) SELECT lang, count(*) AS bigrams, count(DISTINCT pair) / count(*) AS distinct_2 FROM b GROUP BY lang")
def a27_distinct_bigrams(spark, sf_dir):
    return evaluate.distinct_bigrams(read(spark, sf_dir, "documents"), "lang")


@query(f"WITH {P}, a AS ({_auc('score')}), b AS ({_auc('rules')}) SELECT a.n, a.auc AS model_auc, b.auc AS rules_auc, a.n >= 300 AND a.auc > b.auc + 0.03 AS ships FROM a, b")
def a30_ship_gate(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return evaluate.ship_gate(p, p.withColumn("score", F.col("rules")))


_VALID = r"length(text) >= 180 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 0.6 * length(text) AND len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) >= 25"


@query(f"SELECT doc_id, {_VALID} AS valid FROM documents")
def p41_validity(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", corpus.looks_valid().alias("valid"))


@query("SELECT min(doc_id) AS doc_id, lower(text[1:160]) AS prefix FROM documents GROUP BY 2")
def w4_first_of_each_prefix(spark, sf_dir):
    """Union of corpora, then the first row of each key prefix."""
    docs = read(spark, sf_dir, "documents").select("doc_id", corpus.key_prefix("text", 160).alias("prefix"))
    both = docs.filter("doc_id % 2 = 0").unionByName(docs.filter("doc_id % 2 = 1"))
    return corpus.first_of_each(both, "prefix", "doc_id")


@query("SELECT doc_id FROM documents d WHERE doc_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 5 = 0 AND lower(e.text[1:160]) = lower(d.text[1:160]))")
def j24_leakage_guard(spark, sf_dir):
    """Rows whose key prefix no row of the evaluation split has."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.unseen(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0"), corpus.key_prefix("text", 160)).select("doc_id")


_BODYCUT = CUTS.format(t="body")


@query(f"""WITH {MANUSCRIPTS}, s AS (SELECT doc_id, list_filter(list_transform({_BODYCUT}, lambda x: rtrim(x)), lambda x: x <> '') AS s FROM docs),
c AS (SELECT doc_id, unnest(list_filter(list_transform(range(0, CAST(ceil(len(s) / 3.0) AS BIGINT)), lambda k: {{'chunk': k, 'text': array_to_string(s[k * 3 + 1:k * 3 + 3], ' ')}}), lambda g: length(g.text) BETWEEN 80 AND 1200)[1:4]) AS g FROM s)
SELECT doc_id, CAST(g.chunk AS INTEGER) AS chunk, g.text AS text FROM c""")
def w5_sentence_chunks(spark, sf_dir):
    return corpus.sentence_chunks(bodies(spark, sf_dir))


@query()
def w5_packed_passages(spark, sf_dir):
    """Greedy packing depends on its own past, so there is no oracle; a test holds it against a plain loop."""
    return corpus.packed_passages(bodies(spark, sf_dir))


def _has(p: str) -> str:
    return f"regexp_matches(text, {q(T.words_like(p))})"


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, l AS (SELECT CASE WHEN {_has(claims.NOVELTY)} AND NOT {_has(claims.NOVELTY_SHOWN)} AND NOT regexp_matches(text, {q(claims.GAIN)}) THEN 'novelty' WHEN {_has(claims.WEAK_REPORT)} THEN 'publication' WHEN {_has(claims.VAGUE_NUMBER)} AND NOT regexp_matches(text, {q(claims.PRECISE_NUMBER)}) THEN 'numeric' ELSE 'none' END AS label FROM sentences) SELECT label, count(*) AS n FROM l GROUP BY label")
def p43_weak_labels(spark, sf_dir):
    rows = parse.sentences(manuscripts(spark, sf_dir)).select(corpus.weak_label().alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


_MARK = q(corpus.MARKED)
_CUE = q(T.words_like("|".join(claims.ATTRIBUTION.values())))
NEEDROWS = rf"""
marked AS (SELECT *, CAST(regexp_matches(text, {_MARK}) AS INTEGER) AS label, regexp_matches(text, {_CUE}) AS cue, trim(regexp_replace(regexp_replace(regexp_replace(text, {_MARK}, '', 'g'), '\s+([.,;])', '\1', 'g'), '\s+', ' ', 'g')) AS clean FROM sentences),
needrows AS (SELECT doc_id, sentence_index, clean AS text, label, CASE WHEN label = 1 THEN NOT cue ELSE cue END AS hard FROM marked WHERE len(list_filter(string_split_regex(clean, '\s+'), lambda x: x <> '')) BETWEEN 8 AND 60 AND regexp_matches(clean, '[A-Za-z]{{3}}'))"""


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, {NEEDROWS} SELECT label, hard, count(*) AS n, count(*) FILTER (regexp_matches(text, {_MARK})) AS leaked FROM needrows GROUP BY label, hard")
def q10_citation_need_corpus(spark, sf_dir):
    """Labels by marker, cleaning (P40), hard and easy rows, and the leak check."""
    rows = corpus.citation_need_rows(parse.sentences(manuscripts(spark, sf_dir)))
    return rows.groupBy("label", "hard").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(corpus.MARKED)).alias("leaked"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5('7:' || doc_id)) AS n FROM documents) WHERE n <= 5")
def l13_caps_by_source(spark, sf_dir):
    """A seeded order (L10) and caps for each source and language (L13): the limit is the operator."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return corpus.first_n(docs, 5, [corpus.order(F.lit("7"), "doc_id")], "source", "lang").select("doc_id")


@query("WITH s AS (SELECT doc_id, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % 100 AS share FROM documents) SELECT doc_id, CASE WHEN share < 80 THEN 'train' WHEN share < 90 THEN 'validation' ELSE 'test' END AS split FROM s")
def l16_splits(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", corpus.split_name("doc_id").alias("split"))


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS pair_id, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
c AS (SELECT pair_id, trim(regexp_replace(a, '\s+', ' ', 'g'))[1:900] AS a, trim(regexp_replace(b, '\s+', ' ', 'g'))[1:900] AS b FROM t),
f AS (SELECT * FROM c WHERE length(a) >= 20 AND length(b) >= 20 AND lower(a) <> lower(b))
SELECT pair_id, 'forward' AS task, a AS input, b AS target FROM f UNION ALL SELECT pair_id, 'backward', b, a FROM f""")
def p42_pairs(spark, sf_dir):
    """Pairs of consecutive turns, filtered, cleaned (P52) and in both directions."""
    from pyspark.sql import Window as W

    t = read(spark, sf_dir, "conversations")
    pairs = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("a"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return corpus.pair_rows(pairs)
