"""Queries that build corpora in one go and measure rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import biblio, builds, claims, corpus, evaluate, numbers, parse
from foliant.plans import biblio_queries
from foliant.plans.activity_queries import _TOK
from foliant.plans.claim_queries import LOCATED, NUMERIC
from foliant.plans.corpus_queries import GRID, MEASURES, NEEDROWS, P, predictions
from foliant.plans.finding_queries import WIDE, wide
from foliant.plans.parse_queries import CUTS, FIELDS, MANUSCRIPTS, MATCH_SQL, REFERENCES, SENTENCES, bodies, q, read
from foliant.plans.readiness_queries import DELTAS, deltas
from foliant.sources import loaders
from foliant.sources.shared import stored
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


def _like(p: str, c: str = "text") -> str:
    return f"regexp_matches({c}, {q(T.words_like(p))})"


_H = [
    f"CAST({_like(builds.STRUCTURE)} AS INTEGER)", f"CAST({_like(builds.NUMBER)} AS INTEGER)", f"1 - CAST({_like(builds.NOVELTY)} AND NOT {_like(builds.NOVELTY_SHOWN)} AND NOT regexp_matches(text, {q(builds.GAIN)}) AS INTEGER)",
    f"CASE WHEN {_like(builds.VAGUE)} THEN 0 ELSE CAST({_like(builds.CONCRETE)} AS INTEGER) END",
]
CHUNKS = rf"""parts AS (SELECT doc_id, list_filter(list_transform({CUTS.format(t='body')}, lambda x: rtrim(x)), lambda x: x <> '') AS s FROM docs),
groups AS (SELECT doc_id, k AS chunk, array_to_string(s[k * 3 + 1:k * 3 + 3], ' ') AS text FROM (SELECT *, unnest(range(0, CAST(ceil(len(s) / 3.0) AS BIGINT))) AS k FROM parts)),
chunks AS (SELECT doc_id, chunk, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS n FROM groups WHERE length(text) BETWEEN 80 AND 1200) WHERE n <= 4),
heads AS (SELECT *, {', '.join(f'{h} AS h{k}' for k, h in enumerate(_H))}, CAST(regexp_matches(text, {q(builds.CRAFT_MARK)}) OR {_like(builds.CRAFT)} AS INTEGER) AS h5, CASE WHEN regexp_matches(text, {q(builds.CITED)}) THEN 0.5 ELSE 0 END AS cited FROM chunks),
labelled AS (SELECT doc_id, chunk, text, h0, h1, h2, h3, CAST(h0 + h1 + h2 + h3 + cited >= 3.5 AND h2 = 1 AS INTEGER) AS h4, h5 FROM heads)"""


def _chunks(docs):
    return corpus.sentence_chunks(docs).withColumn("labels", builds.head_labels())


@query(f"WITH {MANUSCRIPTS}, {CHUNKS} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, [h0, h1, h2, h3, h4, h5] AS labels FROM labelled")
def p44_head_labels(spark, sf_dir):
    """Weak labels of six heads of chunks of three sentences (P44, W5 d)."""
    return _chunks(bodies(spark, sf_dir)).select("doc_id", "chunk", "labels")


_ORDER = "md5('{s}:' || {k})"


@query(f"""WITH {MANUSCRIPTS}, {CHUNKS}, d AS (SELECT * FROM (SELECT *, doc_id || '-' || chunk AS row_id, row_number() OVER (PARTITION BY lower(text[1:120]) ORDER BY doc_id || '-' || chunk) AS n FROM labelled) WHERE n = 1),
c AS (SELECT count(*) FILTER (h0 = 1) AS ones, count(*) FILTER (h0 = 0) AS zeros FROM d), w AS (SELECT least(ones, 600 - least(zeros, 300)) AS a, least(zeros, 600 - least(ones, 300)) AS b FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY h0 ORDER BY {_ORDER.format(s=6, k='row_id')}, row_id) AS k FROM d), kept AS (SELECT row_id, [h0, h1, h2, h3, h4, h5] AS labels FROM r, w WHERE k <= CASE h0 WHEN 1 THEN a ELSE b END)
SELECT row_id, labels, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, CAST('0x' || md5(row_id)[1:8] AS BIGINT) % 100 AS b FROM kept)""")
def q14_readiness_corpus(spark, sf_dir):
    """Chunks, deduplicated by their beginning, labelled, half and half on one head with top-up (L15), split (Q14)."""
    rows = _chunks(bodies(spark, sf_dir)).withColumn("row_id", F.concat_ws("-", "doc_id", "chunk")).withColumn("key", corpus.key_prefix("text", 120))
    rows = corpus.first_of_each(rows, "key", "row_id").withColumn("head", F.get("labels", F.lit(0)))
    kept = builds.half_and_half(rows, "head", 600)
    return kept.select("row_id", "labels", corpus.split_name("row_id").alias("split"))


_HARD_COUNTS = "hn AS (SELECT label, hard, count(*) AS n FROM hp GROUP BY ALL), hk AS (SELECT min(n) AS k FROM (SELECT sum(n) AS n FROM hn GROUP BY label))"
_HARD = f"{P}, hp AS (SELECT row_id, label, abs(score - label) > 0.3 AS hard FROM p), {_HARD_COUNTS}"
_SIDES = ", ".join(f"s{y} AS (SELECT CAST(floor(k * {s} + 0.0) AS BIGINT) AS goal, k, coalesce((SELECT n FROM hn WHERE label = {y} AND hard), 0) AS nh, coalesce((SELECT n FROM hn WHERE label = {y} AND NOT hard), 0) AS ns FROM hk), t{y} AS (SELECT least(ns, k - least(nh, goal)) AS soft, least(nh, k - least(ns, k - least(nh, goal))) AS hard FROM s{y})" for y, s in ((1, 0.7), (0, 0.55)))


@query(f"WITH {_HARD}, {_SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY label, hard ORDER BY {_ORDER.format(s=5, k='row_id')}, row_id) AS n FROM hp) SELECT row_id, label, r.hard FROM r, t1, t0 WHERE n <= CASE WHEN label = 1 THEN CASE WHEN r.hard THEN t1.hard ELSE t1.soft END ELSE CASE WHEN r.hard THEN t0.hard ELSE t0.soft END END")
def l14_bucket_quotas(spark, sf_dir):
    """Equal classes with shares of hard rows, topped up."""
    rows = predictions(spark, sf_dir).select("row_id", "label", (F.abs(F.col("score") - F.col("label")) > 0.3).alias("hard"))
    return builds.balanced_with_hard(rows)


_NEED = f"{MANUSCRIPTS}, {SENTENCES}, {NEEDROWS}, hp AS (SELECT doc_id || '-' || sentence_index AS row_id, label, hard FROM needrows), {_HARD_COUNTS}"


@query(f"WITH {_NEED}, {_SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY label, hard ORDER BY {_ORDER.format(s=5, k='row_id')}, row_id) AS n FROM hp), kept AS (SELECT row_id, label, r.hard FROM r, t1, t0 WHERE n <= CASE WHEN label = 1 THEN CASE WHEN r.hard THEN t1.hard ELSE t1.soft END ELSE CASE WHEN r.hard THEN t0.hard ELSE t0.soft END END) SELECT row_id, label, hard, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, CAST('0x' || md5(row_id)[1:8] AS BIGINT) % 100 AS b FROM kept)")
def q10_balanced_corpus(spark, sf_dir):
    """Sentences labelled by their marker, equal classes with shares of hard rows, split (Q10); the build stops if a marker is left in a text."""
    rows = stored(corpus.citation_need_rows(parse.sentences(manuscripts(spark, sf_dir))).withColumn("row_id", F.concat_ws("-", "doc_id", "sentence_index")), "need")
    if corpus.leaked(rows).first()[0]:
        raise ValueError("a citation marker is left in the cleaned texts")
    return builds.balanced_with_hard(rows).select("row_id", "label", "hard", corpus.split_name("row_id").alias("split"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER.format(s=9, k='doc_id')}, doc_id) AS n FROM documents) WHERE n <= 120")
def l12_seeded_cap(spark, sf_dir):
    """A training cap without replacement: the limit is the operator."""
    return builds.seeded_cap(read(spark, sf_dir, "documents"), 120, "9", "doc_id").select("doc_id")


@query("SELECT doc_id, CASE WHEN CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % 100 < 97 THEN 'train' ELSE 'validation' END AS split FROM documents")
def l16_carve(spark, sf_dir):
    """97 in 100 to train, the rest to validation."""
    return read(spark, sf_dir, "documents").select("doc_id", corpus.split_name("doc_id", 97, 3).alias("split"))


_C4 = "round(((doc_id * {a} + {b}) % 97) / 96.0, 6)"
_GOLD = "list_extract(['none', 'numbers', 'craft', 'novelty'], doc_id * 7 % 4 + 1)"
_SCORES = {"numbers": (31, 5), "craft": (17, 11), "novelty": (53, 2)}
_S = {c: f"CASE WHEN {_GOLD} = '{c}' THEN round(0.5 + {_C4.format(a=a, b=b)} / 2, 6) ELSE {_C4.format(a=a, b=b)} END" for c, (a, b) in _SCORES.items()}


@query(f"""WITH s AS (SELECT {_GOLD} AS gold, {', '.join(f'{e} AS {c}' for c, e in _S.items())} FROM documents), m AS (SELECT *, greatest(numbers, craft, novelty) AS top FROM s),
e AS ({' UNION ALL '.join(f"SELECT '{c}' AS class, gold = '{c}' AS pos, CASE WHEN {c} = top THEN {c} ELSE -1.0 END AS score FROM m" for c in _SCORES)}), g AS (SELECT unnest({GRID}) AS t),
c AS (SELECT class, CAST(t AS DOUBLE) AS threshold, count(*) FILTER (score >= t AND pos) AS tp, count(*) FILTER (score >= t AND NOT pos) AS fp, count(*) FILTER (score < t AND pos) AS fn FROM e, g GROUP BY ALL), x AS (SELECT *, {MEASURES} FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN recall ELSE precision END DESC, recall DESC, threshold) AS n FROM x) SELECT class, threshold, precision, recall FROM o WHERE n = 1""")
def a20_class_thresholds(spark, sf_dir):
    """A threshold for each class, which must be the greatest among them; gold classes and scores are made up from the id."""
    gold = F.get(F.array(*[F.lit(x) for x in ("none", "numbers", "craft", "novelty")]), (F.col("doc_id") * 7 % 4).cast("int"))
    raw = {c: F.round(((F.col("doc_id") * a + b) % 97) / 96.0, 6) for c, (a, b) in _SCORES.items()}
    rows = read(spark, sf_dir, "documents").select(gold.alias("gold"), *[F.when(gold == c, F.round(0.5 + v / 2, 6)).otherwise(v).alias(c) for c, v in raw.items()])
    return builds.class_thresholds(rows, list(_SCORES), GRID)


def _rewrites(spark, sf_dir):
    """Each document's text with every ninth word left out as a rewrite of it; the text itself is source and target."""
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    kept = F.array_join(F.filter(words, lambda w, i: i % 9 != 4), " ")
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("task"), F.coalesce("text", F.lit("")).alias("source"), kept.alias("hypothesis"), F.coalesce("text", F.lit("")).alias("target"))


@query()
def a28_rewrite_report(spark, sf_dir):
    """Means of entity fidelity, BLEU (X5) and ROUGE-L (X6) by task against a stored baseline; tests hold the measures against plain versions."""
    base = spark.sql("SELECT * FROM VALUES ('en', 0.9D, 0.5D, 0.9D), ('fr', 0.9D, 0.5D, 0.97D) AS t(task, entity_fidelity, bleu, rouge_l)")
    return builds.rewrite_report(_rewrites(spark, sf_dir), base)


@query(f"""WITH {MANUSCRIPTS}, p AS (SELECT doc_id, full_text AS a, replace(full_text, 'n = ', 'N: ') AS b0, doc_id % 4 AS k FROM manuscripts), r AS (SELECT doc_id, a, CASE WHEN k = 0 THEN regexp_replace(b0, '[0-9]', '', 'g') ELSE b0 END AS b FROM p),
t AS (SELECT doc_id, b, list_distinct({_TOK}) AS toks FROM r), s AS (SELECT doc_id, CASE WHEN len(toks) = 0 THEN 1.0 ELSE 1.0 - len(list_filter(toks, lambda x: NOT contains(b, x))) / len(toks) END AS kept FROM t)
SELECT doc_id, round(kept, 6) AS kept, md5(a[1:900]) AS input_md5, md5(b[1:900]) AS target_md5 FROM s JOIN r USING (doc_id) WHERE round(kept, 6) >= 0.85""")
def q16_entity_safe_pairs(spark, sf_dir):
    """Pairs whose protected tokens survive at 0.85 or more, clipped at 900 (Q16)."""
    m = manuscripts(spark, sf_dir)
    plain = F.replace("full_text", F.lit("n = "), F.lit("N: "))
    rows = m.withColumn("b", F.when(F.col("doc_id") % 4 == 0, F.regexp_replace(plain, "[0-9]", "")).otherwise(plain))
    kept = builds.surviving(rows, "full_text", "b", 0.85)
    return kept.select("doc_id", "kept", F.md5(F.substring("full_text", 1, 900)).alias("input_md5"), F.md5(F.substring("b", 1, 900)).alias("target_md5"))


@query(f"""WITH {WIDE}, ed AS (SELECT doc_id, finding_id AS edit_id, page, {MATCH_SQL} AS needle FROM wide WHERE status IN ('accepted', 'edited')),
pg AS (SELECT doc_id, k + 1 AS page, {MATCH_SQL} AS hay FROM (SELECT doc_id, k, full_text[k * 3000 + 1:(k + 1) * 3000] AS text FROM (SELECT *, unnest(range(0, CAST(ceil(length(full_text) / 3000.0) AS BIGINT))) AS k FROM manuscripts))),
m AS (SELECT e.doc_id, edit_id, p.page, abs(p.page - e.page) * 2 + CASE WHEN p.page > e.page THEN 1 ELSE 0 END AS turn, CASE WHEN length(needle) > 0 AND contains(hay, needle) THEN length(needle) {' '.join(f'WHEN length(needle) > {p} AND contains(hay, needle[1:{p}]) THEN {p}' for p in builds.PREFIXES)} END AS size FROM ed e JOIN pg p ON p.doc_id = e.doc_id AND p.page BETWEEN e.page - 1 AND e.page + 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, edit_id ORDER BY turn) AS n FROM m WHERE size IS NOT NULL) WHERE n = 1) SELECT e.doc_id, e.edit_id, CAST(b.page AS INTEGER) AS found_page, CAST(b.size AS INTEGER) AS matched FROM ed e LEFT JOIN b ON b.doc_id = e.doc_id AND b.edit_id = e.edit_id""")
def j28_located_edits(spark, sf_dir):
    """Accepted edits looked up on their pages."""
    return builds.locate_edits(_edits(spark, sf_dir), _pages(spark, sf_dir))


def _edits(spark, sf_dir):
    return wide(spark, sf_dir).filter("status IN ('accepted', 'edited')").select("doc_id", F.col("finding_id").alias("edit_id"), "page", "text")


def _pages(spark, sf_dir):
    slices = F.transform(F.sequence(F.lit(0), F.ceil(F.length("full_text") / 3000.0).cast("int") - 1), lambda k: F.struct((k + 1).alias("page"), F.substring("full_text", k * 3000 + 1, F.lit(3000)).alias("text")))
    return T.each(manuscripts(spark, sf_dir), slices, "doc_id").select("doc_id", "x.*")


@query(f"SELECT doc_id, count(found_page) AS applied, count(*) FILTER (found_page IS NULL) AS missed FROM ({ORACLES['j28_located_edits']}) GROUP BY doc_id")
def a33_edit_tally(spark, sf_dir):
    return builds.locate_edits(_edits(spark, sf_dir), _pages(spark, sf_dir)).groupBy("doc_id").agg(F.count("found_page").alias("applied"), F.count_if(F.col("found_page").isNull()).alias("missed"))


def _raw_pattern(needle: str) -> str:
    """A pattern for what a normalised needle looks like in a raw text."""
    p = needle
    marks = {k: f"chr({1 + i})" for i, k in enumerate(T.LIGATURES)}
    for k, mark in marks.items():
        p = f"replace({p}, '{k}', {mark})"
    p = f"replace(replace({p}, chr(39), {q("['‘’“”]")}), ' ', {q(f'[^{T.KEPT}]+')})"
    for k, mark in marks.items():
        p = f"replace({p}, {mark}, '{T.LIGATURES[k]}')"
    return f"'(?i)' || {p}"


@query(rf"""WITH {WIDE}, ed AS (SELECT doc_id, finding_id AS edit_id, {_raw_pattern(MATCH_SQL)} AS pattern FROM wide WHERE status IN ('accepted', 'edited')),
f AS (SELECT doc_id, edit_id, regexp_extract(full_text, '(?s)^(.*?)(?:' || pattern || ')', 1) AS head, regexp_extract(full_text, pattern || '[^A-Za-z0-9\sﬁﬂﬀ]*', 0) AS body FROM ed JOIN manuscripts USING (doc_id))
SELECT doc_id, edit_id, CAST(CASE WHEN body = '' THEN -1 ELSE length(head) END AS INTEGER) AS raw_start, CAST(CASE WHEN body = '' THEN -1 ELSE length(head) + length(body) END AS INTEGER) AS raw_end FROM f""")
def f4_raw_ranges(spark, sf_dir):
    """Where the text of each accepted edit stands in its document if both are normalised."""
    rows = _edits(spark, sf_dir).join(manuscripts(spark, sf_dir).select("doc_id", T.match_index("full_text").alias("index")).hint("merge"), "doc_id")
    return builds.raw_ranges(rows, "index", "text").select("doc_id", "edit_id", "raw_start", "raw_end")


@query(f"WITH {LOCATED}, {NUMERIC} SELECT doc_id, claim_start, regexp_replace(printf('%.3f', value), '\\.?0+$', '') || CASE WHEN family = 'percent' THEN '%' ELSE '' END AS shown, CAST(CASE WHEN family IN ('percent', 'count') THEN 1.0 WHEN family = 'ratio' THEN 0.015 WHEN family = 'temperature' THEN 0.5 WHEN family IN ('voltage', 'current') THEN greatest(0.05, 0.01 * greatest(abs(value), 1.0)) ELSE greatest(1.0, 0.05 * greatest(abs(value), 1.0)) END AS DOUBLE) AS tolerance FROM numeric")
def f14_shown_values(spark, sf_dir):
    """Values with their units (F14) and the tolerance of their family (F16)."""
    rows = numbers.numeric_claims(numbers.candidates(manuscripts(spark, sf_dir)))
    return rows.select("doc_id", "claim_start", builds.shown_value(F.col("value"), F.col("family")).alias("shown"), numbers.tolerance(F.col("value"), F.col("value"), F.col("family")).alias("tolerance"))


@query("SELECT doc_id, 'f' || k AS id, CASE WHEN k = 1 THEN TRUE ELSE doc_id % 2 = 0 END AS keep, CASE WHEN k = 1 THEN '' ELSE 'why ' || doc_id END AS reason, CASE WHEN k = 1 THEN 0.5 ELSE doc_id % 10 / 10.0 END AS confidence FROM documents, (VALUES (1), (2)) AS t(k) WHERE doc_id % 5 <> 0")
def f19_decisions(spark, sf_dir):
    """Decisions decoded from JSON with defaults; every fifth payload is broken and gives none."""
    d = F.col("doc_id")
    good = F.concat(F.lit('[{"id": "f1"}, {"id": "f2", "keep": '), F.when(d % 2 == 0, "true").otherwise("false"), F.lit(', "reason": "why '), d.cast("string"), F.lit('", "confidence": 0.'), (d % 10).cast("string"), F.lit("}]"))
    return builds.decode_decisions(read(spark, sf_dir, "documents").select("doc_id", F.when(d % 5 == 0, "[{no json").otherwise(good).alias("payload")))


@query(f"WITH {biblio_queries.MANUSCRIPTS}, {REFERENCES}, {FIELDS}, {biblio_queries.RECORDS} SELECT doc_id, ref_index, CASE WHEN doc_id % 3 = 0 AND ref_index = 1 THEN 'Title ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 3 = 0 AND ref_index = 1 THEN 'medium' ELSE confidence END AS confidence, CASE WHEN doc_id % 3 = 0 AND ref_index = 1 THEN 'edited' ELSE 'parsed' END AS origin FROM records")
def j29_overridden_references(spark, sf_dir):
    records = biblio.records(biblio_queries._refs(spark, sf_dir)).select("doc_id", "ref_index", "title", "confidence")
    entered = records.filter("doc_id % 3 = 0 AND ref_index = 1").select("doc_id", "ref_index", F.concat(F.lit(" Title "), F.col("doc_id").cast("string")).alias("new_title"))
    return builds.overridden(records, entered)


@query(f"SELECT doc_id, venue, md5(coalesce(bibliography, '') || chr(10) || notes) AS package_md5 FROM (SELECT doc_id, w AS venue, string_agg(item || ': ' || status, chr(10) ORDER BY item) AS notes FROM (WITH {DELTAS} SELECT * FROM deltas) GROUP BY doc_id, w) LEFT JOIN ({biblio_queries.ORACLES['q8_bibliography']}) USING (doc_id)")
def s18_restyle_package(spark, sf_dir):
    """Bibliography and requirement notes of each document and venue as one text."""
    notes = deltas(spark, sf_dir).groupBy("doc_id", "venue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "status"))), lambda x: F.concat(x["item"], F.lit(": "), x["status"])), "\n").alias("notes"))
    listed = biblio.rendered(biblio.records(biblio_queries._refs(spark, sf_dir)))
    return notes.join(listed.hint("merge"), "doc_id", "left").select("doc_id", "venue", F.md5(F.concat(F.coalesce("bibliography", F.lit("")), F.lit("\n"), "notes")).alias("package_md5"))


@query("WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS h, list(text ORDER BY turn) FILTER (role = 'assistant') AS m FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(k AS INTEGER) AS place, 0 AS label, md5(h[k + 1]) AS text_md5 FROM (SELECT conv_id, h, unnest(range(0, len(h))) AS k FROM c) UNION ALL SELECT conv_id, CAST(k AS INTEGER), 1, md5(m[k + 1]) FROM (SELECT conv_id, m, unnest(range(0, len(m))) AS k FROM c)")
def s9_nested_answers(spark, sf_dir):
    """Records with arrays of human and of machine answers, as labelled rows."""
    c = read(spark, sf_dir, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    nested = c.groupBy("conv_id").agg(of("user").alias("human_answers"), of("assistant").alias("machine_answers"))
    return loaders.answer_rows(nested, "conv_id", {"human_answers": 0, "machine_answers": 1}).select("conv_id", "place", "label", F.md5("text").alias("text_md5"))


@query(f"WITH {MANUSCRIPTS}, {CHUNKS} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS n FROM chunks WHERE CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % 7 = 0) WHERE n = 1")
def s11_strided_passages(spark, sf_dir):
    """Every seventh source row by its hash, and one passage of each: the stride is the operator."""
    rows = loaders.strided(bodies(spark, sf_dir), "doc_id", 7)
    return corpus.first_n(corpus.sentence_chunks(rows), 1, ["chunk"], "doc_id").select("doc_id", "chunk", F.md5("text").alias("text_md5"))


_Q17 = f"{P}, sp AS (SELECT *, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, CAST('0x' || md5(CAST(row_id AS VARCHAR))[1:8] AS BIGINT) % 100 AS b FROM p))"


@query(f"""WITH {_Q17}, g AS (SELECT unnest({GRID}) AS t), c AS (SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn FROM sp, g WHERE split <> 'test' GROUP BY t),
m AS (SELECT *, {MEASURES} FROM c), best AS (SELECT threshold FROM m ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN recall ELSE precision END DESC, recall DESC, threshold LIMIT 1),
r AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM sp, best WHERE split = 'test' GROUP BY threshold) SELECT *, {MEASURES} FROM r""")
def q17_evaluated_predictions(spark, sf_dir):
    """A threshold chosen on what is not test, reported on test (Q17)."""
    p = predictions(spark, sf_dir).withColumn("split", corpus.split_name("row_id"))
    best = evaluate.chosen(evaluate.sweep(p.filter("split <> 'test'"), GRID), 0.9).first()["threshold"]
    return evaluate.confusion(p.filter("split = 'test'"), threshold=best).drop("tn").withColumn("threshold", F.lit(best))


#: Sentences as they are drawn from: cleaned, fit, the first of equal texts, labelled.
OPEN = rf"""
cleaned AS (SELECT doc_id || '-' || sentence_index AS row_id, trim(regexp_replace(regexp_replace(text, {q(corpus.MARKED)}, '', 'g'), '\s+', ' ', 'g')) AS text FROM sentences),
fitted AS (SELECT *, md5(lower(text)) AS key FROM cleaned WHERE len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) BETWEEN {builds.LEAST_WORDS} AND {builds.MOST_WORDS} AND regexp_matches(text, '[A-Za-z]{{3,}}')),
opened AS (
  SELECT *, label = 'none' AND (regexp_matches(text, {q(claims.PRECISE_NUMBER)}) OR {_like(claims.NOVELTY_SHOWN)}) AS hard FROM (
    SELECT row_id, text, key, CASE WHEN {_like(claims.NOVELTY)} AND NOT {_like(claims.NOVELTY_SHOWN)} AND NOT regexp_matches(text, {q(claims.GAIN)}) THEN 'novelty' WHEN {_like(claims.WEAK_REPORT)} THEN 'publication' WHEN {_like(claims.VAGUE_NUMBER)} AND NOT regexp_matches(text, {q(claims.PRECISE_NUMBER)}) THEN 'numeric' ELSE 'none' END AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id) AS n FROM fitted) WHERE n = 1))"""


def _made(name: str, pool: str, seen: str, templates: dict[str, list[str]], need: str, seed: str) -> str:
    """Table expressions that end in ``name``: sentences from clauses and templates; ``need`` gives (label, n)."""
    lists = "CASE label " + " ".join(f"WHEN {q(c)} THEN [{', '.join(map(q, t))}]" for c, t in templates.items()) + " END"
    labels = ", ".join(f"({q(c)})" for c in templates)
    return rf"""
{name}c AS (SELECT row_id AS base, regexp_replace(trim(text), '\.+$', '') AS c FROM {pool}),
{name}d AS (SELECT base, CASE WHEN len(w) > {builds.CLAUSE_WORDS} THEN array_to_string(w[1:{builds.CLAUSE_WORDS}], ' ') ELSE c END AS clause FROM (SELECT base, c, string_split_regex(c, '\s+') AS w FROM (SELECT base, CASE WHEN upper(c[1:2]) = c[1:2] THEN c ELSE lower(c[1:1]) || c[2:] END AS c FROM {name}c))),
{name}e AS (SELECT label || '/' || base || '/' || r AS row_id, label, base, clause, r, {lists} AS t FROM {name}d, (VALUES {labels}) AS l(label), range({builds.ROUNDS}) AS rr(r)),
{name}f AS (SELECT row_id, label, replace(t[(CAST('0x' || md5('{seed}:' || label || ':' || base)[1:8] AS BIGINT) + r) % len(t) + 1], '{{clause}}', clause) AS text FROM {name}e),
{name}g AS (SELECT *, md5(lower(text)) AS key FROM {name}f WHERE label IN (SELECT label FROM {need} WHERE n > 0) AND len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) BETWEEN {builds.LEAST_WORDS} AND {builds.MOST_WORDS}),
{name}h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id) AS k FROM {name}g) WHERE k = 1 AND key NOT IN (SELECT key FROM {seen})),
{name} AS (SELECT row_id, text, label, key FROM (SELECT h.*, n, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || h.row_id), h.row_id) AS place FROM {name}h h JOIN {need} USING (label)) WHERE place <= n)"""


QUALITY_WANT, QUALITY_HARD = {"none": 150, "novelty": 60, "publication": 60, "numeric": 60}, 40
_POSITIVE = [c for c in QUALITY_WANT if c != "none"]
QUALITY_ROWS = rf"""{MANUSCRIPTS}, {SENTENCES}, {OPEN},
hardcount AS (SELECT least(count(*) FILTER (hard), {QUALITY_HARD}) AS n FROM opened),
qneed AS (SELECT label, greatest(0, want - coalesce(have, 0)) AS n FROM (VALUES {', '.join(f'({q(c)}, {QUALITY_WANT[c]})' for c in _POSITIVE)}) AS w(label, want) LEFT JOIN (SELECT label, count(*) AS have FROM opened GROUP BY label) USING (label)),
nones AS (SELECT * FROM opened WHERE label = 'none'),
{_made('qmade', 'nones', 'opened', builds.TEMPLATES, 'qneed', '8t')},
qranked AS (SELECT *, row_number() OVER (PARTITION BY label, hard ORDER BY md5('8:' || row_id), row_id) AS place FROM opened),
qkept AS (SELECT row_id, text, label, key, CASE WHEN hard THEN 'hard_negative' ELSE 'natural' END AS origin FROM qranked, hardcount WHERE place <= CASE WHEN hard THEN hardcount.n WHEN label = 'none' THEN {QUALITY_WANT['none']} - hardcount.n ELSE CASE label {' '.join(f'WHEN {q(c)} THEN {QUALITY_WANT[c]}' for c in _POSITIVE)} END END),
quality_rows AS (SELECT * FROM qkept UNION ALL SELECT *, 'template' FROM qmade)"""


def _quality_rows(spark, sf_dir):
    rows = builds.open_sentences(parse.sentences(manuscripts(spark, sf_dir)))
    return rows, builds.quality_corpus(rows, QUALITY_WANT, QUALITY_HARD)


@query(f"WITH {QUALITY_ROWS} SELECT row_id, label, origin, md5(text) AS text_md5, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, CAST('0x' || md5(row_id)[1:8] AS BIGINT) % 100 AS b FROM quality_rows)")
def q11_quality_corpus(spark, sf_dir):
    """Weakly labelled sentences drawn to a number for each class, hard negatives among them, what is missing made from templates, split (Q11)."""
    kept = _quality_rows(spark, sf_dir)[1]
    return kept.select("row_id", "label", "origin", F.md5("text").alias("text_md5"), corpus.split_name("row_id").alias("split"))


EVAL = {"natural": 20, "made": 25, "hard": 30, "none": 60}


@query(rf"""WITH {QUALITY_ROWS}, fresh AS (SELECT * FROM opened WHERE key NOT IN (SELECT key FROM quality_rows)), freshnone AS (SELECT * FROM fresh WHERE label = 'none'), eseen AS (SELECT key FROM fresh UNION ALL SELECT key FROM quality_rows),
eneed AS (SELECT * FROM (VALUES {', '.join(f"({q(c)}, {EVAL['made']})" for c in builds.UNSEEN_TEMPLATES)}) AS w(label, n)), {_made('emade', 'freshnone', 'eseen', builds.UNSEEN_TEMPLATES, 'eneed', '14t')},
eranked AS (SELECT *, row_number() OVER (PARTITION BY label, hard ORDER BY md5('14:' || row_id), row_id) AS place FROM fresh)
SELECT row_id, label, CASE WHEN hard THEN 'hard_negative' WHEN label = 'none' THEN 'natural_none' ELSE 'natural' END AS origin, md5(text) AS text_md5 FROM eranked WHERE place <= CASE WHEN hard THEN {EVAL['hard']} WHEN label = 'none' THEN {EVAL['none']} ELSE {EVAL['natural']} END
UNION ALL SELECT row_id, label, 'hard_synth', md5(text) FROM emade""")
def q12_hard_eval(spark, sf_dir):
    """Sentences that the corpus of q11 has not seen (J25), templates that it doesn't know, hard negatives and clean sentences (Q12)."""
    rows, kept = _quality_rows(spark, sf_dir)
    out = builds.hard_evaluation(rows, stored(kept, "trained"), **EVAL)
    return out.select("row_id", "label", "origin", F.md5("text").alias("text_md5"))


#: Passages of a source and label at most (machine prose or not, here by the document's weak label).
PASSAGE_CAPS = {f"{source}:{label}": 40 for source in (f"src{k}" for k in range(20)) for label in (0, 1)}


@query()
def q13_passage_corpus(spark, sf_dir):
    """Packed passages (W5 c), valid ones, deduplicated, capped by source and label, carved 97 to 3, those of a held-out source apart and without leaks (Q13); packing has no SQL."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.normalize_layout("text").alias("body"), "source")
    rows = corpus.packed_passages(docs).join(docs.select("doc_id", "source").hint("merge"), "doc_id").filter(corpus.looks_valid())
    rows = rows.withColumns({"row_id": F.concat_ws("-", "doc_id", "passage"), "key": corpus.key_prefix("text", 160), "label": (F.crc32("text") % 2).cast("int")})
    apart = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(5)) == 0
    train, held = rows.filter(~apart), rows.filter(apart)
    train = builds.capped_by(corpus.first_of_each(train, "key", "row_id").withColumn("cell", F.concat_ws(":", "source", "label")), PASSAGE_CAPS, "cell", "13", "row_id").drop("cell")
    out = corpus.unseen(corpus.first_of_each(held, "key", "row_id"), train, F.col("key"))
    named = train.withColumn("split", corpus.split_name("row_id", 97, 3)).unionByName(out.withColumn("split", F.lit("held_out")))
    return named.select("row_id", "source", "split", F.md5("text").alias("text_md5"))
