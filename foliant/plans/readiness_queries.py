"""Queries over readiness in full and submission checks.

Reports' shares, a model's probabilities and others' venues are made up from a
document's id, as no table has them; catalogues and venues are parameters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import bars, claims, grammar, numbers, parse, review
from foliant.plans import grammar_queries, parse_queries, review_queries
from foliant.plans.claim_queries import CONFLICTS, LOCATED, NUMERIC
from foliant.plans.finding_queries import WIDE, wide
from foliant.plans.parse_queries import MANUSCRIPTS, REFERENCES, _heads, q
from foliant.sources.manuscripts import manuscripts
from foliant.sources.shared import stored_once

QUERIES: dict = {}
ORACLES: dict = {}
FORMATS = ["full_article", "letter", "access_oa", "preprint", "communication"]
TERMS = ["studies", "effect", "device", "approach", "yield", "results", "outcome", "record", "price", "der", "est", "samples", "values", "treatment"]
#: A catalogue by rule: 14 venues, with two terms, one or two fields and a format each.
CATALOG = [{"venue": f"Journal {chr(65 + i)}", "keywords": [TERMS[i], TERMS[(i + 5) % 14]], "fields": [["health", "engineering", "language", "economics", "general"][k % 5] for k in ((i, i + 2) if i % 3 else (i,))], "ieee": i % 4 == 0, "open_access": i % 3 == 0, "format": FORMATS[i % 5]} for i in range(14)]
VENUES = [
    {"id": "open-things", "label": "Open Things", "archetype": "ieee", "abstract": (150, 250), "keywords": (3, 10), "numeric": True, "conflict": True}, {"id": "matters-today", "label": "Matters Today", "archetype": "elsevier", "abstract": (0, 300), "structured": True, "highlights": True, "data": True, "words": 6000},
    {"id": "stuff-letters", "label": "Stuff Letters", "archetype": "generic", "abstract": (0, 9999), "words": 3000, "unsupported": True},
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def papers(spark, sf_dir):
    """Manuscripts with keywords and highlights before them, written once for each application and folder."""
    return stored_once(f"papers:{sf_dir}", lambda: _papers(spark, sf_dir), spark)


def _papers(spark, sf_dir):
    m = manuscripts(spark, sf_dir)
    keys = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Keywords: yield, small samples; "), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 7).cast("int")), lambda i: F.concat(F.lit("term "), i.cast("string"))), ", "), F.lit(".\n"))).otherwise("")
    more = F.when(F.col("doc_id") % 5 == 2, "\nHighlights: a new yield.\n").otherwise("")
    return m.select("doc_id", F.concat(keys, more, "full_text").alias("full_text"), F.concat(F.lit("Manuscript "), F.col("doc_id").cast("string")).alias("title"), (F.col("doc_id") % 60).alias("sim_pct"), (F.col("doc_id") % 70).alias("ai_pct"))


def found(spark, sf_dir):
    """Findings of the queue, grammar findings and numeric conflicts."""
    m = manuscripts(spark, sf_dir)
    columns = ("doc_id", "kind", "category", "status", "is_informational")
    made = lambda df, kind, category: df.select("doc_id", F.lit(kind).alias("kind"), F.lit(category).alias("category"), F.lit("open").alias("status"), F.lit(False).alias("is_informational"))
    conflicts = numbers.numeric_conflicts(numbers.numeric_claims(numbers.candidates(m)))
    return wide(spark, sf_dir).select(*columns).unionByName(made(grammar.merged(grammar_queries.reviewed(spark, sf_dir)), "grammar", "grammar_error")).unionByName(made(conflicts, "manuscript_quality", "numerical_inconsistency"))


def boosts(spark, sf_dir):
    """Boosts from probabilities of six heads, which a hash of each head and the whole text stands in for."""
    share = lambda h: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(h), "body")), 1, 8), 16, 10).cast("long") % 101 / 100.0
    p = F.create_map(*[x for h in bars.HEADS for x in (F.lit(h), share(h))])
    return bars.model_boosts(manuscripts(spark, sf_dir).select("doc_id", p.alias("probs")))


def facts(spark, sf_dir):
    """Facts of every document, written once for each application and folder: all that is asked of readiness reads them."""
    return stored_once(f"facts:{sf_dir}", lambda: bars.facts(papers(spark, sf_dir), found(spark, sf_dir), boosts(spark, sf_dir)), spark)


def scored(spark, sf_dir):
    return bars.scores(bars.with_factors(facts(spark, sf_dir)))


def fields(rows):
    return review.fields_of(rows, review_queries.LEXICON)


_P = {h: f"(CAST('0x' || md5('{h}:' || body)[1:8] AS BIGINT) % 101 / 100.0)" for h in bars.HEADS}
_CRAFT = f"(({_P['structure_ok']} + {_P['numerical_clear']} + {_P['novelty_ok']} + {_P['methods_concrete']}) / 4)"


def _boost(x: str, b: int) -> str:
    return f"CAST(greatest(-{b}, least({b}, floor(round({x}, 9) + 0.5))) AS INTEGER)"


BOOSTS = f"""boosts AS (SELECT doc_id, {_boost(f"({_P['selective_ready']} - 0.5) * 18 + ({_CRAFT} - 0.5) * 10", 12)} AS q1_boost, {_boost(f"({_P['selective_ready']} - 0.5) * 10 + ({_CRAFT} - 0.5) * 8", 10)} AS q2_boost,
  {_boost(f"({_P['ieee_craft']} - 0.5) * 16 + ({_P['methods_concrete']} - 0.5) * 6 + ({_P['numerical_clear']} - 0.5) * 4", 12)} AS ieee_boost FROM manuscripts)"""
#: The texts with keywords and highlights take the place of the manuscripts in the expressions that follow.
PAPERS = f"""papers AS (WITH {MANUSCRIPTS} SELECT doc_id, body, CASE WHEN doc_id % 4 = 1 THEN 'Keywords: yield, small samples; ' || array_to_string(list_transform(range(0, doc_id % 7 + 1), lambda i: 'term ' || i), ', ') || '.' || chr(10) ELSE '' END || CASE WHEN doc_id % 5 = 2 THEN chr(10) || 'Highlights: a new yield.' || chr(10) ELSE '' END || full_text AS full_text FROM manuscripts),
manuscripts AS (SELECT * FROM papers)"""
_STYLE = parse_queries.ORACLES["p3_citation_style"].replace(MANUSCRIPTS, PAPERS)
_CALLOUTS = review_queries.ORACLES["p33_callouts"].replace(MANUSCRIPTS, PAPERS)
_STATES = review_queries.ORACLES["p34_statements"].replace(MANUSCRIPTS, PAPERS)
assert PAPERS in _STYLE and PAPERS in _CALLOUTS and PAPERS in _STATES
_ABSTRACT = "full_text[a.start_offset + 1:a.end_offset]"


def _words(x: str) -> str:
    return rf"CAST(len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')) AS INTEGER)"


FACTS = rf"""
opened AS (
  SELECT doc_id, kind, category FROM (WITH {WIDE} SELECT * FROM wide) WHERE status = 'open' AND NOT is_informational UNION ALL SELECT doc_id, 'grammar', 'grammar_error' FROM ({grammar_queries.ORACLES['a31_merged_grammar']})
  UNION ALL SELECT doc_id, 'manuscript_quality', 'numerical_inconsistency' FROM (WITH {LOCATED}, {NUMERIC}, {CONFLICTS} SELECT * FROM conflicts)),
counts AS (SELECT doc_id, {', '.join(f'CAST(count(*) FILTER ({c}) AS INTEGER) AS {k}' for k, c in bars.COUNTS.items())} FROM opened GROUP BY doc_id),
{PAPERS}, {_heads(True)}, {REFERENCES}, {BOOSTS},
refcounts AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS ref_count FROM refs GROUP BY doc_id),
secnames AS (SELECT doc_id, list(name) AS names FROM sections GROUP BY doc_id),
styles AS (SELECT doc_id, style FROM ({_STYLE})),
texts AS (SELECT m.doc_id, names, 'Manuscript ' || m.doc_id AS title, full_text, {_ABSTRACT} AS abstract, regexp_extract(full_text[1:6000], {q(bars.KEYWORDS)}, 1) AS kwline FROM manuscripts m JOIN secnames USING (doc_id) LEFT JOIN sections a ON a.doc_id = m.doc_id AND a.name = 'Abstract'),
facts AS (
  SELECT t.doc_id, title, t.doc_id % 60 AS sim_pct, t.doc_id % 70 AS ai_pct, list_contains(names, 'Abstract') AS has_abstract, list_contains(names, 'Introduction') AS has_intro, list_contains(names, 'Methods') AS has_methods, list_contains(names, 'Results') OR list_contains(names, 'Discussion') AS has_results, list_contains(names, 'Conclusion') AS has_conclusion, list_contains(names, 'References') AS s_references,
    CAST(len(regexp_extract_all(full_text, {q(parse.BRACKET)})) + len(regexp_extract_all(full_text, {q(parse.AUTHOR_YEAR)})) AS INTEGER) AS cite_count, {_words('full_text')} AS words, lower(title || chr(10) || coalesce(abstract[1:1200], full_text[1:1500])) AS lead, CASE WHEN abstract IS NOT NULL THEN {_words('abstract')} END AS abstract_words,
    CAST(len(list_filter(list_transform(string_split_regex(kwline, '[;,·]'), lambda k: regexp_replace(trim(k), '\.$', '')), lambda k: length(k) > 1 AND length(k) < 80)[1:20]) AS INTEGER) AS n_keywords, regexp_matches(abstract, {q(bars.STRUCTURED)}) AS structured, regexp_matches(full_text[1:8000], {q(bars.HIGHLIGHTS)}) AS highlights, {_words('title')} AS title_words,
    style, coalesce(ref_count, 0) AS ref_count, {', '.join(f'coalesce({k}, 0) AS {k}' for k in bars.COUNTS)}, list_contains(names, 'References') OR coalesce(ref_count, 0) > 0 AS has_refs, q1_boost, q2_boost, ieee_boost
  FROM texts t JOIN styles USING (doc_id) LEFT JOIN refcounts USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN boosts USING (doc_id))"""
FACTORS = f"""{FACTS},
flist AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {w} THEN {{'factor': {q(n)}, 'q1': CAST({a} AS DOUBLE), 'q2': CAST({b} AS DOUBLE), 'ieee': CAST({c} AS DOUBLE)}} END" for n, w, a, b, c in bars.FACTORS)}], lambda x: x IS NOT NULL AND (x.q1 <> 0 OR x.q2 <> 0 OR x.ieee <> 0)) AS f FROM facts),
lifted AS (SELECT *, round(58 + list_sum(list_transform(f, lambda x: x.q1)) + 4 - 66 - list_sum(list_transform(f, lambda x: x.q2)), 9) AS lift FROM flist),
factored AS (SELECT *, CASE WHEN lift > 0 THEN list_append(f, {{'factor': 'q2-floor', 'q1': CAST(0 AS DOUBLE), 'q2': CAST(lift AS DOUBLE), 'ieee': CAST(0 AS DOUBLE)}}) ELSE f END AS factors FROM lifted),
scored AS (SELECT *, {', '.join(f'CAST(floor(greatest(0, least(100, round({b} + list_sum(list_transform(factors, lambda x: x.{k})), 6))) + 0.5) AS INTEGER) AS {k}_score' for k, b in bars.BASE.items())} FROM factored)"""


@query(f"WITH {FACTS} SELECT * EXCLUDE (lead), md5(lead) AS lead_md5 FROM facts")
def q6_facts(spark, sf_dir):
    """What readiness rests on, a row a document."""
    return facts(spark, sf_dir).withColumn("lead_md5", F.md5("lead")).drop("lead")


@query(f"WITH {FACTORS} SELECT doc_id, q1_score, q2_score, ieee_score FROM scored")
def a6_readiness_full(spark, sf_dir):
    """The three bars by all 24 factors."""
    return scored(spark, sf_dir).select("doc_id", "q1_score", "q2_score", "ieee_score")


@query(f"WITH {FACTORS}, w AS (SELECT doc_id, factors[k].factor AS factor, CAST(round(abs(factors[k].q1) + abs(factors[k].q2) + abs(factors[k].ieee), 6) AS DOUBLE) AS weight, k FROM (SELECT doc_id, factors, unnest(range(1, len(factors) + 1)) AS k FROM factored)), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, k) AS INTEGER) AS position FROM w) SELECT doc_id, factor, weight, position FROM n WHERE position <= 12")
def l7_breakdown_full(spark, sf_dir):
    """The 12 weightiest factors."""
    return bars.breakdown(bars.with_factors(facts(spark, sf_dir)))


@query(f"WITH {MANUSCRIPTS}, {BOOSTS} SELECT * FROM boosts")
def a8_model_boosts(spark, sf_dir):
    return boosts(spark, sf_dir)


@query(f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT doc_id, {q(n)} AS item, {e} AS passed FROM facts" for n, e in bars.CHECKLIST))
def a7_readiness_checklist(spark, sf_dir):
    return bars.checklist(facts(spark, sf_dir))


_GAPS = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {q(n)} AS gap, {s} AS severity FROM facts WHERE {w}" for k, (n, s, w) in enumerate(bars.GAPS))
GAPS = f"gaps AS (SELECT doc_id, gap, severity, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position({bars.SEVERITIES}, severity), k) AS INTEGER) AS position FROM ({_GAPS}))"


@query(f"WITH {FACTS}, {GAPS} SELECT * FROM gaps")
def l8_gaps(spark, sf_dir):
    """Gaps by the severity rules (A7), high to low."""
    return bars.gaps(facts(spark, sf_dir))


_LEX = ", ".join(f"('{f}', '{t}')" for f, ts in review_queries.LEXICON.items() for t in ts)
GUESS = f"""lexicon(field, term) AS (VALUES {_LEX}), fhits AS (SELECT doc_id, field, count(*) AS hits FROM facts JOIN lexicon ON contains(lead, term) GROUP BY ALL),
ftop AS (SELECT doc_id, field, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, field) AS place FROM fhits),
guess AS (SELECT doc_id, field, place FROM ftop WHERE place <= 3 UNION ALL SELECT doc_id, 'general', 1 FROM facts WHERE doc_id NOT IN (SELECT doc_id FROM fhits)),
mine AS (SELECT doc_id, list(field ORDER BY place) AS mine FROM guess GROUP BY doc_id)"""


@query(f"WITH {FACTORS}, {GAPS}, {GUESS}, g AS (SELECT doc_id, CAST(count(*) FILTER (severity <> 'low') AS INTEGER) AS gaps FROM gaps GROUP BY doc_id) SELECT doc_id, q1_score AS q1, q2_score AS q2, ieee_score AS ieee, coalesce(gaps, 0) AS gaps, array_to_string(mine, ', ') AS fields, CASE WHEN q1_score >= 72 AND coalesce(gaps, 0) <= 2 THEN 'strong' WHEN q2_score >= 60 THEN 'closer' ELSE 'developing' END AS tier FROM scored LEFT JOIN g USING (doc_id) LEFT JOIN mine USING (doc_id)")
def q6_readiness_summary(spark, sf_dir):
    """Bars, gaps and fields together (Q6), with the tier of the summary (P50)."""
    rows = scored(spark, sf_dir)
    return bars.summary(rows, bars.gaps(rows), fields(rows))


_CATALOG = ", ".join(f"('{v['venue']}', {v['keywords']}, {v['fields']}, {v['ieee']}, {v['open_access']}, '{v['format']}')" for v in CATALOG)
RANKED = f"""catalog(venue, keywords, fields, ieee, open_access, format) AS (VALUES {_CATALOG}),
leans AS (SELECT *, style = 'IEEE' OR ieee_score >= 70 AS ieee_lean, words < 4000 OR NOT has_conclusion AS open_lean, NOT has_methods OR craft > 0 AS weak, words > 0 AND words < 3500 AS short, {bars.MISSING} + CASE WHEN has_results THEN 0 ELSE 1 END AS holes, (NOT has_methods AND has_results) OR (words > 0 AND words < 2500) AS letters FROM scored JOIN mine USING (doc_id)),
vboosts AS (SELECT doc_id, venue, mine, lead, ieee_lean, open_lean, keywords, fields, ieee, open_access, CASE WHEN (letters OR short OR weak) AND format IN ('letter', 'communication') THEN 4 WHEN (letters OR short OR weak) AND format IN ('access_oa', 'preprint') THEN 2 WHEN (letters OR short OR weak) AND format = 'full_article' AND holes >= 2 THEN -2
  WHEN open_lean AND format IN ('access_oa', 'preprint') THEN 1 ELSE 0 END AS boost, list_filter(keywords, lambda k: contains(lead, k)) AS matched FROM leans, catalog),
vscores AS (SELECT *, len(list_filter(fields, lambda f: list_contains(mine, f))) AS shared, len(matched) * 2 + len(list_filter(fields, lambda f: list_contains(mine, f))) * 3 + CAST(ieee_lean AND ieee AS INTEGER) * 2 + CAST(open_lean AND open_access AS INTEGER) + CAST(list_contains(mine, 'general') AND list_contains(fields, 'general') AS INTEGER) + 1 + boost AS score FROM vboosts),
vtopical AS (SELECT *, len(matched) > 0 OR score >= 5 AS topical, count(*) FILTER (len(matched) > 0 OR score >= 5) OVER (PARTITION BY doc_id) AS n_topical FROM vscores),
ranked AS (SELECT doc_id, venue, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, venue) AS INTEGER) AS position, CASE WHEN score >= 10 AND len(matched) >= 2 AND (shared > 0 OR len(matched) >= 3) THEN 'medium' ELSE 'low' END AS confidence, boost, matched[1:8] AS matched FROM vtopical WHERE topical OR n_topical < 8),
suggested AS (SELECT * FROM ranked WHERE position <= 15)"""


@query(f"WITH {FACTORS}, {GUESS}, {RANKED} SELECT * FROM suggested")
def l5_venues_full(spark, sf_dir):
    """All points (J20) and format boosts (P50), the pool of 8 to 15 (L5), confidence and keywords matched."""
    rows = scored(spark, sf_dir)
    return bars.venues(rows, fields(rows), CATALOG)


@query(f"""WITH {FACTORS}, {GUESS}, {RANKED}, others AS (SELECT doc_id, n AS position, CASE n WHEN 1 THEN 'JOURNAL ' || chr(CAST(65 + doc_id % 14 AS INTEGER)) ELSE 'Other ' || doc_id % 3 END AS venue FROM documents, (VALUES (1), (2), (3)) AS t(n)),
a AS (SELECT doc_id, venue, 'heuristic' AS origin, 0 AS o, position FROM suggested UNION ALL SELECT doc_id, venue, 'other', 1, position FROM others), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(venue) ORDER BY o, position) AS n FROM a),
c AS (SELECT doc_id, venue, origin, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, position) AS INTEGER) AS position FROM b WHERE n = 1 OR o = 0) SELECT * FROM c WHERE position <= 15""")
def j23_merged_venues(spark, sf_dir):
    rows = scored(spark, sf_dir)
    names = F.array(F.concat(F.lit("JOURNAL "), F.char(F.lit(65) + F.col("doc_id") % 14)), *[F.concat(F.lit("Other "), (F.col("doc_id") % 3).cast("string"))] * 2)
    others = manuscripts(spark, sf_dir).select("doc_id", F.posexplode(names).alias("p", "venue")).select("doc_id", "venue", (F.col("p") + 1).alias("position"))
    return bars.merged_venues(bars.venues(rows, fields(rows), CATALOG), others)


_NAMES = ["Open Things", " matters ", "STUFF-LETTERS", "the journal open things of old", "nothing", ""]
_FOUND = " ".join(f"WHEN qn = '{v['label'].lower()}' OR qn = '{v['id']}' THEN '{v['id']}'" for v in VENUES) + " " + " ".join(f"WHEN contains('{v['label'].lower()}', qn) OR contains(qn, '{v['label'].lower()[:18]}') OR contains('{v['id']}', regexp_replace(qn, '\\s+', '-', 'g')) THEN '{v['id']}'" for v in VENUES)


@query(f"WITH n AS (SELECT page_id AS query_id, lower(trim(coalesce(nullif(list_extract({_NAMES}, page_id % 6 + 1), ''), url))) AS qn FROM pages) SELECT query_id, CASE WHEN qn = '' THEN NULL {_FOUND} END AS venue_id FROM n")
def j22_venue_lookup(spark, sf_dir):
    """Names of every page, some of them venues' (a page's address where there is none), looked up in the list of venues."""
    name = F.coalesce(F.nullif(F.get(F.array(*[F.lit(x) for x in _NAMES]), (F.col("page_id") % 6).cast("int")), F.lit("")), F.col("url"))
    return bars.find_venue(parse_queries.read(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), name.alias("name")), VENUES)


def checked(spark, sf_dir):
    """Facts with gaps in callouts and the statements' statuses, written once: each profile and venue reads them."""
    p = papers(spark, sf_dir)
    holes = review.callouts(p).groupBy("doc_id").agg(F.sum(F.size("missing")).cast("int").alias("callout_gaps"))
    states = review.statements(p, ("conflict", "data")).groupBy("doc_id").agg(F.max(F.when(F.col("statement") == "conflict", F.col("status"))).alias("conflict"), F.max(F.when(F.col("statement") == "data", F.col("status"))).alias("data"))
    made = lambda: facts(spark, sf_dir).join(holes.hint("merge"), "doc_id", "left").fillna(0, ["callout_gaps"]).join(states.hint("merge"), "doc_id", "left")
    return stored_once(f"checked:{sf_dir}", made, spark)


CHECKED = f"""{FACTS}, holes AS (SELECT doc_id, CAST(sum(len(missing)) AS INTEGER) AS callout_gaps FROM ({_CALLOUTS}) GROUP BY doc_id), states AS (SELECT doc_id, max(status) FILTER (statement = 'conflict') AS conflict, max(status) FILTER (statement = 'data') AS data FROM ({_STATES}) GROUP BY doc_id),
checked AS (SELECT f.*, coalesce(callout_gaps, 0) AS callout_gaps, conflict, data FROM facts f LEFT JOIN holes USING (doc_id) LEFT JOIN states USING (doc_id))"""


def _submission(profile: str, extra: str = "") -> str:
    p = bars.PROFILES[profile]
    between = lambda c, b: f"CASE WHEN {c} BETWEEN {b[0]} AND {b[1]} THEN 'pass' ELSE 'warn' END"
    core = f"({bars.MISSING} + CASE WHEN has_results THEN 0 ELSE 1 END)"
    items = {
        "abstract": f"CASE WHEN abstract_words IS NULL THEN 'fail' ELSE {between('abstract_words', p['abstract'])} END", "keywords": between("n_keywords", p["keywords"]), "sections": f"CASE {core} WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END", "conclusion": "CASE WHEN has_conclusion THEN 'pass' ELSE 'warn' END",
        "refcount": f"CASE WHEN ref_count = 0 THEN 'fail' ELSE {between('ref_count', p['refs'])} END", "callouts": "CASE WHEN callout_gaps = 0 THEN 'pass' ELSE 'warn' END", **({"citestyle": "CASE WHEN style = 'IEEE' THEN 'pass' ELSE 'warn' END"} if p["numeric"] else {}),
        "title": f"CASE WHEN title_words <= {p['title']} THEN 'pass' ELSE 'warn' END",
    }
    return " UNION ALL ".join(f"SELECT doc_id, {extra or q(profile)} AS w, '{'base-' if extra else ''}{k}' AS item, {e} AS status FROM checked" for k, e in items.items())


@query(f"WITH {CHECKED} SELECT doc_id, w AS profile, item, status FROM ({' UNION ALL '.join(_submission(p) for p in bars.PROFILES)})")
def a11_submission_checklist(spark, sf_dir):
    """Checks of three archetypes."""
    rows = checked(spark, sf_dir)
    out = None
    for p in bars.PROFILES:
        out = bars.submission(rows, p) if out is None else out.unionByName(bars.submission(rows, p))
    return out


@query(f"WITH {PAPERS} SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_extract(full_text[1:6000], {q(bars.KEYWORDS)}, 1), '[;,·]'), lambda k: regexp_replace(trim(k), '\\.$', '')), lambda k: length(k) > 1 AND length(k) < 80)[1:20] AS keywords FROM manuscripts")
def p32_keywords(spark, sf_dir):
    return _papers(spark, sf_dir).select("doc_id", bars.keywords().alias("keywords"))


def _delta(v: dict) -> str:
    yes = lambda c, no="warn": f"CASE WHEN {c} THEN 'pass' ELSE '{no}' END"
    items = {"abs-limit": f"CASE WHEN abstract_words IS NULL THEN 'fail' ELSE {yes('abstract_words BETWEEN {} AND {}'.format(*v['abstract']), 'fail')} END"}
    if v.get("structured"):
        items["abs-struct"] = f"CASE WHEN structured IS NULL THEN 'fail' ELSE {yes('structured')} END"
    if v.get("keywords"):
        items["kw"] = yes("n_keywords > 0 AND n_keywords BETWEEN {} AND {}".format(*v["keywords"]))
    if v.get("numeric"):
        items["cite-num"] = yes("style IN ('IEEE', 'Vancouver')")
    if v.get("highlights"):
        items["highlights"] = yes("highlights", "fail")
    if v.get("conflict"):
        items["coi"] = yes("conflict = 'ok'")
    if v.get("data"):
        items["data"] = yes("data = 'ok'")
    if v.get("words"):
        items["wordcap"] = yes(f"words <= {v['words']} * 1.15")
    items |= {"fig-res": "'cant_check'", "style-target": "'fail'" if v.get("unsupported") else "'pass'"}
    return _submission(v["archetype"], q(v["id"])) + " UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, {q(v['id'])}, '{k}', {e} FROM checked" for k, e in items.items())


DELTAS = f"{CHECKED}, deltas AS ({' UNION ALL '.join(_delta(v) for v in VENUES)})"


def deltas(spark, sf_dir):
    rows = checked(spark, sf_dir)
    out = None
    for v in VENUES:
        out = bars.requirements_delta(rows, v) if out is None else out.unionByName(bars.requirements_delta(rows, v))
    return out


@query(f"WITH {DELTAS} SELECT doc_id, w AS venue, item, status FROM deltas")
def a12_requirements_delta(spark, sf_dir):
    """What three venues ask beyond their archetypes."""
    return deltas(spark, sf_dir)


@query(f"WITH {DELTAS} SELECT doc_id, w AS venue, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'cant_check') AS unchecked FROM deltas GROUP BY doc_id, w")
def q7_submission_check(spark, sf_dir):
    """Checklist, statements, callouts and venue requirements counted by status (Q7)."""
    return bars.tally(deltas(spark, sf_dir), "venue")
