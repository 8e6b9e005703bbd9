"""Queries over a grammar checker's matches and over models' scores.

No checker and no model run here: matches are those of four patterns in the whole
texts, scores are made up from a sentence's place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, edits, gates, grammar
from foliant.plans.claim_queries import LOCATED, any_of, has
from foliant.plans.finding_queries import WIDE, wide
from foliant.plans.parse_queries import HITS, MANUSCRIPTS, SENTENCES, q
from foliant.sources.manuscripts import manuscripts
from foliant.sources.shared import stored_once

QUERIES: dict = {}
ORACLES: dict = {}
#: Pattern, rule, category, its name, message, characters of the match that are offered as a replacement (0: none).
RULES = [
    ("[a-z]{12,}", "MORFOLOGIK_RULE", "TYPOS", "Spelling", "Unknown word", 6), ("(?:was|were|is|are) [a-z]+ed", "PASSIVE", "GRAMMAR", "Grammar", "Passive", 0), ("(?:was|were|is|are) [a-z]+", "BE", "GRAMMAR", "Grammar", "Form of to be", 4),
    ("[A-Z][a-z]+ [A-Z][a-z]+", "NAMES", "TYPOS", "Spelling", "Unknown name", 3), ("studies? [a-z]+", "WORDY", "STYLE", "Style", "Wordy", 5), ("[A-Z]{2,5}", "CAPITALS", "GRAMMAR", "Grammar", "Capitals", 0),
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MATCH = "struct<start_offset:int,length:int,rule_id:string,category_id:string,category_name:string,message:string,replacements:array<string>>"


def matches(docs):
    """Matches of all patterns: one array for a document, exploded once."""

    def of(pattern, rule, category, name, message, size):
        offered = lambda h: F.array(F.substring(h["text"], 1, size)) if size else F.array().cast("array<string>")
        return F.transform(T.hits("full_text", pattern), lambda h: F.struct(h["start"].alias("start_offset"), F.length(h["text"]).alias("length"), F.lit(rule).alias("rule_id"), F.lit(category).alias("category_id"), F.lit(name).alias("category_name"), F.lit(message).alias("message"), offered(h).alias("replacements")))

    every = F.concat(*[of(*r).cast(f"array<{MATCH}>") for r in RULES])
    return T.each(docs, every, "doc_id").select("doc_id", "x.*")


def _tests(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {q(p)})" for p in patterns) + ")"


_TECH = f"(regexp_matches(tok, {q(grammar.ACRONYM)}) OR regexp_matches(tok, {q(grammar.UNIT)}) OR (regexp_matches(tok, {q(grammar.FORMULA_BODY)}) AND regexp_matches(tok, '\\d')) OR regexp_matches(tok, {q(grammar.FORMULA_MIXED)}) OR (regexp_matches(tok, {q(grammar.SHORT)}) AND NOT regexp_matches(tok, {q(grammar.SHORT_WORDS)})))"
MATCHES = f"{MANUSCRIPTS}, {SENTENCES}, " + ", ".join(HITS.format(name=f"gm{i}", text="full_text", pattern=q(r[0]), table="manuscripts") for i, r in enumerate(RULES)) + ", gmatches AS (" + " UNION ALL ".join(
    f"SELECT doc_id, s AS m_start, CAST(length(h) AS INTEGER) AS len, h, '{rule}' AS rule_id, '{cat}' AS cat, '{name}: {message}' AS explanation, {f'h[1:{size}]' if size else 'NULL'} AS offered FROM gm{i}" for i, (_, rule, cat, name, message, size) in enumerate(RULES)
) + rf"""),
gwords AS (SELECT doc_id, unnest(string_split_regex(lower(full_text), '[^a-z0-9_]+')) AS w FROM manuscripts),
goften AS (SELECT doc_id, w, count(*) AS k FROM gwords GROUP BY ALL HAVING count(*) >= 2),
gfacts AS (SELECT g.*, trim(h) AS tok, full_text, k, substr(full_text, greatest(m_start - 79, 1), least(m_start, 80)) AS before, substr(full_text, greatest(m_start - 1, 1), m_start + len - greatest(m_start - 2, 0) + 2) AS around
  FROM gmatches g JOIN manuscripts USING (doc_id) LEFT JOIN goften o ON o.doc_id = g.doc_id AND o.w = lower(trim(h))),
gkept AS (SELECT *, cat IN ('TYPOS', 'MISC') OR regexp_matches(rule_id, '(?i)MORFOLOGIK') AS spelling FROM gfacts WHERE NOT (len(regexp_extract_all(before, '[“\x22«]')) > len(regexp_extract_all(before, '[”\x22»]')) OR (regexp_matches(around, '(?s)[“\x22].+[”\x22]') AND length(around) < len + 10))
  AND NOT {_TECH} AND NOT {_tests('tok', grammar.NAMES)} AND cat NOT IN {tuple(grammar.DROPPED)} AND NOT ((cat IN ('TYPOS', 'MISC') OR regexp_matches(rule_id, '(?i)MORFOLOGIK')) AND (length(tok) <= 3 OR k IS NOT NULL))),
gwide AS (SELECT g.*, s.start_offset AS ss, s.end_offset AS se, s.sentence_index, NOT spelling AND s.doc_id IS NOT NULL AND s.end_offset - s.start_offset > len AND s.end_offset - s.start_offset <= {grammar.MOST_EXPANDED} AS wide
  FROM gkept g LEFT JOIN sentences s ON s.doc_id = g.doc_id AND s.start_offset <= m_start AND m_start + len <= s.end_offset),
gfound AS (SELECT doc_id, CASE WHEN wide THEN ss ELSE m_start END AS start_offset, CASE WHEN wide THEN se ELSE m_start + len END AS end_offset, CASE WHEN wide THEN substr(full_text, ss + 1, se - ss) ELSE h END AS text, explanation, CASE WHEN NOT wide THEN offered END AS replacement, rule_id, 0.85 AS confidence, m_start FROM gwide),
gordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start_offset, end_offset ORDER BY m_start, rule_id, text, explanation) AS n FROM gfound),
gbase AS (SELECT * FROM gordered WHERE n = 1),
gmerged AS (SELECT b.doc_id, b.start_offset, b.end_offset, CAST(floor(b.start_offset / 3000.0) + 1 AS INTEGER) AS page, any_value(b.text) AS text, any_value(b.explanation) || coalesce(chr(10) || 'Also here:' || chr(10) || '• ' || string_agg(o.explanation, chr(10) || '• ' ORDER BY o.n) FILTER (o.n > 1 AND o.explanation <> b.explanation), '') AS explanation,
  CASE WHEN bool_and(o.replacement IS NOT DISTINCT FROM b.replacement) THEN any_value(b.replacement) END AS replacement, CAST(0.85 AS DOUBLE) AS confidence, CAST(count(*) AS INTEGER) AS n_merged
  FROM gbase b JOIN gordered o ON o.doc_id = b.doc_id AND o.start_offset = b.start_offset AND o.end_offset = b.end_offset GROUP BY b.doc_id, b.start_offset, b.end_offset)"""


def reviewed(spark, sf_dir):
    """Findings of the grammar review, written once for each application and folder."""

    def make():
        m = manuscripts(spark, sf_dir)
        return grammar.review(matches(m), m)

    return stored_once(f"grammar:{sf_dir}", make, spark)


@query(f"WITH {MATCHES} SELECT doc_id, start_offset, end_offset, CAST(floor(start_offset / 3000.0) + 1 AS INTEGER) AS page, text, explanation, replacement, rule_id, CAST(confidence AS DOUBLE) AS confidence, m_start AS match_start FROM gfound")
def p28_grammar_findings(spark, sf_dir):
    """Matches without noise (P28, P29), shown with their sentences."""
    return reviewed(spark, sf_dir)


@query(f"WITH {MATCHES} SELECT * FROM gmerged")
def a31_merged_grammar(spark, sf_dir):
    return grammar.merged(reviewed(spark, sf_dir))


@query(f"WITH {MATCHES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset) AS n FROM gmerged) SELECT * EXCLUDE (n) FROM n WHERE start_offset % 3 <> 0 OR n > 40")
def q9_grammar_review(spark, sf_dir):
    """Filtered, expanded, merged, and without what a second reader (here: of every third place) drops."""
    found = grammar.merged(reviewed(spark, sf_dir))
    decisions = found.select("doc_id", "start_offset", "end_offset", (F.col("start_offset") % 3 != 0).alias("keep"))
    return grammar.decided(found, decisions)


@query(f"WITH {MATCHES} SELECT g.doc_id, m_start AS start_offset, m_start + len AS end_offset, s.sentence_index FROM gmatches g LEFT JOIN sentences s ON s.doc_id = g.doc_id AND s.start_offset <= m_start AND m_start + len <= s.end_offset")
def j11_enclosing_sentences(spark, sf_dir):
    m = manuscripts(spark, sf_dir)
    spans = matches(m).select("doc_id", "start_offset", (F.col("start_offset") + F.col("length")).alias("end_offset"))
    return grammar.enclosing(spans, m)


def w5_grammar_chunks(spark, sf_dir):
    """Chunks for a checker (W5 a): folds have no SQL; tests hold them against a plain loop."""
    return grammar.chunks(manuscripts(spark, sf_dir))


def w5_passages(spark, sf_dir):
    """Passages for a machine-prose model (W5 b)."""
    return gates.passages(manuscripts(spark, sf_dir)).select("doc_id", "start_offset", "end_offset", "page", F.md5("text").alias("text_md5"))


QUERIES |= {"w5_grammar_chunks": w5_grammar_chunks, "w5_passages": w5_passages}


def _scored(spark, sf_dir):
    """Located sentences with made-up predictions."""
    at = F.col("doc_id") * 31 + F.col("start_offset") * 7
    rows = claims.located(manuscripts(spark, sf_dir)).withColumns({"label": F.when(at % 3 == 0, "LABEL_0").otherwise("LABEL_1"), "score": (at % 101) / 100.0})
    score = lambda k: (at * k % 97) / 96.0
    return rows.withColumn("scores", F.create_map(*[x for i, k in enumerate(gates.LABELS) for x in (F.lit(k), score(i + 1))]))


_AT = "(doc_id * 31 + start_offset * 7)"
_SCORED = f"{LOCATED}, scored AS (SELECT *, round(CASE WHEN {_AT} % 3 = 0 THEN 1 - {_AT} % 101 / 100.0 ELSE {_AT} % 101 / 100.0 END, 6) AS score FROM located)"


@query(rf"WITH {_SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) AS n FROM scored WHERE section <> 'References' AND length(trim(text)) >= 40 AND NOT cited AND NOT {has(claims.OWN_WORK)} AND score >= 0.55 AND (score >= 0.82 OR {any_of(claims.ATTRIBUTION.values())} OR regexp_matches(text, {q(f'(?i){T.B}{gates.STATISTIC}')}) OR regexp_matches(text, {q(f'(?i){T.B}{gates.PERCENT_OF}{T.E}')}))) SELECT doc_id, sentence_index, CAST(score AS DOUBLE) AS score FROM p WHERE n <= 20")
def p22_citation_need_gate(spark, sf_dir):
    return gates.citation_need(_scored(spark, sf_dir))


_CLASSES = ", ".join(f"{{'s': {_AT} * {i + 1} % 97 / 96.0, 'o': {-i}, 'l': '{k}'}}" for i, k in enumerate(gates.LABELS) if k != "none")
_CUE = " OR ".join(f"(label = '{k}' AND ({has(p)}" + (rf" OR regexp_matches(text, {q(rf'(?i){T.B}\d+(?:\.\d+)?\s*%')})" if k == "numerical_ambiguity" else "") + "))" for k, p in gates.CUES.items())


@query(rf"WITH {LOCATED}, b AS (SELECT *, list_max([{_CLASSES}]) AS m FROM located WHERE section <> 'References' AND length(trim(text)) >= 40), c AS (SELECT doc_id, sentence_index, start_offset, text, m.l AS label, CAST(m.s AS DOUBLE) AS score FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) AS n FROM c WHERE score >= 0.55 AND (score >= 0.82 OR {_CUE})) SELECT doc_id, sentence_index, label, score FROM p WHERE n <= 24")
def p25_quality_gate(spark, sf_dir):
    return gates.quality(_scored(spark, sf_dir))


@query(f"WITH {_SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) AS n FROM scored WHERE length(text) >= 180 AND score >= 0.6) SELECT doc_id, start_offset, end_offset, CAST(least(0.98, score) AS DOUBLE) AS score FROM p WHERE n <= 12")
def p27_machine_prose_gate(spark, sf_dir):
    """The gate over sentences of passage length, which SQL can list."""
    return gates.machine_prose(_scored(spark, sf_dir).filter(F.length("text") >= gates.SHORTEST))


def p27_passages_gate(spark, sf_dir):
    """The gate over packed passages."""
    at = F.col("doc_id") * 31 + F.col("start_offset") * 7
    rows = gates.passages(manuscripts(spark, sf_dir)).withColumns({"label": F.when(at % 3 == 0, "LABEL_0").otherwise("LABEL_1"), "score": (at % 101) / 100.0})
    return gates.machine_prose(rows)


QUERIES["p27_passages_gate"] = p27_passages_gate


@query(f"""WITH {MATCHES}, wspans AS (WITH {WIDE} SELECT doc_id, start_offset, end_offset, finding_id FROM wide), spans AS (SELECT doc_id, start_offset AS s, end_offset AS e, finding_id AS id FROM wspans UNION ALL SELECT doc_id, start_offset, end_offset, 'g:' || start_offset FROM gmerged),
ok AS (SELECT sp.*, row_number() OVER (PARTITION BY sp.doc_id ORDER BY s, e DESC, id) AS k FROM spans sp JOIN manuscripts USING (doc_id) WHERE s >= 0 AND e > s AND e <= length(full_text)),
picked AS (SELECT doc_id, unnest(kept) AS k FROM (SELECT doc_id, list_reduce(list_prepend({{'stop': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[])}}, list({{'stop': CAST(e AS BIGINT), 'kept': [CAST(s AS BIGINT), CAST(k AS BIGINT)]}} ORDER BY k)), lambda a, b: CASE WHEN b.kept[1] >= a.stop THEN {{'stop': b.stop, 'kept': list_append(a.kept, b.kept[2])}} ELSE a END).kept AS kept FROM ok GROUP BY doc_id)),
chosen AS (SELECT ok.* FROM ok JOIN picked USING (doc_id, k)), n AS (SELECT doc_id, length(full_text) AS n FROM manuscripts), lagged AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prior FROM chosen)
SELECT doc_id, CAST(s AS INTEGER) AS start_offset, CAST(e AS INTEGER) AS end_offset, id AS finding_id FROM chosen UNION ALL SELECT doc_id, CAST(prior AS INTEGER), CAST(s AS INTEGER), NULL FROM lagged WHERE s > prior
UNION ALL SELECT n.doc_id, CAST(coalesce(m, 0) AS INTEGER), CAST(n AS INTEGER), NULL FROM n LEFT JOIN (SELECT doc_id, max(e) AS m FROM chosen GROUP BY doc_id) USING (doc_id) WHERE n > coalesce(m, 0)""")
def w6_highlights(spark, sf_dir):
    """Findings on sentences and of the grammar review as highlights that don't overlap, and the text between (W6 b, W8)."""
    rows = wide(spark, sf_dir).select("doc_id", "start_offset", "end_offset", "finding_id")
    found = grammar.merged(reviewed(spark, sf_dir)).select("doc_id", "start_offset", "end_offset", F.concat(F.lit("g:"), F.col("start_offset").cast("string")).alias("finding_id"))
    return edits.highlights(rows.unionByName(found), manuscripts(spark, sf_dir))
