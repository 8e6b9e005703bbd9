"""Queries over the sentences of manuscripts: uncited claims, wording, prose, conflicting numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, numbers, parse
from foliant.plans.parse_queries import FIELDS, HITS, IN_TEXT, MANUSCRIPTS, REFERENCES, SENTENCES, _heads, q
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


def has(pattern: str) -> str:
    return f"regexp_matches(text, {q(T.words_like(pattern))})"


def any_of(patterns) -> str:
    return "(" + " OR ".join(has(p) for p in patterns) + ")"


WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
LOCATED = rf"""{MANUSCRIPTS}, {SENTENCES}, {_heads(True)},
located AS (
  SELECT t.*, coalesce(s.name, 'Other') AS section, CAST(floor(t.start_offset / 3000.0) + 1 AS INTEGER) AS page,
    regexp_matches(substr(full_text, greatest(1, t.start_offset - 219), t.end_offset - greatest(0, t.start_offset - 220) + 220), {q('(?:' + parse.BRACKET + '|' + parse.AUTHOR_YEAR + '|' + parse.YEAR_ALONE + ')')}) AS cited
  FROM sentences t JOIN manuscripts USING (doc_id) LEFT JOIN sections s ON t.doc_id = s.doc_id AND s.start_offset <= t.start_offset AND t.start_offset < s.end_offset)"""
LABELS = ", ".join(f"CASE WHEN {has(p)} THEN {q(label)} END" for label, p in [*claims.ATTRIBUTION.items(), *claims.CLAIM.items()])
NEED = rf"""
needscored AS (
  SELECT *, round(least(1.0, greatest(0.0, 0.2 + 0.65 + CASE WHEN {any_of(claims.CLAIM.values())} THEN 0.25 ELSE 0 END - CASE WHEN section IN ('Abstract', 'Introduction', 'Discussion', 'Conclusion', 'Other') THEN 0 ELSE 0.25 END - CASE WHEN {WORDS} < 8 THEN 0.3 ELSE 0 END)), 6) AS score,
    array_to_string(list_filter([{LABELS}], lambda x: x IS NOT NULL)[1:2], ' and ') AS reason
  FROM located WHERE section <> 'References' AND length(trim(text)) >= 40 AND NOT cited AND NOT {has(claims.OWN_WORK)} AND {any_of(claims.ATTRIBUTION.values())}),
need AS (SELECT doc_id, sentence_index, CAST(score AS DOUBLE) AS score, reason FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) AS n FROM needscored WHERE score >= 0.78) WHERE n <= 20)"""
_NOV, _WEAK, _VAGUE = f"({has(claims.NOVELTY)} AND NOT {has(claims.NOVELTY_SHOWN)} AND NOT regexp_matches(text, {q(claims.GAIN)}))", has(claims.WEAK_REPORT), f"({has(claims.VAGUE_NUMBER)} AND NOT regexp_matches(text, {q(claims.PRECISE_NUMBER)}))"
QUALITY = rf"""
flagged AS (SELECT *, {_NOV} AS nov, {_WEAK} AS weak, {_VAGUE} AS vague FROM located WHERE section <> 'References' AND length(trim(text)) >= 40),
labelled AS (SELECT *, CASE WHEN nov THEN 'novelty_issue' WHEN weak THEN 'publication_issue' WHEN vague THEN 'numerical_ambiguity' END AS label,
  round(CASE WHEN nov THEN 0.82 WHEN weak THEN 0.78 WHEN vague THEN 0.76 ELSE 0 END - CASE WHEN {WORDS} < 8 THEN 0.25 ELSE 0 END + CASE WHEN section = 'Methods' AND weak THEN 0.05 ELSE 0 END, 6) AS score FROM flagged),
quality AS (SELECT doc_id, sentence_index, label, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) AS n FROM labelled WHERE label IS NOT NULL AND score >= 0.72) WHERE n <= 24)"""
FEATURES = rf"""
lens AS (SELECT *, list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1␞', 'g'), '␞'), lambda x: trim(x)), lambda x: length(x) > 5), lambda x: CAST(len(string_split_regex(x, '\s+')) AS DOUBLE)) AS l FROM {{rows}}),
means AS (SELECT *, CASE WHEN len(l) > 0 THEN list_sum(l) / len(l) ELSE 0 END AS mean FROM lens),
features AS (
  SELECT *, floor(CASE WHEN len(l) > 1 THEN list_sum(list_transform(l, lambda x: (x - mean) * (x - mean))) / len(l) ELSE 0 END * 100.0 + 0.5) / 100.0 AS variance,
    floor(CASE WHEN {WORDS} > 0 THEN len(regexp_extract_all(lower(text), {q(f'{T.B}(?:{claims.HEDGES})')})) / {WORDS} ELSE 0 END * 1000.0 + 0.5) / 1000.0 AS hedging,
    CAST(len(regexp_extract_all(text, '\d+(?:\.\d+)?%?')) + len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])[A-Z]{{{{2,6}}}}')) + len(regexp_extract_all(text, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+')) AS INTEGER) AS entities, floor(mean * 10.0 + 0.5) / 10.0 AS avg_length
  FROM means)"""
_FORM = has(claims.FORMULAIC)
PROSE = rf"""
prosein AS (SELECT * FROM located WHERE length(text) >= 110 AND NOT regexp_matches(text, '(?i)^(?:abstract|introduction|conclusion|references|acknowledg)') AND NOT ({has('we|our|this (?:work|study|paper)')} AND NOT {_FORM})),
{FEATURES.format(rows='prosein')},
strong AS (SELECT *, CASE WHEN {_FORM} THEN 2.5 ELSE 0 END + CASE WHEN hedging > 0.08 THEN 1.5 ELSE 0 END AS st FROM features),
prosescored AS (SELECT *, CAST(CASE WHEN st > 0 THEN st + CASE WHEN variance < 10 AND avg_length > 20 THEN 0.75 ELSE 0 END + CASE WHEN entities < 1 AND length(text) > 160 THEN 0.75 ELSE 0 END + CASE WHEN avg_length > 32 THEN 0.5 ELSE 0 END + CASE WHEN NOT cited AND length(text) > 220 THEN 0.25 ELSE 0 END ELSE 0 END AS DOUBLE) AS score FROM strong),
prose AS (SELECT doc_id, sentence_index, score, round(least(0.9, 0.5 + score * 0.07), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) AS n FROM prosescored WHERE score >= 3.5) WHERE n <= 12)"""


def _hits(name: str, pattern: str) -> str:
    return HITS.format(name=name, text="text", pattern=q(pattern), table="claimrows")


_NAMED = "regexp_replace(lower(regexp_extract(h, {p}, 1)), '\\s+', ' ', 'g')"
_VOLTS = f"ends_with(lower(regexp_extract(h, {q(numbers.UNIT['electric'])}, 1)), 'v')"
_PERCENT = "regexp_matches(h, '[%％]$')"
_KINDS = {
    "size": ("'sample size'", "'count'", "'n'"), "metric": (_NAMED.format(p=q(numbers.NAME["metric"])), f"CASE WHEN {_PERCENT} OR value > 1.5 THEN 'percent' ELSE 'ratio' END", f"CASE WHEN {_PERCENT} THEN '%' ELSE '' END"),
    "share": (_NAMED.format(p=q(numbers.NAME["share"])), "'percent'", "'%'"), "temperature": ("'temperature'", "'temperature'", f"upper(regexp_extract(h, {q(numbers.UNIT['temperature'])}, 1))"),
    "electric": (f"CASE WHEN {_NAMED.format(p=q(numbers.NAME['electric']))} <> '' THEN {_NAMED.format(p=q(numbers.NAME['electric']))} WHEN {_VOLTS} THEN 'voltage' ELSE 'current' END", f"CASE WHEN {_VOLTS} THEN 'voltage' ELSE 'current' END", f"regexp_extract(h, {q(numbers.UNIT['electric'])}, 1)"),
    "setting": (_NAMED.format(p=q(numbers.NAME["setting"])), "'generic'", "''"),
}
_METRIC = "CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in numbers.METRICS.items()) + " ELSE replace(name, ' ', '_') END"
_ROLE = "CASE WHEN starts_with(x, 'train') THEN 'train' WHEN starts_with(x, 'test') THEN 'test' WHEN starts_with(x, 'val') OR starts_with(x, 'dev') THEN 'val' WHEN x = 'baseline' THEN x WHEN starts_with(x, 'propos') OR starts_with(x, 'our') THEN 'proposed' WHEN starts_with(x, 'their') OR starts_with(x, 'control') THEN 'control' ELSE regexp_replace(x, '^(pre|post)[- ]?', '\\1') END"
#: Hits of every kind; then those of a sentence that overlap no kept one, one after the other.
NUMERIC = rf"""
claimrows AS (SELECT doc_id AS d, doc_id * 1000000 + sentence_index AS doc_id, sentence_index AS i, section AS sec, page AS pg, start_offset AS so, end_offset AS eo, text FROM located WHERE section <> 'References' AND length(trim(text)) >= {numbers.LEAST_CHARS}),
{', '.join(_hits(f'n_{k}', p) for k, p in numbers.CLAIMS.items())},
valued AS ({' UNION ALL '.join(f"SELECT doc_id, s, h, {i} AS o, value, raw, {n} AS name, {f} AS family, {u} AS unit FROM (SELECT *, regexp_extract(h, {q(numbers.VALUE[k])}, 1) AS raw, TRY_CAST(regexp_extract(h, {q(numbers.VALUE[k])}, 1) AS DOUBLE) AS value FROM n_{k})" for i, (k, (n, f, u)) in enumerate(_KINDS.items()))}),
wanted AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, length(h) DESC, o) AS k FROM valued WHERE NOT (family = 'generic' AND value = floor(value) AND (value <= 20 OR value BETWEEN 1900 AND 2100))),
chosen AS (SELECT doc_id, unnest(kept) AS k FROM (SELECT doc_id, list_reduce(list_prepend({{'stop': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[])}}, list({{'stop': s + length(h), 'kept': [CAST(s AS BIGINT), CAST(k AS BIGINT)]}} ORDER BY k)), lambda a, b: CASE WHEN b.kept[1] >= a.stop THEN {{'stop': b.stop, 'kept': list_append(a.kept, b.kept[2])}} ELSE a END).kept AS kept FROM wanted GROUP BY doc_id)),
numeric AS (
  SELECT d AS doc_id, i AS sentence_index, sec AS section, pg AS page, so AS start_offset, eo AS end_offset, so + s AS claim_start, so + s + length(h) AS claim_end, {_METRIC} AS metric, family, value, raw, unit,
    list_sort(list_distinct(list_transform(list_transform(regexp_extract_all(substr(text, greatest(0, s - {numbers.AROUND}) + 1, s - greatest(0, s - {numbers.AROUND}) + length(h) + {numbers.AROUND}), {q(numbers.QUALIFIER)}, 1), lambda x: lower(x)), lambda x: {_ROLE}))) AS qualifiers, text
  FROM wanted JOIN chosen USING (doc_id, k) JOIN claimrows USING (doc_id))"""
_MOST = "greatest(abs(a.value), abs(b.value), 1.0)"
_CLASH = "(" + " OR ".join(f"(list_contains(a.qualifiers, '{x}') AND list_contains(b.qualifiers, '{y}')) OR (list_contains(a.qualifiers, '{y}') AND list_contains(b.qualifiers, '{x}'))" for x, y in numbers.ROLES) + " OR NOT list_has_any(a.qualifiers, b.qualifiers))"
CONFLICTS = rf"""
calm AS (SELECT *, raw || CASE WHEN family = 'percent' THEN '%' WHEN unit <> '' THEN ' ' || unit ELSE '' END AS shown FROM numeric WHERE NOT regexp_matches(text, {q(numbers.CONTRAST)})),
clashing AS (
  SELECT a.doc_id, a.metric, a.family, a.claim_start AS a_start, b.claim_start AS b_start, a.value AS a_value, b.value AS b_value, a.shown AS a_shown, b.shown AS b_shown, a.start_offset, a.page, a.page <> b.page AS cross_page
  FROM calm a JOIN calm b ON a.doc_id = b.doc_id AND a.metric = b.metric AND a.family = b.family AND a.claim_start < b.claim_start AND abs(a.start_offset - b.start_offset) >= 8
  WHERE abs(a.value - b.value) >= CASE WHEN a.family IN ('percent', 'count') THEN 1.0 WHEN a.family = 'ratio' THEN 0.015 WHEN a.family = 'temperature' THEN 0.5 WHEN a.family IN ('voltage', 'current') THEN greatest(0.05, 0.01 * {_MOST}) ELSE greatest(1.0, 0.05 * {_MOST}) END
    AND NOT (len(a.qualifiers) > 0 AND len(b.qualifiers) > 0 AND {_CLASH})),
conflicts AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cross_page DESC, a_start, b_start) AS INTEGER) AS position FROM clashing) WHERE position <= 12)"""


@query(f"WITH {LOCATED}, {NEED} SELECT * FROM need")
def p21_citation_need(spark, sf_dir):
    """Eligibility and score (P20), threshold, cap and reasons (P21), citations nearby."""
    return claims.citation_need(claims.located(manuscripts(spark, sf_dir), claims.NEED_CUE))


@query(f"WITH {LOCATED}, {QUALITY} SELECT * FROM quality")
def p24_quality(spark, sf_dir):
    """Features and label (P23), threshold and cap."""
    return claims.quality(claims.located(manuscripts(spark, sf_dir), claims.QUALITY_CUE))


@query(f"WITH {MANUSCRIPTS}, rows AS (SELECT doc_id, body AS text FROM docs), {FEATURES.format(rows='rows')} SELECT doc_id, variance AS sentence_length_variance, hedging AS hedging_density, entities AS entity_count, avg_length AS avg_sentence_length FROM features")
def a14_prose_features(spark, sf_dir):
    rows = claims.prose_features(manuscripts(spark, sf_dir).select("doc_id", F.col("body").alias("text")))
    return rows.drop("text")


@query(f"WITH {LOCATED}, {PROSE} SELECT * FROM prose")
def p26_formulaic_prose(spark, sf_dir):
    return claims.formulaic_prose(claims.located(manuscripts(spark, sf_dir), claims.PROSE_CUE))


@query(f"WITH {LOCATED}, {NUMERIC} SELECT * EXCLUDE (text) FROM numeric")
def p31_numeric_claims(spark, sf_dir):
    """Claims of all six kinds without overlaps."""
    return numbers.numeric_claims(numbers.candidates(manuscripts(spark, sf_dir))).drop("text")


@query(f"WITH {LOCATED}, {NUMERIC}, {CONFLICTS} SELECT * EXCLUDE (position) FROM conflicts")
def j15_numeric_conflicts(spark, sf_dir):
    return numbers.numeric_conflicts(numbers.numeric_claims(numbers.candidates(manuscripts(spark, sf_dir)))).drop("position")


@query(f"WITH {LOCATED}, {NUMERIC}, {CONFLICTS} SELECT doc_id, metric, a_start, b_start, position FROM conflicts")
def l3_conflict_order(spark, sf_dir):
    """Conflicts across pages first, then by place."""
    return numbers.numeric_conflicts(numbers.numeric_claims(numbers.candidates(manuscripts(spark, sf_dir)))).select("doc_id", "metric", "a_start", "b_start", "position")


def _findings(spark, sf_dir):
    """Findings on single sentences: rows (doc_id, kind, category, start_offset, page, score)."""
    return claims.prose_findings(claims.located(manuscripts(spark, sf_dir), claims.CUE))


FINDINGS = f"""{LOCATED}, {NEED}, {QUALITY}, {PROSE},
allfindings AS (SELECT doc_id, sentence_index, 'citation_need' AS kind, 'needs_citation_claim' AS category, score FROM need UNION ALL SELECT doc_id, sentence_index, 'quality', label, score FROM quality UNION ALL SELECT doc_id, sentence_index, 'ai', 'formulaic_prose', confidence FROM prose),
findings AS (SELECT doc_id, kind, category, start_offset, page, score FROM allfindings JOIN located USING (doc_id, sentence_index))"""


_INTEGRITY = """
ks AS (SELECT doc_id, style, start_offset, unnest(keys) AS key FROM citations), surnamed AS (SELECT *, lower(regexp_extract(authors[1], '^(\\S+)', 1)) AS surname FROM fields),
integrity AS (
  SELECT doc_id, 'broken_citation' AS kind, 'broken_citation' AS category, start_offset, CAST(key AS INTEGER) AS key, 0.85 AS confidence FROM ks WHERE style = 'IEEE' AND doc_id IN (SELECT doc_id FROM refs) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = ks.doc_id AND r.ref_index = CAST(ks.key AS INTEGER))
  UNION ALL SELECT doc_id, 'orphan_ref', 'orphan_reference', start_offset, ref_index, 0.7 FROM surnamed f WHERE doc_id IN (SELECT doc_id FROM citations) AND NOT EXISTS (SELECT 1 FROM ks WHERE ks.doc_id = f.doc_id AND style = 'IEEE' AND CAST(key AS INTEGER) = f.ref_index)
    AND NOT EXISTS (SELECT 1 FROM ks WHERE ks.doc_id = f.doc_id AND style = 'APA' AND length(surname) > 2 AND contains(lower(key), surname)))"""


@query(f"""WITH {FINDINGS}, {NUMERIC}, {CONFLICTS}, {IN_TEXT}, {REFERENCES}, {FIELDS}, {_INTEGRITY}
SELECT * FROM findings UNION ALL SELECT doc_id, 'manuscript_quality', 'numerical_inconsistency', start_offset, page, 0.88 FROM conflicts UNION ALL SELECT doc_id, kind, category, start_offset, 1, confidence FROM integrity""")
def q3_review_prose(spark, sf_dir):
    """The review of prose, five kinds of finding in one table."""
    return claims.review(manuscripts(spark, sf_dir))


@query(f"WITH {FINDINGS} SELECT doc_id, count(*) AS total, count(*) FILTER (kind = 'citation_need') AS need, count(*) FILTER (kind = 'quality') AS wording, count(*) FILTER (kind = 'ai') AS prose, count(DISTINCT page) AS pages FROM findings GROUP BY doc_id")
def a2_finding_counters(spark, sf_dir):
    """Counters by kind (A2) and pages with findings (A3)."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return _findings(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("total"), of("citation_need").alias("need"), of("quality").alias("wording"), of("ai").alias("prose"), F.count_distinct("page").alias("pages"))
