"""Queries over the queue of findings.

Findings are those of q3_review_prose. What the queue needs beside them is made up
from a finding's place, as no reviewer's decisions are among the tables: status,
whether it is informational, a replacement, a share and source of a match.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, edits, findings, parse
from foliant.plans.activity_queries import _KEYS, _marks
from foliant.plans.claim_queries import FEATURES, FINDINGS, WORDS, any_of, has
from foliant.plans.parse_queries import q
from foliant.sources.manuscripts import manuscripts
from foliant.sources.shared import stored_once

QUERIES: dict = {}
ORACLES: dict = {}
STATUSES = ["open", "accepted", "dismissed", "edited"]
SOURCE_TYPES = ["internet", "publication", "student_paper", "unknown"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def wide(spark, sf_dir):
    """Findings with all that the queue needs, in one pass over the sentences; written once for each application and folder."""
    return stored_once(f"wide:{sf_dir}", lambda: _wide(spark, sf_dir), spark)


def _wide(spark, sf_dir):
    rows = claims.located(manuscripts(spark, sf_dir), claims.CUE)
    f = claims.prose_findings(rows, keep=("end_offset", "text", "section", "cited"))
    # flags of the findings alone, not of all sentences
    f = f.withColumns({"attributes": claims.any_of(claims.ATTRIBUTION.values()), "claims": claims.any_of(claims.CLAIM.values()), "own_work": claims.has(claims.OWN_WORK)})
    at = F.col("doc_id") + F.col("start_offset")
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    need = F.col("kind") == "citation_need"
    f = f.withColumns({
        "category": F.when(F.col("category") == "formulaic_prose", "ai_flagged").otherwise(F.col("category")), "kind": F.when(F.col("kind") == "quality", "manuscript_quality").otherwise(F.col("kind")), "confidence": F.col("score"),
        "status": pick(STATUSES, at % 4), "is_informational": F.col("start_offset") % 7 == 0, "match_pct": F.when(need, (F.col("start_offset") % 90) / 10.0),
        "source_title": F.when(need & (at % 3 == 0), F.concat(F.lit("Source "), (at % 9).cast("string"))), "source_url": F.when(need & (at % 6 == 0), "https://example.org/s"), "source_type": F.when(need, pick(SOURCE_TYPES, at % 4)),
        "origin": F.when(F.col("kind") == "ai", "local_heuristic").when(need, "similarity_report"),
    })
    f = f.withColumn("finding_id", F.concat_ws(":", "doc_id", "category", "start_offset"))
    change = F.when(F.col("kind") == "manuscript_quality", F.replace("text", F.lit("the "), F.lit("a "))).when(need, F.regexp_replace("text", r"\[[0-9, ]+\]", ""))
    f = f.withColumn("replacement_text", change)
    edited = F.when(F.col("status").isin("accepted", "edited"), F.concat(F.lit("So: "), F.regexp_replace("text", r"\([A-Z][^)]*\)|\[[0-9, ]+\]", "")))
    return claims.prose_features(f.withColumn("edited_text", edited)).drop("score", "sentence_index")


def _features(rows: str, prefix: str) -> str:
    """The table expressions of prose features over ``rows``, under names of their own."""
    return re.sub(r"\b(lens|means|features)\b", rf"{prefix}\1", FEATURES.format(rows=rows))


WIDE = rf"""{FINDINGS},
widerows AS (SELECT f.doc_id, f.kind AS k0, f.category AS c0, f.score AS confidence, l.sentence_index, l.start_offset, l.end_offset, l.text, l.section, l.page, l.cited, f.doc_id + l.start_offset AS at_ FROM allfindings f JOIN located l USING (doc_id, sentence_index)),
{_features('widerows', 'w')},
wide AS (
  SELECT *, doc_id || ':' || category || ':' || start_offset AS finding_id, CASE WHEN status IN ('accepted', 'edited') THEN 'So: ' || regexp_replace(text, '\([A-Z][^)]*\)|\[[0-9, ]+\]', '', 'g') END AS edited_text FROM (
    SELECT *, CASE c0 WHEN 'formulaic_prose' THEN 'ai_flagged' ELSE c0 END AS category, CASE k0 WHEN 'quality' THEN 'manuscript_quality' ELSE k0 END AS kind, list_extract({STATUSES}, at_ % 4 + 1) AS status, start_offset % 7 = 0 AS is_informational,
      CASE WHEN k0 = 'citation_need' THEN start_offset % 90 / 10.0 END AS match_pct, CASE WHEN k0 = 'citation_need' AND at_ % 3 = 0 THEN 'Source ' || at_ % 9 END AS source_title, CASE WHEN k0 = 'citation_need' AND at_ % 6 = 0 THEN 'https://example.org/s' END AS source_url,
      CASE WHEN k0 = 'citation_need' THEN list_extract({SOURCE_TYPES}, at_ % 4 + 1) END AS source_type, CASE k0 WHEN 'ai' THEN 'local_heuristic' WHEN 'citation_need' THEN 'similarity_report' END AS origin,
      CASE k0 WHEN 'quality' THEN replace(text, 'the ', 'a ') WHEN 'citation_need' THEN regexp_replace(text, '\[[0-9, ]+\]', '', 'g') END AS replacement_text FROM wfeatures))"""


def lost(a: str, b: str) -> str:
    return f"list_filter(list_distinct({_marks(a)}), lambda mm: NOT list_has_any({_KEYS.format(m='mm')}, flatten(list_transform({_marks(b)}, lambda zz: {_KEYS.format(m='zz')}))))"


def _in(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


_RANK = f"list_position({findings.PRIORITY}, category)"
_SEVERITY = f"CASE WHEN category IN {_in(findings.HIGH)} THEN 0 WHEN category IN {_in(findings.LOW)} THEN 2 WHEN category IN {_in(findings.INFO)} THEN 3 ELSE 1 END"
_WARNS = f"(edited_text IS NOT NULL AND len({lost('text', 'edited_text')}) > 0)"
_SAFE = f"len({lost('text', 'replacement_text')}) = 0"


@query(f"WITH {WIDE} SELECT doc_id, finding_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY is_informational, {_RANK}, start_offset, finding_id) AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_SEVERITY}, page, start_offset, finding_id) AS INTEGER) AS triage FROM wide")
def l1_finding_order(spark, sf_dir):
    """Order by the 20 ranks with informational findings last (L1) and by severity, page and offset (L2)."""
    return findings.ordered(wide(spark, sf_dir))


_COUNTS = ", ".join(f"count(*) FILTER (NOT is_informational AND status = 'open' AND kind IN {_in(k)}) AS {g}" for g, k in findings.GROUPS.items())


@query(f"WITH {WIDE}, c AS (SELECT doc_id, count(*) FILTER (NOT is_informational) AS total, count(*) FILTER (is_informational) AS info, count(*) FILTER (NOT is_informational AND status = 'open') AS open, count(*) FILTER (NOT is_informational AND status <> 'open') AS reviewed, {_COUNTS} FROM wide GROUP BY doc_id) SELECT *, CAST(CASE WHEN total > 0 THEN floor(reviewed * 100.0 / total + 0.5) ELSE 0 END AS INTEGER) AS progress FROM c")
def a2_queue_counts(spark, sf_dir):
    return findings.queue_counts(wide(spark, sf_dir))


@query(f"WITH {WIDE} SELECT doc_id, {', '.join(f'count(*) FILTER (status = {q(s)}) AS {s}' for s in ('accepted', 'edited', 'dismissed', 'open'))}, count(*) FILTER (status <> 'open' AND {_WARNS}) AS citation_warnings FROM wide GROUP BY doc_id")
def a4_status_summary(spark, sf_dir):
    return findings.status_summary(wide(spark, sf_dir))


@query(f"WITH {WIDE}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY start_offset, finding_id) AS n FROM wide WHERE status = 'open' AND NOT is_informational) SELECT doc_id, category, count(*) AS n, list(finding_id ORDER BY n) FILTER (n <= 12) AS ids FROM o GROUP BY doc_id, category")
def a5_open_actionable(spark, sf_dir):
    return findings.open_actionable(wide(spark, sf_dir))


@query(f"WITH {WIDE} SELECT doc_id, finding_id, category, status AS action, page, CASE WHEN length(text) <= 121 THEN text ELSE text[1:120] || '…' END AS original, edited_text, {_WARNS} AS citation_warning FROM wide WHERE status <> 'open'")
def s17_change_log(spark, sf_dir):
    """Decided findings, what was done, and whether a citation was dropped."""
    return findings.change_log(wide(spark, sf_dir))


@query(f"WITH {WIDE} SELECT doc_id, finding_id, status IN ('accepted', 'edited') AND edited_text IS NOT NULL AND length(trim(text)) > 0 AS editable, status = 'open' AND NOT is_informational AND (kind = 'ai' OR category IN ('needs_restatement', 'ai_flagged')) AS rewritable, status = 'open' AND coalesce(replacement_text, '') <> '' AND {_SAFE.replace('replacement_text', 'coalesce(replacement_text, {e})').replace('{e}', chr(39) * 2)} AS safe FROM wide")
def p39_usable_findings(spark, sf_dir):
    return findings.usable(wide(spark, sf_dir))


@query(f"WITH {WIDE}, o AS (SELECT doc_id, {_SAFE} AS ok FROM wide WHERE status = 'open' AND coalesce(replacement_text, '') <> '') SELECT doc_id, count(*) FILTER (ok) AS applied, count(*) FILTER (NOT ok) AS skipped FROM o GROUP BY doc_id")
def f13_safe_replacements(spark, sf_dir):
    """Bulk replacement: applied where every citation stays, skipped elsewhere."""
    done = findings.apply_safe(wide(spark, sf_dir)).filter("applied OR skipped")
    return done.groupBy("doc_id").agg(F.count_if("applied").alias("applied"), F.count_if("skipped").alias("skipped"))


_FLAG = "CASE WHEN kind = 'citation_need' THEN CAST({c} AS INTEGER) END AS {n}"


@query(rf"""WITH {WIDE} SELECT doc_id, finding_id, CASE status WHEN 'dismissed' THEN 0 ELSE 1 END AS label, kind, category, CAST({WORDS} AS INTEGER) AS f_word_count, CAST(length(text) AS INTEGER) AS f_char_count, CAST(match_pct AS DOUBLE) AS f_match_pct, source_type AS f_source_type, section AS f_section, page AS f_page, confidence AS f_confidence,
  CAST(is_informational AS INTEGER) AS f_is_informational, CAST(regexp_matches(text, {q(findings.MARKER)}) AS INTEGER) AS f_has_citation_marker, CAST(regexp_matches(text, '["“”]') AS INTEGER) AS f_in_quotes, CAST(regexp_matches(text, '\d') AS INTEGER) AS f_has_numbers,
  {_FLAG.format(c=any_of(claims.ATTRIBUTION.values()), n='f_attribution_cue')}, {_FLAG.format(c=any_of(claims.CLAIM.values()), n='f_claim_cue')}, {_FLAG.format(c='cited', n='f_nearby_citation')}, {_FLAG.format(c=has(claims.OWN_WORK), n='f_own_work')},
  CASE WHEN kind = 'ai' THEN variance END AS f_ai_sentence_variance, CASE WHEN kind = 'ai' THEN hedging END AS f_ai_hedging, CASE WHEN kind = 'ai' THEN entities END AS f_ai_entities, text[1:600] AS text, CAST(status = 'edited' AS INTEGER) AS was_edited FROM wide WHERE status <> 'open'""")
def q4_training_rows(spark, sf_dir):
    """Decided findings as labelled rows (Q4), as they are exported."""
    return findings.training_rows(wide(spark, sf_dir))


@query(f"WITH {WIDE} SELECT doc_id, finding_id, category FROM wide WHERE NOT is_informational AND category IN {_in(findings.ESCALATED)}")
def p19_escalated(spark, sf_dir):
    return findings.escalated(wide(spark, sf_dir)).select("doc_id", "finding_id", "category")


_LABEL = "CASE category " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in findings.LABELS.items()) + " ELSE '' END"


@query(f"WITH {WIDE} SELECT doc_id, finding_id FROM wide WHERE NOT is_informational AND status = 'open' AND (contains(lower(text), 'ai-written') OR contains(lower({_LABEL}), 'ai-written'))")
def p48_visible(spark, sf_dir):
    return findings.visible(wide(spark, sf_dir), " AI-Written ").select("doc_id", "finding_id")


_PCT = "regexp_replace(printf('%.1f', match_pct), '\\.0$', '')"
_NEXT = "CASE category " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in findings.NEXT.items()) + " ELSE 'Read it and decide.' END"
_ORIGIN = "CASE origin " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in findings.ORIGINS.items()) + " ELSE 'Analysis rules' END"


@query(rf"""WITH {WIDE}, e AS (SELECT doc_id, finding_id, list_filter([
    CASE WHEN origin IS NOT NULL THEN {{'label': 'Signal source', 'value': {_ORIGIN}}} END, CASE WHEN match_pct IS NOT NULL THEN {{'label': 'Match weight', 'value': CASE WHEN match_pct < 1 THEN '<1% of the document' ELSE '~' || {_PCT} || '% of the document' END}} END,
    CASE WHEN page > 0 THEN {{'label': 'Manuscript page', 'value': CAST(page AS VARCHAR)}} END,
    CASE WHEN source_title IS NOT NULL THEN {{'label': 'Report source', 'value': {_PCT} || '% · ' || source_title || CASE WHEN source_type <> 'unknown' THEN ' · ' || replace(source_type, '_', ' ') ELSE '' END || coalesce(' — ' || source_url, '')}} END,
    {{'label': 'Next step', 'value': {_NEXT}}}, {{'label': 'Category rule', 'value': replace(category, '_', ' ')}}], lambda x: x IS NOT NULL) AS r FROM wide)
SELECT doc_id, finding_id, CAST(k - 1 AS INTEGER) AS place, r[k].label AS label, r[k].value AS value FROM (SELECT *, unnest(range(1, len(r) + 1)) AS k FROM e)""")
def p46_evidence_rows(spark, sf_dir):
    return findings.evidence(wide(spark, sf_dir))


_CONTEXT = "'…' || substr(full_text, greatest(start_offset - 249, 1), least(start_offset, 250)) || '【' || substr(full_text, start_offset + 1, end_offset - start_offset) || '】' || substr(full_text, end_offset + 1, 250) || '…'"


@query(f"WITH {WIDE}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset, finding_id) AS n, {_CONTEXT} AS c FROM wide JOIN manuscripts USING (doc_id) WHERE NOT is_informational AND category IN {_in(findings.ESCALATED)}) SELECT doc_id, finding_id, CASE WHEN length(text) <= 900 THEN text ELSE text[1:899] || '…' END AS text, CASE WHEN length(c) <= 500 THEN c ELSE c[1:499] || '…' END AS context FROM e WHERE n <= 24")
def p47_payloads(spark, sf_dir):
    """At most 24 clipped spans a document; 24 of them never reach the budget, so the oracle has no shrinking (tests have)."""
    return findings.payloads(wide(spark, sf_dir), manuscripts(spark, sf_dir))


_TIPS = f"list_filter([CASE WHEN variance < 15 THEN {q(findings.TIPS['uniform'])} END, CASE WHEN hedging > 0.04 THEN {q(findings.TIPS['hedged'])} END, CASE WHEN entities < 2 THEN {q(findings.TIPS['unspecific'])} END, CASE WHEN NOT cited AND length(text) > 120 THEN {q(findings.TIPS['uncited'])} END, CASE WHEN avg_length > 28 THEN {q(findings.TIPS['long'])} END], lambda x: x IS NOT NULL)"


@query(f"WITH {WIDE} SELECT doc_id, finding_id, CASE WHEN len({_TIPS}) > 0 THEN {_TIPS} ELSE [{q(findings.NO_TIP)}] END AS tips FROM wide WHERE kind = 'ai'")
def p49_tips(spark, sf_dir):
    return findings.tips(wide(spark, sf_dir).filter("kind = 'ai'")).select("doc_id", "finding_id", "tips")


@query(f"WITH {WIDE} SELECT doc_id, finding_id, 'ai' AS kind, 'ai_flagged' AS category, start_offset, end_offset, page, text, confidence, variance AS sentence_length_variance, hedging AS hedging_density, entities AS entity_count, avg_length AS avg_sentence_length, FALSE AS is_informational, 'open' AS status FROM wide WHERE kind = 'ai'")
def p18_ai_findings(spark, sf_dir):
    spans = claims.prose_features(claims.prose_findings(claims.located(manuscripts(spark, sf_dir), claims.PROSE_CUE), keep=("end_offset", "text")).filter("kind = 'ai'"))
    return findings.ai_findings(spans)


@query(f"WITH {WIDE} SELECT doc_id, finding_id, CASE WHEN start_offset % 5 = 0 THEN 'edited' ELSE status END AS status, CASE WHEN start_offset % 5 = 0 THEN replace(text, '[', '(') ELSE edited_text END AS edited_text, CASE WHEN start_offset % 2 = 0 THEN 'Because ' || category END AS explanation, CASE WHEN start_offset % 5 = 0 THEN len({lost('text', chr(34) + 'draft' + chr(34))}) > 0 ELSE FALSE END AS citation_warning FROM (SELECT *, replace(text, '[', '(') AS draft FROM wide)")
def j19_merged_explanations(spark, sf_dir):
    """Explanations of every second finding and drafts for every fifth, merged back by id."""
    f = wide(spark, sf_dir)
    explained = f.filter("start_offset % 2 = 0").select("finding_id", F.concat(F.lit("Because "), "category").alias("explanation"))
    drafts = f.filter("start_offset % 5 = 0").select("finding_id", F.replace("text", F.lit("["), F.lit("(")).alias("draft"))
    return findings.merged(f, explained, drafts).select("doc_id", "finding_id", "status", "edited_text", "explanation", "citation_warning")


@query(f"WITH {WIDE} SELECT doc_id, finding_id, kind, category, start_offset, end_offset, page, text[1:500] AS text, status, CAST(match_pct AS DOUBLE) AS match_pct, confidence FROM wide")
def s14_saved_findings(spark, sf_dir):
    return findings.saved(wide(spark, sf_dir))
