"""Queries over flagged passages, reference lists, statements, callouts and venues."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, parse, review
from foliant.plans.claim_queries import LOCATED, WORDS
from foliant.plans.parse_queries import CITATIONS, FIELDS, MAIN, MANUSCRIPTS, MATCH_SQL, REFERENCES, SENTENCES, _heads, q, read
from foliant.sources.manuscripts import manuscripts

QUERIES: dict = {}
ORACLES: dict = {}
TITLES = ["A study of small things", "Another study of mattresses", "Rivers and the people who live by them"]
TYPES = ["internet", "publication", "student_paper", "unknown", "internet"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flags(spark, sf_dir, whole: bool = False):
    """A similarity report's flags: every fifth sentence of each manuscript, or every one; some with a text that it doesn't hold."""
    s = parse.sentences(manuscripts(spark, sf_dir))
    s = s if whole else s.filter("pmod(sentence_index + doc_id, 5) = 0")
    k = F.col("sentence_index")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(k, F.lit(len(xs))).cast("int"))
    return s.select("doc_id", k.alias("flag_id"), F.when(k % 11 == 7, F.concat(F.lit("zz "), "text")).otherwise(F.col("text")).alias("text"), (F.pmod(F.col("doc_id") * 7 + k * 3, F.lit(60)) / 10.0).alias("match_pct"), pick([*TITLES, None]).alias("source_title"), pick(TYPES).alias("source_type"), F.when(k % 2 == 0, "https://example.org/x").alias("source_url"))


FLAGS = f"""flags AS (SELECT doc_id, sentence_index AS flag_id, CASE WHEN sentence_index % 11 = 7 THEN 'zz ' || text ELSE text END AS text, (doc_id * 7 + sentence_index * 3) % 60 / 10.0 AS match_pct,
  list_extract(['{TITLES[0]}', '{TITLES[1]}', '{TITLES[2]}', NULL], sentence_index % 4 + 1) AS source_title, list_extract({TYPES}, sentence_index % 5 + 1) AS source_type, CASE WHEN sentence_index % 2 = 0 THEN 'https://example.org/x' END AS source_url
  FROM sentences WHERE (sentence_index + doc_id) % 5 = 0),
aligned AS (SELECT f.*, CASE WHEN length(text) >= 15 AND contains(lower(full_text), lower(text)) THEN instr(lower(full_text), lower(text)) - 1 ELSE -1 END AS paper_start FROM flags f JOIN manuscripts USING (doc_id)),
ends AS (SELECT *, CASE WHEN paper_start >= 0 THEN paper_start + length(text) ELSE -1 END AS paper_end, CASE WHEN paper_start >= 0 THEN 1.0 ELSE 0.0 END AS score FROM aligned)"""

FIFTH = "FROM sentences WHERE (sentence_index + doc_id) % 5 = 0"


def whole(of: str):
    """Registers f as ``of`` with every sentence as a flag; the oracle is that of ``of`` without its filter."""

    def add(f):
        assert FIFTH in ORACLES[of]
        QUERIES[f.__name__], ORACLES[f.__name__] = f, ORACLES[of].replace(FIFTH, "FROM sentences")
        return f

    return add


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, {FLAGS} SELECT doc_id, flag_id, CAST(paper_start AS INTEGER) AS paper_start, CAST(paper_end AS INTEGER) AS paper_end, CAST(score AS DOUBLE) AS score FROM ends")
def j1_aligned_flags(spark, sf_dir):
    """Exact part of the alignment; flags that are not found stay."""
    return review.align(flags(spark, sf_dir), manuscripts(spark, sf_dir)).select("doc_id", "flag_id", "paper_start", "paper_end", "score")


@whole("j1_aligned_flags")
def j1_aligned_flags_whole(spark, sf_dir):
    return review.align(flags(spark, sf_dir, whole=True), manuscripts(spark, sf_dir)).select("doc_id", "flag_id", "paper_start", "paper_end", "score")


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, {FLAGS} SELECT doc_id, count(*) AS flags, avg(score) AS match_rate FROM ends GROUP BY doc_id")
def a1_match_rate(spark, sf_dir):
    return review.match_rate(review.align(flags(spark, sf_dir), manuscripts(spark, sf_dir)))


@whole("a1_match_rate")
def a1_match_rate_whole(spark, sf_dir):
    return review.match_rate(review.align(flags(spark, sf_dir, whole=True), manuscripts(spark, sf_dir)))


def _respelt(spark, sf_dir):
    """Every sentence as a flag, with other marks between its words and other capitals in two of three."""
    f = flags(spark, sf_dir, whole=True).select("doc_id", "flag_id", "text")
    other = F.translate(F.regexp_replace("text", "[ ,.;:-]+", " — "), string.ascii_lowercase, string.ascii_uppercase)
    return f.withColumn("text", F.when(F.col("flag_id") % 3 > 0, other).otherwise(F.col("text")))


_PATTERN = "'(?i)' || replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(n, 'ffi', chr(1)), 'ffl', chr(2)), 'ff', chr(3)), 'fi', chr(4)), 'fl', chr(5)), chr(39), {quotes}), ' ', {gap}), chr(1), '{ffi}'), chr(2), '{ffl}'), chr(3), '{ff}'), chr(4), '{fi}'), chr(5), '{fl}')".format(quotes=q("['‘’“”]"), gap=q(f"[^{T.KEPT}]+"), **T.LIGATURES)


@query(rf"""WITH {MANUSCRIPTS}, {SENTENCES}, f0 AS (SELECT doc_id, sentence_index, CASE WHEN sentence_index % 11 = 7 THEN 'zz ' || text ELSE text END AS text FROM sentences),
f AS (SELECT doc_id, sentence_index AS flag_id, CASE WHEN sentence_index % 3 > 0 THEN translate(regexp_replace(text, '[ ,.;:-]+', ' — ', 'g'), '{string.ascii_lowercase}', '{string.ascii_uppercase}') ELSE text END AS text FROM f0),
e AS (SELECT f.*, full_text, CASE WHEN length(text) >= 15 THEN instr(lower(full_text), lower(text)) ELSE 0 END AS at_, {MATCH_SQL} AS n FROM f JOIN manuscripts USING (doc_id)),
p AS (SELECT *, CASE WHEN at_ = 0 AND length(text) >= 15 AND length(n) > {review.SECOND_TRY} THEN {_PATTERN} END AS pattern FROM e),
b AS (SELECT *, regexp_extract(full_text, '(?s)^(.*?)(?:' || pattern || ')', 1) AS head, regexp_extract(full_text, pattern, 0) AS body FROM p)
SELECT doc_id, flag_id, CAST(CASE WHEN at_ > 0 THEN at_ - 1 WHEN body <> '' THEN length(head) ELSE -1 END AS INTEGER) AS paper_start, CAST(CASE WHEN at_ > 0 THEN at_ - 1 + length(text) WHEN body <> '' THEN length(head) + length(body) ELSE -1 END AS INTEGER) AS paper_end, CAST(CASE WHEN at_ > 0 OR body <> '' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM b""")
def j3_normalised_flags(spark, sf_dir):
    """Flags whose marks and capitals differ from the document's, found by the second try."""
    return review.align(_respelt(spark, sf_dir), manuscripts(spark, sf_dir)).select("doc_id", "flag_id", "paper_start", "paper_end", "score")


def _norm(c: str) -> str:
    return MATCH_SQL.replace("lower(text)", f"lower({c})")


SOURCES = rf"""
flagtitles AS (SELECT doc_id, flag_id, source_title, {_norm('source_title')} AS x FROM flags WHERE source_title IS NOT NULL),
haves AS (SELECT doc_id, ref_index, year, authors, unnest([title, raw, venue]) AS of_ FROM fields), have AS (SELECT doc_id, ref_index, year, {_norm('of_')} AS y, lower(regexp_extract(authors[1], '^(\S+)', 1)) AS surname FROM haves WHERE of_ IS NOT NULL),
titlepairs AS (SELECT DISTINCT source_title, x, y, year, surname FROM flagtitles JOIN have USING (doc_id) WHERE length(x) >= 8),
grams AS (SELECT *, list_transform(range(1, length(x)), lambda i: x[i:i + 1]) AS gx, list_transform(range(1, length(y)), lambda i: y[i:i + 1]) AS gy FROM titlepairs),
dices AS (SELECT *, 2.0 * coalesce(list_sum(list_transform(list_distinct(gx), lambda t: least(len(list_filter(gx, lambda v: v = t)), len(list_filter(gy, lambda v: v = t))))), 0) / (len(gx) + len(gy)) AS dice FROM grams),
titlescores AS (
  SELECT source_title, y, year, surname, round(least(1.0, CASE WHEN length(y) = 0 THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.85 + 0.15 * (least(length(x), length(y)) / greatest(length(x), length(y)))
    WHEN greatest(length(x), length(y)) < 120 THEN greatest(dice, 1.0 - levenshtein(x, y) / greatest(length(x), length(y))) ELSE dice END
    + CASE WHEN length(surname) > 2 AND contains(x, surname) THEN 0.1 ELSE 0 END + CASE WHEN contains(source_title, year) THEN 0.08 ELSE 0 END), 9) AS ref_score FROM dices),
sources AS (SELECT doc_id, flag_id, ref_index, CAST(ref_score AS DOUBLE) AS ref_score FROM (
  SELECT n.doc_id, n.flag_id, h.ref_index, ref_score, row_number() OVER (PARTITION BY n.doc_id, n.flag_id ORDER BY ref_score DESC, h.ref_index) AS k
  FROM flagtitles n JOIN have h USING (doc_id) JOIN titlescores t ON t.source_title = n.source_title AND t.y = h.y AND t.year IS NOT DISTINCT FROM h.year AND t.surname IS NOT DISTINCT FROM h.surname WHERE ref_score >= 0.86) WHERE k = 1)"""


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, {FLAGS}, {REFERENCES}, {FIELDS}, {SOURCES} SELECT * FROM sources")
def j5_sources_in_references(spark, sf_dir):
    m = manuscripts(spark, sf_dir)
    return review.references_of(flags(spark, sf_dir), parse.reference_fields(parse.references(m)))


@whole("j5_sources_in_references")
def j5_sources_in_references_whole(spark, sf_dir):
    return review.references_of(flags(spark, sf_dir, whole=True), parse.reference_fields(parse.references(manuscripts(spark, sf_dir))))


def _any(phrases) -> str:
    return "(" + " OR ".join(f"contains(norm, {q(p)})" for p in phrases) + ")"


_BOILER = [p for p in review.METHODS_BOILERPLATE if p not in ("p < 0.05", "p<0.05", "mean ± standard", "mean +/- standard", "double-blind")] + ["double blind"]
CASCADE = rf"""
facts AS (
  SELECT e.*, coalesce(s.name, 'Other') AS section, ref_index, {_norm('text')} AS norm, {WORDS} AS words, full_text,
    substr(full_text, greatest(paper_start - 79, 1), least(paper_start, 80)) AS before, substr(full_text, greatest(paper_start - 1, 1), paper_end - greatest(paper_start - 2, 0) + 2) AS around,
    string_split_regex(regexp_replace(substr(full_text, greatest(paper_start - 200, 0) + 1, least(paper_start, 200)), '^\s+|\s+$', '', 'g'), '\s+') AS wb, string_split_regex(regexp_replace(substr(full_text, paper_end + 1, 200), '^\s+|\s+$', '', 'g'), '\s+') AS wa
  FROM ends e JOIN manuscripts USING (doc_id) LEFT JOIN sections s ON s.doc_id = e.doc_id AND s.start_offset <= paper_start AND paper_start < s.end_offset LEFT JOIN sources r ON r.doc_id = e.doc_id AND r.flag_id = e.flag_id),
nearby AS (SELECT DISTINCT f.doc_id, f.flag_id FROM facts f JOIN citations c ON c.doc_id = f.doc_id AND c.start_offset >= paper_start - length(array_to_string(wb[greatest(len(wb) - 15, 0) + 1:], ' ')) - 5 AND c.end_offset <= paper_end + length(array_to_string(wa[1:15], ' ')) + 55),
cascade AS (SELECT doc_id, flag_id, paper_start, CASE
  WHEN paper_start < 0 OR score < 0.62 THEN 'review_manually' WHEN source_type = 'student_paper' THEN 'source_unidentifiable' WHEN section = 'References' THEN 'reference_entry'
  WHEN len(regexp_extract_all(before, '[“\x22«]')) > len(regexp_extract_all(before, '[”\x22»]')) OR (regexp_matches(around, '(?s)[“\x22].+[”\x22]') AND length(around) < paper_end - paper_start + 10) THEN 'properly_quoted'
  WHEN words < 8 OR {_any(review.COMMON_PHRASES)} THEN 'common_phrase' WHEN section = 'Methods' AND {_any(_BOILER)} THEN 'methods_boilerplate'
  WHEN (doc_id, flag_id) IN (SELECT (doc_id, flag_id) FROM nearby) THEN 'already_cited' WHEN ref_index IS NOT NULL THEN 'missing_in_text_citation' WHEN match_pct < 2 THEN 'trivial_match'
  WHEN source_type = 'unknown' AND source_url IS NULL AND source_title IS NULL THEN 'source_unidentifiable' WHEN words >= 24 AND match_pct >= 3 AND score >= 0.7 THEN 'needs_restatement'
  WHEN source_title IS NOT NULL OR source_url IS NOT NULL THEN 'needs_new_citation' ELSE 'review_manually' END AS category FROM facts)"""


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, {_heads(True)}, {FLAGS}, {CITATIONS}, {REFERENCES}, {FIELDS}, {SOURCES}, {CASCADE} SELECT doc_id, flag_id, category, category IN ('reference_entry', 'properly_quoted', 'common_phrase', 'methods_boilerplate', 'already_cited', 'trivial_match') OR (category = 'review_manually' AND paper_start < 0) AS informational FROM cascade")
def q2_review_similarity(spark, sf_dir):
    """Flags aligned, matched to references and sorted by the ordered cascade."""
    return _categorized(manuscripts(spark, sf_dir), flags(spark, sf_dir))


@whole("q2_review_similarity")
def q2_review_similarity_whole(spark, sf_dir):
    return _categorized(manuscripts(spark, sf_dir), flags(spark, sf_dir, whole=True))


def _categorized(m, f):
    return review.categorize(review.align(f, m), m, parse.sections(m), review.references_of(f, parse.reference_fields(parse.references(m))))


@query(r"SELECT page_id, CASE WHEN regexp_matches(t, 'student paper|submitted to') THEN 'student_paper' WHEN regexp_matches(t, 'journal|proceedings|conference|press|publication') OR regexp_matches(u, 'doi\.org|/article|pubmed') THEN 'publication' WHEN u <> '' OR regexp_matches(t, 'https?://|www\.') THEN 'internet' ELSE 'unknown' END AS source_type FROM (SELECT page_id, lower(coalesce(html[1:200], '')) AS t, lower(coalesce(CASE WHEN page_id % 4 = 0 THEN NULL ELSE url END, '')) AS u FROM pages)")
def p10_source_types(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", review.source_type(F.substring("html", 1, 200), F.when(F.col("page_id") % 4 != 0, F.col("url"))).alias("source_type"))


_TITLE = "(?is)<title[^>]*>(.*?)</title>"


@query(rf"SELECT page_id, CASE WHEN regexp_matches(t, 'student paper|submitted to') THEN 'student_paper' WHEN regexp_matches(t, 'journal|proceedings|conference|press|publication') OR regexp_matches(u, 'doi\.org|/article|pubmed') THEN 'publication' WHEN u <> '' OR regexp_matches(t, 'https?://|www\.') THEN 'internet' ELSE 'unknown' END AS source_type FROM (SELECT page_id, lower(coalesce(regexp_extract(html, {q(_TITLE)}, 1), '')) AS t, lower(coalesce(url, '')) AS u FROM pages)")
def p10_source_types_whole(spark, sf_dir):
    """The title of the whole page, and every page's address."""
    return read(spark, sf_dir, "pages").select("page_id", review.source_type(F.regexp_extract("html", _TITLE, 1), "url").alias("source_type"))


def _has(p: str, c: str = "full_text") -> str:
    return f"regexp_matches({c}, {q(T.words_like(p))})"


_STATES = {
    "ethics": f"CASE WHEN {_has(review.PRESENT['ethics'])} THEN 'ok' WHEN {_has(review.NEEDS['human'], 'methods')} OR {_has(review.NEEDS['animal'], 'methods')} THEN 'missing' ELSE 'not_needed' END",
    "consent": f"CASE WHEN {_has(review.NEEDS['human'], 'methods')} THEN CASE WHEN {_has(review.PRESENT['consent'])} THEN 'ok' ELSE 'missing' END END",
    "data": f"CASE WHEN {_has(review.PRESENT['data'])} THEN 'ok' WHEN {_has(review.NEEDS['data'])} OR {_has(review.NEEDS['code'])} THEN 'missing' ELSE 'check' END",
    "conflict": f"CASE WHEN {_has(review.PRESENT['conflict'])} THEN 'ok' ELSE 'missing' END",
    "funding": f"CASE WHEN {_has(review.PRESENT['funding'])} THEN 'ok' ELSE 'check' END",
}


@query(f"WITH {MANUSCRIPTS}, {_heads(True)}, stated AS (SELECT m.doc_id, full_text, coalesce(substr(full_text, s.start_offset + 1, s.end_offset - s.start_offset), full_text) AS methods FROM manuscripts m LEFT JOIN sections s ON s.doc_id = m.doc_id AND s.name = 'Methods') SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS statement, {v} AS status FROM stated" for k, v in _STATES.items()) + ") WHERE status IS NOT NULL")
def p34_statements(spark, sf_dir):
    """Required statements by the full lists of signals and wordings."""
    return review.statements(manuscripts(spark, sf_dir))


HYGIENE = rf"""
ages AS (SELECT *, 2025 - CAST(year[1:4] AS INTEGER) AS age, {_norm('title')} AS k FROM fields),
dups AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS duplicates FROM (SELECT doc_id, k, count(*) AS n FROM ages WHERE length(title) >= 15 GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id),
hygiene AS (SELECT doc_id, count(*) AS total, count(year) AS with_year, count(doi) AS with_doi, count(*) FILTER (age > 10) AS older_than_10, count(*) FILTER (age <= 5) AS recent_5, count(*) FILTER (regexp_matches(raw, {q(T.words_like(review.VENUE_CAUTION))})) AS cautions, coalesce(any_value(duplicates), 0) AS duplicates FROM ages LEFT JOIN dups USING (doc_id) GROUP BY doc_id)"""


@query(f"WITH {MANUSCRIPTS}, {REFERENCES}, {FIELDS}, {HYGIENE} SELECT * FROM hygiene")
def a9_reference_hygiene(spark, sf_dir):
    """Counts of a reference list (A9), duplicates (A10), cautions (P36), ages."""
    return review.hygiene(parse.reference_fields(parse.references(manuscripts(spark, sf_dir))), 2025)


@query(f"WITH {MANUSCRIPTS}, {REFERENCES}, {FIELDS}, {HYGIENE} SELECT doc_id, unnest(list_filter([CASE WHEN with_year >= 5 AND older_than_10 / with_year > 0.6 THEN 'aged' END, CASE WHEN with_year >= 5 AND recent_5 = 0 THEN 'no-recent' END, CASE WHEN total >= 5 AND with_doi / total < 0.3 THEN 'missing-doi' END, CASE WHEN duplicates > 0 THEN 'duplicates' END, CASE WHEN cautions > 0 THEN 'venue-caution' END], lambda x: x IS NOT NULL)) AS issue FROM hygiene")
def a9_hygiene_issues(spark, sf_dir):
    return review.hygiene_issues(review.hygiene(parse.reference_fields(parse.references(manuscripts(spark, sf_dir))), 2025))


_ROMAN = " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split(), 1))


def _callouts(kind: str, whole: str, last: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, regexp_extract(lower(unnest(regexp_extract_all(full_text, {q(whole)}))), '{last}', 1) AS t FROM mains"


@query(rf"""WITH {MANUSCRIPTS}, {MAIN}, t AS ({_callouts('figure', rf'(?i){T.B}(?:fig\.?|figure)\s*\d{{1,3}}', r'(\d+)$')} UNION ALL {_callouts('table', rf'(?i){T.B}(?:table|tab\.)\s*(?:\d{{1,3}}|[ivx]{{1,5}})', r'(\d+|[ivx]+)$')}),
n AS (SELECT doc_id, kind, list_distinct(list(v)) AS n FROM (SELECT doc_id, kind, coalesce(TRY_CAST(t AS INTEGER), CASE t {_ROMAN} END) AS v FROM t) WHERE v BETWEEN 1 AND 200 GROUP BY ALL)
SELECT doc_id, kind, CAST(len(n) AS INTEGER) AS count, list_max(n) AS max_number, list_filter(range(1, list_max(n) + 1), lambda i: NOT list_contains(n, i)) AS missing FROM n""")
def p33_callouts(spark, sf_dir):
    """Figures and tables called out (P33) and the numbers left out."""
    return review.callouts(manuscripts(spark, sf_dir))


LEXICON = {"health": ["patients", "cohort", "treatment", "samples"], "engineering": ["device", "yield", "framework", "accuracy"], "language": ["est", "der", "the", "que"], "economics": ["market", "price"]}
VENUES = [("Annals of Matters", ["studies", "effect"], ["health"]), ("Journal of Things", ["device", "approach", "yield"], ["engineering", "health"]), ("Letters of Stuff", ["results", "outcome"], ["language"]), ("Open Record", ["record"], ["general"]), ("Price Review", ["price"], ["economics"]), ("Word Notes", ["der", "est"], ["language", "general"])]


def _lead(spark, sf_dir):
    return manuscripts(spark, sf_dir).select("doc_id", F.lower(F.substring("full_text", 1, 1200)).alias("lead"))


def _lexicon(spark):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{f}', '{t}')" for f, ts in LEXICON.items() for t in ts) + " AS t(field, term)")


FIELDHITS = f"""leads AS (SELECT doc_id, lower(full_text[1:1200]) AS lead FROM manuscripts), lexicon(field, term) AS (VALUES {', '.join(f"('{f}', '{t}')" for f, ts in LEXICON.items() for t in ts)}),
fieldhits AS (SELECT doc_id, field, count(*) AS hits FROM leads JOIN lexicon ON contains(lead, term) GROUP BY ALL),
fieldtop AS (SELECT doc_id, field, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, field) AS place FROM fieldhits),
fieldguess AS (SELECT doc_id, field, CAST(hits AS INTEGER) AS hits, CAST(place AS INTEGER) AS place FROM fieldtop WHERE place <= 3 UNION ALL SELECT doc_id, 'general', 0, 1 FROM leads WHERE doc_id NOT IN (SELECT doc_id FROM fieldhits))"""


@query(f"WITH {MANUSCRIPTS}, {FIELDHITS} SELECT * FROM fieldguess")
def l6_field_guess(spark, sf_dir):
    """Terms of a field lexicon in the lead (J21), the three best fields."""
    return review.fields(_lead(spark, sf_dir), _lexicon(spark))


@query(f"""WITH {MANUSCRIPTS}, {FIELDHITS}, venues(venue, keywords, fields) AS (VALUES {', '.join(f"('{v}', {k}, {f})" for v, k, f in VENUES)}), mine AS (SELECT doc_id, list(field) AS mine FROM fieldguess GROUP BY doc_id),
s AS (SELECT doc_id, venue, CAST(1 + 2 * len(list_filter(keywords, lambda k: contains(lead, k))) + 3 * len(list_filter(fields, lambda f: list_contains(mine, f))) AS INTEGER) AS score FROM leads JOIN mine USING (doc_id), venues)
SELECT doc_id, venue, score, CAST(n AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, venue) AS n FROM s) WHERE n <= 5""")
def l5_venue_ranking(spark, sf_dir):
    """Every venue scored for each document (J20), the best of them."""
    catalog = spark.sql("SELECT * FROM VALUES " + ", ".join("('{}', array({}), array({}))".format(v, ", ".join(f"'{x}'" for x in k), ", ".join(f"'{x}'" for x in f)) for v, k, f in VENUES) + " AS t(venue, keywords, fields)")
    lead = _lead(spark, sf_dir)
    return review.venues(lead, review.fields(lead, _lexicon(spark)), catalog)
