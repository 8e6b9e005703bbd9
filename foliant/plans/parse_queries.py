"""Queries over documents and manuscripts: text functions, parsing, citations against references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import overlap, parse
from foliant.sources.manuscripts import SQL as MANUSCRIPTS
from foliant.sources.manuscripts import manuscripts, spread
from foliant.sources.shared import stored_once

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bodies(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.normalize_layout("text").alias("body"))


def q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


MATCH_SQL = """trim(regexp_replace(regexp_replace(replace(replace(replace(translate(lower(text), '‘’“”–—', '''''''''--'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '[^a-z0-9\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"""
CUTS = r"string_split(regexp_replace(regexp_replace({t}, '([.!?])(\s+)([A-Z\[(\x22''])', '\1\2␞\3', 'g'), '([.!?]\x22)(\s+)', '\1\2␞', 'g'), '␞')"
SENTENCES = rf"""
pieces AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS k FROM (SELECT doc_id, {CUTS.format(t='full_text')} AS a FROM manuscripts)),
sentences AS (
  SELECT doc_id, CAST(k AS INTEGER) AS sentence_index, rtrim(x) AS text, s AS start_offset, s + length(rtrim(x)) AS end_offset
  FROM (SELECT *, CAST(coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM pieces)
  WHERE rtrim(x) <> '')"""


def _heads(strict: bool) -> str:
    rows = [f"SELECT doc_id, {k} AS o, '{n}' AS name, length(full_text) AS n, length(regexp_extract(full_text, {q(parse.heading(n, strict))}, 1)) AS s FROM manuscripts WHERE regexp_matches(full_text, {q(parse.heading(n, strict))})" for k, n in enumerate(parse.SECTIONS)]
    return f"""
heads AS ({' UNION ALL '.join(rows)}),
withother AS (SELECT doc_id, o, name, n, s FROM heads UNION ALL SELECT doc_id, -1, 'Other', length(full_text), 0 FROM manuscripts WHERE doc_id NOT IN (SELECT doc_id FROM heads WHERE s = 0)),
sections AS (SELECT doc_id, name, s AS start_offset, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s, o), n) AS end_offset FROM withother)"""


HITS = """
{name} AS (
  SELECT doc_id, h, CAST(sum(length(b) + CASE WHEN k > 1 THEN length(p) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS s FROM (
    SELECT doc_id, k, m[k] AS h, coalesce(m[k - 1], '') AS p, b[k] AS b FROM (
      SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all({text}, {pattern}) AS m, string_split_regex({text}, {pattern}) AS b FROM {table}))))"""
BRACKETS = HITS.format(name="brackets", text="full_text", pattern=q(parse.BRACKET), table="manuscripts")
NAMED = HITS.format(name="named", text="full_text", pattern=q(parse.AUTHOR_YEAR), table="manuscripts")
CITATIONS = rf"""{BRACKETS}, {NAMED},
citations AS (
  SELECT doc_id, h AS marker, 'IEEE' AS style, s AS start_offset, s + length(h) AS end_offset, list_filter(list_transform(string_split_regex(h[2:-2], '[,–-]'), lambda x: trim(x)), lambda x: x <> '') AS keys FROM brackets
  UNION ALL
  SELECT doc_id, h, 'APA', s, s + length(h), list_filter(list_transform(string_split(h[2:-2], ';'), lambda x: trim(x)), lambda x: x <> '') FROM named)"""
_REF = q(parse.heading("References", True))
REFERENCES = rf"""
refbodies AS (SELECT doc_id, length(regexp_extract(full_text, {_REF}, 0)) AS body_at, substr(full_text, length(regexp_extract(full_text, {_REF}, 0)) + 1) AS body FROM manuscripts WHERE regexp_matches(full_text, {_REF})),
{HITS.format(name='brackets_', text='body', pattern=q(parse.LISTED['bracket']), table='refbodies')},
{HITS.format(name='dots_', text='body', pattern=q(parse.LISTED['dot']), table='refbodies')},
nums AS (SELECT doc_id, 0 AS how, s, CAST(regexp_extract(h, '\d+') AS INTEGER) AS num FROM brackets_ UNION ALL SELECT doc_id, 1, s, CAST(regexp_extract(h, '\d+') AS INTEGER) FROM dots_),
steps AS (SELECT *, lag(num) OVER w AS before, lead(s) OVER w AS nxt FROM nums WINDOW w AS (PARTITION BY doc_id, how ORDER BY s)),
good AS (SELECT doc_id, min(how) AS how FROM (SELECT doc_id, how FROM steps GROUP BY doc_id, how HAVING count(*) >= 2 AND count(*) FILTER (num > before) >= 0.85 * (count(*) - 1) AND arg_min(num, s) <= 3) GROUP BY doc_id),
loosecut AS (SELECT doc_id, body_at, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM (SELECT *, string_split(regexp_replace(body, '(\.)(\s+)([A-Z\[])', '\1\2␞\3', 'g'), '␞') AS a FROM refbodies WHERE doc_id NOT IN (SELECT doc_id FROM good))),
loose AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM loosecut),
refs AS (
  SELECT doc_id, num AS ref_index, trim(substr(body, s + 1, coalesce(nxt, length(body)) - s)) AS raw, CAST(body_at + s AS INTEGER) AS start_offset
  FROM steps JOIN good USING (doc_id, how) JOIN refbodies USING (doc_id) WHERE length(trim(substr(body, s + 1, coalesce(nxt, length(body)) - s))) > {parse.LEAST_ENTRY}
  UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER), trim(x), CAST(body_at + s AS INTEGER) FROM loose WHERE length(trim(x)) > {parse.LEAST_LOOSE})"""
_YEAR = q(rf"{T.B}((?:19|20)\d{{2}}[a-z]?){T.E}")
FIELDS = f"""
years AS (SELECT *, nullif(regexp_extract(raw, {_YEAR}, 1), '') AS year, nullif(regexp_extract(raw, '\\x22(.+?)\\x22', 1), '') AS quoted FROM refs),
afters AS (
  SELECT *, trim(regexp_extract(regexp_replace(substr(raw, instr(raw, coalesce(year, '')) + length(coalesce(year, ''))), '^[\\s.,:;)\\]}}]+', ''), '^([^.?]*)', 1)) AS plain,
    CASE WHEN year IS NULL THEN raw[1:80] ELSE regexp_replace(raw[1:instr(raw, year) - 1], '^(?:\\[\\d+\\]|\\d+\\.)\\s*', '') END AS head FROM years),
titled_ AS (SELECT *, coalesce(quoted, CASE WHEN year IS NOT NULL AND length(plain) > 8 THEN plain END) AS title FROM afters),
fields AS (
  SELECT doc_id, ref_index, raw, start_offset, year, title, nullif(trim(regexp_extract(substr(raw, instr(raw, title) + length(title)), {q(parse.VENUE)}, 1)), '') AS venue,
    list_filter(list_transform(string_split_regex(head, ',|&|;| and '), lambda x: trim(x)), lambda a: length(a) > 1 AND length(a) < 60 AND regexp_matches(a, '[A-Za-z]'))[1:6] AS authors,
    nullif(regexp_replace(regexp_extract(raw, '(10\\.\\d{{4,9}}/[^\\s\\x22<>]+)', 1), '[.,;)]+$', ''), '') AS doi
  FROM titled_)"""


@query(f"WITH {MANUSCRIPTS} SELECT doc_id, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS body_md5, CAST(ceil(length(full_text) / 3000.0) AS BIGINT) AS page_count, md5(full_text) AS full_md5 FROM manuscripts")
def s1_manuscripts(spark, sf_dir):
    m = manuscripts(spark, sf_dir)
    return m.select("doc_id", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"), F.ceil(F.length("full_text") / 3000.0).alias("page_count"), F.md5("full_text").alias("full_md5"))


@query(f"SELECT doc_id, md5({MATCH_SQL}) AS match_md5, md5(coalesce({MATCH_SQL}[1:80], '')) AS key_md5 FROM documents")
def f2_match_keys(spark, sf_dir):
    """Match normalisation (F2) and the key prefix for deduplication."""
    m = T.normalize_match("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(m).alias("match_md5"), F.md5(F.substring(m, 1, 80)).alias("key_md5"))


@query(f"WITH {MANUSCRIPTS}, {SENTENCES} SELECT * FROM sentences")
def p2_sentences(spark, sf_dir):
    return parse.sentences(manuscripts(spark, sf_dir))


@query(rf"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words, CAST(len(regexp_extract_all(text, '[.!?]')) AS INTEGER) AS n_stops,
  md5(CASE WHEN length(text) <= 60 THEN text ELSE text[1:59] || '…' END) AS clipped, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')[1:60], 'untitled') AS slug FROM documents""")
def f6_words_and_labels(spark, sf_dir):
    """Word count (F6), clipped text and slug."""
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("n_words"), T.count("text", "[.!?]").alias("n_stops"), F.md5(T.clip("text", 60)).alias("clipped"), T.slug("text").alias("slug"))


@query(r"""WITH c AS (SELECT page_id, url, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS cleaned FROM (SELECT page_id, url, regexp_replace(url, '[.,;:)\]]+$', '') AS u FROM pages)),
b AS (SELECT *, lower(url) AS x, lower(regexp_replace(cleaned, '^https?://(?:m\.|blog\.)?', '')) AS y FROM c),
g AS (SELECT *, list_transform(range(1, length(x)), lambda i: x[i:i + 1]) AS gx, list_transform(range(1, length(y)), lambda i: y[i:i + 1]) AS gy FROM b),
d AS (SELECT *, 2.0 * coalesce(list_sum(list_transform(list_distinct(gx), lambda t: least(len(list_filter(gx, lambda v: v = t)), len(list_filter(gy, lambda v: v = t))))), 0) / (len(gx) + len(gy)) AS dice, 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) AS ratio FROM g)
SELECT page_id, cleaned, round(CASE WHEN x = y THEN 1.0 ELSE dice END, 9) AS dice, round(ratio, 9) AS ratio,
  round(CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.85 + 0.15 * (least(length(x), length(y)) / greatest(length(x), length(y))) WHEN greatest(length(x), length(y)) < 120 THEN greatest(dice, ratio) ELSE dice END, 9) AS similarity FROM d""")
def f9_similarity(spark, sf_dir):
    """Dice on character pairs (F7), edit ratio (F8) and their combination (F9), of each page's URL and its cleaned form."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", T.clean_url("url").alias("cleaned"))
    pages = pages.withColumn("x", F.lower("url")).withColumn("y", F.lower(F.regexp_replace("cleaned", r"^https?://(?:m\.|blog\.)?", "")))
    return pages.select("page_id", "cleaned", F.round(T.dice("x", "y"), 9).alias("dice"), F.round(T.levenshtein_ratio("x", "y"), 9).alias("ratio"), F.round(T.similarity("x", "y"), 9).alias("similarity"))


@query(f"WITH {MANUSCRIPTS}, {_heads(True)} SELECT doc_id, name, start_offset, end_offset FROM sections")
def p1_sections(spark, sf_dir):
    return parse.sections(manuscripts(spark, sf_dir))


@query(f"WITH {MANUSCRIPTS}, {_heads(False)} SELECT doc_id, name, start_offset, end_offset FROM sections")
def p1_sections_anywhere(spark, sf_dir):
    return parse.sections(manuscripts(spark, sf_dir), strict=False)


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, {_heads(True)} SELECT t.doc_id, sentence_index, coalesce(s.name, 'Other') AS section, CAST(floor(t.start_offset / 3000.0) + 1 AS INTEGER) AS page FROM sentences t LEFT JOIN sections s ON t.doc_id = s.doc_id AND s.start_offset <= t.start_offset AND t.start_offset < s.end_offset")
def j8_sentence_sections(spark, sf_dir):
    """Each sentence's section (J8) and page."""
    m = manuscripts(spark, sf_dir)
    return parse.at_page(parse.at_section(parse.sentences(m), parse.sections(m))).select("doc_id", "sentence_index", "section", "page")


@query(f"WITH {MANUSCRIPTS}, {CITATIONS} SELECT * FROM citations")
def p4_citations(spark, sf_dir):
    return parse.citations(manuscripts(spark, sf_dir))


@query(rf"""WITH {MANUSCRIPTS}, c AS (
  SELECT doc_id, CAST(len(regexp_extract_all(full_text, '\[\d{{1,3}}\]')) AS INTEGER) AS ieee, CAST(len(regexp_extract_all(full_text, '\([A-Z][a-zA-Z-]+(?:\s+et\s+al\.)?,?\s*\d{{4}}[a-z]?\)')) AS INTEGER) AS apa,
    CAST(len(regexp_extract_all(full_text, '[A-Z][a-zA-Z-]+\s+\(\d{{4}}\)')) AS INTEGER) AS harvard,
    CAST(len(regexp_extract_all(CASE WHEN regexp_matches(full_text, {_REF}) THEN substr(full_text, length(regexp_extract(full_text, {_REF}, 1)) + 1) ELSE '' END, '\[\d+\]\s+[A-Z]')) AS INTEGER) AS numbered FROM manuscripts),
s AS (SELECT *, ieee * 2.0 + CASE WHEN numbered > 3 THEN 5 ELSE 0 END AS a, apa * 3.0 AS b, harvard * 2.0 AS h, CASE WHEN numbered > 3 AND ieee < 3 THEN numbered ELSE 0 END AS v FROM c)
SELECT doc_id, ieee, apa, harvard, numbered, CASE WHEN greatest(a, b, h, v) < 2 THEN 'unknown' WHEN a >= greatest(b, h, v) THEN 'IEEE' WHEN b >= greatest(h, v) THEN 'APA' WHEN h >= v THEN 'Harvard' ELSE 'Vancouver' END AS style FROM s""")
def p3_citation_style(spark, sf_dir):
    return parse.citation_style(manuscripts(spark, sf_dir))


@query(f"WITH {MANUSCRIPTS}, {REFERENCES} SELECT doc_id, ref_index, raw, start_offset FROM refs")
def p5_references(spark, sf_dir):
    return parse.references(manuscripts(spark, sf_dir))


@query(f"WITH {MANUSCRIPTS}, {REFERENCES}, {FIELDS} SELECT doc_id, ref_index, authors, year, title, venue, doi FROM fields")
def p6_reference_fields(spark, sf_dir):
    """Fields of a reference (P6), with its DOI."""
    return parse.reference_fields(parse.references(manuscripts(spark, sf_dir))).select("doc_id", "ref_index", "authors", "year", "title", "venue", "doi")


MAIN = f"mains AS (SELECT doc_id, CASE WHEN regexp_matches(full_text, {_REF}) THEN regexp_extract(full_text, {_REF}, 1) ELSE full_text END AS full_text FROM manuscripts)"
IN_TEXT = f"{MAIN}, {CITATIONS.replace('FROM manuscripts', 'FROM mains')}"


@query(f"WITH {MANUSCRIPTS}, {IN_TEXT}, {REFERENCES}, k AS (SELECT doc_id, CAST(unnest(keys) AS INTEGER) AS key FROM citations WHERE style = 'IEEE') SELECT doc_id, key FROM k WHERE doc_id IN (SELECT doc_id FROM refs) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = k.doc_id AND r.ref_index = k.key)")
def j6_broken_citations(spark, sf_dir):
    return parse.integrity(manuscripts(spark, sf_dir)).filter("kind = 'broken_citation'").select("doc_id", "key")


@query(rf"""WITH {MANUSCRIPTS}, {IN_TEXT}, {REFERENCES}, {FIELDS},
k AS (SELECT doc_id, style, unnest(keys) AS key FROM citations), f AS (SELECT *, lower(regexp_extract(authors[1], '^(\S+)', 1)) AS surname FROM fields)
SELECT doc_id, ref_index FROM f WHERE doc_id IN (SELECT doc_id FROM citations) AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND style = 'IEEE' AND CAST(key AS INTEGER) = f.ref_index)
  AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND style = 'APA' AND length(surname) > 2 AND contains(lower(key), surname))""")
def j7_orphan_references(spark, sf_dir):
    return parse.integrity(manuscripts(spark, sf_dir)).filter("kind = 'orphan_ref'").select("doc_id", F.col("key").alias("ref_index"))


def _parsed(spark, sf_dir):
    """All that parsing finds, in one row a document, written once for each application and folder."""
    return stored_once(f"parsed:{sf_dir}", lambda: parse.parsed(manuscripts(spark, sf_dir)), spark)


def _table(spark, sf_dir, name):
    return T.each(_parsed(spark, sf_dir), name, "doc_id").select("doc_id", "x.*")


@query(f"WITH {MANUSCRIPTS}, p AS (SELECT doc_id, length(full_text) AS n, unnest(range(0, greatest(1, CAST(ceil(length(full_text) / 3000.0) AS BIGINT)))) AS k FROM manuscripts) SELECT doc_id, CAST(k + 1 AS INTEGER) AS page, CAST(k * 3000 AS INTEGER) AS start_offset, CAST(least((k + 1) * 3000, n) AS INTEGER) AS end_offset FROM p")
def q1_pages(spark, sf_dir):
    """Pages, from the one parse of the corpus that all queries q1 read."""
    return _table(spark, sf_dir, "pages")


@query(f"WITH {MANUSCRIPTS}, {_heads(True)} SELECT doc_id, name, start_offset, end_offset FROM sections")
def q1_sections(spark, sf_dir):
    return _table(spark, sf_dir, "sections")


@query(f"WITH {MANUSCRIPTS}, {SENTENCES}, {_heads(True)} SELECT t.doc_id, CAST(t.sentence_index AS INTEGER) AS sentence_index, t.text, t.start_offset, t.end_offset, CAST(floor(t.start_offset / 3000.0) + 1 AS INTEGER) AS page, coalesce(s.name, 'Other') AS section FROM sentences t LEFT JOIN sections s ON t.doc_id = s.doc_id AND s.start_offset <= t.start_offset AND t.start_offset < s.end_offset")
def q1_sentences(spark, sf_dir):
    return _table(spark, sf_dir, "sentences")


@query(f"WITH {MANUSCRIPTS}, {CITATIONS} SELECT doc_id, marker, style, start_offset, end_offset, keys FROM citations")
def q1_citations(spark, sf_dir):
    return _table(spark, sf_dir, "citations")


@query(f"WITH {MANUSCRIPTS}, {REFERENCES}, {FIELDS} SELECT doc_id, ref_index, raw, start_offset, authors, year, title, venue, doi FROM fields")
def q1_references(spark, sf_dir):
    return parse.reference_fields(_table(spark, sf_dir, "references"))


@query(ORACLES["p3_citation_style"])
def q1_styles(spark, sf_dir):
    return parse.with_style(_parsed(spark, sf_dir).select("doc_id", "style_counts.*"))


PASSAGES = rf"""passages AS (SELECT item_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z0-9_])-\n([A-Za-z0-9_])', '\1\2', 'g'), '\n+', ' ', 'g'), '[ \t\x{{00a0}}]+', ' ', 'g'), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')) AS p FROM benchmark),
contained AS (SELECT doc_id, item_id, instr(lower(body), p) - 1 AS start_offset, instr(lower(body), p) - 1 + length(p) AS end_offset FROM docs JOIN passages ON contains(lower(body), p) WHERE length(p) >= 15)"""


def _overlap(spark, sf_dir):
    docs = bodies(spark, sf_dir)
    return docs, overlap.contained(docs, read(spark, sf_dir, "benchmark").select("item_id", T.normalize_layout("text").alias("passage")))


@query(f"WITH {MANUSCRIPTS}, {PASSAGES} SELECT doc_id, item_id, CAST(start_offset AS INTEGER) AS start_offset, CAST(end_offset AS INTEGER) AS end_offset FROM contained")
def j3_contained_passages(spark, sf_dir):
    return _overlap(spark, sf_dir)[1]


@query(f"""WITH {MANUSCRIPTS}, {PASSAGES},
r AS (SELECT *, coalesce(max(end_offset) OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM contained),
s AS (SELECT doc_id, count(*) AS n_hits, CAST(sum(greatest(0, end_offset - greatest(start_offset, reach))) AS BIGINT) AS covered FROM r GROUP BY doc_id)
SELECT doc_id, n_hits, covered, round(100.0 * covered / length(body), 4) AS covered_pct FROM s JOIN docs USING (doc_id)""")
def q21_source_overlap(spark, sf_dir):
    """How much of each document is covered by passages of the source set."""
    docs, hits = _overlap(spark, sf_dir)
    return overlap.coverage(hits, docs)
