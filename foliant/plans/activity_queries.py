"""Queries over events and edits: quotas, sessions, latest status, repeated requests, applied edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import edits, parse
from foliant.plans.claim_queries import LOCATED, QUALITY
from foliant.plans.parse_queries import MANUSCRIPTS, SENTENCES, q, read
from foliant.operators import claims
from foliant.sources.manuscripts import manuscripts
from foliant.streaming import activity

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark, sf_dir):
    """Events as requests: tokens from the value, a finding and a generation from the id."""
    e = read(spark, sf_dir, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL")
    return e.select("event_id", "ts", "user_id", F.floor(F.abs("value") * 100).cast("long").alias("tokens"), (F.col("event_id") % 500).alias("finding_id"), F.floor(F.col("event_id") / 5000).alias("generation"), F.col("event_type").alias("status"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("request"))


E = "e AS (SELECT event_id, ts, user_id, CAST(floor(abs(value) * 100) AS BIGINT) AS tokens, event_id % 500 AS finding_id, CAST(floor(event_id / 5000) AS BIGINT) AS generation, event_type AS status, user_id || ':' || event_type AS request FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


@query(f"WITH {E} SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests, sum(tokens) >= 50000 OR count(*) >= 40 AS over FROM e GROUP BY ALL")
def q20_usage_report(spark, sf_dir):
    """Daily usage (A32, F23); the batch form of T1."""
    return activity.daily_usage(events(spark, sf_dir))


@query(f"WITH {E} SELECT event_id, coalesce(sum(tokens) OVER w, 0) < 20000 AND count(*) OVER w < 3 AS allowed FROM e WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def a32_admitted_requests(spark, sf_dir):
    """Each request against what the day's earlier ones left."""
    return activity.admitted(events(spark, sf_dir), 20_000, 3).select("event_id", "allowed")


@query(f"""WITH {E}, g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 10 MINUTE AS purged_at, count(*) AS events FROM s GROUP BY user_id, k""")
def t2_idle_sessions(spark, sf_dir):
    return activity.sessions(events(spark, sf_dir))


@query(f"WITH {E} SELECT finding_id, generation, ts, status FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY generation DESC, ts DESC, event_id DESC) AS n FROM e) WHERE n = 1")
def t3_latest_status(spark, sf_dir):
    """Latest status of each finding, of the newest generation."""
    return activity.latest(events(spark, sf_dir))


@query(f"WITH {E} SELECT request, slot, event_id FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS slot, row_number() OVER (PARTITION BY request, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) AS n FROM e) WHERE n = 1")
def t4_first_requests(spark, sf_dir):
    return activity.first_requests(events(spark, sf_dir))


@query(f"""WITH RECURSIVE {E}, opens(request, ts) AS (SELECT request, min(ts) FROM e GROUP BY request UNION ALL SELECT o.request, min(e.ts) FROM opens o JOIN e ON e.request = o.request AND e.ts > o.ts + INTERVAL 6 HOUR GROUP BY o.request, o.ts),
w AS (SELECT e.request, e.event_id, e.ts, max(o.ts) AS opened FROM e JOIN opens o ON o.request = e.request AND o.ts <= e.ts GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY request, opened ORDER BY ts, event_id) > 1 AS reused FROM w""")
def t4_reuse_windows(spark, sf_dir):
    """Which requests an earlier identical one answers, within six hours of the one that opened the window (T4)."""
    return activity.reuse_windows(events(spark, sf_dir))


def _marks(t: str) -> str:
    return f"list_concat(list_concat(regexp_extract_all({t}, {q(parse.BRACKET)}), regexp_extract_all({t}, {q(parse.AUTHOR_YEAR)})), regexp_extract_all({t}, {q(parse.YEAR_ALONE)}))"


_KEYS = "list_filter(list_transform(CASE WHEN starts_with({m}, '[') THEN string_split_regex({m}[2:-2], '[,–-]') WHEN starts_with({m}, '(') THEN string_split({m}[2:-2], ';') ELSE [{m}] END, lambda k: lower(trim(k))), lambda k: k <> '')"


@query(rf"""WITH {MANUSCRIPTS}, p AS (SELECT doc_id, full_text AS a, regexp_replace(replace(replace(full_text, '[2, 9]', '[2] [3]'), '(Smith et al., 2015)', ''), '\[3\]', '', 'g') AS b FROM manuscripts),
bm AS (SELECT doc_id, unnest(list_distinct({_marks('a')})) AS m FROM p), ak AS (SELECT doc_id, unnest({_KEYS.format(m='m')}) AS k FROM (SELECT doc_id, unnest({_marks('b')}) AS m FROM p)),
lost AS (SELECT doc_id, count(*) AS n FROM bm WHERE NOT EXISTS (SELECT 1 FROM ak WHERE ak.doc_id = bm.doc_id AND list_contains({_KEYS.format(m='bm.m')}, ak.k)) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_lost FROM p LEFT JOIN lost USING (doc_id)""")
def f11_lost_citations(spark, sf_dir):
    """Markers (F10) that a rewrite of the whole text drops."""
    m = manuscripts(spark, sf_dir)
    after = F.regexp_replace(F.replace(F.replace("full_text", F.lit("[2, 9]"), F.lit("[2] [3]")), F.lit("(Smith et al., 2015)"), F.lit("")), r"\[3\]", "")
    return m.withColumn("after", after).select("doc_id", F.size(edits.lost_markers("full_text", "after")).alias("n_lost"))


_TOK = "list_filter(list_transform(list_concat(" + ", ".join([*[f"regexp_extract_all(a, {q(p)}, {1 if '((' in p else 0})" for p in edits.PROTECTED], f"list_distinct({_marks('a')})"]) + "), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH {MANUSCRIPTS}, p AS (SELECT doc_id, full_text AS a, replace(full_text, '9', '') AS b FROM manuscripts), t AS (SELECT doc_id, b, unnest(list_distinct({_TOK})) AS x FROM p) SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(count(*) FILTER (NOT contains(b, x)) AS INTEGER) AS n_missing FROM t GROUP BY doc_id")
def f12_missing_tokens(spark, sf_dir):
    """Protected tokens of each kind, and those that a rewrite lost."""
    m = manuscripts(spark, sf_dir).withColumn("after", F.replace("full_text", F.lit("9"), F.lit("")))
    return m.select("doc_id", F.size(edits.protected_tokens("full_text")).alias("n_tokens"), F.size(edits.missing_tokens("full_text", "after")).alias("n_missing"))


@query(rf"""WITH {LOCATED}, {QUALITY}, ed AS (SELECT doc_id, start_offset AS s, end_offset AS e, '<' || label || '>' AS r FROM quality JOIN located USING (doc_id, sentence_index)),
o AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prior FROM ed),
f AS (SELECT doc_id, string_agg(substr(full_text, prior + 1, s - prior) || r, '' ORDER BY s) AS head, max(e) AS e, count(*) AS n FROM o JOIN manuscripts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, md5(coalesce(head, '') || substr(full_text, coalesce(e, 0) + 1)) AS revised_md5, CAST(coalesce(n, 0) AS INTEGER) AS applied, 0 AS skipped FROM manuscripts LEFT JOIN f USING (doc_id)""")
def q5_apply_edits(spark, sf_dir):
    """Each flagged sentence replaced by its label."""
    m, changes = _edits(spark, sf_dir)
    out = edits.apply_edits(m, changes)
    return out.select("doc_id", F.md5("revised").alias("revised_md5"), "applied", "skipped")


def _edits(spark, sf_dir):
    m = manuscripts(spark, sf_dir)
    changes = claims.quality(claims.located(m, claims.QUALITY_CUE), keep=("start_offset", "end_offset"))
    return m, changes.select("doc_id", F.col("sentence_index").alias("edit_id"), "start_offset", "end_offset", F.concat(F.lit("<"), "label", F.lit(">")).alias("replacement"))


_MOVES = f"{LOCATED}, {QUALITY}, ed AS (SELECT doc_id, sentence_index AS edit_id, start_offset AS s, end_offset AS e, '<' || label || '>' AS r FROM quality JOIN located USING (doc_id, sentence_index)), mv AS (SELECT *, coalesce(sum(length(r) - (e - s)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM ed)"


@query(f"WITH {_MOVES} SELECT doc_id, edit_id, s AS start_offset, e AS end_offset, CAST(s + d AS INTEGER) AS new_start, CAST(s + d + length(r) AS INTEGER) AS new_end, r AS replacement FROM mv")
def q5_applied_spans(spark, sf_dir):
    """Where each applied edit stands in the revised text."""
    m, changes = _edits(spark, sf_dir)
    return edits.applied_spans(m, changes)


@query(f"WITH {_MOVES} SELECT l.doc_id, l.sentence_index, l.start_offset, l.end_offset, CASE WHEN t.s IS NULL THEN CAST(l.start_offset + coalesce((SELECT sum(length(r) - (e - s)) FROM ed WHERE ed.doc_id = l.doc_id AND ed.e <= l.start_offset), 0) AS INTEGER) END AS new_start, CASE WHEN t.s IS NULL THEN CAST(l.end_offset + coalesce((SELECT sum(length(r) - (e - s)) FROM ed WHERE ed.doc_id = l.doc_id AND ed.e <= l.start_offset), 0) AS INTEGER) END AS new_end FROM located l LEFT JOIN ed t ON t.doc_id = l.doc_id AND t.s = l.start_offset")
def q5_mapped_sentences(spark, sf_dir):
    """Every sentence's place in the revised text; null for those that an edit changed."""
    m, changes = _edits(spark, sf_dir)
    return edits.mapped_spans(parse.sentences(m).select("doc_id", "sentence_index", "start_offset", "end_offset"), m, changes)


@query(f"""WITH {LOCATED}, {QUALITY}, ed AS (SELECT doc_id, start_offset AS s, end_offset AS e FROM quality JOIN located USING (doc_id, sentence_index)),
b AS (SELECT doc_id, 0 AS x FROM manuscripts UNION ALL SELECT doc_id, s FROM ed UNION ALL SELECT doc_id, e FROM ed), n AS (SELECT doc_id, x AS start_offset, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY x), length(full_text)) AS end_offset FROM b JOIN manuscripts USING (doc_id))
SELECT n.doc_id, CAST(start_offset AS INTEGER) AS start_offset, CAST(end_offset AS INTEGER) AS end_offset, ed.s IS NOT NULL AS marked FROM n LEFT JOIN ed ON ed.doc_id = n.doc_id AND ed.s = n.start_offset WHERE end_offset > start_offset""")
def w8_segments(spark, sf_dir):
    m = manuscripts(spark, sf_dir)
    return edits.gaps(claims.quality(claims.located(m, claims.QUALITY_CUE), keep=("start_offset", "end_offset")), m)
