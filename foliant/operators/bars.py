"""Readiness in full: facts of a manuscript, 24 factors on three bars, checklist, gaps, venues; submission checks and what a venue asks beyond them.

Rules are rows of (name, expressions over the columns of ``facts``), one row of
facts a document; each document's rules are one array that is exploded where the
document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import parse

# Baselines, factors (name, when it counts, what it adds to the bars Q1, Q2 and IEEE), checklist, gaps (name, severity, when).
BASE = {"q1": 58.0, "q2": 66.0, "ieee": 55.0}
CORE = "(CAST(has_abstract AS INT) + CAST(has_intro AS INT) + CAST(has_methods AS INT) + CAST(has_results AS INT) + CAST(has_refs AS INT))"
MISSING = "(4 - CAST(has_abstract AS INT) - CAST(has_intro AS INT) - CAST(has_methods AS INT) - CAST(s_references AS INT))"
FACTORS = [
    ("structure-core", f"{CORE} > 0", f"{CORE} * 4", f"{CORE} * 3.2", "CAST(has_methods AS INT) * 4 + CAST(has_results AS INT) * 2 + CAST(has_abstract AS INT)"),
    ("structure-conclusion", "has_conclusion", "2", "2", "1"),
    ("structure-missing", f"{MISSING} > 0", f"{MISSING} * -8", f"{MISSING} * -5", "CASE WHEN has_methods THEN -2 ELSE -10 END"),
    ("structure-results", "NOT has_results", "-6", "-4", "-3"),
    ("novelty", "novelty > 0", "least(novelty, 4) * -4", "least(novelty, 4) * -2", "least(novelty, 4) * -3"),
    ("numerical-inconsistency", "inconsistent > 0", "least(inconsistent, 4) * -6", "least(inconsistent, 4) * -3.5", "least(inconsistent, 4) * -5"),
    ("numerical-ambiguity", "ambiguous > 0", "least(ambiguous, 5) * -3", "least(ambiguous, 5) * -1.5", "least(ambiguous, 5) * -3.5"),
    ("pub-craft", "craft > 0", "least(craft, 5) * -2.5", "least(craft, 5) * -1.5", "least(craft, 5) * -3"),
    ("citations", "citations > 0", "-least(22, citations * 3)", "-least(14, citations * 2)", "-least(14, citations * 2.5)"),
    ("grammar", "grammar > 8", "-least(14, (grammar - 8) * 1.2)", "-least(8, (grammar - 8) * 0.8)", "-least(10, grammar - 8)"),
    ("ai", "ai > 0", "least(ai, 5) * -5", "least(ai, 5) * -3", "least(ai, 5) * -4"),
    ("similarity", "overlap > 0", "least(overlap, 6) * -4", "least(overlap, 6) * -2.5", "least(overlap, 6) * -2"),
    ("sim-pct", "sim_pct > 25", "-6", "-3", "-2"),
    ("ai-pct", "ai_pct > 30", "-6", "-3", "-5"),
    ("ieee-style", "style = 'IEEE'", "1", "1", "8"),
    ("ieee-style-miss", "style <> 'IEEE'", "0", "0", "-5"),
    ("refs-dense", "ref_count >= 25", "3", "2", "5"),
    ("refs-ok", "ref_count >= 15 AND ref_count < 25", "2", "1", "3"),
    ("refs-thin", "ref_count > 0 AND ref_count < 10 AND has_methods", "-3", "-2", "-4"),
    ("in-text-cites", "cite_count >= 20", "2", "1", "3"),
    ("length-ok", "words >= 3500 AND words <= 12000", "2", "2", "1"),
    ("quality-clean", "quality = 0 AND inconsistent = 0", "5", "4", "4"),
    ("local-model", "q1_boost IS NOT NULL", "q1_boost", "q2_boost", "ieee_boost"),
]
FLOOR = "q2-floor"  # the 24th: Q2 is kept at least 4 above Q1
CHECKLIST = [
    ("imrad_core", "has_abstract AND has_intro AND has_methods AND has_results AND has_refs"), ("novelty_claims", "novelty = 0"), ("numerical_clarity", "ambiguous = 0"), ("numerical_consistency", "inconsistent = 0"), ("publication_craft", "craft = 0"),
    ("citation_hygiene", "citations = 0"), ("grammar_load", "grammar <= 8"), ("ai_similarity", "ai = 0 AND overlap = 0"), ("ieee_markers", "style = 'IEEE' AND has_methods AND ref_count >= 15"),
]
GAPS = [
    ("section-Abstract", "'high'", "NOT has_abstract"), ("section-Introduction", "'medium'", "NOT has_intro"), ("section-Methods", "'high'", "NOT has_methods"), ("section-Results", "'medium'", "NOT has_results"), ("section-Discussion", "'medium'", "NOT has_results"),
    ("section-Conclusion", "'medium'", "NOT has_conclusion"), ("section-References", "'high'", "NOT s_references"), ("novelty", "'high'", "novelty > 0"), ("numerical-inconsistency", "'high'", "inconsistent > 0"), ("numerical", "'high'", "ambiguous > 0"), ("pub-craft", "'medium'", "craft > 0"),
    ("citations", "CASE WHEN citations >= 5 THEN 'high' ELSE 'medium' END", "citations > 0"), ("grammar", "CASE WHEN grammar > 25 THEN 'high' ELSE 'medium' END", "grammar > 8"), ("grammar-light", "'low'", "grammar > 0 AND grammar <= 8"), ("ai", "'high'", "ai > 0"),
    ("similarity", "CASE WHEN overlap >= 5 THEN 'high' ELSE 'medium' END", "overlap > 0"), ("ieee-style", "'low'", "style <> 'IEEE'"), ("refs-thin", "'medium'", "has_methods AND ref_count < 10"), ("length-short", "'low'", "words > 0 AND words < 2500"),
]
SEVERITIES = ["high", "medium", "low"]
#: Counts of open findings, each by its condition.
COUNTS = {
    "quality": "kind = 'manuscript_quality' AND category <> 'numerical_inconsistency'", "novelty": "category = 'novelty_issue'", "ambiguous": "category = 'numerical_ambiguity'", "inconsistent": "category = 'numerical_inconsistency'", "craft": "category = 'publication_issue'",
    "citations": "kind IN ('citation_need', 'orphan_ref', 'broken_citation') OR category IN ('needs_new_citation', 'missing_in_text_citation', 'needs_citation_claim')", "grammar": "kind = 'grammar'", "ai": "kind = 'ai' OR category = 'ai_flagged'",
    "overlap": "kind = 'similarity' AND category IN ('needs_restatement', 'needs_new_citation', 'missing_in_text_citation', 'review_manually')",
}
HEADS = ["selective_ready", "structure_ok", "numerical_clear", "novelty_ok", "methods_concrete", "ieee_craft"]
# What three archetypes of journal expect.
PROFILES = {
    "ieee": {"abstract": (100, 250), "keywords": (3, 8), "refs": (15, 120), "title": 20, "numeric": True}, "elsevier": {"abstract": (100, 300), "keywords": (3, 7), "refs": (20, 150), "title": 25, "numeric": False},
    "generic": {"abstract": (100, 350), "keywords": (3, 8), "refs": (10, 200), "title": 30, "numeric": False},
}
KEYWORDS = r"(?i)(?:keywords|key words|index terms)\s*[:—–-]\s*([^\n]{3,400})"
HIGHLIGHTS, STRUCTURED = r"(?i)(?:^|\n)\s*highlights?\s*[:\n]", r"(?i)(?:^|[^A-Za-z0-9_])(?:background|objective|methods?|results?|conclusions?)\s*:"
VENUES_LEAST, VENUES_MOST = 8, 15


def keywords(text="full_text") -> Column:
    """At most 20 keywords of the line that names them in the first 6000 characters."""
    line = F.regexp_extract(F.substring(text, 1, 6000), KEYWORDS, 1)
    parts = F.transform(F.split(line, "[;,·]"), lambda k: F.regexp_replace(F.trim(k), r"\.$", ""))
    return F.slice(F.filter(parts, lambda k: (F.length(k) > 1) & (F.length(k) < 80)), 1, 20)


def facts(docs: DataFrame, found: DataFrame, boosts: DataFrame | None = None, text: str = "full_text") -> DataFrame:
    """One row a document: sections, style, counts of references, citations, words and open findings.

    docs: (doc_id, full_text, title, sim_pct, ai_pct). found: (doc_id, kind, category, status, is_informational).
    """
    rows = parse.with_sections(docs, True, text)
    names = F.transform("_sections", lambda s: s["name"])
    has = lambda n: F.array_contains(names, n)
    abstract = F.get(F.filter("_sections", lambda s: s["name"] == "Abstract"), F.lit(0))
    abstract_text = F.substring(text, abstract["start_offset"] + 1, abstract["end_offset"] - abstract["start_offset"])
    lead = F.when(abstract.isNotNull(), F.substring(abstract_text, 1, 1200)).otherwise(F.substring(text, 1, 1500))
    rows = rows.select(
        "doc_id", "title", "sim_pct", "ai_pct", has("Abstract").alias("has_abstract"), has("Introduction").alias("has_intro"), has("Methods").alias("has_methods"), (has("Results") | has("Discussion")).alias("has_results"), has("Conclusion").alias("has_conclusion"), has("References").alias("s_references"),
        (T.count(text, parse.BRACKET) + T.count(text, parse.AUTHOR_YEAR)).alias("cite_count"), T.word_count(text).alias("words"), F.lower(F.concat("title", F.lit("\n"), lead)).alias("lead"), F.when(abstract.isNotNull(), T.word_count(abstract_text)).alias("abstract_words"),
        F.size(keywords(text)).alias("n_keywords"), F.when(abstract.isNotNull(), abstract_text.rlike(STRUCTURED)).alias("structured"), F.substring(text, 1, 8000).rlike(HIGHLIGHTS).alias("highlights"), T.word_count("title").alias("title_words"),
    )
    style = parse.citation_style(docs, text).select("doc_id", "style")
    refs = parse.references(docs.select("doc_id", text), text).groupBy("doc_id").agg(F.count("*").cast("int").alias("ref_count"))
    open_ = found.filter("status = 'open' AND NOT is_informational")
    counts = open_.groupBy("doc_id").agg(*[F.expr(f"CAST(count_if({c}) AS INT)").alias(k) for k, c in COUNTS.items()])
    rows = rows.join(style.hint("merge"), "doc_id").join(refs.hint("merge"), "doc_id", "left").join(counts.hint("merge"), "doc_id", "left").fillna(0, ["ref_count", *COUNTS])
    rows = rows.withColumn("has_refs", F.col("s_references") | (F.col("ref_count") > 0))
    if boosts is None:
        return rows.withColumns({f"{b}_boost": F.lit(None).cast("int") for b in BASE})
    return rows.join(boosts.hint("merge"), "doc_id", "left")


def model_boosts(probs: DataFrame) -> DataFrame:
    """(doc_id, q1_boost, q2_boost, ieee_boost) from ``probs``, a map of head to probability (0.5 where one is missing); bounded, halves up."""
    p = {h: F.coalesce(F.col("probs")[h], F.lit(0.5)) for h in HEADS}
    craft = (p["structure_ok"] + p["numerical_clear"] + p["novelty_ok"] + p["methods_concrete"]) / 4
    half = lambda x: T.half_up(F.round(x, 9))
    q1, q2 = half((p["selective_ready"] - 0.5) * 18 + (craft - 0.5) * 10), half((p["selective_ready"] - 0.5) * 10 + (craft - 0.5) * 8)
    ieee = half((p["ieee_craft"] - 0.5) * 16 + (p["methods_concrete"] - 0.5) * 6 + (p["numerical_clear"] - 0.5) * 4)
    bound = lambda x, b: F.greatest(F.lit(-b), F.least(F.lit(b), x)).cast("int")
    return probs.select("doc_id", bound(q1, 12).alias("q1_boost"), bound(q2, 10).alias("q2_boost"), bound(ieee, 12).alias("ieee_boost"))


def _rules(rows: DataFrame, rules: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """(doc_id, k, the names): a row for each rule whose first column, the condition, holds."""
    items = [F.when(c[0], F.struct(F.lit(k).alias("k"), F.lit(name).alias(names[0]), *[v.alias(n) for v, n in zip(c[1:], names[1:], strict=True)])) for k, (name, c) in enumerate(rules.items())]
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*items))).alias("x")).select("doc_id", "x.*")


def with_factors(rows: DataFrame) -> DataFrame:
    """Adds ``factors``, array of (factor, q1, q2, ieee): what adds to and takes from the bars; factors that move nothing are left out."""
    double = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    items = [F.when(F.expr(when), F.struct(F.lit(name).alias("factor"), double(a).alias("q1"), double(b).alias("q2"), double(c).alias("ieee"))) for name, when, a, b, c in FACTORS]
    rows = rows.withColumn("_f", F.filter(F.array_compact(F.array(*items)), lambda x: (x["q1"] != 0) | (x["q2"] != 0) | (x["ieee"] != 0)))
    total = lambda k: F.aggregate("_f", F.lit(BASE[k]), lambda s, x: s + x[k])
    lift = F.round(total("q1") + 4 - total("q2"), 9)
    floor = F.when(lift > 0, F.array(F.struct(F.lit(FLOOR).alias("factor"), F.lit(0.0).alias("q1"), lift.alias("q2"), F.lit(0.0).alias("ieee"))))
    return rows.withColumn("factors", F.when(lift > 0, F.concat("_f", floor)).otherwise(F.col("_f"))).drop("_f")


def scores(rows: DataFrame) -> DataFrame:
    """Adds q1_score, q2_score and ieee_score to rows with factors: baselines and factors, 0 to 100, halves up."""
    total = lambda k: F.round(F.aggregate("factors", F.lit(BASE[k]), lambda s, x: s + x[k]), 6)
    return rows.withColumns({f"{k}_score": T.half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total(k)))).cast("int") for k in BASE})


def breakdown(rows: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, factor, weight, position): a document's weightiest factors, by the sum of what they move; of equals the first."""
    weigh = F.transform("factors", lambda x, i: F.struct((-F.round(F.abs(x["q1"]) + F.abs(x["q2"]) + F.abs(x["ieee"]), 6)).alias("w"), i.alias("i"), x["factor"].alias("factor")))
    best = F.slice(F.array_sort(weigh), 1, most)
    return rows.select("doc_id", F.posexplode(best).alias("p", "x")).select("doc_id", "x.factor", (-F.col("x.w")).alias("weight"), (F.col("p") + 1).alias("position"))


def checklist(rows: DataFrame) -> DataFrame:
    """(doc_id, item, passed): the nine items."""
    return _rules(rows, {n: [F.lit(True), F.expr(e)] for n, e in CHECKLIST}, ["item", "passed"]).drop("k")


def gaps(rows: DataFrame) -> DataFrame:
    """(doc_id, gap, severity, position): what to mend, high before medium before low."""
    found = _rules(rows, {n: [F.expr(when), F.expr(severity)] for n, severity, when in GAPS}, ["gap", "severity"])
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return found.select("doc_id", "gap", "severity", F.row_number().over(W.partitionBy("doc_id").orderBy(rank, "k")).alias("position"))


def summary(scored: DataFrame, found: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, q1, q2, ieee, gaps, tier, fields): the three bars, gaps that are not low, and which of three tiers that is."""
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") != "low").cast("int").alias("gaps"))
    guess = fields.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "field"))), lambda x: x["field"]), ", ").alias("fields"))
    rows = scored.select("doc_id", F.col("q1_score").alias("q1"), F.col("q2_score").alias("q2"), F.col("ieee_score").alias("ieee")).join(counts.hint("merge"), "doc_id", "left").fillna(0, ["gaps"]).join(guess.hint("merge"), "doc_id", "left")
    return rows.withColumn("tier", F.when((F.col("q1") >= 72) & (F.col("gaps") <= 2), "strong").when(F.col("q2") >= 60, "closer").otherwise("developing"))


def catalog_array(catalog: list[dict]) -> Column:
    """A catalogue of venues (venue, keywords, fields, ieee, open_access, format) as one literal: a table of a few hundred rows at most, an error beyond 2000."""
    if len(catalog) > 2000:
        raise ValueError("a catalogue of over 2000 venues is no dimension table; join it")
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array(*[F.struct(F.lit(v["venue"]).alias("venue"), texts(v["keywords"]).alias("keywords"), texts(v["fields"]).alias("fields"), F.lit(v["ieee"]).alias("ieee"), F.lit(v["open_access"]).alias("open_access"), F.lit(v["format"]).alias("format")) for v in catalog])


def venues(scored: DataFrame, fields: DataFrame, catalog: list[dict]) -> DataFrame:
    """(doc_id, venue, score, position, confidence, boost, matched): 8 to 15 venues of a catalogue for each document.

    2 a keyword in the lead, 3 a shared field, 2 for IEEE, 1 for open access, 1 for
    general, 1 always, and what the format adds for short or uneven manuscripts.
    Venues with a keyword or 5 points are the pool if they are 8 or more, else all.
    """
    mine = fields.groupBy("doc_id").agg(F.sort_array(F.collect_set("field")).alias("mine"))
    missing = F.expr(f"{MISSING} + CASE WHEN has_results THEN 0 ELSE 1 END")
    rows = scored.join(mine.hint("merge"), "doc_id").withColumns({
        "ieee_lean": (F.col("style") == "IEEE") | (F.col("ieee_score") >= 70), "open_lean": (F.col("words") < 4000) | ~F.col("has_conclusion"), "weak": ~F.col("has_methods") | (F.col("craft") > 0), "short": (F.col("words") > 0) & (F.col("words") < 3500), "holes": missing,
        "letters": (~F.col("has_methods") & F.col("has_results")) | ((F.col("words") > 0) & (F.col("words") < 2500)), "catalog": catalog_array(catalog),
    })

    def boost(fmt):
        light = F.col("letters") | F.col("short") | F.col("weak")
        return (
            F.when(light & fmt.isin("letter", "communication"), 4).when(light & fmt.isin("access_oa", "preprint"), 2).when(light & (fmt == "full_article") & (F.col("holes") >= 2), -2)
            .when(F.col("open_lean") & fmt.isin("access_oa", "preprint"), 1).otherwise(0)
        )

    def score(v):
        matched = F.filter(v["keywords"], lambda k: F.contains("lead", k))
        shared = F.size(F.array_intersect(v["fields"], "mine"))
        general = F.array_contains("mine", "general") & F.array_contains(v["fields"], "general")
        points = F.size(matched) * 2 + shared * 3 + (F.col("ieee_lean") & v["ieee"]).cast("int") * 2 + (F.col("open_lean") & v["open_access"]).cast("int") + general.cast("int") + 1 + boost(v["format"])
        sure = (points >= 10) & (F.size(matched) >= 2) & ((shared > 0) | (F.size(matched) >= 3))
        return F.struct((-points).alias("s"), v["venue"].alias("venue"), F.when(sure, "medium").otherwise("low").alias("confidence"), boost(v["format"]).alias("boost"), F.slice(matched, 1, 8).alias("matched"))

    ranked = rows.select("doc_id", F.array_sort(F.transform("catalog", score)).alias("r"))
    topical = F.filter("r", lambda x: (F.size(x["matched"]) > 0) | (x["s"] <= -5))
    pool = F.when(F.size(topical) >= VENUES_LEAST, topical).otherwise(F.col("r"))
    return ranked.select("doc_id", F.posexplode(F.slice(pool, 1, VENUES_MOST)).alias("p", "x")).select("doc_id", "x.venue", (-F.col("x.s")).alias("score"), (F.col("p") + 1).alias("position"), "x.confidence", "x.boost", "x.matched")


def merged_venues(own: DataFrame, others: DataFrame, most: int = VENUES_MOST) -> DataFrame:
    """(doc_id, venue, origin, position): suggested venues, then others' (doc_id, venue, position) that are not among them by lower-case name, the first of equals; ``most`` in all."""
    rows = own.select("doc_id", "venue", F.lit("heuristic").alias("origin"), F.lit(0).alias("o"), "position").unionByName(others.select("doc_id", "venue", F.lit("other").alias("origin"), F.lit(1).alias("o"), "position"))
    first = F.row_number().over(W.partitionBy("doc_id", F.lower("venue")).orderBy("o", "position"))
    rows = rows.withColumn("_n", first).filter((F.col("_n") == 1) | (F.col("o") == 0))
    return rows.select("doc_id", "venue", "origin", F.row_number().over(W.partitionBy("doc_id").orderBy("o", "position")).alias("position")).filter(F.col("position") <= most)


def find_venue(queries: DataFrame, requirements: list[dict]) -> DataFrame:
    """(query_id, venue_id): of a small list of venues (id, label) the first that a name means: equal label or id, else contained."""
    q = F.lower(F.trim("name"))
    arr = F.array(*[F.struct(F.lit(v["id"]).alias("id"), F.lit(v["label"].lower()).alias("label")) for v in requirements])
    exact = F.filter(arr, lambda v: (v["label"] == q) | (v["id"] == q))
    loose = F.filter(arr, lambda v: F.contains(v["label"], q) | F.contains(q, F.substring(v["label"], 1, 18)) | F.contains(v["id"], F.regexp_replace(q, r"\s+", "-")))
    found = F.coalesce(F.get(exact, F.lit(0)), F.get(loose, F.lit(0)))
    return queries.select("query_id", F.when(q != "", found["id"]).alias("venue_id"))


def submission(rows: DataFrame, profile: str) -> DataFrame:
    """(doc_id, profile, item, status): pass, warn or fail of each check of an archetype. ``rows``: facts with ``callout_gaps``."""
    p = PROFILES[profile]
    inside = lambda c, b: (F.col(c) >= b[0]) & (F.col(c) <= b[1])
    ok = lambda c, no="warn": F.when(c, "pass").otherwise(no)
    core = F.expr(f"{MISSING} + CASE WHEN has_results THEN 0 ELSE 1 END")
    items = {
        "abstract": F.when(F.col("abstract_words").isNull(), "fail").otherwise(ok(inside("abstract_words", p["abstract"]))), "keywords": ok(inside("n_keywords", p["keywords"])), "sections": F.when(core == 0, "pass").when(core == 1, "warn").otherwise("fail"), "conclusion": ok(F.col("has_conclusion")),
        "refcount": F.when(F.col("ref_count") == 0, "fail").otherwise(ok(inside("ref_count", p["refs"]))), "callouts": ok(F.col("callout_gaps") == 0),
    }
    if p["numeric"]:
        items["citestyle"] = ok(F.col("style") == "IEEE")
    items["title"] = F.when(F.col("title_words") > 0, ok(F.col("title_words") <= p["title"]))
    listed = F.array(*[F.struct(F.lit(k).alias("item"), v.alias("status")) for k, v in items.items()])
    return rows.select("doc_id", F.lit(profile).alias("profile"), F.explode(listed).alias("x")).select("doc_id", "profile", "x.*").filter(F.col("status").isNotNull())


def requirements_delta(rows: DataFrame, venue: dict) -> DataFrame:
    """(doc_id, venue, item, status): the archetype's checks and what one venue asks beyond them; also ``cant_check``. ``rows``: facts with callout_gaps, conflict and data (status of those statements)."""
    base = submission(rows, venue["archetype"]).select("doc_id", F.lit(venue["id"]).alias("venue"), F.concat(F.lit("base-"), "item").alias("item"), "status")
    ok = lambda c, no="warn": F.when(c, "pass").otherwise(no)
    items: dict[str, Column] = {}
    if venue.get("abstract"):
        low, high = venue["abstract"]
        items["abs-limit"] = F.when(F.col("abstract_words").isNull(), "fail").otherwise(ok((F.col("abstract_words") >= low) & (F.col("abstract_words") <= high), "fail"))
    if venue.get("structured"):
        items["abs-struct"] = F.when(F.col("structured").isNull(), "fail").otherwise(ok(F.col("structured")))
    if venue.get("keywords"):
        low, high = venue["keywords"]
        items["kw"] = ok((F.col("n_keywords") > 0) & (F.col("n_keywords") >= low) & (F.col("n_keywords") <= high))
    if venue.get("numeric"):
        items["cite-num"] = ok(F.col("style").isin("IEEE", "Vancouver"))
    if venue.get("highlights"):
        items["highlights"] = ok(F.col("highlights"), "fail")
    if venue.get("conflict"):
        items["coi"] = ok(F.col("conflict") == "ok")
    if venue.get("data"):
        items["data"] = ok(F.col("data") == "ok")
    if venue.get("words"):
        items["wordcap"] = ok(F.col("words") <= venue["words"] * 1.15)
    items |= {"fig-res": F.lit("cant_check"), "style-target": F.lit("fail" if venue.get("unsupported") else "pass")}
    listed = F.array(*[F.struct(F.lit(k).alias("item"), v.alias("status")) for k, v in items.items()])
    own = rows.select("doc_id", F.lit(venue["id"]).alias("venue"), F.explode(listed).alias("x")).select("doc_id", "venue", "x.*")
    return base.unionByName(own)


def tally(items: DataFrame, by: str) -> DataFrame:
    """(doc_id, by, passed, warned, failed, unchecked): counts of statuses."""
    return items.groupBy("doc_id", by).agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("warn", "warned"), ("fail", "failed"), ("cant_check", "unchecked"))])
