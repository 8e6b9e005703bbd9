"""Passages that a similarity report flags: aligned with the document, matched to references, sorted into categories."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from foliant.functions import text as T
from foliant.operators import claims, parse

# Phrases that many papers share, and those of methods sections.
COMMON_PHRASES = [
    "et al", "in this paper", "in this study", "the results show", "as shown in figure", "as shown in table", "this work was supported", "all rights reserved", "corresponding author", "for example",
    "in other words", "on the other hand", "it is well known", "in recent years", "the purpose of this", "data availability", "conflict of interest", "informed consent", "institutional review board",
]
METHODS_BOILERPLATE = [
    "was approved by", "written informed consent", "statistical analysis was performed", "p < 0.05", "p<0.05", "mean ± standard", "mean +/- standard", "using spss", "using graphpad", "randomly assigned",
    "double-blind", "inclusion criteria", "exclusion criteria", "samples were collected", "according to the manufacturer", "previously described",
]


#: Normalised characters from which on a flag is looked for a second time.
SECOND_TRY = 30


def align(flags: DataFrame, docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds paper_start, paper_end and score to flags (doc_id, flag_id, text, ...): where the document holds the flagged text, case aside, -1 and 0 where it doesn't.

    What is not there as it stands is looked for a second time, if it has more than
    30 characters once it is normalised: what stands between its words may then
    differ. Every flag stays. A document meets all of its flags at once, in an array,
    so that neither its text nor what is looked up in it is copied for each flag.
    The engine's own search compares a passage at each character, so Python's finds
    first where a passage is, or that it isn't there.
    """
    keep = [c for c in flags.columns if c != "doc_id"]
    listed = flags.groupBy("doc_id").agg(F.collect_list(F.struct(*keep)).alias("_f")).join(docs.select("doc_id", F.col(text).alias("_t")).hint("merge"), "doc_id", "left")
    listed = listed.withColumn("_at", _first_places(F.lower("_t"), F.transform("_f", lambda f: F.when(F.length(f["text"]) >= 15, F.lower(f["text"])))))

    def place(index, f, a):
        again = T.let(F.when(a["again"], T.raw_place(index, f["text"])), lambda r: F.struct(F.coalesce(r["s"], F.lit(-1)).alias("s"), F.coalesce(r["e"], F.lit(-1)).alias("e")))
        return F.struct(f.alias("f"), F.when(a["at"] >= 0, F.struct(a["at"].alias("s"), (a["at"] + F.length(f["text"])).alias("e"))).otherwise(again).alias("at"))

    # words are numbered where a flag was found by them
    found = T.let(F.when(F.exists("_at", lambda a: a["again"]), T.match_index("_t")), lambda index: F.zip_with("_f", "_at", lambda f, a: place(index, f, a)))
    rows = T.each(listed, found, "doc_id").select("doc_id", *[F.col(f"x.f.{c}").alias(c) for c in keep], F.col("x.at.s").alias("paper_start"), F.col("x.at.e").alias("paper_end"))
    return rows.withColumn("score", F.when(F.col("paper_start") >= 0, 1.0).otherwise(0.0)).select(*flags.columns, "paper_start", "paper_end", "score")


@arrow_udf(ArrayType(StructType([StructField("at", IntegerType()), StructField("again", BooleanType())])))
def _first_places(wholes: pa.Array, passages: pa.Array) -> pa.Array:
    """For each text in small letters and its passages: where it holds a passage (-1 if it doesn't), and whether only the normalised text holds it."""
    at, again, ends = [], [], [0]
    for whole, listed in zip(wholes, passages, strict=True):
        whole, plain = whole.as_py(), None
        for x in listed.as_py() or []:
            k = -1 if whole is None or x is None else whole.find(x)
            second = False
            if k < 0 and whole is not None and x is not None and len(n := T.normal(x)) > SECOND_TRY:
                plain = T.normal(whole) if plain is None else plain
                second = n in plain
            at.append(k)
            again.append(second)
        ends.append(len(at))
    found = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(again, pa.bool_())], ["at", "again"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def match_rate(aligned: DataFrame) -> DataFrame:
    """(doc_id, flags, match_rate): the share of a document's flags that were found."""
    return aligned.groupBy("doc_id").agg(F.count("*").alias("flags"), F.avg((F.col("score") > 0).cast("int")).alias("match_rate"))


def references_of(flags: DataFrame, refs: DataFrame, threshold: float = 0.86) -> DataFrame:
    """(doc_id, flag_id, ref_index, ref_score): the reference most like a flag's source title, if enough; the first of equals.

    A reference is as like as the best of its title, its whole entry and its venue,
    normalised, with 0.1 for the first author's name and 0.08 for the year in the
    source title, 1 at most. A document's titles are compared once, however many
    flags have them.
    """
    named = flags.filter(F.col("source_title").isNotNull()).select("doc_id", "source_title").distinct().withColumn("_a", T.normalize_match("source_title")).filter(F.length("_a") >= 8)
    each = T.each(refs, F.array("title", "raw", "venue"), "doc_id", "ref_index", "year", "authors", name="of")
    have = each.select("doc_id", "ref_index", "year", T.normalize_match("of").alias("_b"), F.lower(F.regexp_extract(F.get("authors", F.lit(0)), r"^(\S+)", 1)).alias("_surname"))
    # few bytes and much work: as many tasks as there are partitions, not as their sizes ask for
    tasks = int(flags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = named.repartition(tasks, "doc_id").join(have.repartition(tasks, "doc_id").hint("merge"), "doc_id")
    bonus = F.when((F.length("_surname") > 2) & F.contains("_a", F.col("_surname")), 0.1).otherwise(0.0) + F.when(F.contains("source_title", F.col("year")), 0.08).otherwise(0.0)
    scored = pairs.withColumn("ref_score", F.round(F.least(F.lit(1.0), T.similarity("_a", "_b", threshold - 0.18) + bonus), 9)).filter(F.col("ref_score") >= threshold)
    best = scored.groupBy("doc_id", "source_title").agg(F.max(F.struct("ref_score", (-F.col("ref_index")).alias("r"))).alias("b"))
    return flags.select("doc_id", "flag_id", "source_title").join(best.hint("merge"), ["doc_id", "source_title"]).select("doc_id", "flag_id", (-F.col("b.r")).alias("ref_index"), F.col("b.ref_score").alias("ref_score"))


#: Characters on either side of a span that its neighbourhood is read from.
REACH = 200


def quoted(before, around, size) -> Column:
    """More quotes opened than closed in the 80 characters before a span of ``size`` characters, or quotes right around it (``around``: the span with two characters on either side)."""
    return (T.count(before, '[“"«]') > T.count(before, '[”"»]')) | (around.rlike('(?s)[“"].+[”"]') & (F.length(around) < size + 10))


def inside_quotes(start, end, text: str = "full_text") -> Column:
    """Whether a span of a text is ``quoted``."""
    before = F.substring(text, F.greatest(start - 79, F.lit(1)), F.least(start, F.lit(80)))
    around = F.substring(text, F.greatest(start - 1, F.lit(1)), end - F.greatest(start - 2, F.lit(0)) + 2)
    return quoted(before, around, end - start)


def cited_nearby(start, end, text: str = "full_text", citations: str = "_citations", words: int = 15, reach: int = REACH) -> Column:
    """Whether a citation lies within ``words`` words of the span, see ``near_citation``."""
    before, after = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach))), F.substring(text, end + 1, F.lit(reach))
    return near_citation(start, end, before, after, citations, words)


def near_citation(start, end, before, after, citations, words: int = 15) -> Column:
    """Whether a citation lies within ``words`` words of a span, and some characters more: 5 before, 55 after.

    The words are those of the ``REACH`` characters on either side (``before`` and
    ``after``); joined by single blanks, they say how far the neighbourhood goes.
    """
    words_of = lambda x: F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+")
    size = lambda x: F.length(F.array_join(x, " "))
    low = start - T.let(words_of(before), lambda w: size(F.slice(w, F.greatest(F.size(w) - words, F.lit(0)) + 1, words))) - 5
    high = end + size(F.slice(words_of(after), 1, words)) + 55
    return T.let(F.struct(low.alias("low"), high.alias("high")), lambda r: F.exists(citations, lambda c: (c["start_offset"] >= r["low"]) & (c["end_offset"] <= r["high"])))


def surroundings(spans: DataFrame, docs: DataFrame, sections: DataFrame, keep: list[str], text: str = "full_text") -> DataFrame:
    """Adds to the columns ``keep`` of spans (doc_id, paper_start, paper_end, ...): ``section``, what stands ``before`` and ``after`` a span and ``around`` it, and ``near``, the citations not too far; nothing for spans that stand nowhere.

    A document meets all of its spans in one array, and what surrounds them is cut
    from slices of its text, so that neither is copied or read through for each span.
    """
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*keep, "paper_start", "paper_end")).alias("_f"))
    found = sections.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), "name")).alias("_sections"))
    texts = parse.with_citations(docs.select("doc_id", text), text).select("doc_id", T.slices(text).alias("_slices"), F.transform("_citations", lambda c: F.struct(c["start_offset"], c["end_offset"])).alias("_citations"))
    rows = listed.join(texts.hint("merge"), "doc_id").join(found.hint("merge"), "doc_id", "left").withColumn("_sections", F.array_sort("_sections"))

    def one(f):
        start, end = f["paper_start"], f["paper_end"]
        inside = F.filter("_sections", lambda x: (x["s"] <= start) & (start < x["e"]))
        cut = lambda low, high: T.between("_slices", F.greatest(low, F.lit(0)), high)
        near = F.filter("_citations", lambda c: (c["start_offset"] >= start - REACH - 5) & (c["end_offset"] <= end + REACH + 55))
        facts = F.struct(F.get(inside, F.lit(0))["name"].alias("section"), cut(start - REACH, start).alias("before"), cut(start - 2, end + 2).alias("around"), cut(end, end + REACH).alias("after"), near.alias("near"))
        return F.struct(f.alias("f"), F.when(start >= 0, facts).alias("x"))

    each = T.each(rows, F.transform("_f", one), "doc_id", name="y")
    return each.select("doc_id", *[F.col(f"y.f.{c}").alias(c) for c in [*keep, "paper_start", "paper_end"]], F.coalesce("y.x.section", F.lit("Other")).alias("section"), *[F.col(f"y.x.{c}").alias(c) for c in ("before", "around", "after", "near")])


def holds_any(text, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def categorize(aligned: DataFrame, docs: DataFrame, sections: DataFrame, matches: DataFrame, text: str = "full_text") -> DataFrame:
    """(doc_id, flag_id, category, informational): an ordered cascade over facts joined beforehand."""
    boiler = [p for p in METHODS_BOILERPLATE if p not in ("p < 0.05", "p<0.05", "mean ± standard", "mean +/- standard", "double-blind")] + ["double blind"]
    # what is asked of a flag's own text is asked before it meets others, and the text stays behind
    norm = T.each(aligned, F.array(F.coalesce(T.normalize_match("text"), F.lit(""))), *aligned.columns, name="_norm")
    asked = {"words": T.word_count("text"), "common": holds_any("_norm", COMMON_PHRASES), "boiler": holds_any("_norm", boiler), "title": F.col("source_title").isNotNull(), "url": F.col("source_url").isNotNull()}
    slim = norm.select("doc_id", "flag_id", "paper_start", "paper_end", "score", "source_type", "match_pct", *[c.alias(k) for k, c in asked.items()])
    slim = slim.join(matches.hint("merge"), ["doc_id", "flag_id"], "left")
    rows = surroundings(slim, docs, sections, ["flag_id", "score", "source_type", "match_pct", *asked, "ref_index"], text)
    start, end, words = F.col("paper_start"), F.col("paper_end"), F.col("words")
    category = (
        F.when((start < 0) | (F.col("score") < 0.62), "review_manually")
        .when(F.col("source_type") == "student_paper", "source_unidentifiable")
        .when(F.col("section") == "References", "reference_entry")
        .when(quoted(F.substring("before", -80, 80), F.col("around"), end - start), "properly_quoted")
        .when((words < 8) | F.col("common"), "common_phrase")
        .when((F.col("section") == "Methods") & F.col("boiler"), "methods_boilerplate")
        .when(near_citation(start, end, F.col("before"), F.col("after"), "near"), "already_cited")
        .when(F.col("ref_index").isNotNull(), "missing_in_text_citation")
        .when(F.col("match_pct") < 2, "trivial_match")
        .when((F.col("source_type") == "unknown") & ~F.col("url") & ~F.col("title"), "source_unidentifiable")
        .when((words >= 24) & (F.coalesce("match_pct", F.lit(0.0)) >= 3) & (F.col("score") >= 0.7), "needs_restatement")
        .when(F.col("title") | F.col("url"), "needs_new_citation")
        .otherwise("review_manually")
    )
    quiet = ["reference_entry", "properly_quoted", "common_phrase", "methods_boilerplate", "already_cited", "trivial_match"]
    rows = rows.withColumn("category", category)
    return rows.select("doc_id", "flag_id", "category", (F.col("category").isin(quiet) | ((F.col("category") == "review_manually") & (start < 0))).alias("informational"))


def source_type(title, url) -> Column:
    """What kind of source a title or an address names."""
    t, u = F.lower(F.coalesce(T.col(title), F.lit(""))), F.lower(F.coalesce(T.col(url), F.lit("")))
    return F.when(t.rlike("student paper|submitted to"), "student_paper").when(t.rlike("journal|proceedings|conference|press|publication") | u.rlike(r"doi\.org|/article|pubmed"), "publication").when((u != "") | t.rlike(r"https?://|www\."), "internet").otherwise("unknown")


# Cautious venue titles, signals of what a study involves and of statements that it has.
VENUE_CAUTION = (
    r"(?:world|global|universal)\s+journal\s+of\s+advanced?|international\s+journal\s+of\s+(?:advanced?|innovative|emerging)\s+(?:research|trends|science and)"
    r"|journal\s+of\s+(?:advanced?|innovative)\s+research\s+in|(?:american|british|european)\s+(?:open|online)\s+journal|research\s+journal\s+international"
)
NEEDS = {
    "human": r"participants?|patients?|volunteers?|respondents?|human subjects?|questionnaires?|surveyed|interviews?|focus groups?|cohort|clinical trial",
    "animal": r"mice|rats?|murine|zebrafish|rabbits?|in vivo|animal (?:model|stud|experiment)|c57bl|sprague.?dawley",
    "data": r"datasets?|data set|corpus|corpora|benchmark|database|collected data|raw data|measurement data",
    "code": r"source code|github|gitlab|open.?source (?:code|implementation)|our (?:code|implementation)|scripts? (?:are|is) available",
}
PRESENT = {
    "ethics": r"ethic(?:s|al)?\s+(?:approval|committee|review board|clearance)|institutional review board|IRB|declaration of helsinki|animal care and use committee|IACUC",
    "consent": r"informed consent|written consent|consent (?:was|were) obtained|consent form",
    "data": r"data availability|data (?:are|is|will be) (?:openly |publicly |freely )?available|available (?:at|from|upon|on) (?:https|request|reasonable request|zenodo|figshare|github|osf)",
    "conflict": r"conflicts? of interest|competing interests?|no (?:known )?(?:conflict|competing)|declare no",
    "funding": r"this (?:work|research|study) (?:was|is) (?:partially |partly )?(?:supported|funded)|funding:?\s|grant (?:no|number|agreement)|financial support",
}


def statements(docs: DataFrame, of: tuple[str, ...] = ("ethics", "consent", "data", "conflict", "funding"), text: str = "full_text") -> DataFrame:
    """(doc_id, statement, status): ok, missing, not_needed or check for each required statement, or for some ``of`` them.

    What a study involves is read from its methods (the whole text where it has no
    such section), data and code from the whole text. There is a row for consent only
    where there are human subjects.
    """
    rows = parse.with_sections(docs.select("doc_id", text), True, text)
    methods = F.get(F.filter("_sections", lambda s: s["name"] == "Methods"), F.lit(0))
    rows = rows.withColumn("_m", F.coalesce(F.substring(text, methods["start_offset"] + 1, methods["end_offset"] - methods["start_offset"]), F.col(text)))
    has = lambda p: F.col(text).rlike(T.words_at(p))
    human, animal, data = F.col("_m").rlike(T.words_at(NEEDS["human"])), F.col("_m").rlike(T.words_at(NEEDS["animal"])), has(f"{NEEDS['data']}|{NEEDS['code']}")
    status = {
        "ethics": F.when(has(PRESENT["ethics"]), "ok").when(human | animal, "missing").otherwise("not_needed"),
        "consent": F.when(human, F.when(has(PRESENT["consent"]), "ok").otherwise("missing")),
        "data": F.when(has(PRESENT["data"]), "ok").when(data, "missing").otherwise("check"),
        "conflict": F.when(has(PRESENT["conflict"]), "ok").otherwise("missing"),
        "funding": F.when(has(PRESENT["funding"]), "ok").otherwise("check"),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("statement"), v.alias("status")) for k, v in status.items() if k in of])
    return T.each(rows, listed, "doc_id").select("doc_id", "x.*").filter(F.col("status").isNotNull())


def hygiene(refs: DataFrame, year: int) -> DataFrame:
    """(doc_id, total, with_year, with_doi, older_than_10, recent_5, duplicates, cautions) of each reference list, as of ``year``."""
    age = F.lit(year) - F.substring("year", 1, 4).cast("int")
    counts = refs.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count("year").alias("with_year"), F.count("doi").alias("with_doi"), F.count_if(age > 10).alias("older_than_10"), F.count_if(age <= 5).alias("recent_5"), F.count_if(F.col("raw").rlike(T.words_like(VENUE_CAUTION))).alias("cautions")
    )
    same = refs.filter(F.length("title") >= 15).groupBy("doc_id", T.normalize_match("title").alias("k")).agg(F.count("*").alias("n")).filter("n > 1").groupBy("doc_id").agg(F.sum("n").alias("duplicates"))
    return counts.join(same.hint("merge"), "doc_id", "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0).cast("long")))


def hygiene_issues(facts: DataFrame) -> DataFrame:
    """(doc_id, issue): aged, no-recent, missing-doi, duplicates, venue-caution."""
    rules = {
        "aged": (F.col("with_year") >= 5) & (F.col("older_than_10") / F.col("with_year") > 0.6), "no-recent": (F.col("with_year") >= 5) & (F.col("recent_5") == 0), "missing-doi": (F.col("total") >= 5) & (F.col("with_doi") / F.col("total") < 0.3),
        "duplicates": F.col("duplicates") > 0, "venue-caution": F.col("cautions") > 0,
    }
    return facts.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("issue"))


def callouts(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """(doc_id, kind, count, max_number, missing): figures and tables that the text before the references calls out, Roman numerals too, and numbers left out."""
    main = parse.main_text(docs, text)
    roman = F.create_map(*[F.lit(x) for k, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split(), 1) for x in (r, k)])
    tokens = {"figure": (r"(?:^|\W)(?i:fig\.?|figure)\s*\d{1,3}", r"(\d+)$"), "table": (r"(?:^|\W)(?i:table|tab\.)\s*(?i:\d{1,3}|[ivx]{1,5})", r"(\d+|[ivx]+)$")}

    def of(kind: str):
        whole, last = tokens[kind]
        found = F.transform(F.regexp_extract_all("main", F.lit(whole), F.lit(0)), lambda x: F.regexp_extract(F.lower(x), last, 1))
        numbers = F.array_distinct(F.filter(F.transform(found, lambda x: F.coalesce(x.try_cast("int"), roman[x])), lambda n: (n >= 1) & (n <= 200)))
        return F.struct(F.lit(kind).alias("kind"), numbers.alias("n"))

    # both kinds in one array: the texts are read once
    rows = T.each(main, F.array(of("figure"), of("table")), "doc_id").select("doc_id", "x.*").filter(F.size("n") > 0)
    most = F.array_max("n")
    return rows.select("doc_id", "kind", F.size("n").alias("count"), most.alias("max_number"), F.array_except(F.sequence(F.lit(1), most), "n").alias("missing"))


def small(table: DataFrame, most: int = 2000) -> list:
    """The rows of a dimension table; an error if it has over ``most``, as it is no dimension then."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: join this table instead")
    return rows


def fields_of(docs: DataFrame, lexicon: dict[str, list[str]], most: int = 3) -> DataFrame:
    """(doc_id, field, hits, place): the fields with most terms in a lead text, ``general`` if none. The lexicon is a literal of the plan: no join."""
    terms = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(t) for t in sorted(set(ts))]).alias("terms")) for f, ts in sorted(lexicon.items())])
    hits = F.transform(terms, lambda f: F.struct((-F.size(F.filter(f["terms"], lambda t: F.contains("lead", t)))).alias("h"), f["field"].alias("field")))
    best = F.slice(F.array_sort(F.filter(hits, lambda x: x["h"] < 0)), 1, most)
    none = F.array(F.struct(F.lit(0).alias("h"), F.lit("general").alias("field")))
    rows = docs.select("doc_id", best.alias("best"))
    return rows.select("doc_id", F.posexplode(F.when(F.size("best") > 0, F.col("best")).otherwise(none)).alias("place", "x")).select("doc_id", "x.field", (-F.col("x.h")).alias("hits"), (F.col("place") + 1).alias("place"))


def fields(docs: DataFrame, lexicon: DataFrame, most: int = 3) -> DataFrame:
    """``fields_of`` for a lexicon that is a small table (field, term)."""
    terms: dict[str, list[str]] = {}
    for r in small(lexicon):
        terms.setdefault(r["field"], []).append(r["term"])
    return fields_of(docs, terms, most)


def venues(docs: DataFrame, found: DataFrame, catalog: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, venue, score, position): venues (venue, keywords, fields), a small table, by 2 a keyword, 3 a shared field and 1; ties by name."""
    mine = found.groupBy("doc_id").agg(F.collect_set("field").alias("mine"))
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    listed = F.array(*[F.struct(F.lit(r["venue"]).alias("venue"), texts(r["keywords"]).alias("keywords"), texts(r["fields"]).alias("fields")) for r in small(catalog)])
    rows = docs.select("doc_id", "lead").join(mine.hint("merge"), "doc_id").withColumn("catalog", listed)
    score = lambda v: 1 + 2 * F.size(F.filter(v["keywords"], lambda k: F.contains("lead", k))) + 3 * F.size(F.array_intersect(v["fields"], "mine"))
    ranked = F.slice(F.array_sort(F.transform("catalog", lambda v: F.struct((-score(v)).alias("s"), v["venue"].alias("venue")))), 1, most)
    return rows.select("doc_id", F.posexplode(ranked).alias("p", "x")).select("doc_id", "x.venue", (-F.col("x.s")).alias("score"), (F.col("p") + 1).alias("position"))
