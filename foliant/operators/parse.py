"""Manuscripts to tables of sections, sentences, citations and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

# Section names and their headings.
SECTIONS = {
    "Abstract": r"abstract|summary",
    "Introduction": r"introduction|background",
    "Methods": r"materials?\s+and\s+methods|methods?|methodology|experimental\s+procedure",
    "Results": r"results?|findings",
    "Discussion": r"discussion|results?\s+and\s+discussion",
    "Conclusion": r"conclusions?|concluding\s+remarks",
    "References": r"references|bibliography|works\s+cited|literature\s+cited",
}
# Citation markers.
BRACKET = r"\[\d+(?:\s*[,–-]\s*\d+)*\]"
AUTHOR_YEAR = r"\([A-Z][a-zA-Z'-]+(?:\s+et\s+al\.)?(?:\s*&\s*[A-Z][a-zA-Z'-]+)?,?\s*\d{4}[a-z]?(?:\s*;\s*[A-Z][a-zA-Z'-]+(?:\s+et\s+al\.)?,?\s*\d{4}[a-z]?)*\)"
YEAR_ALONE = r"[A-Z][a-zA-Z-]+\s+\(\d{4}[a-z]?\)"


def _capital(name: str) -> str:
    return "|".join(f"[{w[0].upper()}]{w[1:]}" for w in SECTIONS[name].split("|"))


def heading(name: str, strict: bool) -> str:
    """A pattern for what stands before a heading (group 1) and the heading.

    ``strict`` asks for a capital letter, and for the beginning of the text or
    the end of a sentence before it; else a heading may stand anywhere, in any case.
    """
    words = SECTIONS[name]
    if strict:
        return rf"(?s)^((?:.*?[.!?:]\s)?)(?:\d{{1,2}}\.?\s*)?(?:{_capital(name)})\s"
    return rf"(?is)^((?:.*?\s)??)(?:\d{{1,2}}\.?\s*)?(?:{words})(?:\s|$)"


def _first_headings(text: str) -> Column:
    """Array of (start, order, name): each section's first strict heading, as ``heading`` has it, all sections in one search of the text.

    Only the beginning of the text counts later than what follows the end of a
    sentence. Of headings that begin alike the longer is looked for first, so that
    what is found holds both.
    """
    number = r"(?:\d{1,2}\.?\s*)?"
    every = "|".join(sorted((w for n in SECTIONS for w in _capital(n).split("|")), key=len, reverse=True))
    both = F.struct(T.hits(text, rf"[.!?:]\s{number}(?:{every})\s").alias("hits"), F.regexp_extract(text, rf"^{number}(?:{every})\s", 0).alias("begin"))

    def first(d, k, name):
        pattern = rf"^{number}(?:{_capital(name)})\s"
        after = F.get(F.filter(d["hits"], lambda h: F.substring(h["text"], F.lit(3), F.length(h["text"])).rlike(pattern)), F.lit(0))["start"] + 2
        start = F.coalesce(after, F.when(d["begin"].rlike(pattern), F.lit(0)))
        return F.struct(start.alias("start"), F.lit(k).alias("order"), F.lit(name).alias("name"))

    return T.let(both, lambda d: F.filter(F.array(*[first(d, k, n) for k, n in enumerate(SECTIONS)]), lambda x: x["start"].isNotNull()))


def with_sections(docs: DataFrame, strict: bool = True, text: str = "full_text") -> DataFrame:
    """Adds ``_sections``, array of (name, start_offset, end_offset): from each section's first heading to the next; before the first, and without any, ``Other``."""
    found = [
        F.when(F.col(text).rlike(heading(n, strict)), F.struct(F.length(F.regexp_extract(text, heading(n, strict), 1)).alias("start"), F.lit(k).alias("order"), F.lit(n).alias("name")))
        for k, n in enumerate(SECTIONS)
    ]
    other = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("order"), F.lit("Other").alias("name"))
    listed = docs.withColumn("_s", F.array_sort(_first_headings(text) if strict else F.filter(F.array(*found), lambda x: x.isNotNull())))
    listed = listed.withColumn("_s", F.when((F.size("_s") == 0) | (F.get("_s", F.lit(0))["start"] > 0), F.concat(F.array(other), "_s")).otherwise(F.col("_s")))
    ends = F.transform("_s", lambda x, i: F.struct(x["name"].alias("name"), x["start"].alias("start_offset"), F.coalesce(F.get("_s", i + 1)["start"], F.length(text)).alias("end_offset")))
    return listed.withColumn("_sections", ends).drop("_s")


def sections(docs: DataFrame, strict: bool = True, text: str = "full_text") -> DataFrame:
    """Rows (doc_id, name, start_offset, end_offset), see ``with_sections``."""
    rows = with_sections(docs.select("doc_id", text), strict, text)
    return T.each(rows, "_sections", "doc_id").select("doc_id", "x.*").filter("end_offset > start_offset OR name = 'Other'")


def cites(text) -> Column:
    """Whether a text holds a citation marker; every marker has a bracket, which is looked for first."""
    return (F.contains(text, F.lit("[")) | F.contains(text, F.lit("("))) & (text.rlike(BRACKET) | text.rlike(AUTHOR_YEAR) | text.rlike(YEAR_ALONE))


def located_sentences(docs: DataFrame, window: int, text: str = "full_text", pattern: str | None = None) -> DataFrame:
    """Sentences with section, page, and whether a citation stands within ``window`` characters; with a ``pattern`` only those that it is found in.

    All of it comes from arrays of the document's own row before they are exploded: no join, no shuffle.
    """
    rows = with_sections(docs.select("doc_id", text), True, text)
    parts = F.struct(T.sentence_pieces(text).alias("p"), T.slices(text).alias("slices"))

    def one(slices, y):
        end = y["s"] + F.length(y["t"])
        near = T.between(slices, F.greatest(F.lit(0), y["s"] - window), end + window)
        return F.struct(y["i"].alias("sentence_index"), y["t"].alias("text"), y["s"].alias("start_offset"), end.alias("end_offset"), near.alias("near"))

    def wanted(p):
        rows = F.transform(F.zip_with(p, T.starts(p), lambda x, s: F.struct(F.rtrim(x).alias("t"), s.alias("s"))), lambda y, i: F.struct(i.alias("i"), y["t"].alias("t"), y["s"].alias("s")))
        return F.filter(rows, lambda y: y["t"] != "" if pattern is None else y["t"].rlike(pattern))

    found = T.let(parts, lambda d: F.transform(wanted(d["p"]), lambda y: one(d["slices"], y)))
    # surroundings are tested once they are rows, where an expression that is used often is made once
    each = T.each(rows, found, "doc_id", "_sections").select("doc_id", "_sections", "x.*")
    inside = F.filter("_sections", lambda x: (x["start_offset"] <= F.col("start_offset")) & (F.col("start_offset") < x["end_offset"]))
    each = each.select("doc_id", "_sections", "sentence_index", "text", "start_offset", "end_offset", cites(F.col("near")).alias("cited"))
    return at_page(each.withColumn("section", F.coalesce(F.get(inside, F.lit(0))["name"], F.lit("Other"))).drop("_sections"))


def sentences_with(docs: DataFrame, pattern: str, text: str = "full_text") -> DataFrame:
    """Sentences that a pattern is found in, with section and page; others are dropped before the arrays are exploded."""
    rows = with_sections(docs.select("doc_id", text), True, text).withColumn("_p", T.sentence_pieces(text)).withColumn("_at", T.starts("_p"))
    pairs = F.zip_with("_p", "_at", lambda x, s: F.struct(x.alias("x"), s.alias("s")))
    numbered = F.filter(F.transform(pairs, lambda y, i: F.struct(i.alias("sentence_index"), y["x"].alias("x"), y["s"].alias("start_offset"))), lambda y: y["x"].rlike(pattern))
    each = T.each(rows, numbered, "doc_id", "_sections", name="y").select("doc_id", "_sections", "y.sentence_index", F.rtrim("y.x").alias("text"), "y.start_offset")
    inside = F.filter("_sections", lambda x: (x["start_offset"] <= F.col("start_offset")) & (F.col("start_offset") < x["end_offset"]))
    each = each.withColumns({"end_offset": F.col("start_offset") + F.length("text"), "section": F.coalesce(F.get(inside, F.lit(0))["name"], F.lit("Other"))})
    return at_page(each.drop("_sections"))


def sentences(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Rows (doc_id, sentence_index, text, start_offset, end_offset), found without a shuffle."""
    pieces = docs.select("doc_id", T.sentence_pieces(text).alias("p"))
    rows = F.zip_with("p", T.starts("p"), lambda x, s: F.struct(F.rtrim(x).alias("text"), s.alias("start_offset"), (s + F.length(F.rtrim(x))).alias("end_offset")))
    return T.each(pieces, rows, "doc_id", place="sentence_index").select("doc_id", "sentence_index", "x.*").filter("text <> ''")


def at_section(spans: DataFrame, secs: DataFrame, offset: str = "start_offset") -> DataFrame:
    """Adds ``section``: the section that holds the offset, ``Other`` if none; both tables meet by document."""
    s = secs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), "name"))).alias("_sections"))
    inside = F.filter("_sections", lambda x: (x["s"] <= F.col(offset)) & (F.col(offset) < x["e"]))
    return spans.join(s.hint("merge"), "doc_id", "left").withColumn("section", F.coalesce(F.get(inside, F.lit(0))["name"], F.lit("Other"))).drop("_sections")


def at_page(spans: DataFrame, page_chars: int = 3000, offset: str = "start_offset") -> DataFrame:
    """Adds ``page``, where pages have a fixed number of characters."""
    return spans.withColumn("page", (F.floor(F.col(offset) / page_chars) + 1).cast("int"))


def _keyed(text: str, pattern: str, style: str, at: str) -> Column:
    """Array of (start_offset, end_offset, marker, style, keys) of the markers of one style."""

    def one(h):
        inner = F.substring(h["text"], F.lit(2), F.length(h["text"]) - 2)
        keys = F.filter(F.transform(F.split(inner, at), lambda k: F.trim(k)), lambda k: k != "")
        return F.struct(h["start"].alias("start_offset"), (h["start"] + F.length(h["text"])).alias("end_offset"), h["text"].alias("marker"), F.lit(style).alias("style"), keys.alias("keys"))

    return F.transform(T.hits(text, pattern), one)


def with_citations(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds ``_citations``: array of (start_offset, end_offset, marker, style, keys) of bracketed numbers and of authors with years, by place."""
    return docs.withColumn("_citations", F.array_sort(F.concat(_keyed(text, BRACKET, "IEEE", "[,–-]"), _keyed(text, AUTHOR_YEAR, "APA", ";"))))


def citations(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Rows (doc_id, marker, style, start_offset, end_offset, keys), see ``with_citations``."""
    rows = with_citations(docs.select("doc_id", text), text)
    return T.each(rows, "_citations", "doc_id").select("doc_id", "x.marker", "x.style", "x.start_offset", "x.end_offset", "x.keys")


def style_counts(text: str, refs: Column | None = None) -> list[Column]:
    """Counts of marker shapes: ieee, apa, harvard, and numbered entries in the list of references (``refs``, if it is known)."""
    refs = refs if refs is not None else F.regexp_extract(text, heading("References", True).replace("(?s)^((?:", "(?s)^(?:(?:", 1) + "(.*)$", 1)
    return [
        T.count(text, r"\[\d{1,3}\]").alias("ieee"), T.count(text, r"\([A-Z][a-zA-Z-]+(?:\s+et\s+al\.)?,?\s*\d{4}[a-z]?\)").alias("apa"),
        T.count(text, r"[A-Z][a-zA-Z-]+\s+\(\d{4}\)").alias("harvard"), T.count(refs, r"\[\d+\]\s+[A-Z]").alias("numbered"),
    ]


def with_style(counts: DataFrame) -> DataFrame:
    """Adds ``style`` to counts of marker shapes: the greatest weighted count, ``unknown`` below 2."""
    scores = F.array(
        F.struct((F.col("ieee") * 2.0 + F.when(F.col("numbered") > 3, 5.0).otherwise(0.0)).alias("score"), F.lit(0).alias("rank"), F.lit("IEEE").alias("style")),
        F.struct((F.col("apa") * 3.0).alias("score"), F.lit(-1).alias("rank"), F.lit("APA").alias("style")),
        F.struct((F.col("harvard") * 2.0).alias("score"), F.lit(-2).alias("rank"), F.lit("Harvard").alias("style")),
        F.struct(F.when((F.col("numbered") > 3) & (F.col("ieee") < 3), F.col("numbered").cast("double")).otherwise(0.0).alias("score"), F.lit(-3).alias("rank"), F.lit("Vancouver").alias("style")),
    )
    best = F.array_max(scores)
    return counts.withColumn("style", F.when(best["score"] < 2, "unknown").otherwise(best["style"]))


def citation_style(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Rows (doc_id, ieee, apa, harvard, numbered, style): weighted counts of marker shapes, the greatest naming the style."""
    return with_style(docs.select("doc_id", *style_counts(text)))


# What numbers an entry of a reference list.
LISTED = {"bracket": r"\[\d{1,3}\]\s+[A-Z\"“]", "dot": r"(?:^|\s)\d{1,3}\.\s+[A-Z\"“]"}
LEAST_ENTRY, LEAST_LOOSE = 10, 20
VENUE = r"([A-Z][A-Za-z\s&:]+?)(?:,|\s+\d{4}|\s+vol)"


def with_references(docs: DataFrame, text: str = "full_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_references``: array of (ref_index, raw, start_offset) of the entries of the reference list; empty without one.

    Entries are numbered in brackets, or else with dots: numbers count as a list
    where there are two or more, the first at most 3, and 85 of 100 greater than the
    one before; entries of up to 10 characters go. A list without such numbers is
    cut after full stops; pieces of over 20 characters are entries, in order. All of
    it is made from arrays of the document's own row. ``keep``: ``_body``, the text of the list.
    """
    # a heading is never empty, so one search tells whether and where it is
    rows = docs.withColumn("_n", F.length(F.regexp_extract(text, heading("References", True), 0)))
    rows = rows.withColumn("_at", F.when(F.col("_n") > 0, F.col("_n")))
    rows = rows.withColumn("_body", F.coalesce(F.expr(f"substring({text}, _at + 1)"), F.lit("")))
    number = lambda h: F.regexp_extract(h["text"], r"\d+", 0).cast("int")
    for how, pattern in LISTED.items():
        rows = rows.withColumn(f"_{how}", F.transform(T.hits("_body", pattern), lambda h: F.struct(h["start"].alias("start"), number(h).alias("num"))))
        marks = F.col(f"_{how}")
        rises = F.size(F.filter(marks, lambda m, i: (i > 0) & (m["num"] > F.get(marks, i - 1)["num"])))  # noqa: B023
        good = (F.size(marks) >= 2) & (rises >= 0.85 * (F.size(marks) - 1)) & (F.get(marks, F.lit(0))["num"] <= 3)
        rows = rows.withColumn(f"_{how}", F.when(good, marks))
    rows = rows.withColumn("_marks", F.coalesce("_bracket", "_dot"))
    end = lambda i: F.coalesce(F.get("_marks", i + 1)["start"], F.length("_body"))
    entry = lambda num, raw, at: F.struct(num.cast("int").alias("ref_index"), raw.alias("raw"), (F.col("_at") + at).alias("start_offset"))
    numbered = F.filter(F.transform("_marks", lambda m, i: entry(m["num"], F.trim(F.substring("_body", m["start"] + 1, end(i) - m["start"])), m["start"])), lambda r: F.length(r["raw"]) > LEAST_ENTRY)
    rows = rows.withColumn("_loose", F.when(F.col("_marks").isNull() & (F.col("_body") != ""), T.cut("_body", (r"(\.)(\s+)([A-Z\[])", "$1$2", "$3"))))
    loose = F.filter(F.zip_with("_loose", T.starts("_loose"), lambda x, at: F.struct(at.alias("at"), F.trim(x).alias("raw"))), lambda r: F.length(r["raw"]) > LEAST_LOOSE)
    unmarked = F.transform(loose, lambda r, i: entry(i + 1, r["raw"], r["at"]))
    none = F.array().cast("array<struct<ref_index:int,raw:string,start_offset:int>>")
    return rows.withColumn("_references", F.coalesce(numbered, unmarked, none)).drop(*({"_n", "_at", "_body", "_bracket", "_dot", "_marks", "_loose"} - set(keep)))


def references(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Rows (doc_id, ref_index, raw, start_offset), see ``with_references``."""
    return T.each(with_references(docs.select("doc_id", text), text), "_references", "doc_id").select("doc_id", "x.*")


def entry_year(raw) -> Column:
    """The first year of an entry; empty if none."""
    return F.regexp_extract(raw, rf"{T.B}((?:19|20)\d{{2}}[a-z]?){T.E}", 1)


def entry_authors(raw, year) -> Column:
    """Names before the year, or in the first 80 characters without one."""
    head = F.when(year != "", F.regexp_replace(F.substring(raw, F.lit(1), F.position(year, raw) - 1), r"^(?:\[\d+\]|\d+\.)\s*", "")).otherwise(F.substring(raw, 1, 80))
    return F.filter(F.transform(F.split(head, r",|&|;| and "), lambda a: F.trim(a)), lambda a: (F.length(a) > 1) & (F.length(a) < 60) & a.rlike("[A-Za-z]"))


def reference_fields(refs: DataFrame) -> DataFrame:
    """Adds authors (at most six), year, title (quoted, else what follows the year), venue (capitalised words after the title), doi to rows with ``raw``."""
    rows = refs.withColumn("year", entry_year(F.col("raw")))
    quoted = F.regexp_extract("raw", r"\"(.+?)\"", 1)
    after = F.regexp_replace(F.expr("substring(raw, instr(raw, year) + length(year))"), r"^[\s.,:;)\]}]+", "")
    plain = F.trim(F.regexp_extract(after, r"^([^.?]*)", 1))
    title = F.when(quoted != "", quoted).when((F.col("year") != "") & (F.length(plain) > 8), plain)
    doi = F.nullif(F.regexp_replace(F.regexp_extract("raw", r"(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)]+$", ""), F.lit(""))
    rows = rows.withColumn("title", title)
    venue = F.trim(F.regexp_extract(F.expr("substring(raw, instr(raw, title) + length(title))"), VENUE, 1))
    rows = rows.withColumn("venue", F.nullif(venue, F.lit(""))).withColumn("authors", F.slice(entry_authors(F.col("raw"), F.col("year")), 1, 6))
    return rows.withColumn("doi", doi).withColumn("year", F.nullif("year", F.lit("")))


def main_text(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds ``main``: the text before the list of references, all of it if there is none."""
    return docs.withColumn("main", F.when(F.col(text).rlike(heading("References", True)), F.regexp_extract(text, heading("References", True), 1)).otherwise(F.col(text)))


def integrity(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Rows (doc_id, kind, category, start_offset, key, confidence): numbers cited in the text without an entry in the list, and entries that nothing cites.

    Numbers are only missing where there is a list; entries are only left over
    where anything is cited, and not if an author-year marker holds their first
    author's name. A document's markers and entries meet in its own row.
    """
    rows = with_citations(with_references(main_text(docs.select("doc_id", text), text), text), "main")
    flat = lambda style: F.flatten(F.transform(F.filter("_citations", lambda c: c["style"] == style), lambda c: c["keys"]))
    rows = rows.withColumns({"_numbers": F.transform("_references", lambda r: r["ref_index"]), "_cited": F.transform(flat("IEEE"), lambda k: k.cast("int")), "_names": F.transform(flat("APA"), lambda k: F.lower(k))})
    finding = lambda kind, category, at, key, sure: F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"), at.alias("start_offset"), key.cast("int").alias("key"), F.lit(sure).alias("confidence"))
    missing = lambda c: F.transform(F.filter(c["keys"], lambda k: ~F.array_contains("_numbers", k.cast("int"))), lambda k: finding("broken_citation", "broken_citation", c["start_offset"], k, 0.85))
    broken = F.flatten(F.transform(F.filter("_citations", lambda c: c["style"] == "IEEE"), missing))

    def named(r):
        surname = F.lower(F.regexp_extract(F.get(entry_authors(r["raw"], entry_year(r["raw"])), F.lit(0)), r"^(\S+)", 1))
        return F.coalesce(F.exists("_names", lambda n: F.contains(n, surname)) & (F.length(surname) > 2), F.lit(False))

    left = F.filter("_references", lambda r: ~F.array_contains("_cited", r["ref_index"]) & ~named(r))
    orphans = F.transform(left, lambda r: finding("orphan_ref", "orphan_reference", r["start_offset"], r["ref_index"], 0.7))
    kind = "array<struct<kind:string,category:string,start_offset:int,key:int,confidence:double>>"
    none = F.array().cast(kind)
    found = F.concat(F.when(F.size("_references") > 0, broken.cast(kind)).otherwise(none), F.when(F.size("_citations") > 0, orphans.cast(kind)).otherwise(none))
    return T.each(rows, found, "doc_id").select("doc_id", "x.*")


def parsed(docs: DataFrame, page_chars: int = 3000, text: str = "full_text") -> DataFrame:
    """A row for each document with all that parsing finds, in arrays: (doc_id, style_counts, pages, sections, sentences, citations, references).

    style_counts as in ``style_counts``, pages (page, start_offset, end_offset), sections (name, start_offset,
    end_offset), sentences (sentence_index, text, start_offset, end_offset, page,
    section), citations and references as in ``with_citations`` and
    ``with_references``. One scan, no shuffle; written once, it feeds a table for each.
    """
    rows = with_references(with_citations(with_sections(docs.select("doc_id", text), True, text), text), text, keep=("_body",))
    listed = F.when(F.col(text).isNotNull(), F.col("_body"))
    rows = rows.withColumn("_p", T.sentence_pieces(text)).withColumn("_starts", T.starts("_p"))
    within = lambda s: F.coalesce(F.get(F.filter("_sections", lambda x: (x["start_offset"] <= s) & (s < x["end_offset"])), F.lit(0))["name"], F.lit("Other"))
    whole = F.transform(F.zip_with("_p", "_starts", lambda x, s: F.struct(F.rtrim(x).alias("t"), s.alias("s"))), lambda y, i: F.struct(i.alias("sentence_index"), y["t"].alias("text"), y["s"].alias("start_offset"), (y["s"] + F.length(y["t"])).alias("end_offset"), (F.floor(y["s"] / page_chars) + 1).cast("int").alias("page"), within(y["s"]).alias("section")))
    size = F.coalesce(F.length(text), F.lit(0))  # a null text is one empty page
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / page_chars).cast("int"), F.lit(1)) - 1), lambda k: F.struct((k + 1).alias("page"), (k * page_chars).alias("start_offset"), F.least((k + 1) * page_chars, size).alias("end_offset")))
    sections = F.filter("_sections", lambda x: (x["end_offset"] > x["start_offset"]) | (x["name"] == "Other"))
    return rows.select("doc_id", F.struct(*style_counts(text, listed)).alias("style_counts"), pages.alias("pages"), sections.alias("sections"), F.filter(whole, lambda x: x["text"] != "").alias("sentences"), F.col("_citations").alias("citations"), F.col("_references").alias("references"))
