"""The queue of findings: order, counters, filters, edits that are safe, evidence, exports.

Findings are rows (doc_id, finding_id, kind, category, start_offset, end_offset,
page, text, confidence, is_informational, status, replacement_text, edited_text,
match_pct, source_title, source_url, source_type, origin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import edits

# Categories in the order in which they are worked off, their severities and labels, and kinds of a group.
PRIORITY = [
    "needs_restatement", "needs_new_citation", "missing_in_text_citation", "needs_citation_claim", "numerical_inconsistency", "numerical_ambiguity", "publication_issue", "novelty_issue", "source_unidentifiable", "ai_flagged",
    "broken_citation", "orphan_reference", "grammar_error", "review_manually", "already_cited", "methods_boilerplate", "common_phrase", "trivial_match", "properly_quoted", "reference_entry",
]
HIGH = ["needs_restatement", "needs_new_citation", "missing_in_text_citation", "broken_citation", "source_unidentifiable", "numerical_inconsistency"]
LOW = ["grammar_error"]
INFO = ["trivial_match", "reference_entry", "properly_quoted", "already_cited", "common_phrase", "methods_boilerplate"]
LABELS = {
    "methods_boilerplate": "Methods boilerplate", "missing_in_text_citation": "Add the in-text citation marker", "needs_new_citation": "Add a citation for this source", "needs_restatement": "Rewrite in your own words",
    "source_unidentifiable": "Overlap with an unknown source", "ai_flagged": "Reads as AI-written", "orphan_reference": "Reference never cited in text", "broken_citation": "Broken citation marker", "review_manually": "Needs your judgement",
    "grammar_error": "Grammar & style", "trivial_match": "Trivial match (under 1%)", "needs_citation_claim": "Claim may need a citation", "numerical_ambiguity": "Unclear number or statistic", "numerical_inconsistency": "Conflicting numbers in the paper",
    "publication_issue": "Vague or weak statement", "novelty_issue": "Novelty claim needs substance",
}
GROUPS = {"similarity": ["similarity"], "citation": ["citation_need", "orphan_ref", "broken_citation"], "ai": ["ai"], "grammar": ["grammar"], "quality": ["manuscript_quality"]}
ESCALATED = ["needs_new_citation", "needs_restatement", "ai_flagged", "numerical_ambiguity", "numerical_inconsistency", "publication_issue", "novelty_issue"]
ORIGINS = {"similarity_report": "Similarity / originality report", "ai_report": "AI writing report", "local_heuristic": "Local voice heuristic (no AI-report span aligned)"}
MARKER = r"\[\d+\]|\([A-Z][a-z]+[^)]*\d{4}\)"
#: What to do next, by category.
NEXT = {
    "needs_restatement": "Say it anew, without the source's wording.", "needs_new_citation": "Cite the source, or restate.", "missing_in_text_citation": "Cite the listed reference here.", "needs_citation_claim": "Cite the earlier work, or soften the claim.",
    "ai_flagged": "Add what only the authors know: numbers, names, citations.", "numerical_ambiguity": "Give unit, n, baseline, or interval.", "numerical_inconsistency": "Reconcile the two values, or name the conditions.", "publication_issue": "Give the concrete step or result.", "novelty_issue": "Name a baseline, or drop the claim.",
}
#: Bounds of a request for explanations.
SPANS, TEXT_CHARS, CONTEXT_CHARS, PAYLOAD_CHARS, SPAN_OVERHEAD = 24, 900, 500, 450_000, 300


def among(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values)


def rank() -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in PRIORITY]), F.col("category"))


def severity() -> Column:
    return F.when(among("category", HIGH), 0).when(among("category", LOW), 2).when(among("category", INFO), 3).otherwise(1)


def ordered(found: DataFrame) -> DataFrame:
    """(doc_id, finding_id, priority, triage): the place of a finding by category and offset, informational ones last, and by severity, page and offset."""
    doc = W.partitionBy("doc_id")
    first = F.row_number().over(doc.orderBy("is_informational", rank(), "start_offset", "finding_id"))
    triage = F.row_number().over(doc.orderBy(severity(), "page", "start_offset", "finding_id"))
    return found.select("doc_id", "finding_id", first.alias("priority"), triage.alias("triage"))


def queue_counts(found: DataFrame) -> DataFrame:
    """(doc_id, total, info, open, reviewed, a count of open findings for each group, progress): informational findings count as info alone."""
    real, opened = ~F.col("is_informational"), F.col("status") == "open"
    of = [F.count_if(real & opened & among("kind", kinds)).alias(group) for group, kinds in GROUPS.items()]
    counts = found.groupBy("doc_id").agg(F.count_if(real).alias("total"), F.count_if("is_informational").alias("info"), F.count_if(real & opened).alias("open"), F.count_if(real & ~opened).alias("reviewed"), *of)
    return counts.withColumn("progress", F.when(F.col("total") > 0, T.half_up(F.col("reviewed") * 100.0 / F.col("total"))).otherwise(0).cast("int"))


def keeps_citations(before, after) -> Column:
    return F.size(edits.lost_markers(before, after)) == 0


def decided(found: DataFrame) -> DataFrame:
    return found.filter("status IN ('accepted', 'dismissed', 'edited')")


def change_log(found: DataFrame) -> DataFrame:
    """(doc_id, finding_id, category, action, page, original, edited_text, citation_warning): decided findings, what was done, and whether an edit drops a citation."""
    warning = F.col("edited_text").isNotNull() & ~keeps_citations("text", "edited_text")
    return decided(found).select("doc_id", "finding_id", "category", F.col("status").alias("action"), "page", T.clip("text", 121).alias("original"), "edited_text", F.coalesce(warning, F.lit(False)).alias("citation_warning"))


def status_summary(found: DataFrame) -> DataFrame:
    """(doc_id, accepted, edited, dismissed, open, citation_warnings)."""
    warning = F.col("edited_text").isNotNull() & ~keeps_citations("text", "edited_text") & (F.col("status") != "open")
    return found.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "edited", "dismissed", "open")], F.count_if(warning).alias("citation_warnings"))


def open_actionable(found: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, category, n, ids): open findings that are not informational, with the first ids of each category."""
    rows = found.filter("status = 'open' AND NOT is_informational")
    nth = F.row_number().over(W.partitionBy("doc_id", "category").orderBy("start_offset", "finding_id"))
    rows = rows.withColumn("_n", nth)
    ids = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "finding_id"))))
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.transform(ids, lambda x: x["finding_id"]).alias("ids"))


def usable(found: DataFrame) -> DataFrame:
    """(doc_id, finding_id, editable, rewritable, safe): edits that can be exported, findings that a rewrite may be asked for, and replacements that keep every citation."""
    open_ = (F.col("status") == "open") & ~F.col("is_informational")
    editable = among("status", ["accepted", "edited"]) & F.col("edited_text").isNotNull() & (F.length(F.trim("text")) > 0)
    rewritable = open_ & ((F.col("kind") == "ai") | among("category", ["needs_restatement", "ai_flagged"]))
    safe = (F.col("status") == "open") & F.col("replacement_text").isNotNull() & (F.col("replacement_text") != "") & keeps_citations("text", F.coalesce("replacement_text", F.lit("")))
    return found.select("doc_id", "finding_id", editable.alias("editable"), rewritable.alias("rewritable"), safe.alias("safe"))


def apply_safe(found: DataFrame) -> DataFrame:
    """Findings with the safe replacements accepted; the others, which would lose a citation, are only counted (column ``skipped``)."""
    offered = (F.col("status") == "open") & F.col("replacement_text").isNotNull() & (F.col("replacement_text") != "")
    ok = offered & keeps_citations("text", F.coalesce("replacement_text", F.lit("")))
    rows = found.withColumns({"_ok": ok, "skipped": offered & ~ok})
    return rows.withColumns({"status": F.when(F.col("_ok"), "accepted").otherwise(F.col("status")), "edited_text": F.when(F.col("_ok"), F.col("replacement_text")).otherwise(F.col("edited_text"))}).withColumnRenamed("_ok", "applied")


def training_rows(found: DataFrame) -> DataFrame:
    """(doc_id, finding_id, label, kind, category, f_..., text, was_edited): decided findings with their features; 0 for what was dismissed.

    Features of a kind that a finding is not of are null. ``section`` and the flags of citation need and prose come with the finding.
    """
    flag = lambda c: F.col(c).cast("int")
    need, ai = F.col("kind") == "citation_need", F.col("kind") == "ai"
    return decided(found).select(
        "doc_id", "finding_id", F.when(F.col("status") == "dismissed", 0).otherwise(1).alias("label"), "kind", "category", T.word_count("text").alias("f_word_count"), F.length("text").alias("f_char_count"), F.col("match_pct").alias("f_match_pct"), F.col("source_type").alias("f_source_type"),
        F.col("section").alias("f_section"), F.col("page").alias("f_page"), F.col("confidence").alias("f_confidence"), flag("is_informational").alias("f_is_informational"), F.col("text").rlike(MARKER).cast("int").alias("f_has_citation_marker"), F.col("text").rlike('["“”]').cast("int").alias("f_in_quotes"), F.col("text").rlike(r"\d").cast("int").alias("f_has_numbers"),
        F.when(need, flag("attributes")).alias("f_attribution_cue"), F.when(need, flag("claims")).alias("f_claim_cue"), F.when(need, flag("cited")).alias("f_nearby_citation"), F.when(need, flag("own_work")).alias("f_own_work"),
        F.when(ai, F.col("sentence_length_variance")).alias("f_ai_sentence_variance"), F.when(ai, F.col("hedging_density")).alias("f_ai_hedging"), F.when(ai, F.col("entity_count")).alias("f_ai_entities"), F.substring("text", 1, 600).alias("text"), (F.col("status") == "edited").cast("int").alias("was_edited"),
    )


def escalated(found: DataFrame) -> DataFrame:
    """Findings whose category asks for an explanation, informational ones aside."""
    return found.filter(~F.col("is_informational") & among("category", ESCALATED))


def visible(found: DataFrame, words: str = "", group: str | None = None, informational: bool = False, resolved: bool = False) -> DataFrame:
    """Findings that a search shows: of a group, by words in the text or the category's label; without words and group open grammar findings are batched, so not shown."""
    keep = F.lit(True)
    if not informational:
        keep &= ~F.col("is_informational")
    if not resolved:
        keep &= F.col("status") == "open"
    if group:
        keep &= among("kind", GROUPS[group])
    wanted = words.strip().lower()
    if wanted:
        label = F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("category")], F.lit(""))
        keep &= F.contains(F.lower("text"), F.lit(wanted)) | F.contains(F.lower(label), F.lit(wanted))
    elif not group:
        keep &= ~((F.col("kind") == "grammar") & (F.col("status") == "open"))
    return found.filter(keep)


def percent(x) -> Column:
    """A number as people write it: without ``.0``."""
    return F.regexp_replace(F.format_number(x, 1), r"\.0$", "")


def evidence(found: DataFrame) -> DataFrame:
    """(doc_id, finding_id, place, label, value): why a finding is there, a row for each thing known of it."""
    row = lambda label, value, ok: F.when(ok, F.struct(label.alias("label"), value.alias("value")))
    origin = F.coalesce(F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv])[F.col("origin")], F.lit("Analysis rules"))
    pct = F.when(F.col("match_pct") < 1, F.lit("<1% of the document")).otherwise(F.concat(F.lit("~"), percent("match_pct"), F.lit("% of the document")))
    kind = F.when(F.col("source_type").isNotNull() & (F.col("source_type") != "unknown"), F.concat(F.lit(" · "), F.replace("source_type", F.lit("_"), F.lit(" ")))).otherwise("")
    source = F.concat(F.coalesce(percent("match_pct"), F.lit("0")), F.lit("% · "), F.col("source_title"), kind, F.coalesce(F.concat(F.lit(" — "), "source_url"), F.lit("")))
    rows = F.array_compact(F.array(
        row(F.lit("Signal source"), origin, F.col("origin").isNotNull()), row(F.lit("Match weight"), pct, F.col("match_pct").isNotNull()), row(F.lit("Manuscript page"), F.col("page").cast("string"), F.col("page") > 0),
        row(F.lit("Report source"), source, F.col("source_title").isNotNull()), row(F.lit("Next step"), next_step(), F.lit(True)), row(F.lit("Category rule"), F.replace("category", F.lit("_"), F.lit(" ")), F.lit(True)),
    ))
    return found.select("doc_id", "finding_id", F.posexplode(rows).alias("place", "x")).select("doc_id", "finding_id", "place", "x.label", "x.value")


def next_step() -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in NEXT.items() for x in kv])[F.col("category")], F.lit("Read it and decide."))


def payloads(found: DataFrame, docs: DataFrame, most: int = SPANS, budget: int = PAYLOAD_CHARS, text: str = "full_text") -> DataFrame:
    """(doc_id, finding_id, text, context): what is sent for explanation, at most ``most`` spans a document in text order, clipped.

    Where they have over ``budget`` characters together, seven tenths of them stay
    (rounded up), and so on, as long as there are more than four.
    """
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("start_offset", "finding_id"))
    rows = escalated(found).withColumn("n", nth).filter(F.col("n") <= most)
    item = F.struct("n", "finding_id", "text", "start_offset", "end_offset")
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("spans")).join(docs.select("doc_id", text).hint("merge"), "doc_id")

    def span(x):
        before = F.substring(text, F.greatest(x["start_offset"] - 249, F.lit(1)), F.least(x["start_offset"], F.lit(250)))
        context = F.concat(F.lit("…"), before, F.lit("【"), F.substring(text, x["start_offset"] + 1, x["end_offset"] - x["start_offset"]), F.lit("】"), F.substring(text, x["end_offset"] + 1, F.lit(250)), F.lit("…"))
        return F.struct(x["n"].alias("n"), x["finding_id"].alias("finding_id"), T.clip(x["text"], TEXT_CHARS).alias("text"), T.clip(context, CONTEXT_CHARS).alias("context"))

    made = listed.select("doc_id", F.transform("spans", span).alias("spans"))
    size = lambda n: F.aggregate(F.slice("spans", F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x["text"]) + F.length(x["context"]) + SPAN_OVERHEAD)
    shrunk = lambda n: F.when((size(n) > budget) & (n > 4), F.ceil(n * 7 / 10.0).cast("int")).otherwise(n)
    kept = made.withColumn("n", F.size("spans"))
    for _ in range(6):  # 24 spans are at most 4 after six steps
        kept = kept.withColumn("n", shrunk(F.col("n")))
    return kept.select("doc_id", F.explode(F.slice("spans", F.lit(1), F.col("n"))).alias("x")).select("doc_id", "x.finding_id", "x.text", "x.context")


#: Tips by what a passage's prose features show, and what is said where nothing does.
TIPS = {"uniform": "Vary the length of sentences.", "hedged": "Say directly what the data support.", "unspecific": "Give numbers, datasets or names.", "uncited": "Cite what the claim rests on.", "long": "Split long sentences."}
NO_TIP = "Say what was done, seen and decided."


def tips(rows: DataFrame) -> DataFrame:
    """Adds ``tips`` to texts with prose features and ``cited``: the tips whose thresholds are met, else one that always holds."""
    when = {
        "uniform": F.col("sentence_length_variance") < 15, "hedged": F.col("hedging_density") > 0.04, "unspecific": F.col("entity_count") < 2,
        "uncited": ~F.col("cited") & (F.length("text") > 120), "long": F.col("avg_sentence_length") > 28,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(TIPS[k])) for k, c in when.items()]))
    return rows.withColumn("tips", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_TIP))))


def merged(found: DataFrame, explanations: DataFrame, drafts: DataFrame) -> DataFrame:
    """Findings with explanations (finding_id, explanation) and accepted drafts (finding_id, draft) merged in; without them they stay as they are.

    An accepted draft makes a finding edited, with a warning where it drops a citation.
    """
    rows = found.join(explanations.hint("merge"), "finding_id", "left").join(drafts.hint("merge"), "finding_id", "left")
    has = F.col("draft").isNotNull()
    return rows.withColumns({
        "status": F.when(has, "edited").otherwise(F.col("status")), "edited_text": F.coalesce("draft", "edited_text"),
        "citation_warning": F.when(has, ~keeps_citations("text", F.coalesce("draft", F.lit("")))).otherwise(F.lit(False)),
    }).drop("draft")


def saved(found: DataFrame) -> DataFrame:
    """What a project stores of its findings: texts of at most 500 characters."""
    return found.select("doc_id", "finding_id", "kind", "category", "start_offset", "end_offset", "page", F.substring("text", 1, 500).alias("text"), "status", "match_pct", "confidence")


def ai_findings(spans: DataFrame) -> DataFrame:
    """AI-voice spans (doc_id, start_offset, end_offset, page, text, score, with prose features) as findings."""
    return spans.select(
        "doc_id", F.concat_ws(":", "doc_id", F.lit("ai_flagged"), "start_offset").alias("finding_id"), F.lit("ai").alias("kind"), F.lit("ai_flagged").alias("category"), "start_offset", "end_offset", "page", "text", F.col("score").alias("confidence"),
        "sentence_length_variance", "hedging_density", "entity_count", "avg_sentence_length", F.lit(False).alias("is_informational"), F.lit("open").alias("status"),
    )
