"""Findings on sentences: uncited claims, vague or weak wording, formulaic prose, conflicting numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import numbers, parse
from foliant.sources.shared import stored

# Cues of sentences that attribute, claim, or report the authors' own work.
ATTRIBUTION = {
    "attributes a finding to unnamed studies": r"(?:studies|research|works?|papers?|authors?|investigations?)\s+(?:have\s+)?(?:shown|demonstrated|reported|found|indicated|suggested|revealed|established|confirmed)",
    'uses an impersonal "it has been shown" construction': r"it\s+(?:has\s+been|was|is)\s+(?:shown|demonstrated|reported|found|observed|established|suggested|proposed)",
    "refers to previous work without naming it": r"(?:previous|prior|earlier|recent|several|many|numerous)\s+(?:studies|works?|reports?|investigations?|authors?|researchers?)",
    "explicitly attributes to a source": r"(?:according\s+to|as\s+reported\s+by|as\s+shown\s+by|as\s+described\s+(?:by|in))",
    "claims established prior usage": r"has\s+been\s+(?:widely|extensively|commonly|successfully)\s+(?:used|studied|investigated|applied|reported)",
    "asserts common knowledge": r"(?:is|are)\s+(?:widely|well|commonly|generally)\s+(?:known|established|accepted|recognized|reported|documented)",
}
CLAIM = {
    "makes a comparative claim": r"(?:outperform|surpass|exceed|superior\s+to|better\s+than|higher\s+than|lower\s+than|compared\s+(?:to|with))",
    "makes a superlative claim": r"(?:the\s+)?(?:most|least|best|worst|highest|lowest|largest|smallest)\s+[A-Za-z0-9_]+",
    "asserts causation or ranking": r"(?:leading|major|primary|principal)\s+(?:cause|causes|factor|factors|reason|source)",
    "cites an external statistic": r"(?:approximately|about|nearly|over|more\s+than|up\s+to)\s+\d+",
    "cites a percentage of a population": r"\d+(?:\.\d+)?\s*%\s+of",
}
OWN_WORK = (
    r"we|our|us|I|my|(?:this|the\s+present|the\s+proposed|the\s+current)\s+(?:work|study|paper|article|section|analysis|simulation|design|device|model)|(?:here|herein)\s*,?\s+(?:we|the)"
    r"|(?:fig(?:ure)?|table|eq(?:uation)?|section|appendix)\.?\s*\d+|as\s+(?:shown|seen|illustrated|summarized)\s+in\s+(?:fig|table|section|eq)"
)
CLAIM_SECTIONS = ["Abstract", "Introduction", "Discussion", "Conclusion", "Other"]
# Cues of novelty, vague numbers, precise numbers, weak reporting, formulaic prose, hedging.
NOVELTY = (
    r"to\s+the\s+best\s+of\s+our\s+knowledge|for\s+the\s+first\s+time|(?:a\s+)?novel\s+(?:approach|method|framework|algorithm|technique|model|architecture)|we\s+(?:are\s+the\s+first|propose\s+a\s+novel|introduce\s+a\s+novel)"
    r"|no\s+previous\s+(?:work|study|research)\s+has|fills?\s+an?\s+important\s+gap"
)
NOVELTY_SHOWN = r"compared\s+(?:to|with|against)|unlike\s+(?:prior|previous|earlier)"
GAIN = r"(?i)(?:^|[^A-Za-z0-9_])(?:outperforms?|improves?\s+upon)(?:[^A-Za-z0-9_].{0,39})?[^A-Za-z0-9_](?:by|with)\s+\d"
VAGUE_NUMBER = (
    r"(?:approximately|roughly|around|about|nearly|almost)\s+(?:\d|half|a\s+third|a\s+quarter)|(?:several|numerous|various|a\s+number\s+of|a\s+few)\s+(?:percent|patients?|samples?|subjects?|cases?)"
    r"|(?:significant(?:ly)?|substantial(?:ly)?)\s+(?:increase|decrease|improvement|reduction|difference|effect)"
)
PRECISE_NUMBER = r"(?i)(?:^|[^A-Za-z0-9_])(?:p\s*[<≈=]\s*0?\.\d+|95\s*%\s*CI|confidence\s+interval|n\s*=\s*\d+|±\s*\d)"
WEAK_REPORT = (
    r"as\s+(?:shown|seen|illustrated|depicted)\s+in\s+(?:Fig(?:ure)?|Table)\.?\s*\d|(?:standard|conventional|usual)\s+(?:methods?|procedures?|protocols?)\s+(?:were|was)\s+(?:used|followed|applied)"
    r"|(?:was|were)\s+(?:carefully|properly|thoroughly)\s+(?:performed|conducted|carried\s+out)|results?\s+(?:were|was)\s+(?:significant|promising|encouraging|satisfactory)"
)
FORMULAIC = (
    r"Furthermore|Moreover|Additionally|In conclusion|It is (?:important|worth) (?:to note|noting) that|In today's world|delve into|landscape of|multifaceted|robust framework|plays a crucial role|It is widely (?:known|recognized)"
    r"|In summary|To summarize|a comprehensive (?:overview|analysis)|underscores the importance"
)
HEDGES = r"might|possibly|perhaps|seemingly|apparently|potentially|arguably|it\s+is\s+possible|in\s+some\s+cases|may\s+or\s+may\s+not"
CITATION_WINDOW = 220

#: What a sentence holds that any finding of a kind is on; others need no closer look.
NEED_CUE, QUALITY_CUE, PROSE_CUE = T.cue(*ATTRIBUTION.values()), T.cue(NOVELTY, VAGUE_NUMBER, WEAK_REPORT), T.cue(FORMULAIC, HEDGES)
CUE = T.cue(*ATTRIBUTION.values(), NOVELTY, VAGUE_NUMBER, WEAK_REPORT, FORMULAIC, HEDGES)

has = lambda pattern: F.col("text").rlike(T.words_at(pattern))


def any_of(patterns) -> Column:
    """Whether any of the patterns is there: one pattern of them all, as each search of a text costs most at its characters that begin nothing."""
    return has("|".join(f"(?:{p})" for p in patterns))


def located(docs: DataFrame, cue: str | None = None) -> DataFrame:
    """Sentences with section, page, and whether a citation lies within ``CITATION_WINDOW`` characters; with a ``cue`` only those that hold it."""
    return parse.located_sentences(docs, CITATION_WINDOW, pattern=cue)


def need_score(rows: DataFrame) -> DataFrame:
    """Adds ``need``, the score of a sentence that attributes a claim without a citation nearby (null if it doesn't), and ``need_reason``."""
    eligible = (F.col("section") != "References") & (F.length(F.trim("text")) >= 40) & ~F.col("cited") & any_of(ATTRIBUTION.values()) & ~has(OWN_WORK)
    score = 0.2 + F.lit(0.65) + F.when(any_of(CLAIM.values()), 0.25).otherwise(0.0)
    score = score - F.when(F.col("section").isin(CLAIM_SECTIONS), 0.0).otherwise(0.25) - F.when(T.word_count("text") < 8, 0.3).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(has(p), F.lit(label)) for label, p in [*ATTRIBUTION.items(), *CLAIM.items()]]))
    rows = rows.withColumn("need", F.when(eligible, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)))
    return rows.withColumn("need_reason", F.when(F.col("need").isNotNull(), F.array_join(F.slice(reasons, 1, 2), " and ")))


def quality_score(rows: DataFrame) -> DataFrame:
    """Adds ``label`` (novelty without proof, weak reporting, vague numbers, in this order of precedence; null if none) and ``quality``, its score."""
    eligible = (F.col("section") != "References") & (F.length(F.trim("text")) >= 40) & F.col("text").rlike(QUALITY_CUE)
    novelty, vague, weak = has(NOVELTY) & ~has(NOVELTY_SHOWN) & ~F.col("text").rlike(GAIN), has(VAGUE_NUMBER) & ~F.col("text").rlike(PRECISE_NUMBER), has(WEAK_REPORT)
    label = F.when(novelty, "novelty_issue").when(weak, "publication_issue").when(vague, "numerical_ambiguity")
    rows = rows.withColumn("label", F.when(eligible, label))
    base = F.when(F.col("label") == "novelty_issue", 0.82).when(F.col("label") == "publication_issue", 0.78).when(F.col("label") == "numerical_ambiguity", 0.76)
    score = base - F.when(T.word_count("text") < 8, 0.25).otherwise(0.0) + F.when((F.col("section") == "Methods") & weak, 0.05).otherwise(0.0)
    return rows.withColumn("quality", F.round(score, 6))


def citation_need(rows: DataFrame, threshold: float = 0.78, most: int = 20) -> DataFrame:
    """Rows (doc_id, sentence_index, score, reason): sentences that attribute a claim without a citation nearby, at most ``most`` a document."""
    found = need_score(rows).filter(F.col("need") >= threshold)
    return capped(found, most).select("doc_id", "sentence_index", F.col("need").alias("score"), F.col("need_reason").alias("reason"))


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first findings of each document, in text order."""
    return found.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("start_offset"))).filter(F.col("_n") <= most).drop("_n")


def quality(rows: DataFrame, threshold: float = 0.72, most: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, sentence_index, label, score, and the columns ``keep``): novelty without proof, weak reporting, vague numbers, in this order of precedence."""
    return capped(quality_score(rows).filter(F.col("quality") >= threshold), most).select("doc_id", "sentence_index", "label", F.col("quality").alias("score"), *keep)


def prose_features(rows: DataFrame) -> DataFrame:
    """Adds to each text: mean and population variance of its sentences' lengths in words, hedges a word, counts of numbers, acronyms and names."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", r"([.!?])\s+", f"$1{T.CUT}"), T.CUT), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    lengths = F.transform(parts, lambda x: F.size(F.split(x, r"\s+")).cast("double"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(F.size(lengths) > 0, total(lengths) / F.size(lengths)).otherwise(0.0)
    rows = rows.withColumns({"_lengths": lengths, "_mean": mean})
    variance = F.when(F.size("_lengths") > 1, F.aggregate("_lengths", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.size("_lengths")).otherwise(0.0)
    hedges = T.count(F.lower("text"), f"{T.B}(?:{HEDGES})")
    entities = T.count("text", r"\d+(?:\.\d+)?%?") + T.count("text", r"(?:^|[^A-Za-z0-9_])[A-Z]{2,6}") + T.count("text", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+")
    return rows.withColumns({
        "sentence_length_variance": T.half_up(variance, 2), "hedging_density": T.half_up(F.when(T.word_count("text") > 0, hedges / T.word_count("text")).otherwise(0.0), 3),
        "entity_count": entities, "avg_sentence_length": T.half_up(F.col("_mean"), 1),
    }).drop("_lengths", "_mean")


def prose_score(rows: DataFrame) -> DataFrame:
    """Adds ``prose``: stock phrases or dense hedging, to which structural traits only add; null where nothing of it is there."""
    own = has(r"we|our|this (?:work|study|paper)") & ~has(FORMULAIC)
    eligible = (F.length("text") >= 110) & F.col("text").rlike(PROSE_CUE) & ~F.col("text").rlike(r"(?i)^(?:abstract|introduction|conclusion|references|acknowledg)") & ~own
    # features of other sentences are those of an empty text, which cost nothing
    kept = rows.withColumn("_text", F.col("text")).withColumn("text", F.when(eligible, F.col("text")).otherwise(""))
    kept = prose_features(kept)
    strong = F.when(has(FORMULAIC), 2.5).otherwise(0.0) + F.when(F.col("hedging_density") > 0.08, 1.5).otherwise(0.0)
    extra = (
        F.when((F.col("sentence_length_variance") < 10) & (F.col("avg_sentence_length") > 20), 0.75).otherwise(0.0) + F.when((F.col("entity_count") < 1) & (F.length("text") > 160), 0.75).otherwise(0.0)
        + F.when(F.col("avg_sentence_length") > 32, 0.5).otherwise(0.0) + F.when(~F.col("cited") & (F.length("text") > 220), 0.25).otherwise(0.0)
    )
    kept = kept.withColumn("prose", F.when(strong > 0, strong + extra)).withColumn("text", F.col("_text"))
    return kept.drop("_text", "sentence_length_variance", "hedging_density", "entity_count", "avg_sentence_length")


def formulaic_prose(rows: DataFrame, least: float = 3.5, most: int = 12) -> DataFrame:
    """Rows (doc_id, sentence_index, score, confidence) of formulaic or hedged sentences."""
    found = prose_score(rows).filter(F.col("prose") >= least).withColumn("score", F.col("prose"))
    return capped(found, most).select("doc_id", "sentence_index", "score", F.round(F.least(F.lit(0.9), 0.5 + F.col("score") * 0.07), 6).alias("confidence"))


def prose_findings(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, kind, category, start_offset, page, score, and the columns ``keep``): all three kinds of finding on sentences, in one pass over them, each kind capped a document."""
    scored = prose_score(quality_score(need_score(rows)))
    one = lambda kind, category, ok, score: F.when(ok, F.struct(F.lit(kind).alias("kind"), category.alias("category"), score.alias("score")))
    kinds = F.array_compact(F.array(
        one("citation_need", F.lit("needs_citation_claim"), F.col("need") >= 0.78, F.col("need")), one("quality", F.col("label"), F.col("quality") >= 0.72, F.col("quality")),
        one("ai", F.lit("formulaic_prose"), F.col("prose") >= 3.5, F.round(F.least(F.lit(0.9), 0.5 + F.col("prose") * 0.07), 6)),
    ))
    each = T.each(scored, kinds, "doc_id", "start_offset", "page", *keep).select("doc_id", "start_offset", "page", *keep, "x.*")
    most = F.when(F.col("kind") == "citation_need", 20).when(F.col("kind") == "quality", 24).otherwise(12)
    nth = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("start_offset"))
    return each.withColumn("_n", nth).filter(F.col("_n") <= most).select("doc_id", "kind", "category", "start_offset", "page", "score", *keep)


def review(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, category, start_offset, page, score): the review of prose in full.

    Uncited claims, wording and formulaic prose, numbers that contradict each other,
    citations without an entry and entries without a citation. Sentences are located
    once for the first four.
    """
    rows = stored(located(docs), "located")
    conflicts = numbers.numeric_conflicts(numbers.numeric_claims(rows))
    numeric = conflicts.select("doc_id", F.lit("manuscript_quality").alias("kind"), F.lit("numerical_inconsistency").alias("category"), "start_offset", "page", F.lit(0.88).alias("score"))
    broken = parse.integrity(docs).select("doc_id", "kind", "category", "start_offset", F.lit(1).alias("page"), F.col("confidence").alias("score"))
    return prose_findings(rows).unionByName(numeric).unionByName(broken)
