"""Gates over a model's scores of sentences and passages: floors, cues that middling scores need, caps a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, parse

# Floors, the score from which no cue is needed, caps, and cues by label.
NEED_FLOOR, QUALITY_FLOOR, MACHINE_FLOOR, SURE = 0.55, 0.5, 0.6, 0.82
NEED_MOST, QUALITY_MOST, MACHINE_MOST, MACHINE_TOP = 20, 24, 12, 0.98
STATISTIC = r"(?:approximately|about|nearly|over|more\s+than|up\s+to)\s+\d"
PERCENT_OF = r"\d+(?:\.\d+)?\s*%\s+of"
CUES = {
    "numerical_ambiguity": r"approximately|roughly|around|about|nearly|several|numerous|significant(?:ly)?|substantial(?:ly)?",
    "publication_issue": r"as\s+shown\s+in|Fig(?:ure)?|Table|standard\s+(?:methods?|procedures?)|carefully\s+(?:performed|conducted)|results?\s+were\s+(?:significant|promising)",
    "novelty_issue": r"to\s+the\s+best\s+of\s+our\s+knowledge|for\s+the\s+first\s+time|novel\s+(?:approach|method|framework|algorithm|technique|model)|unprecedented|no\s+previous\s+(?:work|study)",
}
LABELS = ["none", "numerical_ambiguity", "publication_issue", "novelty_issue"]
PASSAGE, SHORTEST = 550, 180


def positive(label, score):
    """The score of the positive class, from whichever class was predicted."""
    return F.when(label.isin("LABEL_1", "1"), score).when(label.isin("LABEL_0", "0"), 1 - score).otherwise(F.lit(0.0))


def citation_need(rows: DataFrame, threshold: float = NEED_FLOOR) -> DataFrame:
    """(doc_id, sentence_index, score): located sentences with ``label`` and ``score`` of a citation-need model that pass.

    The threshold is never under its floor; scores not well above it need words that attribute or count.
    """
    t = max(threshold, NEED_FLOOR)
    hint = claims.any_of(claims.ATTRIBUTION.values()) | F.col("text").rlike(f"(?i){T.B}{STATISTIC}") | F.col("text").rlike(f"(?i){T.B}{PERCENT_OF}{T.E}")
    eligible = (F.col("section") != "References") & (F.length(F.trim("text")) >= 40) & ~F.col("cited") & ~claims.has(claims.OWN_WORK)
    rows = rows.filter(eligible).withColumn("score", F.round(positive(F.col("label"), F.col("score")), 6))
    passed = rows.filter((F.col("score") >= t) & ((F.col("score") >= max(t + 0.2, SURE)) | hint))
    return claims.capped(passed, NEED_MOST).select("doc_id", "sentence_index", "score")


def quality(rows: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, sentence_index, label, score): located sentences with ``scores`` (map of class to score) that pass.

    The best class other than none counts, the first of equals; it needs its
    class's threshold, and a cue of its class where it is not sure.
    """
    t = {k: max((thresholds or {}).get(k, 0.55), QUALITY_FLOOR) for k in CUES}
    best = F.array_max(F.array(*[F.struct(F.col("scores")[k].alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, k in enumerate(LABELS) if k != "none"]))
    eligible = rows.filter((F.col("section") != "References") & (F.length(F.trim("text")) >= 40)).withColumn("b", best).select("doc_id", "sentence_index", "start_offset", "text", "b.label", "b.score")
    number = F.col("text").rlike(rf"(?i){T.B}\d+(?:\.\d+)?\s*%")
    cue = reduce(lambda a, b: a | b, [(F.col("label") == k) & (claims.has(p) | (number if k == "numerical_ambiguity" else F.lit(False))) for k, p in CUES.items()])
    floor = reduce(lambda a, b: a | b, [(F.col("label") == k) & (F.col("score") >= t[k]) for k in CUES])
    return claims.capped(eligible.filter(floor & ((F.col("score") >= SURE) | cue)), QUALITY_MOST).select("doc_id", "sentence_index", "label", "score")


def machine_prose(passages: DataFrame, threshold: float = MACHINE_FLOOR) -> DataFrame:
    """(doc_id, start_offset, end_offset, score): passages with ``label`` and ``score`` of a machine-prose model that pass; scores are capped at 0.98."""
    rows = passages.withColumn("score", F.round(positive(F.col("label"), F.col("score")), 6)).filter(F.col("score") >= max(threshold, MACHINE_FLOOR))
    return claims.capped(rows, MACHINE_MOST).select("doc_id", "start_offset", "end_offset", F.least(F.lit(MACHINE_TOP), "score").alias("score"))


def passages(docs: DataFrame, target: int = PASSAGE, least: int = SHORTEST, page_chars: int = 3000, text: str = "full_text") -> DataFrame:
    """(doc_id, start_offset, end_offset, page, text): consecutive sentences packed to about ``target`` characters.

    Sentences under 20 characters, those that begin a list of references or thanks,
    and the end of a page close a passage; passages under ``least`` characters go.
    """
    rows = docs.select("doc_id", T.sentence_pieces(text).alias("_p")).withColumn("_at", T.starts("_p"))
    spans = F.filter(F.zip_with("_p", "_at", lambda x, s: F.struct(s.alias("s"), (s + F.length(F.rtrim(x))).alias("e"), F.rtrim(x).alias("t"))), lambda x: x["t"] != "")
    kind = "struct<s:int,e:int,t:string>"
    page = lambda s: F.floor(s / page_chars)

    def close(acc):
        return F.when(F.length(acc["t"]) >= least, F.array_append(acc["out"], F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["t"].alias("t")))).otherwise(acc["out"])

    def step(acc, x):
        word = F.trim(x["t"])
        stop = (F.length(word) < 20) | word.rlike("(?i)^(?:references|acknowledg|bibliography)")
        cut = stop | (acc["open"] & (page(acc["last"]) != page(x["s"])))
        fresh = cut | ~acc["open"]
        joined = F.when(fresh, x["t"]).otherwise(F.concat(acc["t"], F.lit(" "), x["t"]))
        size = F.when(fresh, F.lit(0)).otherwise(acc["size"]) + F.length(word)
        full = ~stop & (size >= target)
        out = F.when(cut & acc["open"], close(acc)).otherwise(acc["out"])
        start = F.when(fresh, x["s"]).otherwise(acc["s"])
        done = F.when(full & (F.length(joined) >= least), F.array_append(out, F.struct(start.alias("s"), x["e"].alias("e"), joined.alias("t")))).otherwise(out)
        return F.struct((~stop & ~full).alias("open"), start.alias("s"), x["e"].alias("e"), x["s"].alias("last"), F.when(stop | full, F.lit("")).otherwise(joined).alias("t"), F.when(stop | full, F.lit(0)).otherwise(size).alias("size"), done.alias("out"))

    zero = F.struct(F.lit(False).alias("open"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("last"), F.lit("").alias("t"), F.lit(0).alias("size"), F.array().cast(f"array<{kind}>").alias("out"))
    packed = F.aggregate(spans, zero, step, lambda a: F.when(a["open"], close(a)).otherwise(a["out"]))
    each = T.each(rows, packed, "doc_id").select("doc_id", F.col("x.s").alias("start_offset"), F.col("x.e").alias("end_offset"), F.col("x.t").alias("text"))
    return parse.at_page(each, page_chars)
