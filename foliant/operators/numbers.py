"""Numeric claims of manuscripts (sizes, metric values, temperatures, voltages, settings) and those that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import parse

# Names of metrics and what they stand for.
METRICS = {
    "accuracy": "accuracy", "acc": "accuracy", "precision": "precision", "recall": "recall", "sensitivity": "sensitivity", "specificity": "specificity", "f1": "f1", "f1-score": "f1", "f1 score": "f1", "f-measure": "f1", "auc": "auc", "auroc": "auc",
    "map": "map", "iou": "iou", "mean iou": "iou", "miou": "iou", "bleu": "bleu", "rouge": "rouge", "psnr": "psnr", "ssim": "ssim", "n": "sample_size", "sample size": "sample_size", "samples": "sample_size", "subjects": "sample_size",
    "participants": "sample_size", "patients": "sample_size", "cases": "sample_size", "cohort": "sample_size", "temperature": "temperature", "temp": "temperature", "voltage": "voltage", "current": "current", "learning rate": "learning_rate",
    "lr": "learning_rate", "epoch": "epochs", "epochs": "epochs", "batch": "batch_size", "batch size": "batch_size", "throughput": "throughput", "latency": "latency", "error rate": "error_rate", "error": "error_rate", "mse": "mse", "rmse": "rmse", "mae": "mae",
}
# What is claimed; \b is a boundary of ASCII words.
CLAIMS = {
    "size": r"\b(?:(?:sample\s+size|cohort\s+size|number\s+of\s+(?:samples?|subjects?|participants?|patients?|cases?))\s*(?:of|=|:)?\s*|[nN]\s*=\s*)\d{1,7}(?:\.\d+)?\b",
    "metric": r"(?i)\b(?:accuracy|precision|recall|sensitivity|specificity|F1(?:-?\s*score)?|AUC|AUROC|mAP|IoU|mIoU|BLEU|ROUGE|PSNR|SSIM|error\s+rate|MSE|RMSE|MAE)\s*(?:score\s*)?(?:of|was|were|=|:)?\s*\d{1,3}(?:\.\d+)?\s*(?:%|％)?\b",
    "share": r"(?i)\b\d{1,3}(?:\.\d+)?\s*(?:%|％)\s*(?:accuracy|precision|recall|sensitivity|specificity|F1(?:-?\s*score)?|AUC|mAP|IoU|error(?:\s+rate)?)\b",
    "temperature": r"(?i)\b(?:(?:temperature|temp(?:erature)?)\s*(?:of|=|:)?\s*|at\s+|heated\s+to\s+|cooled\s+to\s+)-?\d{1,4}(?:\.\d+)?\s*°?\s*[CFK]\b",
    "electric": r"(?i)\b(?:(?:voltage|current)\s*(?:of|=|:)?\s*|at\s+)-?\d{1,4}(?:\.\d+)?\s*(?:m?V|kV|m?A|µA|uA)\b",
    "setting": r"(?i)\b(?:learning\s+rate|lr|batch\s+size|epochs?)\s*(?:of|=|:)?\s*\d+(?:\.\d+)?(?:e[-+]?\d+)?\b",
}
# Words that say under which condition a number holds, pairs of conditions that exclude each other, and words of contrast.
QUALIFIER = r"(?i)\b(train(?:ing)?|test(?:ing)?|val(?:idation)?|dev(?:elopment)?|baseline|proposed|ours?|their|control|treatment|before|after|pre[- ]?|post[- ]?|male|female|young|old|indoor|outdoor|low[- ]?power|high[- ]?power)\b"
ROLES = [("train", "test"), ("train", "val"), ("test", "val"), ("baseline", "proposed"), ("control", "treatment"), ("before", "after"), ("pre", "post")]
CONTRAST = r"(?i)\b(?:respectively|whereas|while|compared\s+to|versus|vs\.?|when\s+using|for\s+the\s+\w+\s+set)\b"

#: Of a claim's text: its value, what it is a value of, its unit.
VALUE = {"size": r"(\d{1,7}(?:\.\d+)?)$", "metric": r"(\d{1,3}(?:\.\d+)?)\s*[%％]?$", "share": r"^(\d{1,3}(?:\.\d+)?)", "temperature": r"(-?\d{1,4}(?:\.\d+)?)\s*°?\s*[CFKcfk]$", "electric": r"(?i)(-?\d{1,4}(?:\.\d+)?)\s*(?:m?V|kV|m?A|µA|uA)$", "setting": r"(?i)(\d+(?:\.\d+)?(?:e[-+]?\d+)?)$"}
NAME = {"metric": r"(?i)^(accuracy|precision|recall|sensitivity|specificity|F1(?:-?\s*score)?|AUC|AUROC|mAP|IoU|mIoU|BLEU|ROUGE|PSNR|SSIM|error\s+rate|MSE|RMSE|MAE)", "share": r"[%％]\s*([A-Za-z].*)$", "electric": r"(?i)^(voltage|current)", "setting": r"(?i)^(learning\s+rate|lr|batch\s+size|epochs?)"}
UNIT = {"temperature": r"([CFKcfk])$", "electric": r"(?i)(m?V|kV|m?A|µA|uA)$"}
AROUND, LEAST_CHARS = 40, 12

#: How claims of all kinds begin, or, of shares, what they hold: sentences without any of it need no closer look.
CUE = (
    r"(?:^|\W)(?i:sample\s+size|cohort\s+size|number\s+of|n\s*=|accuracy|precision|recall|sensitivity|specificity|F1|AUC|AUROC|mAP|IoU|mIoU|BLEU|ROUGE|PSNR|SSIM|error\s+rate|MSE|RMSE|MAE"
    r"|\d{1,3}(?:\.\d+)?\s*[%％]|temp|heated\s+to|cooled\s+to|at\s+-?\d|voltage|current|learning\s+rate|lr|batch\s+size|epoch)"
)

#: \b of ASCII words for an engine whose own counts accented letters as well; at the beginning of a pattern, which always begins with a word, its first half.
FIRST, EDGE = r"(?<!\w)(?=\w)", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
HIT = "struct<start:int,size:int,kind:int,raw:string,value:double,metric:string,family:string,unit:string>"


def ascii_edges(pattern: str) -> str:
    blind = "(?i)" if pattern.startswith("(?i)") else ""
    rest = pattern.removeprefix(blind)
    return blind + (FIRST + rest[2:] if rest.startswith(r"\b") else rest).replace(r"\b", EDGE)


def _hits_of(text: str, kind: str, order: int) -> Column:
    """Claims of one kind in a text: (start, −length, order, raw, value, metric, family, unit), without years and small counts among settings."""

    def one(h):
        at = h["text"]
        part = lambda patterns: F.regexp_extract(at, patterns[kind], 1) if kind in patterns else F.lit("")
        raw = part(VALUE)
        value, name = T.number(raw), F.regexp_replace(F.lower(part(NAME)), r"\s+", " ")
        volts = F.lower(part(UNIT)).endswith("v")
        name = {"size": F.lit("sample size"), "temperature": F.lit("temperature"), "electric": F.when(name != "", name).when(volts, "voltage").otherwise("current")}.get(kind, name)
        known = lambda: F.coalesce(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[name], F.regexp_replace(name, " ", "_"))
        metric = F.lit("sample_size") if kind == "size" else name if kind in ("temperature", "electric") else known()
        percent = at.rlike("[%％]$")
        family = {"size": F.lit("count"), "metric": F.when(percent | (value > 1.5), "percent").otherwise("ratio"), "share": F.lit("percent"), "temperature": F.lit("temperature"), "electric": F.when(volts, "voltage").otherwise("current"), "setting": F.lit("generic")}[kind]
        unit = {"size": F.lit("n"), "metric": F.when(percent, "%").otherwise(""), "share": F.lit("%"), "temperature": F.upper(part(UNIT))}.get(kind, part(UNIT))
        return F.struct(h["start"].alias("start"), (-F.length(at)).alias("size"), F.lit(order).alias("kind"), raw.alias("raw"), value.alias("value"), metric.alias("metric"), family.alias("family"), unit.alias("unit"))

    pattern = ascii_edges(CLAIMS[kind])
    found = F.transform(T.hits(text, pattern), one)
    if kind == "setting":
        whole = lambda h: h["value"] == F.floor(h["value"])
        found = F.filter(found, lambda h: ~(whole(h) & ((h["value"] <= 20) | ((h["value"] >= 1900) & (h["value"] <= 2100)))))
    return F.when(F.col(text).rlike(pattern), found.cast(f"array<{HIT}>")).otherwise(F.array().cast(f"array<{HIT}>"))


def claimed(text: str) -> Column:
    """All claims of a text in one array, by place, without those that overlap an earlier or longer one: a single fold over the sorted array."""
    every = F.array_sort(F.concat(*[_hits_of(text, kind, k) for k, kind in enumerate(CLAIMS)]))
    none = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{HIT}>").alias("kept"))
    keep = lambda s, h: F.when(h["start"] >= s["end"], F.struct((h["start"] - h["size"]).alias("end"), F.array_append(s["kept"], h).alias("kept"))).otherwise(s)
    return T.let(every, lambda found: F.when(F.size(found) > 1, F.aggregate(found, none, keep)["kept"]).otherwise(found))


def qualifiers(around) -> Column:
    """Under which conditions a number holds, by the words around it; sorted."""

    def role(x):
        w = F.lower(x)
        out = F.when(w.rlike("^(?:train)"), "train").when(w.rlike("^test"), "test").when(w.rlike("^(?:val|dev)"), "val").when(w == "baseline", "baseline").when(w.rlike("^(?:propos|our)"), "proposed")
        return out.when(w.rlike("^(?:their|control)"), "control").when(w == "treatment", "treatment").otherwise(F.regexp_replace(w, "^(pre|post)[- ]?", "$1"))

    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(around, F.lit(ascii_edges(QUALIFIER)), F.lit(1)), role)))


_FIELDS = ("doc_id", "sentence_index", "section", "page", "start_offset", "end_offset", "claim_start", "claim_end", "metric", "family", "value", "raw", "unit", "qualifiers", "text")


def candidates(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """The sentences that may hold a claim: those with what one begins with."""
    return parse.sentences_with(docs, CUE, text)


def numeric_claims(rows: DataFrame) -> DataFrame:
    """Rows of numeric claims in sentences: (doc_id, sentence_index, section, page, start_offset, end_offset, claim_start, claim_end, metric, family, value, raw, unit, qualifiers, text).

    ``rows``: located sentences, or ``candidates``. The sentence goes along as ``text``. All kinds of
    claim of a sentence are found in one array, which is exploded once.
    """
    kept = rows.filter((F.col("section") != "References") & (F.length(F.trim("text")) >= LEAST_CHARS) & F.col("text").rlike("[0-9]") & F.col("text").rlike(CUE))
    found = T.each(kept, claimed("text"), "doc_id", "sentence_index", "section", "page", "start_offset", "end_offset", "text", name="h")
    low = F.greatest(F.lit(0), F.col("h.start") - AROUND)
    around = F.substring("text", low + 1, F.col("h.start") - low - F.col("h.size") + AROUND)
    claim = F.col("start_offset") + F.col("h.start")
    return found.select("*", claim.alias("claim_start"), (claim - F.col("h.size")).alias("claim_end"), qualifiers(around).alias("qualifiers"), "h.metric", "h.family", "h.value", "h.raw", "h.unit").select(*_FIELDS)


def whole_text_claims(docs: DataFrame, claims: DataFrame, page_chars: int = 3000, text: str = "full_text", least_chars: int = 80) -> DataFrame:
    """The same rows for the documents without any claim in ``claims``, from their whole text; a claim's sentence runs from the full stop before it to the next."""
    left = docs.select("doc_id", text).filter((F.length(text) > least_chars) & F.col(text).rlike("[0-9]")).join(claims.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    found = T.each(left, claimed(text), "doc_id", text, name="h", place="sentence_index")
    end = F.col("h.start") - F.col("h.size")
    before, after = F.substring(text, F.lit(1), F.col("h.start")), F.expr(f"substring({text}, h.start - h.size + 1)")
    start = F.when(F.contains(before, F.lit(".")), F.length(before) - F.instr(F.reverse(before), ".") + 1).otherwise(0)
    stop = F.when(F.contains(after, F.lit(".")), end + F.instr(after, ".")).otherwise(F.least(F.length(text), end + 160))
    low = F.greatest(F.lit(0), F.col("h.start") - AROUND)
    around = F.substring(text, low + 1, F.col("h.start") - low - F.col("h.size") + AROUND)
    found = found.select("*", start.cast("int").alias("start_offset"), stop.cast("int").alias("end_offset"), F.col("h.start").alias("claim_start"), end.alias("claim_end"), qualifiers(around).alias("qualifiers"), F.lit("Other").alias("section"), (F.floor(F.col("h.start") / page_chars) + 1).cast("int").alias("page"), "h.metric", "h.family", "h.value", "h.raw", "h.unit")
    return found.withColumn("text", F.trim(F.expr(f"substring({text}, start_offset + 1, end_offset - start_offset)"))).select(*_FIELDS)


def tolerance(a, b, family) -> Column:
    """How much two values of a family must differ at least to contradict each other."""
    most = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    known = F.when(family.isin("percent", "count"), 1.0).when(family == "ratio", 0.015).when(family == "temperature", 0.5)
    return known.when(family.isin("voltage", "current"), F.greatest(F.lit(0.05), 0.01 * most)).when(family.isin("time", "length", "mass", "frequency"), F.greatest(F.lit(0.01), 0.02 * most)).otherwise(F.greatest(F.lit(1.0), 0.05 * most))


def apart(a, b) -> Column:
    """Whether two sets of qualifiers name different conditions."""
    has = F.array_contains
    roles = [(has(a, x) & has(b, y)) | (has(a, y) & has(b, x)) for x, y in ROLES]
    excluded = roles[0]
    for r in roles[1:]:
        excluded = excluded | r
    return (F.size(a) > 0) & (F.size(b) > 0) & (excluded | ~F.arrays_overlap(a, b))


def numeric_conflicts(claims: DataFrame, most: int = 12) -> DataFrame:
    """Rows (doc_id, metric, family, a_start, b_start, a_value, b_value, a_shown, b_shown, start_offset, page, cross_page): claims of one metric and family in one document that differ by the family's tolerance or more.

    Claims under different qualifiers, in sentences that begin within 8 characters
    of each other, or in a sentence of contrast are no conflict. A document's
    claims of a metric meet in one sorted array; each is paired with those that
    follow it, and only conflicts are emitted. ``start_offset`` and ``page`` are of
    the earlier claim's sentence. Those across pages come first, then by place; at
    most ``most`` a document.
    """
    shown = F.concat("raw", F.when(F.col("family") == "percent", "%").when(F.col("unit") != "", F.concat(F.lit(" "), "unit")).otherwise(""))
    calm = claims.filter(~F.col("text").rlike(ascii_edges(CONTRAST)))
    item = F.struct("claim_start", "value", "qualifiers", "page", "start_offset", shown.alias("shown"))
    lists = calm.groupBy("doc_id", "metric", "family").agg(F.array_sort(F.collect_list(item)).alias("c")).filter(F.size("c") > 1)
    each = lists.select("doc_id", "metric", "family", "c", F.posexplode("c").alias("k", "a"))
    a = F.col("a")
    differ = lambda b: (b["claim_start"] > a["claim_start"]) & (F.abs(a["start_offset"] - b["start_offset"]) >= 8) & (F.abs(a["value"] - b["value"]) >= tolerance(a["value"], b["value"], F.col("family"))) & ~apart(a["qualifiers"], b["qualifiers"])
    pairs = each.select("doc_id", "metric", "family", "a", F.explode(F.filter(F.slice("c", F.col("k") + 2, F.size("c")), differ)).alias("b"))
    pairs = pairs.select("doc_id", "metric", "family", F.col("a.claim_start").alias("a_start"), F.col("b.claim_start").alias("b_start"), F.col("a.value").alias("a_value"), F.col("b.value").alias("b_value"), F.col("a.shown").alias("a_shown"), F.col("b.shown").alias("b_shown"), "a.start_offset", "a.page", (F.col("a.page") != F.col("b.page")).alias("cross_page"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("cross_page"), "a_start", "b_start"))
    return pairs.withColumn("position", nth).filter(F.col("position") <= most)
