"""Reviewed edits: which apply, the text they give, what they lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import numbers, parse


def markers(text) -> Column:
    """Distinct citation markers of a text."""
    t = T.col(text)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (parse.BRACKET, parse.AUTHOR_YEAR, parse.YEAR_ALONE)]))


def keys(marker: Column) -> Column:
    """The keys inside a marker: numbers or authors with years, in lower case."""
    inner = F.regexp_replace(marker, r"^[\[(]|[\])]$", "")
    parts = F.when(marker.rlike(r"^\["), F.split(inner, "[,–-]")).when(marker.rlike(r"^\("), F.split(inner, ";")).otherwise(F.array(marker))
    return F.filter(F.transform(parts, lambda k: F.lower(F.trim(k))), lambda k: k != "")


def lost_markers(before, after) -> Column:
    """Markers of ``before`` none of whose keys is left in ``after``."""
    left = F.flatten(F.transform(markers(after), lambda m: keys(m)))
    return F.filter(markers(before), lambda m: ~F.arrays_overlap(keys(m), left))


# What a rewrite must keep; what is in a group counts, else the whole match.
PROTECTED = [
    r"[αβγδεζηθικλμνξπρστυφχψωΑ-Ω]", r"(?i)\b(?:AlGaN|GaN|SiO2|MoS2|HEMT|MOSFET|TCAD|DNA|RNA|PBS|EDTA)\b", r"\b[A-Z]{2,}[A-Za-z0-9/-]*\d[A-Za-z0-9/-]*\b", r"\b[A-Z][A-Z0-9]{1,7}\b",
    r"(?:^|[^A-Za-z])((?:\d+\.\d+|\d+)(?:\s*[×xX]\s*10\s*[−\-]?\s*\d+|\s*[eE][+\-]?\d+|%)?)",
]


def protected_tokens(text) -> Column:
    """Distinct Greek letters, terms, codes, acronyms, numbers and markers that a rewrite must keep."""
    t = T.col(text)
    found = [F.regexp_extract_all(t, F.lit(p.replace(r"\b", numbers.EDGE)), F.lit(1 if "((" in p else 0)) for p in PROTECTED]
    return F.array_distinct(F.filter(F.transform(F.concat(*found, markers(t)), lambda x: F.trim(x)), lambda x: x != ""))


def restored(source, draft) -> Column:
    """A draft with the protected tokens of its source that it lost, in brackets at its end."""
    lost = missing_tokens(source, draft)
    return F.when(F.size(lost) == 0, F.trim(T.col(draft))).otherwise(F.concat(F.trim(T.col(draft)), F.lit(" ("), F.array_join(lost, ", "), F.lit(")")))


def missing_tokens(before, after) -> Column:
    return F.filter(protected_tokens(before), lambda x: ~F.contains(T.col(after), x))


def apart(spans, kind) -> Column:
    """Of an array of spans (s, e, ...) by place those that begin before no kept one ends; ``kind`` is the array's type.

    Most arrays have no overlap; only where there is one are they taken one after the other.
    """
    clear = lambda x: F.forall(F.sequence(F.lit(1), F.size(x) - 1), lambda k: F.get(x, k)["s"] >= F.get(x, k - 1)["e"])
    none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("kept"))
    step = lambda acc, x: F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    return T.let(spans, lambda x: F.when(F.size(x) < 2, x).when(clear(x), x).otherwise(F.aggregate(x, none, step)["kept"]))


def with_applied(docs: DataFrame, edits: DataFrame, text: str = "full_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, t, n, applied): the edits (doc_id, start_offset, end_offset, replacement) that apply to each document, as an array (s, e, r, the columns ``keep``) by place, and how many there are.

    An edit that has no replacement, is out of bounds, or begins before the last
    applied one ends, doesn't apply.
    """
    e = F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.col("replacement").alias("r"), *keep)
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(e)).alias("edits"))
    kind = listed.schema["edits"].dataType
    # lengths are taken first, so that texts that nobody asks for are not shuffled
    rows = docs.select("doc_id", F.col(text).alias("t"), F.length(text).alias("chars")).join(listed.hint("merge"), "doc_id", "left").withColumn("edits", F.coalesce("edits", F.array().cast(kind)))
    fit = F.filter("edits", lambda x: x["r"].isNotNull() & (x["s"] >= 0) & (x["e"] > x["s"]) & (x["e"] <= F.col("chars")))
    return rows.select("doc_id", "t", F.size("edits").alias("n"), apart(fit, kind).alias("applied"))


def apply_edits(docs: DataFrame, edits: DataFrame, text: str = "full_text") -> DataFrame:
    """(doc_id, revised, applied, skipped): edits applied from left to right, see ``with_applied``."""
    rows = with_applied(docs, edits, text)
    before = lambda i: F.when(i > 0, F.get("applied", i - 1)["e"]).otherwise(0)
    parts = F.transform("applied", lambda x, i: F.concat(F.substring("t", before(i) + 1, x["s"] - before(i)), x["r"]))
    last = F.when(F.size("applied") > 0, F.element_at("applied", -1)["e"]).otherwise(0)
    revised = F.concat(F.array_join(parts, ""), F.substring("t", last + 1, F.length("t")))
    return rows.select("doc_id", revised.alias("revised"), F.size("applied").alias("applied"), (F.col("n") - F.size("applied")).alias("skipped"))


def applied_spans(docs: DataFrame, edits: DataFrame, text: str = "full_text", id_col: str = "edit_id") -> DataFrame:
    """(doc_id, edit_id, start_offset, end_offset, new_start, new_end, replacement): where each applied edit stands in the original and in the revised text.

    What earlier edits added and took moves a span: a running sum of the differences in length.
    """
    rows = with_applied(docs, edits, text, (id_col,)).withColumn("moved", T.running(F.transform("applied", lambda x: F.length(x["r"]) - (x["e"] - x["s"]))))
    each = T.each(rows, F.zip_with("applied", "moved", lambda x, d: F.struct(x.alias("a"), d.alias("d"))), "doc_id")
    start = F.col("x.a.s") + F.col("x.d")
    return each.select("doc_id", F.col(f"x.a.{id_col}").alias(id_col), F.col("x.a.s").alias("start_offset"), F.col("x.a.e").alias("end_offset"), start.alias("new_start"), (start + F.length("x.a.r")).alias("new_end"), F.col("x.a.r").alias("replacement"))


def mapped_spans(spans: DataFrame, docs: DataFrame, edits: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds new_start and new_end to spans (doc_id, start_offset, end_offset): their place in the revised text; null where an edit changed a part of them.

    A document's edits come to its spans in one sorted array with their running differences.
    """
    rows = with_applied(docs, edits, text).withColumn("moved", T.running(F.transform("applied", lambda x: F.length(x["r"]) - (x["e"] - x["s"]))))
    steps = F.zip_with("applied", "moved", lambda x, d: F.struct(x["s"].alias("s"), x["e"].alias("e"), (d + F.length(x["r"]) - (x["e"] - x["s"])).alias("after")))
    joined = spans.join(rows.select("doc_id", steps.alias("_steps")).hint("merge"), "doc_id", "left")
    earlier = F.filter("_steps", lambda x: x["e"] <= F.col("start_offset"))
    touched = F.exists("_steps", lambda x: (x["s"] < F.col("end_offset")) & (x["e"] > F.col("start_offset")))
    by = F.coalesce(F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["after"]), F.lit(0))
    out = joined.withColumn("_by", F.when(~F.coalesce(touched, F.lit(False)), by))
    return out.withColumns({"new_start": F.col("start_offset") + F.col("_by"), "new_end": F.col("end_offset") + F.col("_by")}).drop("_by", "_steps")


def highlights(spans: DataFrame, docs: DataFrame, text: str = "full_text", id_col: str = "finding_id") -> DataFrame:
    """(doc_id, start_offset, end_offset, finding_id): each document cut into highlighted spans and the stretches between, which have no id.

    Spans (doc_id, start_offset, end_offset, finding_id) are taken by place, the longer
    of those that begin together first (then by id), if they overlap none taken
    before; what is out of bounds or empty is left out.
    """
    item = F.struct(F.col("start_offset").alias("s"), (-F.col("end_offset")).alias("k"), F.col(id_col).alias("id"), F.col("end_offset").alias("e"))
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    kind = listed.schema["m"].dataType
    rows = docs.select("doc_id", F.length(text).alias("n")).join(listed.hint("merge"), "doc_id", "left")
    fit = F.filter(F.coalesce("m", F.array().cast(kind)), lambda x: (x["s"] >= 0) & (x["e"] > x["s"]) & (x["e"] <= F.col("n")))
    rows = rows.withColumn("c", apart(fit, kind))
    one = lambda s, e, i: F.struct(s.cast("int").alias("start_offset"), e.cast("int").alias("end_offset"), i.cast("string").alias(id_col))
    before = lambda i: F.when(i > 0, F.get("c", i - 1)["e"]).otherwise(0)
    marked = F.flatten(F.transform("c", lambda x, i: F.array(one(before(i), x["s"], F.lit(None)), one(x["s"], x["e"], x["id"]))))
    last = F.array(one(F.when(F.size("c") > 0, F.element_at("c", -1)["e"]).otherwise(0), F.col("n"), F.lit(None)))
    return T.each(rows, F.concat(marked, last), "doc_id").select("doc_id", "x.*").filter("end_offset > start_offset")


def gaps(spans: DataFrame, docs: DataFrame, text: str = "full_text") -> DataFrame:
    """(doc_id, start_offset, end_offset, marked): a document cut into marked spans and the stretches between; overlapping spans are one."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("start_offset", "end_offset")
    reach = F.coalesce(F.max("end_offset").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    island = F.sum((F.col("start_offset") > F.col("_r")).cast("int")).over(order)
    merged = spans.select("doc_id", "start_offset", "end_offset").withColumn("_r", reach).withColumn("_i", island).groupBy("doc_id", "_i").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset")).drop("_i")
    listed = merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "end_offset"))).alias("m"))
    rows = docs.select("doc_id", F.length(text).alias("n")).join(listed.hint("merge"), "doc_id", "left").withColumn("m", F.coalesce("m", F.array().cast(listed.schema["m"].dataType)))
    edge = F.concat(F.array(F.lit(0)), F.flatten(F.transform("m", lambda x: F.array(x["start_offset"], x["end_offset"]))), F.array(F.col("n")))
    parts = F.transform(F.sequence(F.lit(0), F.size(edge) - 2), lambda i: F.struct(F.get(edge, i).alias("start_offset"), F.get(edge, i + 1).alias("end_offset"), (i % 2 == 1).alias("marked")))
    return rows.select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.*").filter("end_offset > start_offset")
