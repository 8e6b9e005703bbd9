"""Grammar review: raw matches of a checker become findings, noise goes, findings of one span are merged.

Matches are rows (doc_id, start_offset, length, rule_id, category_id,
category_name, message, replacements), offsets counting into the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import parse
from foliant.operators.review import quoted

# What is a technical token or a name and no mistake, categories that are about spelling, and those that are dropped.
ACRONYM = r"^[A-Z][A-Z0-9-]{1,9}$"
UNIT = (
    r"(?i)^(?:nm|µm|um|mm|cm|km|pm|fm|Å|angstrom|kg|g|mg|µg|ug|ng|pg|Hz|kHz|MHz|GHz|THz|eV|meV|keV|MeV|GeV|Pa|kPa|MPa|GPa|mA|µA|uA|nA|pA|V|mV|kV|W|mW|kW|dB|dBm|Ω|ohm|mol|mmol|µM|uM|nM|pM|K|°C|C|F|Torr|mbar|bar|sccm|rpm|arb\.?u\.?|a\.?u\.?|wt%|at%|vol%)$"
)
FORMULA_BODY, FORMULA_MIXED = r"^[A-Za-z][A-Za-z0-9().-]{0,24}$", r"^[A-Z][a-z]?(?:[A-Z][a-z]?\d*)+$"
SHORT, SHORT_WORDS = r"^[A-Za-zµμΩÅ]{1,3}$", r"(?i)^(?:a|an|the|is|are|was|were|be|to|of|in|on|or|and|not|for|as|by|at|it|if|so|do|we|us|my)$"
NAMES = [
    r"^\[\d+(?:\s*[-–,]\s*\d+)*(?:\s*,\s*\d+(?:\s*[-–,]\s*\d+)*)*\]$", r"^\(\s*[A-Z][A-Za-z0-9_'’-]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z]?[A-Za-z0-9_'’.-]+)*,?\s*\d{4}[a-z]?\s*\)$", r"(?i)^(?:[A-Z][a-z'’-]+(?:\s+[A-Z]\.?)?\s+)?et\s+al\.?$",
    r"^[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+){1,3}$", r"^(?:[A-Z]\.\s*){1,3}[A-Z][a-z'’-]+$", r"^[A-Z][a-z'’-]+(?:\s*,\s*[A-Z][a-z'’-]+)+(?:\s*,?\s*(?:and|&)\s*[A-Z][a-z'’-]+)?$",
]
SPELLING = ["TYPOS", "MISC"]
DROPPED = ["STYLE", "REDUNDANCY", "COLLOQUIALISMS", "BRITISH_ENGLISH", "AMERICAN_ENGLISH_STYLE", "PLAIN_ENGLISH", "WIKIPEDIA", "NONSTANDARD_PHRASES", "CASING", "TYPOGRAPHY", "PUNCTUATION", "CONFUSED_WORDS"]
MOST_EXPANDED, CONFIDENCE, REVIEWED, CHUNK = 320, 0.85, 40, 6000


def technical(token: Column) -> Column:
    """Acronyms, units, formulas, and tokens of up to three letters that are no common word."""
    return (token != "") & (token.rlike(ACRONYM) | token.rlike(UNIT) | (token.rlike(FORMULA_BODY) & token.rlike(r"\d")) | token.rlike(FORMULA_MIXED) | (token.rlike(SHORT) & ~token.rlike(SHORT_WORDS)))


def name_noise(token: Column) -> Column:
    """Citation markers, names of persons, lists of authors."""
    out = token.rlike(NAMES[0])
    for p in NAMES[1:]:
        out |= token.rlike(p)
    return (token != "") & out


def review(matches: DataFrame, docs: DataFrame, text: str = "full_text") -> DataFrame:
    """(doc_id, start_offset, end_offset, page, text, explanation, replacement, rule_id, confidence, match_start) of matches that are worth a look.

    Dropped are matches without length or out of bounds, in quotes, of technical
    tokens, names and markers, of categories about style; and of spelling those of
    up to three letters and of words that recur in the document. What is no
    spelling is shown with its whole sentence, if that has at most 320 characters;
    then no replacement stands. A document meets its matches once; sentences and
    recurring words come from its own row, in which places are found by halving
    and texts are cut from slices, so that the work grows with its matches and not
    with their number times its length. What the matched text alone rules out goes
    first; recurring words are asked for spelling, sentences for the rest.
    """
    m = F.struct("start_offset", "length", "rule_id", "category_id", "category_name", "message", "replacements")
    rows = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(m)).alias("m")).join(docs.select("doc_id", text).hint("merge"), "doc_id")
    # words of up to three letters are noise in any case
    pieces, words = T.sentence_pieces(text), F.sort_array(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{4,}"), F.lit(0)))
    spelt = lambda x: x["category_id"].isin(SPELLING) | x["rule_id"].rlike("(?i)MORFOLOGIK")
    of = F.struct(F.length(text).alias("n"), T.slices(text).alias("slices"), words.alias("w"), pieces.alias("p"))

    def one(d, at, y):
        x, token = y["x"], y["t"]
        start, end = x["start_offset"], x["start_offset"] + x["length"]
        sentence = lambda i: F.struct(F.get(at, i).alias("s"), F.rtrim(F.get(d["p"], i)).alias("t"))
        flagged = lambda t: F.struct(t.alias("t"), T.rank(d["w"], F.lower(F.trim(t))).alias("r"))
        # two of a word's places in the sorted words
        often = lambda f: F.coalesce((F.get(d["w"], f["r"] - 2) == F.lower(F.trim(f["t"]))), F.lit(False))
        return F.struct(
            x.alias("m"), T.between(d["slices"], F.greatest(start - 80, F.lit(0)), start).alias("before"), T.between(d["slices"], F.greatest(start - 2, F.lit(0)), end + 2).alias("around"),
            token.alias("flagged"), F.when(~spelt(x), F.lit(False)).otherwise(T.let(flagged(token), often)).alias("often"), F.when(spelt(x), F.lit(None)).otherwise(T.let(T.rank(at, start) - 1, sentence)).alias("sentence"),
        )

    inside = lambda d: F.filter("m", lambda x: ~x["category_id"].isin(DROPPED) & (x["length"] > 0) & (x["start_offset"] >= 0) & (x["start_offset"] + x["length"] <= d["n"]))
    worded = lambda d: F.transform(inside(d), lambda x: F.struct(x.alias("x"), T.between(d["slices"], x["start_offset"], x["start_offset"] + x["length"]).alias("t")))
    wanted = lambda d: F.filter(worded(d), lambda y: ~technical(F.trim(y["t"])) & ~name_noise(F.trim(y["t"])))
    found = T.let(of, lambda d: T.let(T.starts(d["p"]), lambda at: F.transform(wanted(d), lambda y: one(d, at, y))))
    each = T.each(rows, found, "doc_id").select("doc_id", "x.m.*", "x.before", "x.around", "x.flagged", "x.often", F.col("x.sentence.s").alias("_s"), F.col("x.sentence.t").alias("sentence"))
    start, end, token, size = F.col("start_offset"), F.col("start_offset") + F.col("length"), F.trim("flagged"), F.length("sentence")
    spelling = F.col("category_id").isin(SPELLING) | F.col("rule_id").rlike("(?i)MORFOLOGIK")
    noise = spelling & ((F.length(token) <= 3) | F.col("often"))
    kept = each.filter(~noise & ~quoted("before", F.col("around"), F.col("length")))
    wide = ~spelling & F.coalesce((F.col("_s") <= start) & (end <= F.col("_s") + size) & (size > F.col("length")) & (size <= MOST_EXPANDED), F.lit(False))
    kept = kept.withColumn("_wide", wide)
    return parse.at_page(kept.select(
        "doc_id", F.when(F.col("_wide"), F.col("_s")).otherwise(start).alias("start_offset"), F.when(F.col("_wide"), F.col("_s") + size).otherwise(end).alias("end_offset"), F.when(F.col("_wide"), F.col("sentence")).otherwise(F.col("flagged")).alias("text"),
        F.concat("category_name", F.lit(": "), "message").alias("explanation"), F.when(~F.col("_wide"), F.get("replacements", F.lit(0))).alias("replacement"), "rule_id", F.lit(CONFIDENCE).alias("confidence"), start.alias("match_start"),
    ))


def merged(found: DataFrame) -> DataFrame:
    """Findings of equal span made one: the surest (then the first) stays, the others' notes are added, and differing replacements cancel out."""
    item = F.struct((-F.col("confidence")).alias("c"), "match_start", "rule_id", "text", "page", "explanation", "replacement")
    groups = found.groupBy("doc_id", "start_offset", "end_offset").agg(F.array_sort(F.collect_list(item)).alias("g")).withColumn("b", F.get("g", F.lit(0)))
    notes = F.transform(F.filter("g", lambda x, i: (i > 0) & (x["explanation"] != F.col("b.explanation"))), lambda x: x["explanation"])
    same = F.forall("g", lambda x: x["replacement"].eqNullSafe(F.col("b.replacement")))
    return groups.select(
        "doc_id", "start_offset", "end_offset", "b.page", "b.text", F.when(F.size(notes) > 0, F.concat("b.explanation", F.lit("\nAlso here:\n• "), F.array_join(notes, "\n• "))).otherwise(F.col("b.explanation")).alias("explanation"),
        F.when(same, F.col("b.replacement")).alias("replacement"), (-F.col("b.c")).alias("confidence"), F.size("g").alias("n_merged"),
    )


def decided(found: DataFrame, decisions: DataFrame, reviewed: int = REVIEWED) -> DataFrame:
    """Findings without those that decisions (doc_id, start_offset, end_offset, keep) say to drop; what has no decision stays, as do those beyond the first ``reviewed`` of a document."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("start_offset", "end_offset"))
    drop = decisions.filter("NOT keep").select("doc_id", "start_offset", "end_offset", F.lit(True).alias("_drop"))
    rows = found.withColumn("_n", nth).join(drop.hint("merge"), ["doc_id", "start_offset", "end_offset"], "left")
    return rows.filter(F.col("_drop").isNull() | (F.col("_n") > reviewed)).drop("_n", "_drop")


def enclosing(spans: DataFrame, docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds sentence_index to spans (doc_id, start_offset, end_offset): the first sentence that holds a span, null if none does."""
    keep = [c for c in spans.columns if c != "doc_id"]
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*keep)).alias("m")).join(docs.select("doc_id", text).hint("merge"), "doc_id")

    def index(p, at, x):
        # the last sentence that begins at the span's start or before; an empty span may end the one before it
        holds = lambda i: (F.length(F.rtrim(F.get(p, i))) > 0) & (x["end_offset"] <= F.get(at, i) + F.length(F.rtrim(F.get(p, i))))
        return T.let(T.rank(at, x["start_offset"]) - 1, lambda i: F.when(holds(i - 1), i - 1).when(holds(i), i))

    found = T.let(T.sentence_pieces(text), lambda p: T.let(T.starts(p), lambda at: F.transform("m", lambda x: F.struct(x.alias("m"), index(p, at, x).alias("i")))))
    return T.each(listed, found, "doc_id").select("doc_id", "x.m.*", F.col("x.i").alias("sentence_index"))


def chunks(docs: DataFrame, target: int = CHUNK, text: str = "full_text") -> DataFrame:
    """(doc_id, start_offset, end_offset): consecutive sentences before the references, packed into stretches of at most ``target`` characters; a longer sentence stands alone."""
    main = parse.main_text(docs.select("doc_id", text), text)
    rows = main.withColumn("_p", T.sentence_pieces("main")).withColumn("_at", T.starts("_p"))
    spans = F.filter(F.zip_with("_p", "_at", lambda x, s: F.struct(s.alias("s"), (s + F.length(F.rtrim(x))).alias("e"))), lambda x: x["e"] > x["s"])
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc, x):
        new = acc["s"].isNull() | (x["e"] - acc["s"] > target)
        out = F.when(new & acc["s"].isNotNull(), F.array_append(acc["out"], F.struct(acc["s"].alias("s"), acc["e"].alias("e")))).otherwise(acc["out"])
        return F.struct(F.when(new, x["s"]).otherwise(acc["s"]).alias("s"), x["e"].alias("e"), out.alias("out"))

    start = F.struct(F.lit(None).cast("int").alias("s"), F.lit(0).alias("e"), none.alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.when(a["s"].isNotNull(), F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e")))).otherwise(a["out"]))
    return T.each(rows, done, "doc_id").select("doc_id", F.col("x.s").alias("start_offset"), F.col("x.e").alias("end_offset"))
