"""Building labelled corpora: validity, weak labels, chunks, deduplication, balance, splits, leakage guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import claims, parse


def order(*cols) -> Column:
    """A seeded order that any partitioning gives: by MD5 of the values, joined by colons."""
    return F.md5(F.concat_ws(":", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in cols]))


def key_prefix(text: str, n: int) -> Column:
    return F.lower(F.substring(text, 1, n))


def looks_valid(text: str = "text", chars: int = 180, letters: float = 0.6, words: int = 25) -> Column:
    """Long enough, mostly letters, enough words."""
    return (F.length(text) >= chars) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= letters * F.length(text)) & (T.word_count(text) >= words)


def first_of_each(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The row of least ``by`` for each key; partial minima go ahead of the shuffle, so a frequent key is no bottleneck."""
    least = rows.groupBy(key).agg(F.min(by).alias(by))
    return rows.join(least.hint("merge"), [key, by], "left_semi")


def sentence_chunks(docs: DataFrame, size: int = 3, least: int = 80, most: int = 1200, per_doc: int = 4, text: str = "body") -> DataFrame:
    """(doc_id, chunk, text): groups of consecutive sentences of fitting length, the first few of each document; no shuffle."""
    s = docs.select("doc_id", F.filter(T.sentences(text), lambda x: x != "").alias("s"))
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size("s") / size).cast("int") - 1), lambda k: F.struct(k.alias("chunk"), F.array_join(F.slice("s", k * size + 1, size), " ").alias("text")))
    kept = F.slice(F.filter(groups, lambda g: (F.length(g["text"]) >= least) & (F.length(g["text"]) <= most)), 1, per_doc)
    # as a filter the test would move to the scan, with the sentences made once more for it
    return T.each(s, F.when(F.size("s") > 0, kept), "doc_id").select("doc_id", "x.*")


def packed_passages(docs: DataFrame, target: int = 550, least: int = 180, most: int = 900, text: str = "body") -> DataFrame:
    """(doc_id, passage, text): consecutive sentences packed greedily until the target is reached; a fold over each document's sentences."""
    s = docs.select("doc_id", F.filter(T.sentences(text), lambda x: (x != "") & (F.length(x) <= most)).alias("s"))
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(" "), x))
        full = (acc["open"] != "") & (F.length(joined) > target)
        return F.struct(F.when(full, x).otherwise(joined).alias("open"), F.when(full, F.array_append(acc["out"], acc["open"])).otherwise(acc["out"]).alias("out"))

    folded = s.select("doc_id", F.aggregate("s", zero, step).alias("f"))
    every = F.when(F.col("f.open") != "", F.array_append("f.out", F.col("f.open"))).otherwise(F.col("f.out"))
    return T.each(folded, F.filter(every, lambda x: (F.length(x) >= least) & (F.length(x) <= most)), "doc_id", name="text", place="passage")


def weak_label(text: str = "text") -> Column:
    """One of four labels by wording: novelty without proof, weak reporting, vague numbers, none."""
    like = lambda p: F.col(text).rlike(T.words_at(p))
    novelty, vague = like(claims.NOVELTY) & ~like(claims.NOVELTY_SHOWN) & ~F.col(text).rlike(claims.GAIN), like(claims.VAGUE_NUMBER) & ~F.col(text).rlike(claims.PRECISE_NUMBER)
    # every label has one of these cues, which are looked for first
    return F.when(~F.col(text).rlike(claims.QUALITY_CUE), "none").when(novelty, "novelty").when(like(claims.WEAK_REPORT), "publication").when(vague, "numeric").otherwise("none")


MARKED = f"(?:{parse.BRACKET}|{parse.AUTHOR_YEAR})"


def citation_need_rows(sentences: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, text, label, hard): sentences labelled by whether they carry a citation, which is then taken out.

    ``hard`` marks sentences whose wording suggests the other label. Only
    sentences of 8 to 60 words that have a word of three letters stay.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", MARKED, ""), r"\s+([.,;])", "$1"), r"\s+", " ")
    cue = F.col("text").rlike(T.words_like("|".join(claims.ATTRIBUTION.values())))
    label = F.col("text").rlike(MARKED).cast("int")
    rows = sentences.withColumns({"label": label, "clean": F.trim(bare), "hard": F.when(label == 1, ~cue).otherwise(cue)})
    fit = T.word_count("clean").between(8, 60) & F.col("clean").rlike("[A-Za-z]{3}")
    return rows.filter(fit).select("doc_id", "sentence_index", F.col("clean").alias("text"), "label", "hard")


def leaked(rows: DataFrame) -> DataFrame:
    """(leaked): how many cleaned texts still carry a marker; a build must stop unless it is 0."""
    return rows.agg(F.count_if(F.col("text").rlike(MARKED)).alias("leaked"))


def first_n(rows: DataFrame, n: Column | int, by: list, *partition: str) -> DataFrame:
    """The first n rows of each partition in an order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*partition).orderBy(*by))).filter(F.col("_n") <= n).drop("_n")


def split_name(key, train: int = 80, validation: int = 10) -> Column:
    """train, validation or test by a hash of the key: stable, and a key is never in two."""
    share = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")


def unseen(rows: DataFrame, seen: DataFrame, key) -> DataFrame:
    """Rows whose key none of ``seen`` has."""
    return rows.withColumn("_k", key).join(seen.select(key.alias("_k")).distinct().hint("merge"), "_k", "left_anti").drop("_k")


def pair_rows(pairs: DataFrame, least: int = 20) -> DataFrame:
    """(pair_id, task, input, target): both long enough and different but for case, whitespace collapsed, clipped, in both directions."""
    collapse = lambda c: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 900)
    rows = pairs.select("pair_id", collapse("a").alias("a"), collapse("b").alias("b")).filter((F.length("a") >= least) & (F.length("b") >= least) & (F.lower("a") != F.lower("b")))
    return rows.select("pair_id", F.explode(F.array(F.struct(F.lit("forward").alias("task"), F.col("a").alias("input"), F.col("b").alias("target")), F.struct(F.lit("backward").alias("task"), F.col("b").alias("input"), F.col("a").alias("target")))).alias("x")).select("pair_id", "x.*")
