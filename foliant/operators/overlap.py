"""Passages of a source set inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Up to so many passages (with their texts, of so many characters in all) are broadcast; more are shuffled.
BROADCAST_PASSAGES, BROADCAST_CHARS = 5_000, 20_000_000
#: Up to so many passages of few words are looked for in each document as they are.
SHORT_PASSAGES = 500
WORDS, CHARS = 5, 15


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start_offset, end_offset): first place of each passage in each document, case aside.

    docs (doc_id, body) and passages (item_id, passage) are layout-normalised;
    passages of under fifteen characters are not looked for. Candidates meet in an
    equi-join on hashes of words: of the second to sixth word of a passage (its
    first and last may be cut). Passages of up to six words are looked for in each
    document if they are few, else they meet on a hash of their first fifteen
    characters. What meets is then looked up in the text.
    """
    items = passages.select("item_id", F.lower("passage").alias("p")).filter(F.length("p") >= CHARS).withColumn("w", F.split("p", " "))
    long, short = items.filter(F.size("w") > WORDS + 1), items.filter(F.size("w") <= WORDS + 1)
    sizes = items.agg(F.count("*"), F.sum(F.length("p")), F.count_if(F.size("w") <= WORDS + 1)).first()
    few = sizes[0] <= BROADCAST_PASSAGES and (sizes[1] or 0) <= BROADCAST_CHARS
    body = docs.select("doc_id", F.lower("body").alias("b"))

    def met(keys: DataFrame, grams) -> DataFrame:
        # only ids and hashes travel with the grams; texts come back for the pairs that match
        candidates = T.each(body.withColumn("w", F.split("b", " ")), grams, "doc_id", name="key")
        pairs = candidates.join(F.broadcast(keys) if few else keys.hint("merge"), "key").select("doc_id", "item_id").distinct()
        texts = items.select("item_id", "p")
        full = pairs.join(body.hint("merge"), "doc_id").join(F.broadcast(texts) if few else texts.hint("merge"), "item_id")
        return full.select("doc_id", "item_id", "p", F.expr("instr(b, p)").alias("at")).filter("at > 0")

    starts = lambda n, size: F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    found = met(long.select("item_id", F.xxhash64(F.slice("w", 2, WORDS)).alias("key")), F.array_distinct(F.transform(starts(F.size("w"), WORDS), lambda i: F.xxhash64(F.slice("w", i, WORDS)))))
    if 0 < sizes[2] <= SHORT_PASSAGES:
        wanted = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["p"]).alias("p")) for r in short.select("item_id", "p").collect()])
        here = T.each(body, F.filter(wanted, lambda x: F.contains("b", x["p"])), "doc_id", "b")
        found = found.unionByName(here.select("doc_id", F.col("x.item_id").alias("item_id"), F.col("x.p").alias("p"), F.expr("instr(b, x.p)").alias("at")))
    elif sizes[2]:
        grams = F.array_distinct(F.transform(starts(F.length("b"), CHARS), lambda i: F.xxhash64(F.substring("b", i, F.lit(CHARS)))))
        found = found.unionByName(met(short.select("item_id", F.xxhash64(F.substring("p", 1, CHARS)).alias("key")), grams))
    return found.select("doc_id", "item_id", (F.col("at") - 1).alias("start_offset"), (F.col("at") - 1 + F.length("p")).alias("end_offset"))


def coverage(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_hits, covered, covered_pct): characters of a document in any hit, overlaps counted once."""
    order = W.partitionBy("doc_id").orderBy("start_offset", "end_offset", "item_id")
    reach = F.coalesce(F.max("end_offset").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end_offset") - F.greatest("start_offset", reach))
    sums = hits.withColumn("new", new).groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.sum("new").alias("covered"))
    return sums.join(docs.select("doc_id", F.length("body").alias("n")).hint("merge"), "doc_id").select("doc_id", "n_hits", "covered", F.round(100.0 * F.col("covered") / F.col("n"), 4).alias("covered_pct"))
