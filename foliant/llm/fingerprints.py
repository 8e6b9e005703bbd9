"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of ``K`` words, numbered by occurrence, so that each is
distinct, and hashed onto a ring. Each tuple has an ordering of its own: the ring
read from the tuple's starting point. The ``PARTS`` minimal k-mers of that
ordering are selected, put in the order in which the text has them and hashed
together. Two texts agree in a tuple if they select the same k-mers in the same
order, which words that are moved upset as much as words that are replaced. Each
k-mer is hashed once and the ring sorted once, however many tuples there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm._shared import shuffle_tasks, stored

K, TUPLES, PARTS = 2, 32, 2
#: Bits of a packed value that hold a k-mer's place; no Spark array has more entries. The others hold its hash.
PLACE_BITS = 31


def starting_points(tuples: int = TUPLES) -> list[int]:
    """Where each tuple's ordering begins: packed values without a place, spread by a golden-ratio sequence."""
    return [(((t + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) - (1 << 63) >> PLACE_BITS << PLACE_BITS for t in range(tuples)]


def with_signature(texts: DataFrame, text: str, name: str, k: int = K, tuples: int = TUPLES, parts: int = PARTS) -> DataFrame:
    """Adds ``name``, array<long>: the hashes of a text's tuples; equal texts have equal signatures.

    A text of fewer words than k has one k-mer, of all its words; an empty text
    has one of none; where there are fewer k-mers than ``parts``, tuples have all.
    Very long texts are treated alike: places have as many bits as an array can
    have entries. All is done on arrays of packed numbers, row by row: k-mers
    sorted by hash and place give each its occurrence number (that of its equals
    before it), numbered k-mers sorted by hash are the ring, and a tuple's
    starting point is found in it by binary search. Nothing is exploded, shuffled
    or spilled. Hashes are of 33 bits; two k-mers of one text that share one count
    as the same k-mer.
    """
    places = (1 << PLACE_BITS) - 1
    words, first, ring, powers = (f"_{name}_{x}" for x in ("words", "first", "ring", "powers"))
    top = lambda h: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS)
    of = lambda x: F.shiftright(x, PLACE_BITS)
    kmer = lambda i: F.xxhash64(*[F.try_element_at(words, i + 1 + j) for j in range(k)])
    packed = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: top(kmer(i)).bitwiseOR(i.cast("long")))
    rows = texts.withColumn(words, F.filter(F.split(text, r"[\x09-\x0D\x20]+"), lambda w: w != "")).withColumn(first, F.sort_array(packed)).drop(words)
    # the powers of two up to the number of k-mers, falling, for binary searches
    all_powers = F.array(*[F.lit(1 << b) for b in range(PLACE_BITS - 1, -1, -1)])
    rows = rows.withColumn(powers, F.filter(all_powers, lambda d: d <= F.size(first)))
    # columns that lambdas use are named several times, which keeps the planner from moving their making into the lambda
    search = lambda begin, step: F.when(F.size(powers) > 0, F.aggregate(powers, begin, step))

    def nth(x, j):
        equal = lambda at: of(F.get(first, at)) == of(x)
        begin = search(j, lambda at, d: F.when((at >= d) & equal(at - d), at - d).otherwise(at))
        return F.when((j > 0) & equal(j - 1), j - begin).otherwise(F.lit(0))

    rows = rows.withColumn(ring, F.sort_array(F.transform(first, lambda x, j: top(F.xxhash64(of(x), nth(x, j))).bitwiseOR(x.bitwiseAND(F.lit(places)))))).drop(first)
    n = F.size(ring)

    def one(start):
        at = search(F.lit(0), lambda at, d: F.when((at + d <= n) & (F.get(ring, at + d - 1) < start), at + d).otherwise(at))
        chosen = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(parts)) - 1), lambda j: F.get(ring, F.pmod(at + j, n)))
        in_order = F.sort_array(F.transform(chosen, lambda v: F.shiftleft(v, 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(v, PLACE_BITS))))
        return F.xxhash64(F.transform(in_order, lambda v: v.bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1))))

    return rows.withColumn(name, F.transform(F.array(*[F.lit(x) for x in starting_points(tuples)]), one)).drop(ring, powers)


def likeness(a, b):
    """The share of tuples that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def following(ids: DataFrame, tasks: int) -> DataFrame:
    """Rows (id, next_id) of distinct ids (id): the next larger, after the largest the smallest.

    Ids are sorted into ranges once and written with their range, so that the
    ranges hold still; each range finds its neighbours, and the first id of the
    next range (one row a range) closes the gaps.
    """
    ranged = stored(ids.repartitionByRange(tasks, "id").select("id", F.spark_partition_id().alias("range")), "ids")
    firsts = ranged.groupBy("range").agg(F.min("id").alias("first"))
    over = W.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    inside = ranged.withColumn("next_id", F.lead("id").over(W.partitionBy("range").orderBy("id")))
    return inside.join(firsts.hint("merge"), "range").select("id", F.coalesce("next_id", "after").alias("next_id"))


def compare(docs: DataFrame, k: int = K, tuples: int = TUPLES, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text has the last quarter of the code points (rounded down)
    replaced by as many from the beginning of the next document by id, or all of
    it if it is shorter; after the last comes the first. Fingerprints are the
    hashes of the tuples in hexadecimal, joined by dashes.

    Null texts count as empty. Several rows with one id are told apart by their
    texts; the next document is then the row with the least text. A row without
    id has no next document: nothing replaces what it loses, and near_next is 0.
    Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    tasks = shuffle_tasks(docs.sparkSession)
    known, text = F.col(id_col).isNotNull(), F.coalesce(text_col, F.lit(""))
    quarter = lambda t: F.floor(F.length(t) / 4).cast("int")
    # how much of the next document is wanted depends on the longest row of the id
    ids = docs.filter(known).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(quarter(text)).alias("quarter"))
    ids = stored(ids, "quarters")
    pairs = following(ids.select("id"), tasks).join(ids.hint("merge"), "id").select(F.col("id").alias("for_id"), "quarter", F.col("next_id").alias("id"))
    # rows without id are spread by their text; texts are dealt out by id once, for both joins
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("id"), known.alias("known"), text.alias("text")).repartition(tasks, "id")
    base = base.withColumn("row", F.row_number().over(W.partitionBy("id").orderBy(F.desc("known"), "text")))
    heads = base.join(pairs.hint("merge"), "id").filter("known AND row = 1").select(F.col("for_id").alias("id"), F.substring("text", F.lit(1), F.col("quarter")).alias("head"), F.col("id").alias("next_id"))
    n = F.length("text")
    head = F.when(F.col("known"), F.col("head"))
    edited = F.concat(F.substring("text", F.lit(1), n - quarter("text")), F.substring(F.coalesce(head, F.lit("")), F.lit(1), quarter("text")))
    both = base.join(heads.hint("merge"), "id", "left").select("id", "known", "row", F.when(F.col("known"), F.col("next_id")).alias("next_id"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = with_signature(both.withColumn("edited_sha256", F.sha2("edited", 256)), "text", "mine", k, tuples, parts).drop("text")
    prints = stored(with_signature(both, "edited", "other", k, tuples, parts).drop("edited"), "prints")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 16, "0")), "-")
    neighbour = prints.filter("known AND row = 1").select(F.col("id").alias("next_id"), F.col("mine").alias("following"))
    joined = prints.join(neighbour.hint("merge"), "next_id", "left")
    return joined.select(
        F.when(F.col("known"), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256", shown("mine").alias("fingerprint"), shown("other").alias("edited_fingerprint"),
        likeness("mine", "other").alias("near_edited"), F.when(F.col("following").isNull(), 0.0).otherwise(likeness("mine", "following")).alias("near_next"),
    )
