"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (in words). Each source's budget is met
first by whole copies of all its documents, then by the same share of every
length, and what is left over by a bounded-knapsack dynamic program over the
documents that remain at each length. Which documents of a length are taken is
settled by a seeded hash. Only counts of lengths reach a planning task; no task
ever holds the documents of a source or of a length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm._shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: The budget left for the dynamic program; more is spent on long documents first.
DP_WORDS = 1 << 17
#: Parts by hash of the documents of one source and length.
BUCKETS = 1024


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, so that the sum is the greatest that is at most ``budget``."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    made_by = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        if reach[budget]:
            break
        c, k = min(c, budget // n if n else 0), 1
        while c > 0:
            k = min(k, c)
            w = n * k
            new = np.flatnonzero(reach[: budget + 1 - w] & ~reach[w:]) + w
            made_by[new] = len(items)
            reach[new] = True
            items.append((i, k))
            c, k = c - k, 2 * k
    take, s = [0] * len(lengths), int(np.flatnonzero(reach)[-1])
    while s:
        i, k = items[made_by[s]]
        take[i] += k
        s -= lengths[i] * k
    return take


def fit(lengths: list[int], counts: list[int], budget: int, dp_words: int = DP_WORDS) -> list[int]:
    """Documents of each length whose sizes sum to ``budget``, or come as near below it as can be found."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = min(budget, total)
    if not total or budget <= 0:
        return [0] * len(lengths)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= dp_words:
            break
        k = min(counts[i] - take[i], left // max(lengths[i], 1)) if lengths[i] else 0
        take[i] += k
        left -= k * lengths[i]
    rest = [i for i in order if 0 < lengths[i] <= left and counts[i] > take[i]]
    if rest and left:
        for i, k in zip(rest, knapsack([lengths[i] for i in rest], [counts[i] - take[i] for i in rest], left), strict=True):
            take[i] += k
    return take


def targets(sizes: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes; none gets more than ``most`` times its size, and what
    is above goes to the others by weight until none is above: a water level,
    found by sorting the sources by the level at which they are full. These
    windows hold one row a source, not one a document.
    """
    n = len(weights)
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    full = F.col("source_size") * F.lit(float(most))
    rows = sizes.withColumn("turn", turn).withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[(F.col("turn") - 1) % n])
    rows = rows.withColumn("full", full).withColumn("full_at", F.col("full") / F.col("weight"))
    by_level, everything = W.orderBy("full_at", "turn"), W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("full").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "turn", "level"))).over(everything)
    return rows.withColumn("at", level["level"]).withColumn("target", F.coalesce(F.least("full", F.col("weight") * F.col("at")), "full")).select("source", "source_size", "target")


def mix(docs: DataFrame, seed: int = 7, weights=(1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Rows (id, size, source_size, target, taken, copies) for each row of ``docs``.

    ``size`` is the number of words of the text (null and empty: 0), ``taken``
    the words that the mix takes of the row: its size times 0 to ``most``. A
    null source is a source of its own, the last. Ties of the hash are settled
    by id; rows that are equal in id and text are taken one by one, and which
    of them is taken makes no difference; ``copies`` is how often. An empty table gives no rows.
    ``keep`` names further columns to carry along.
    """
    keep = keep or []
    size = F.coalesce(F.size(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n")).alias("key"),
        size.alias("size"), h.alias("h"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(BUCKETS)).cast("int").alias("bucket"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
    )
    sized = stored(sized, "sized")
    parts = stored(sized.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"), F.first("source").alias("source")), "parts")
    lengths = parts.groupBy("key", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    goals = targets(lengths.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size")).drop("key"), weights, float(most))
    goals = goals.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")

    def plan(rows):
        source_size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(int(target // source_size), most) if source_size else 0
        rest = 0 if whole >= most else round(target - whole * source_size)
        rows["whole"] = whole
        rows["extra"] = fit([int(x) for x in rows["size"]], [int(x) for x in rows["n"]], rest)
        return rows[["key", "size", "source_size", "target", "whole", "extra"]]

    plans = lengths.drop("source").join(goals.hint("merge"), "key").groupBy("key").applyInPandas(plan, "key string, size long, source_size long, target double, whole int, extra long")
    before = F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = parts.select("key", "size", "bucket", before.alias("before")).join(plans.hint("merge"), ["key", "size"])
    nth = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("h", "id"))
    copies = F.col("whole") + (F.col("before") + nth <= F.col("extra")).cast("int")
    out = sized.join(quotas.hint("merge"), ["key", "size", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *[F.col(f"kept.{c}").alias(c) for c in keep])


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it; see ``mix``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.select("*", *[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    rows = mix(held, keep=names, **how).filter("copies > 0")
    again = rows.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return again.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
