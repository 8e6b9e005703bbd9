"""Evaluation of predictions: counts, metrics, threshold choice, ranking measures, gates.

Predictions are rows (row_id, label 0/1, score 0..1, and what slices them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Ranges of a score over which running sums are split, so that no window holds all rows.
PARTS = 256


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and f05 to rows with tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    counts = counts.withColumns({"precision": p, "recall": r})
    f = lambda b2: ratio((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall"))
    return counts.withColumns({"f1": f(1.0), "f05": f(0.25)})


def confusion(predictions: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn and the measures at a threshold, of all rows or of each slice."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    counts = predictions.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    return measures(counts)


def sweep(predictions: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """(by, threshold, tp, fp, fn, measures) for each threshold of a rising grid.

    Each row is counted once, at the number of thresholds that it reaches;
    running sums over the grid then give every threshold's counts.
    """
    reached = sum((F.col("score") >= t).cast("int") for t in grid)
    counts = predictions.groupBy(*by, reached.alias("reached")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("n"))
    listed = counts.groupBy(*by).agg(F.collect_list(F.struct("reached", "pos", "n")).alias("c"), F.sum("pos").alias("positives"))
    above = lambda what, i: F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.when(x["reached"] > i, x[what]).otherwise(F.lit(0)))
    rows = listed.select(*by, "positives", F.posexplode(F.transform(F.array(*[F.lit(t) for t in grid]), lambda t, i: F.struct(t.alias("threshold"), above("pos", i).alias("tp"), above("n", i).alias("n")))).alias("i", "x"))
    rows = rows.select(*by, "x.threshold", F.col("x.tp").alias("tp"), (F.col("x.n") - F.col("x.tp")).alias("fp"), (F.col("positives") - F.col("x.tp")).alias("fn"))
    return measures(rows)


def chosen(swept: DataFrame, target: float, *by: str) -> DataFrame:
    """Of each sweep the threshold of greatest recall whose precision reaches the target, else of greatest precision; the lower of equals."""
    good = F.col("precision") >= target
    order = [F.desc(good), F.desc(F.when(good, F.col("recall")).otherwise(F.col("precision"))), F.desc("recall"), F.asc("threshold")]
    keys = [*by] or [F.lit(0)]
    return swept.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def _by_score(predictions: DataFrame, *by: str) -> DataFrame:
    """(by, score, pos, neg, pos_above, neg_above): counts at each score and at greater ones.

    Running sums go over ranges of scores first, then inside each range.
    """
    part = F.least(F.lit(PARTS - 1), F.floor(F.col("score") * PARTS)).cast("int")
    at = predictions.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).withColumn("part", part)
    sums = at.groupBy(*by, "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = W.partitionBy(*by or [F.lit(0)]).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"))
    inside = W.partitionBy(*by, "part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    both = at.join(sums.hint("merge"), [*by, "part"])
    return both.withColumns({"pos_above": F.col("p") + F.coalesce(F.sum("pos").over(inside), F.lit(0)), "neg_above": F.col("n") + F.coalesce(F.sum("neg").over(inside), F.lit(0))}).drop("p", "n", "part")


def roc_auc(predictions: DataFrame, *by: str) -> DataFrame:
    """(by, n, auc): the chance that a positive scores above a negative, ties counting half; null with one class only."""
    rows = _by_score(predictions, *by)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + 0.5 * F.col("pos")))
    pos, neg = F.sum("pos"), F.sum("neg")
    return rows.groupBy(*by).agg((pos + neg).alias("n"), F.when((pos > 0) & (neg > 0), wins / (pos * neg)).alias("auc"))


def average_precision(predictions: DataFrame, *by: str) -> DataFrame:
    """(by, average_precision): precision at each score, weighted by the recall that it adds."""
    rows = _by_score(predictions, *by)
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg"))
    return rows.groupBy(*by).agg(F.when(F.sum("pos") > 0, F.sum(precision * F.col("pos")) / F.sum("pos")).alias("average_precision"))


def one_of_classes(scores: DataFrame, thresholds: dict[str, float], other: str = "none") -> DataFrame:
    """Adds ``predicted``: of the columns named as classes the greatest, where it reaches its threshold, else ``other``; the first of equals."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("rank"), F.lit(c).alias("name"), F.lit(t).alias("least")) for i, (c, t) in enumerate(thresholds.items())]))
    return scores.withColumn("predicted", F.when(best["score"] >= best["least"], best["name"]).otherwise(F.lit(other)))


def class_report(rows: DataFrame, classes: list[str]) -> DataFrame:
    """(class, tp, fp, fn, measures): each class against the rest, from columns gold and predicted."""
    each = rows.select("gold", "predicted", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    is_, was = F.col("gold") == F.col("class"), F.col("predicted") == F.col("class")
    return measures(each.groupBy("class").agg(F.count_if(is_ & was).alias("tp"), F.count_if(~is_ & was).alias("fp"), F.count_if(is_ & ~was).alias("fn")))


def slices(rows: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """Of each slice: false-positive rate of its negatives, recall of its positives, rows."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    n_pos, n_neg = F.count_if(pos), F.count_if(~pos)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.count_if(hit & ~pos), n_neg).alias("fp_rate"), ratio(F.count_if(hit & pos), n_pos).alias("detect_recall"))


def ship_gate(model: DataFrame, rules: DataFrame, margin: float = 0.03, least: int = 300) -> DataFrame:
    """(n, model_auc, rules_auc, ships): whether the model beats the rules by the margin on enough labels."""
    both = roc_auc(model).select("n", "auc", F.lit(True).alias("m")).unionByName(roc_auc(rules).select("n", "auc", F.lit(False).alias("m")))
    of = lambda c, m: F.max(F.when(F.col("m") == m, F.col(c))).alias
    one = both.agg(of("n", True)("n"), of("auc", True)("model_auc"), of("auc", False)("rules_auc"))
    return one.withColumn("ships", F.coalesce((F.col("n") >= least) & (F.col("model_auc") > F.col("rules_auc") + margin), F.lit(False)))


def missing_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing): the share of nulls in each column."""
    one = rows.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.*")


def distinct_bigrams(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, bigrams, distinct_2): word pairs, and the share of them that differ; exact, from counts of each pair."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    pairs = T.each(texts.select(by, w.alias("w")).filter(F.size("w") > 1), F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))), by, name="pair")
    counts = pairs.groupBy(by, "pair").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.sum("n").alias("bigrams"), (F.count("*") / F.sum("n")).alias("distinct_2"))
