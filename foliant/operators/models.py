"""Baselines trained with Spark ML: text classification and ranking of findings."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.corpus import split_name
from foliant.sources.shared import stored


def text_baseline(rows: DataFrame, features: int = 1 << 14) -> DataFrame:
    """(row_id, split, label, score): logistic regression on weighted words and word pairs, fitted to the train split by hash of the id.

    Terms are hashed, so no vocabulary is gathered on the driver.
    """
    rows = rows.withColumn("split", split_name("row_id"))
    stages = [RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\s+"), NGram(n=2, inputCol="w1", outputCol="w2")]
    for k in ("1", "2"):
        stages += [HashingTF(inputCol=f"w{k}", outputCol=f"tf{k}", numFeatures=features), IDF(inputCol=f"tf{k}", outputCol=f"x{k}", minDocFreq=3)]
    stages += [VectorAssembler(inputCols=["x1", "x2"], outputCol="features"), LogisticRegression(regParam=0.01, maxIter=20, labelCol="label")]
    model = Pipeline(stages=stages).fit(rows.filter("split = 'train'"))
    return model.transform(rows).select("row_id", "split", "label", F.round(vector_to_array("probability")[1], 6).alias("score"))


def finding_ranker(rows: DataFrame, columns: list[str], folds: int = 5) -> DataFrame:
    """(row_id, fold, label, score): gradient-boosted trees, each row scored by the model that did not see its fold; folds by hash of the id within a label.

    Each fold's model reads the rows many times, so their columns are written once.
    """
    rows = stored(rows.select("row_id", "label", *columns), "ranked")
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("label").cast("string"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.withColumn("fold", fold)).select("row_id", "fold", F.col("label").cast("double").alias("label"), "features")
    out = None
    for k in range(folds):
        model = GBTClassifier(maxIter=5, maxDepth=3, seed=7).fit(data.filter(F.col("fold") != k))
        part = model.transform(data.filter(F.col("fold") == k)).select("row_id", "fold", F.col("label").cast("int").alias("label"), F.round(vector_to_array("probability")[1], 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
