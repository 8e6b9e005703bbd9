"""Loading and storing: pages, admission, nested and wide records, splits, projects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and corrupt lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # Spark refuses a query that reads the corrupt column alone, so a field of the schema is named with it
    return rows.filter("_corrupt IS NULL").select(*[c for c in rows.columns if c != "_corrupt"])


def first_present(rows: DataFrame, name: str, candidates: list[str]) -> DataFrame:
    """Adds ``name``: the first value among those candidate columns that there are."""
    there = [F.col(c) for c in candidates if c in rows.columns]
    if not there:
        raise ValueError(f"none of {candidates} is a column")
    return rows.withColumn(name, F.coalesce(*there))


def with_page_offsets(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """Adds start_offset and end_offset of each page in the document that its pages make, a blank between."""
    before = W.partitionBy(doc).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("int")
    return pages.withColumn("start_offset", start).withColumn("end_offset", start + F.length(text))


def head_and_tail(pages: DataFrame, doc: str, page: str, cap: int = 160) -> DataFrame:
    """Of documents with more than ``cap`` pages the first ones and the last third, 48 at most."""
    tail = min(48, cap // 3)
    doc_w = W.partitionBy(doc)
    rows = pages.withColumns({"_n": F.row_number().over(doc_w.orderBy(page)), "_all": F.count("*").over(doc_w)})
    return rows.filter((F.col("_all") <= cap) | (F.col("_n") <= cap - tail) | (F.col("_n") > F.col("_all") - tail)).drop("_n", "_all")


def admission(docs: DataFrame, most: int, warn: int, text: str = "text") -> DataFrame:
    """Adds ``status``: empty, too_large, large or ok. What is not admitted goes to a table of its own, it is not lost."""
    n = F.length(F.trim(text))
    return docs.withColumn("status", F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(F.length(text) > most, "too_large").when(F.length(text) > warn, "large").otherwise("ok"))


def long_labels(rows: DataFrame, key: str, heads: list[str]) -> DataFrame:
    """(key, head, label): a wide record of labels as rows, nulls left out."""
    return rows.unpivot([key], heads, "head", "label").filter("label IS NOT NULL")


def owned(projects: DataFrame, user) -> DataFrame:
    """A user sees only projects of their own."""
    return projects.filter(F.col("user_id") == F.lit(user))


def write_splits(rows: DataFrame, path: str, splits: list[str], labels: list[str], split: str = "split", label: str = "label") -> dict[tuple[str, str], int]:
    """JSON lines under ``path``/rows, a folder for each split, and under ``path``/counts the rows of each split and label; gives these counts.

    The rows are counted as they are written, by the write itself; no second pass.
    The counts follow it, so a write that fails leaves none. What is in no named
    split or label counts as ``other``.
    """
    pairs = [(s, y) for s in splits for y in labels]
    at = {p: (F.col(split) == p[0]) & F.coalesce(F.col(label).cast("string") == p[1], F.lit(False)) for p in pairs}
    seen = Observation(f"written-{uuid.uuid4().hex}")
    metrics = [F.count_if(c).alias(f"n{k}") for k, c in enumerate(at.values())]
    # a session that has observed can't be serialised any more, which plans of Spark ML need; so another session observes
    view = f"written_{uuid.uuid4().hex}"
    rows.createGlobalTempView(view)
    try:
        same = rows.sparkSession.newSession().table(f"global_temp.{view}")
        same.observe(seen, F.count(F.lit(1)).alias("all"), *metrics).write.mode("overwrite").partitionBy(split).json(f"{path}/rows")
    finally:
        rows.sparkSession.catalog.dropGlobalTempView(view)
    got = {p: seen.get[f"n{k}"] for k, p in enumerate(pairs)}
    rest = seen.get["all"] - sum(got.values())
    if rest:
        got["other", "other"] = rest
    spark = rows.sparkSession
    spark.createDataFrame([(s, y, n) for (s, y), n in got.items()], "split string, label string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    return got


def append_history(rows: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's rows to a history; a run that is written again replaces itself."""
    rows.write.mode("overwrite").json(f"{path}/run={run_id}")


def labelled_csv(spark: SparkSession, path: str, text: str, label: str, source: str) -> DataFrame:
    """(text, label, source) of CSV files with a header, fields over several lines allowed; labels are turned round (1 - label)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col(text).alias("text"), (1 - F.col(label).cast("int")).alias("label"), F.lit(source).alias("source"))


def csv_folder(spark: SparkSession, path: str, text: str, label: str, test_share: int = 15) -> DataFrame:
    """(text, label, split) of a folder of CSV files: test where a file's name says so, train where another does; if no name says test, a share by hash of the text."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.lower(F.col("_metadata.file_name")).alias("_f"))
    has_test = named.filter(F.contains("_f", F.lit("test"))).limit(1).count() > 0
    by_hash = F.pmod(F.xxhash64("text"), F.lit(100)) < test_share
    test = F.contains("_f", F.lit("test")) if has_test else by_hash
    return named.select("text", "label", F.when(test, "test").otherwise("train").alias("split"))


def answer_rows(records: DataFrame, key: str, arrays: dict[str, int]) -> DataFrame:
    """(key, place, label, text): the elements of several arrays of texts as rows, each array with its label."""
    out = None
    for name, label in arrays.items():
        rows = T.each(records, name, key, name="text", place="place").select(key, "place", F.lit(label).alias("label"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def strided(rows: DataFrame, key: str, stride: int) -> DataFrame:
    """Every so many-th row, by a hash of its key: the same rows in every order and run."""
    return rows.filter(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(stride)) == 0)
