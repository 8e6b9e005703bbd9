"""What the operators of this subpackage share: the shared folder and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Only where that setting is unset and the master is local (tests) a temporary
    folder of the machine stands in for it; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="foliant-"))
    return _OWN[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, gives the planner
    true sizes, and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts fit a Python worker.

    The same values for all operators, as plans run later than they are made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def salted(rows: DataFrame, groups: DataFrame, on: str, parts: int = 8) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row a value of ``on``; no null), where a third of all rows may have one value.

    Each value's rows are spread over ``parts`` tasks by a hash of all columns
    that can be hashed, and its row of ``groups`` is sent to each of them. Sort-merge:
    the size of exploded tables is not known to the planner.
    """
    spread = F.pmod(F.hash(*[c for c, k in rows.dtypes if c != on and not k.startswith("map")]), F.lit(parts)).alias("_part")
    copies = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    return rows.select("*", spread).join(copies.hint("merge"), [on, "_part"]).drop("_part")


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
