"""Tables written to the shared folder, so that several consumers read one computation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_ONCE: dict[tuple[str, str], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Only where that setting is unset and Spark runs in this one process (tests) a
    temporary folder of the machine stands in for it; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="foliant-"))
    return _OWN[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, sizes are known, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/foliant-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(key: str, make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """What ``make`` gives, written once for each application and key; later calls read that. Inputs must not change in between."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _ONCE:
        df = make()
        path = f"{shared_dir(spark)}/foliant-once-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        _ONCE[at] = (path, df.schema)
    path, schema = _ONCE[at]
    return spark.read.schema(schema).parquet(path)
