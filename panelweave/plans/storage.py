"""Tables written in the folder that driver and executors share.

Iterative plans cut their lineage here: a written table survives the loss of
an executor, which a local checkpoint does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Paths that this process was given, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary folder, in local mode only: elsewhere executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jsc.get() if jsc.isDefined() else None
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="panelweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_with(df: DataFrame, name: str, facts: dict[str, Column]) -> tuple[DataFrame, dict]:
    """As durable(), and aggregates of the rows, observed while they are written."""
    seen = Observation()
    out = durable(df.observe(seen, *(c.alias(n) for n, c in facts.items())), name)
    return out, seen.get


def written(spark: SparkSession) -> list[str]:
    """Paths that place() gave and nobody dropped."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove what stands at paths of place(). Nothing that reads it may run afterwards."""
    known = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        known.remove(path)
