"""Tables written to the folder that the driver and all executors share, so that they are computed once."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a local folder is set (local masters only)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_own_shared_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark._own_shared_dir = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later jobs neither recompute it nor lose it with an executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what materialise() wrote for tables that no later plan reads."""
    for df in tables:
        if df is not None and getattr(df, "_written", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def without_shuffles(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f of a table, while which Spark deletes the shuffle files of each job as it ends; else they stay until the driver happens to collect its garbage."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            return f(df, *args, **options)
        finally:
            conf.set(key, before)

    return run
