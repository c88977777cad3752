"""Tables in the shared folder: they cut lineage, survive lost executors and know their size."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str = "table") -> str:
    """A new folder, not yet made, under ``spark.checkpoint.dir``; under a temporary one where a local
    session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="docloom-")


def stored(df: DataFrame) -> DataFrame:
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
