"""Results that several jobs read: written once to the shared folder, so that lineage stays short and lost executors cost little."""

from __future__ import annotations

import atexit
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_tops: set[str] = set()


def folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir, if the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def reused(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which goes when the driver ends; without such a folder, kept by the executors."""
    spark = df.sparkSession
    top = folder(spark)
    if not top:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    top = f"{top}/driftline-passes/{spark.sparkContext.applicationId}"
    if top not in _tops:
        _tops.add(top)
        atexit.register(_remove, spark, top)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, top: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
