"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="coppice-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: what is above it isn't computed again, even if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner find out which shuffles nothing refers to any more, and delete their files; by itself it does so when the driver's memory fills up or after half an hour."""
    spark._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The same rows from Parquet files in the shared folder, which are deleted afterwards: smaller than a checkpoint, for results that are made at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    freed(spark)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        removed(spark, path)
