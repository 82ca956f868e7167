"""Tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the whole cluster sees; in local mode a temporary one where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that holds a path, and the path as an object of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in ascending order; none if it isn't there."""
    fs, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def create(spark: SparkSession, path: str) -> None:
    """An empty file, whose name is the message; fails if it is there."""
    fs, at = file_system(spark, path)
    if not fs.createNewFile(at):
        raise FileExistsError(path)


def clear(spark: SparkSession) -> None:
    """Deletes the steps that kept has written in this application; no table that reads them may be used afterwards."""
    fs, at = file_system(spark, f"{shared_dir(spark)}/steps")
    fs.delete(at, True)
