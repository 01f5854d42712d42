"""Results kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A session on one machine without that setting gets a folder
    of its own; on a cluster it is an error."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def shared_path(spark: SparkSession, stem: str) -> str:
    """A new path in that folder."""
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, now, in the shared folder, so that later passes neither repeat it nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` computed once, now, as compressed files in the shared folder: a fraction of what ``cut`` takes, but no longer dealt by a key."""
    path = path or shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Folders of ``stored`` that no table is read from any more."""
    for path in paths:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
