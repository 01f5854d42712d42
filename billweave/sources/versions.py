"""Tables whose files were written by different versions of a schema."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Column(NamedTuple):
    """A column of the newest version: its type, and what it is in files of versions that don't have it (null by default)."""

    name: str
    kind: str
    default: object = None


def version_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders ``version=...`` below ``path``, in order of the version's number."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [str(f.getPath().toString()) for f in there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(there) if f.getPath().getName().startswith("version=")]
    return sorted(found, key=lambda p: int(p.rpartition("=")[2]))


def read_versions(spark: SparkSession, path: str, columns: list[Column]) -> DataFrame:
    """All rows below ``path`` in the newest schema, with their ``version``.

    Files of one version share a schema; a version's columns are cast, and those it doesn't have get their default. A null in a
    version that has the column stays null. Columns that aren't asked for are not read.
    """
    parts = []
    for folder in version_folders(spark, path):
        old = spark.read.parquet(folder)
        have = {c.lower() for c in old.columns}
        own = [(F.col(c.name) if c.name.lower() in have else F.lit(c.default)).cast(c.kind).alias(c.name) for c in columns]
        parts.append(old.select(*own, F.lit(int(folder.rpartition("=")[2])).alias("version")))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c.name}` {c.kind}" for c in columns) + ", version int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
