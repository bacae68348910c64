"""Intermediate tables in the shared folder: lineage ends there, and no lost executor takes rows away."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables that were written in this process and not deleted yet.
WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session
    gets a temporary folder; on a cluster that is a ValueError, as executors could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
        base = tempfile.mkdtemp(prefix="slatework-")
    WRITTEN.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}-{name}")
    return WRITTEN[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables. Results may read them until they are computed, so this is for
    whoever has written or collected a result."""
    for path in list(WRITTEN):
        delete(spark, path)
