"""Fresh folders in the store that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below ``spark.checkpoint.dir``; nothing is there yet.

    Only where that setting is unset and everything runs in one process, as in tests, a local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Has what is at ``path`` deleted when the driver ends."""
    at, fs = _located(spark, path)
    fs.deleteOnExit(at)


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave. Only for those that nothing reads again: what came of them must be written."""
    for table in tables:
        at, fs = _located(table.sparkSession, table.folder)
        fs.delete(at, True)
