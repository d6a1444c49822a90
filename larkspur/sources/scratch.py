"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="larkspur-"))


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read again: later jobs and retried tasks read the files, and its lineage ends here."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing reads any more."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
