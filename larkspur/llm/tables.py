"""Intermediate tables in the folder that all executors and the driver share, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more than one in HOT rows is hot; there are fewer than HOT such keys, which bounds what is broadcast for them.
HOT = 1024

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="larkspur-"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Later jobs, and tasks retried after a lost executor, read the files instead of computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the files of a table from ``materialise`` that nothing reads any more."""
    files = written.inputFiles()
    if files:
        folder = written.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(written.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def width(df: DataFrame) -> int:
    """How many partitions a repartition by key should have at least: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with ``table``, whose ``key`` is unique and whose ``weight`` counts the rows that have it.

    Keys with more than one in HOT rows are met by a broadcast (HOT rows at most), all others by a shuffle, so no task
    gets the rows of a hot key. Rows without a partner are left out. Both tables are read twice: they should be written ones.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot, adds = F.col(weight) * HOT > total, [c for c in table.columns if c not in (key, weight)]
    few = F.broadcast(table.filter(hot).select(key, F.struct(F.lit(1).alias("_one"), *adds).alias("_hot")))
    tagged = rows.join(few, key, "left")
    done = tagged.filter("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in adds])
    rest = tagged.filter("_hot IS NULL").select(*rows.columns).join(table.filter(~hot).select(key, *adds), key)
    return done.unionByName(rest)
