"""Sinks: keyed, partitioned and resumable writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import latest


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't have yet: a run that broke off goes on where it stopped."""
    done = existing(rows.sparkSession, path, rows.schema).select(key)
    rows.join(done, key, "left_anti").write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str, version: str, key: str, order: str) -> str:
    """The table of ``path`` with ``rows`` merged in by key, newest by ``order``, written beside it as a new version."""
    spark = rows.sparkSession
    both = existing(spark, path, rows.schema).unionByName(rows)
    target = f"{path.rstrip('/')}-{version}"
    latest(both, [key], [order]).write.mode("errorifexists").parquet(target)
    return target


def archive(rows: DataFrame, path: str, bucket: str, ts: str) -> None:
    """Append by bucket and day."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy(bucket, "day").parquet(path)


def search_index(items: DataFrame, path: str, fields: list[str], keep: list[str]) -> None:
    """A flat index: one text of the filled fields, and the fields to filter by."""
    text = F.concat_ws(" · ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields]).alias("text")
    items.select(*keep, text).write.mode("overwrite").json(path)


def manifest(df: DataFrame, path: str, version: str, **facts) -> None:
    """One row beside a table: its version, its count and further facts."""
    row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(version).alias("version"), "rows", *[F.lit(v).alias(k) for k, v in facts.items()])
    row.coalesce(1).write.mode("overwrite").json(path)


def answers(df: DataFrame, path: str) -> None:
    """CSV with a header, never over an existing one."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small aggregate as a table."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def documents(df: DataFrame, path: str, kind: str) -> None:
    """Documents as JSON lines, by kind, written over those that were there."""
    df.write.mode("overwrite").partitionBy(kind).json(path)


def catalog(df: DataFrame, path: str, audits: dict[str, DataFrame]) -> None:
    """A catalog as Parquet and JSON lines, with audit tables as CSV beside it."""
    df.write.mode("overwrite").parquet(f"{path}/catalog.parquet")
    df.write.mode("overwrite").json(f"{path}/catalog.jsonl")
    for name, table in audits.items():
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
