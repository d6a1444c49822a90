"""A table of vectors that grows without being rebuilt: a base and small later segments, put together when it is read.

Under the table's folder lie ``base`` and ``segments/batch=n``, plain Parquet. A row has its point (a name-based UUID of its id), the id, the vector and the
payload; in segments also whether it was removed. Of a point's rows that of the latest batch holds. A batch is
written under its number, so one that is repeated after a failure replaces itself.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of points are made in this space; any fixed one will do.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "larkspur:points")


def point_id(id_: Column, space: uuid.UUID = SPACE) -> Column:
    """The version 5 UUID of an id's text in a name space, the same wherever it is made; null with null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(id_.cast("string"), "utf-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    piece = lambda start, n: F.substring(digest, start, n)
    parts = (piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-5"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12))
    return F.concat(*parts)


def _checked(rows: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """``rows`` with their points; a vector of another dimension is an error when they are written."""
    given = F.coalesce(F.size(vector_col), F.lit(-1))
    wrong = F.raise_error(F.concat(F.lit(f"not of {dim} dimensions: "), F.col(id_col).cast("string"))).cast(rows.schema[vector_col].dataType)
    return rows.withColumn(vector_col, F.when(given == dim, F.col(vector_col)).otherwise(wrong)).withColumn("point", point_id(F.col(id_col)))


class Segments:
    """The table in a folder, of vectors of one dimension."""

    def __init__(self, spark: SparkSession, path: str, dim: int, id_col: str = "id", vector_col: str = "vector"):
        self.spark, self.path, self.dim, self.id, self.vector = spark, path.rstrip("/"), dim, id_col, vector_col

    def create(self, rows: DataFrame) -> None:
        """Write the base; of rows that repeat an id any one stays, so they should not."""
        _checked(rows, self.dim, self.id, self.vector).dropDuplicates(["point"]).write.mode("errorifexists").parquet(f"{self.path}/base")

    def _segment(self, rows: DataFrame, batch: int) -> None:
        if batch < 1:
            raise ValueError("batches are numbered from 1")
        rows.write.mode("overwrite").parquet(f"{self.path}/segments/batch={batch}")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Add rows, or replace those of the same ids. The rows have the base's columns; a repeated batch changes nothing."""
        self._segment(_checked(rows, self.dim, self.id, self.vector).dropDuplicates(["point"]).withColumn("removed", F.lit(False)), batch)

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Remove the rows of ids (one column); unknown ones are passed over."""
        base = self._base().schema
        kept = ids.select(F.col(ids.columns[0]).cast(base[self.id].dataType).alias(self.id)).distinct()
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in base if f.name not in (self.id, "point")]
        self._segment(kept.select(self.id, *rest, point_id(F.col(self.id)).alias("point"), F.lit(True).alias("removed")), batch)

    def _base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base")

    def _latest(self, base: DataFrame) -> DataFrame:
        """Of each point in the segments the row of its latest batch."""
        schema = T.StructType([*base.schema.fields, T.StructField("removed", T.BooleanType()), T.StructField("batch", T.IntegerType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/segments")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)
        rest = [c for c in rows.columns if c != "point"]
        return rows.groupBy("point").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("point", "r.*").drop("batch")

    def read(self) -> DataFrame:
        """The table as it is now. Segments are few rows beside the base, so the anti join is one against a small side, and the base isn't moved."""
        base = self._base()
        latest = self._latest(base)
        kept = base.join(latest.select("point"), "point", "left_anti")
        return kept.unionByName(latest.filter(~F.col("removed")).drop("removed"))

    def compacted(self, path: str) -> Segments:
        """The table as it is now, written as the base of a new folder."""
        self.read().write.mode("errorifexists").parquet(f"{path.rstrip('/')}/base")
        return Segments(self.spark, path, self.dim, self.id, self.vector)


def ensured(spark: SparkSession, path: str, dim: int, rows: DataFrame, id_col: str = "id", vector_col: str = "vector") -> Segments:
    """The table in ``path`` if its vectors have that dimension; else, and where there is none, one of ``rows`` in its place beside it."""
    for at in (path.rstrip("/"), f"{path.rstrip('/')}-{dim}"):
        try:
            found = spark.read.parquet(f"{at}/base").select(F.size(vector_col).alias("n")).head()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            table = Segments(spark, at, dim, id_col, vector_col)
            table.create(rows)
            return table
        if found is not None and found.n == dim:
            return Segments(spark, at, dim, id_col, vector_col)
    raise ValueError(f"{path}-{dim} holds vectors of another dimension")
