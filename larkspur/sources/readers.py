"""Sources: explicit schemas, nothing inferred, missing files as empty tables where that is meant."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stem_and_extension, upload_parts


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False) -> DataFrame:
    """One document a line; blank lines are skipped. A missing path is an empty table if that is allowed."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def json_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One document a file, with ``slug``, the file's name without its ending."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("slug", name)


def log_lines(spark: SparkSession, path: str, schema: T.StructType, key: str, seq: str, error: str | None = None) -> DataFrame:
    """A log that may have torn or broken lines: those and error rows are dropped, the last row of each key counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    rows = rows.filter(F.col(error).isNull()) if error else rows
    rest = F.max_by(F.struct(*rows.columns), F.col(seq)).alias("r")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(rest).select("r.*")


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of strings with a header (a byte-order mark is ignored), trimmed, empty as null; a missing column is an error."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = found.toDF(*[c.lstrip("﻿") for c in found.columns])
    if missing := [c for c in columns if c not in found.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return found.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns])


def one_per_key(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): exact repeats dropped and the first row of each key, and keys with rows that differ."""
    distinct = rows.withColumn("_seq", F.monotonically_increasing_id()).groupBy(*rows.columns).agg(F.min("_seq").alias("_seq"))
    w = Window.partitionBy(key).orderBy("_seq")
    first = distinct.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*rows.columns)
    conflicts = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    return first, conflicts


def labelled(spark: SparkSession, path: str, aliases: dict[str, list[str]], sep: str = "\t") -> DataFrame:
    """A label table whose columns may go by several names; each is renamed to the one it stands for."""
    found = spark.read.option("header", True).option("sep", sep).csv(path)
    by_name = {a: name for name, names in aliases.items() for a in [name, *names]}
    known = [(c, by_name[c.strip().lower()]) for c in found.columns if c.strip().lower() in by_name]
    return found.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in known])


def violations(rows: DataFrame, required: list[str], unique: str, patterns: dict[str, str], enums: dict[str, list[str]]) -> DataFrame:
    """(row key, problem): what a strict label file must not have; empty if it is sound."""
    w = Window.partitionBy(unique)
    checks: list[Column] = [F.when(F.col(c).isNull(), f"{c}: missing") for c in required]
    checks += [F.when(~F.col(c).rlike(p), f"{c}: malformed") for c, p in patterns.items()]
    checks += [F.when(~F.col(c).isin(*v), f"{c}: unknown value") for c, v in enums.items()]
    checks.append(F.when(F.count(F.lit(1)).over(w) > 1, f"{unique}: repeated"))
    marked = rows.withColumn("problem", F.array(*checks))
    return marked.select(F.col(unique).alias("key"), F.explode(F.filter("problem", lambda p: p.isNotNull())).alias("problem"))


def file_table(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with size, time and the parts of their names; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), "length", "modificationTime", upload_parts(name).alias("parts"), stem_and_extension(name)[1].alias("ext"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def mapping(spark: SparkSession, path: str, value: str = "string", wrapped: str = "mapping") -> DataFrame:
    """(key, value) of a JSON object, bare or under ``wrapped``; a missing or broken file is an empty table."""
    schema = f"key string, value {value}"
    try:
        text = spark.read.option("wholetext", True).text(path)
        text.limit(1).count()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    bare = F.from_json("value", f"map<string, {value}>")
    inner = F.from_json("value", f"struct<`{wrapped}`: map<string, {value}>>")[wrapped]
    return text.select(F.explode(F.coalesce(inner, bare)))


def dimension(spark: SparkSession, path: str, schema: str, root: str | None = None) -> DataFrame:
    """A small YAML list of records (under ``root``) as a table; the file is read on the driver."""
    import yaml

    held = yaml.safe_load(b"".join(r.content for r in spark.read.format("binaryFile").load(path).select("content").collect()).decode("utf-8-sig")) or {}
    records = (held.get(root) or []) if root else held
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)


def usable_references(listed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of references (slug, file, usable): those that may be used and whose file (file) is there; and how many of each slug are not."""
    wanted = listed.filter(F.coalesce(F.col("usable"), F.lit(True))).select("slug", "file").distinct()
    missing = wanted.join(files.select("file"), "file", "left_anti").groupBy("slug").agg(F.count(F.lit(1)).alias("missing"))
    return wanted.join(files.select("file").distinct(), "file", "left_semi"), missing


def extra_fields(rows: DataFrame, key: str, category: str, photo: str, seq: str) -> DataFrame:
    """(key, category, photos): each key's first category that isn't empty, and all its photo names in order."""
    filled = F.col(category).isNotNull() & (F.trim(category) != "")
    listed = F.array_sort(F.collect_list(F.when(F.col(photo).isNotNull(), F.struct(seq, photo))))
    return rows.groupBy(key).agg(F.min_by(F.col(category), F.when(filled, F.col(seq))).alias("category"), F.transform(listed, lambda x: x[photo]).alias("photos"))
