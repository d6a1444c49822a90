"""Streams over append-only logs: current state, rate limits, sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import folder


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{folder(spark)}/stream-{uuid.uuid4().hex}"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append", rocksdb: bool = False, at: str | None = None) -> DataFrame:
    """Run a stream over all that is there, and return what it has written; state with lists and timers needs ``rocksdb``.

    In append mode it goes to files with exactly-once commits; in update and complete mode each batch's rows are written under
    the batch's number, and of complete results the last batch counts. A stream that is carried on in a folder ``at`` goes over what is
    new, and all that it has ever written is returned.
    """
    spark = stream.sparkSession
    at = at or _folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    if rocksdb:  # read when the stream starts
        spark.conf.set(provider, ROCKSDB)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        q = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).start()
    spark.conf.set(provider, before)
    q.awaitTermination()
    # the folder is read with the stream's schema: without input there are no files
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    try:
        out = spark.read.schema(schema).parquet(f"{at}/out")
        out.limit(1).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        return out.filter(F.col("batch") == last).drop("batch")
    return out


def follow(stream: DataFrame, at: str) -> None:
    """Carry a stream on in a folder, over all that is new: its state and progress, and each batch's changed rows under the batch's number.

    A batch that is repeated after a failure replaces its own rows.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode("update")
    writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).start().awaitTermination()


def followed(spark: SparkSession, at: str, schema, keys: list[str]) -> DataFrame:
    """The newest row of each key that a stream has written by ``follow``."""
    return current(spark.read.schema(schema.add("batch", "long")).parquet(f"{at}/out"), keys, ["batch"]).drop("batch")


def read_log(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A folder (or one file) of a log as a stream, its schema taken from what is there."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern that matches just this path: a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def current(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; works on streams (complete or update mode) and on tables."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return log.groupBy(*keys).agg(newest).select(*keys, "r.*")


def _allow(times: list[int], now: int, limit: int, window: int) -> tuple[bool, list[int]]:
    times = [x for x in times if x > now - window]
    return (True, [*times, now]) if len(times) < limit else (False, times)


def rate_limited(stream: DataFrame, key: str, id_col: str, ts_col: str, limit: int, seconds: int, expire: bool = False) -> DataFrame:
    """(key, id, allowed): a hit is rejected if ``limit`` allowed ones lie within the last ``seconds``; rejected ones don't count.

    The state of a key is the times of its allowed hits, ``limit`` at most. With ``expire``, for streams that run on, it goes
    when the key has been idle for the window. Hits of a batch are taken in the order of their time.
    """
    window = seconds * 1_000_000
    kind = stream.schema[key].dataType.simpleString()
    id_kind = stream.schema[id_col].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("at"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        hits = pd.concat(list(parts)).sort_values(["at", "id"])
        allowed = []
        for now in hits["at"].tolist():
            ok, times = _allow(times, now, limit, window)
            allowed.append(ok)
        state.update((times,))
        if expire:
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"key": hits["key"], "id": hits["id"], "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(
        step, f"key {kind}, id {id_kind}, allowed boolean", "times array<long>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout,
    )


def tumbling(stream: DataFrame, ts_col: str, late: str, length: str, by: list[str]) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped, windows leave when they are over."""
    rows = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late)
    return rows.groupBy(F.window(ts_col, length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")


def sessions(log: DataFrame, key: str, ts_col: str, gap: str, least: int = 1) -> DataFrame:
    """(key, start, end, n): runs of a key's rows less than ``gap`` apart, confirmed by ``least`` rows; on tables and streams."""
    rows = log.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if log.isStreaming:
        rows = rows.withWatermark(ts_col, gap)
    s = rows.groupBy(F.session_window(ts_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.filter(F.col("n") >= least).select(key, "w.start", "w.end", "n")
