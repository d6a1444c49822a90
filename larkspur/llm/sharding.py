"""Sharding by weighted rendezvous hashing, with gapless places in each shard.

A record goes to the shard with the highest score ``weight / -ln(u)``, where u in (0, 1) is drawn by hashing the record's key with the
shard's number. A score depends on the key and on one shard only, so a shard that is added or grows takes records only into
itself, one that is removed or shrinks gives away only its own, and the expected share of a shard is its weight's.

Places (slots) follow the order of the table. Each task numbers its own rows within every shard and writes them with its number,
counts of (task, shard) give where a task's rows start, and these few rows are joined back. So no shard is
sorted or brought together, a key that holds any part of the rows makes no task larger, and a retried task writes whole rows anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialise

#: Most starting places (one for each task and shard) that are broadcast: 24 MB. Beyond, they are joined by a shuffle.
MOST_BROADCAST = 1 << 20


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number (int) of the shard that ``key`` goes to; ``weights`` has one for each shard, 0 for one that takes nothing.

    The key counts as text, so 7 and '7' are one; null is a key like any other. Equal scores go to the smaller number.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("no shard has a weight above zero, or one is below")
    hashed = F.xxhash64(key.cast("string"))
    shards = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0])

    def score(shard: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(hashed, shard["n"]), 11) + 0.5) / F.lit(2.0**53)
        return F.struct((shard["w"] / -F.ln(u)).alias("score"), (-shard["n"]).alias("n"))

    return (-F.array_max(F.transform(shards, score))["n"]).cast("int")


def place(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", shard_out: str = "shard", slot_out: str = "slot") -> DataFrame:
    """``docs`` with its columns and two more: ``shard``, and ``slot``, gapless from 0 within each shard; columns of those names are replaced.

    Repeated rows share a shard and have slots of their own. Null keys are one key. An empty table gives no rows. Texts of any
    length are passed on as they are.
    """
    shards = len(weights)
    kept = [c for c in docs.columns if c.lower() not in (shard_out.lower(), slot_out.lower())]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], rendezvous(F.col(f"`{key_col}`"), weights).alias("shard"))
    names = [*held.columns, "task", "rank"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(np.int64)
            counts, order = np.bincount(shard, minlength=shards), np.argsort(shard, kind="stable")
            rank = np.empty(len(shard), np.int64)
            rank[order] = np.arange(len(shard)) - (np.cumsum(counts) - counts)[shard[order]]
            columns = [*batch.columns, pa.array(np.full(len(shard), task, np.int32)), pa.array(rank + seen[shard])]
            yield pa.RecordBatch.from_arrays(columns, names)
            seen += counts

    fields = T.StructType([*held.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType())])
    ranked = materialise(held.mapInArrow(number, fields), "ranked")
    counts = materialise(ranked.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n")), "starts")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = counts.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if counts.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    placed = ranked.join(starts, ["task", "shard"])
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)]
    return placed.select(*own, F.col("shard").alias(shard_out), (F.col("start") + F.col("rank")).alias(slot_out))


def write_shards(placed: DataFrame, path: str, rows: int = 1 << 20, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Write a placed table as Parquet, a folder for each shard, in files of up to ``rows`` rows that are in the order of the slots."""
    files = F.floor(F.col(slot_col) / rows)
    spread = placed.repartition(F.col(shard_col), files).sortWithinPartitions(shard_col, slot_col)
    spread.write.option("maxRecordsPerFile", rows).partitionBy(shard_col).parquet(path)
