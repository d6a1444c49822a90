"""Exact deduplication with a heavy-hitter split.

Digests of the normalised texts are split in two. Frequent digests are found by Misra-Gries summaries, one per
partition and merged; their exact counts and first rows are verified and broadcast, so copies of a text that fills
a third of the corpus are settled where they are read. All other digests go through an ordinary shuffle, in which
no group can hold more than the heavy share of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

#: Counters of a Misra-Gries summary. Every digest in more than 2 / (SUMMARY + 1) of the rows is found, and no more
#: than SUMMARY are kept, which bounds the broadcast to about 100 KB.
SUMMARY = 1023


def normalised(text: Column) -> Column:
    """The text (null: empty) with each run of white space replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def shrink(counts: Counter, k: int) -> Counter:
    """The Misra-Gries step on merged counters: subtract the (k + 1)-th largest count, keep what is above zero."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({key: n - cut for key, n in counts.items() if n > cut})


def misra_gries(df: DataFrame, column: str, k: int = SUMMARY) -> DataFrame:
    """(column, estimate): candidates for values in more than 2 / (k + 1) of the rows, k at most.

    Estimates are lower bounds; nulls are not counted.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            kept.update(v for v in batch.column(0).to_pylist() if v is not None)
            kept = shrink(kept, k)
        if kept:
            yield pa.RecordBatch.from_pydict({column: list(kept), "estimate": pa.array(kept.values(), pa.int64())})

    kind = df.schema[column].dataType.simpleString()
    partial = df.select(column).mapInArrow(summaries, f"`{column}` {kind}, estimate long")
    merged = partial.groupBy(column).agg(F.sum("estimate").alias("estimate"))
    return merged.orderBy(F.desc("estimate"), column).limit(k)


def heavy_digests(digests: DataFrame, k: int = SUMMARY) -> DataFrame:
    """(text_sha256, group_size, first): the verified frequent digests, at most ``k`` rows, written once.

    ``digests`` has id, text_sha256 and row_no. ``first`` is the row that stays: smallest id (null last), then row_no.
    """
    candidates = misra_gries(digests, "text_sha256", k)
    least = 2 * digests.count() / (k + 1)
    winners = (
        digests.join(F.broadcast(candidates.select("text_sha256")), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("first"))
        .filter(F.col("group_size") > max(1, least))
    )
    return materialise(winners, "frequent-digests")


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SUMMARY) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after white space is normalised; a null text counts as empty. Of equal texts the row
    with the smallest id stays; null ids come last. Of repeated rows (same id and text) exactly one stays. An
    empty table gives no rows; other columns are not read, whatever their names.
    """
    digests = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("text_sha256"))
    digests = materialise(digests.withColumn("row_no", F.monotonically_increasing_id()), "digests")
    winners = heavy_digests(digests, k)
    tagged = digests.join(F.broadcast(winners), "text_sha256", "left")
    frequent = tagged.filter(F.col("group_size").isNotNull())
    group = Window.partitionBy("text_sha256")
    rest = (
        tagged.filter(F.col("group_size").isNull())
        .drop("group_size", "first")
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("first", F.min(_order()).over(group))
    )
    return frequent.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SUMMARY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in ``exact_groups``.

    Copies of a frequent text whose id is not the winner's leave where they are read. The rest meets by digest in one
    shuffle, of which Spark takes all but the first row of a digest before it is sent (window group limit).
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col(f"row.`{id_col}`").alias("id"), text_digest(F.col(f"row.`{text_col}`")).alias("text_sha256")
    )
    digests = held.select("id", "text_sha256").withColumn("row_no", F.lit(0))
    winners = heavy_digests(materialise(digests, "digests"), k)
    firsts = winners.select("text_sha256", F.col("first.id").alias("first_id"), F.lit(True).alias("heavy"))
    left = held.join(F.broadcast(firsts), "text_sha256", "left").filter(
        F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("first_id"))
    )
    first = Window.partitionBy("text_sha256").orderBy(F.col("id").asc_nulls_last())
    return left.withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")
