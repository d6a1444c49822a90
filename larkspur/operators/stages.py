"""Candidates through successive stages: each one is dearer than the last and sees only what the last has left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking

# Candidates of the first stage; finalists by the second, and by the first; what the best of the second must reach.
SHORTLIST, FINALISTS, ALSO, GATE = 24, 3, 2, 12.0


def staged(
    candidates: DataFrame, coarse: Callable[[DataFrame], DataFrame], costly: Callable[[DataFrame], DataFrame], known: DataFrame | None = None,
    shortlist: int = SHORTLIST, finalists: int = FINALISTS, also: int = ALSO, gate: float = GATE,
) -> DataFrame:
    """(query_id, id, rank, coarse, costly, final) of the finalists of ``candidates`` (query_id, id, score), ``final`` from 1 by the costly score.

    Of each query the ``shortlist`` best by score, and its ``known`` ids (query_id, id), get a coarse score: ``coarse`` adds that column, and
    may join. Where the best of it is under ``gate`` the query has no result. The ``finalists`` best by the coarse score and the ``also`` best by the
    first one get the costly score. Equal scores go by the first rank. The ranks between the stages keep the
    costly column from being computed for anything else, wherever it is used later.
    """
    ranked = ranking.top_k(candidates.select("query_id", "id", "score"), ["query_id"], "score", "id", shortlist).select("query_id", "id", "rank")
    if known is not None:
        ranked = ranked.unionByName(known.join(ranked, ["query_id", "id"], "left_anti").distinct().withColumn("rank", F.lit(None).cast("int")))
    place = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    first = [F.col("rank").asc_nulls_last(), "id"]
    seen = coarse(ranked).withColumn("_place", place(F.desc("coarse"), *first))
    seen = seen.withColumn("_top", F.max("coarse").over(Window.partitionBy("query_id")))
    best = F.col("_place") <= finalists
    left = seen.filter((F.col("_top") >= gate) & (best | F.coalesce(F.col("rank") <= also, F.lit(False))))
    # those of the coarse stage come first among equals
    order = [F.when(best, F.col("_place")).asc_nulls_last(), *first]
    judged = costly(left.withColumn("_order", place(*order)).drop("_top", "_place"))
    return judged.select("query_id", "id", "rank", "coarse", "costly", place(F.desc("costly"), "_order").alias("final"))


def accepted(judged: DataFrame, least: float, lead: float) -> DataFrame:
    """(query_id, id): the final best of each query if its costly score is at least ``least`` and ``lead`` times that of the next."""
    best = judged.groupBy("query_id").agg(
        F.max(F.when(F.col("final") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("final") == 1, F.col("costly"))).alias("a"), F.max(F.when(F.col("final") == 2, F.col("costly"))).alias("b")
    )
    return best.filter((F.col("a") >= least) & (F.col("a") >= lead * F.coalesce("b", F.lit(0.0)))).select("query_id", "id")
