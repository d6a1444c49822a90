"""Rankings with a total order: score descending, then id. Top-k goes through Spark's window group limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.vectors import iou


def order_of(score: str, id_col: str) -> list[Column]:
    return [F.desc_nulls_last(score), F.asc_nulls_last(id_col)]


def top_k(df: DataFrame, group: list[str], score: str, id_col: str, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank from 1."""
    w = Window.partitionBy(*group).orderBy(*order_of(score, id_col))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def capped(df: DataFrame, group: list[str], order: list[Column], cap: int, total: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each group, then the first ``total`` of all: what a greedy scan in that order would keep."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= cap).drop("_place")
    return kept.orderBy(*order).limit(total) if total is not None else kept


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: largest by ``order``, nulls oldest."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def earliest_filled(df: DataFrame, key: str, columns: list[str], seq: str) -> DataFrame:
    """Per key the first non-empty value of each column in the order of ``seq``."""
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(seq)))
    return df.groupBy(key).agg(*[pick(c).alias(c) for c in columns])


def chain_groups(df: DataFrame, group: list[str], score: str, id_col: str, epsilon: float) -> DataFrame:
    """``cluster`` from 0: a new one starts where the score falls by more than ``epsilon`` from the row before."""
    w = Window.partitionBy(*group).orderBy(*order_of(score, id_col))
    fell = (F.lag(score).over(w) - F.col(score) > epsilon).cast("int")
    df = df.withColumn("_fell", F.coalesce(fell, F.lit(0)))
    return df.withColumn("cluster", F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fell")


def gap_to_next_cluster(df: DataFrame, group: list[str], score: str, cluster: str = "cluster") -> DataFrame:
    """``gap``: the score less the best score of the next cluster; null in the last one."""
    best = df.groupBy(*group, (F.col(cluster) - 1).alias(cluster)).agg(F.max(score).alias("_best"))
    met = df.join(best, [*group, cluster], "left").withColumn("gap", F.col(score) - F.col("_best"))
    return met.select(*df.columns, "gap")


def gap_to_next_family(df: DataFrame, group: list[str], score: str, id_col: str, family: str) -> DataFrame:
    """``gap``: the score less the score of the first later row of another family; null if there is none.

    A null family is a family of its own row. A row's own run ends at the next row of another family, so the gap is to the
    first row of the next run: runs are numbered and their first scores looked up, with no lists of following rows.
    """
    w = Window.partitionBy(*group).orderBy(*order_of(score, id_col))
    own = F.coalesce(F.concat(F.lit("f:"), F.col(family).cast("string")), F.concat(F.lit("id:"), F.col(id_col).cast("string")))
    df = df.withColumn("_own", own)
    df = df.withColumn("_new", F.coalesce((F.lag("_own").over(w) != F.col("_own")).cast("int"), F.lit(0)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = df.groupBy(*group, (F.col("_run") - 1).alias("_run")).agg(F.max(score).alias("_next"))
    return df.join(firsts, [*group, "_run"], "left").withColumn("gap", F.col(score) - F.col("_next")).drop("_own", "_new", "_run", "_next")


def bands(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``band``: high, medium or low by the third in which the distinct rank of ``order`` falls."""
    w = Window.partitionBy(*group)
    df = df.withColumn("_rank", F.dense_rank().over(w.orderBy(*order)) - 1)
    share = F.coalesce(F.try_divide(F.col("_rank"), F.max("_rank").over(w)), F.lit(0.0))
    return df.withColumn("band", F.when(share * 3 < 1, "high").when(share * 3 < 2, "medium").otherwise("low")).drop("_rank")


def best_view(df: DataFrame, keys: list[str], score: str, view: str) -> DataFrame:
    """The best score of each key over its views, and the view that gives it (smallest of equals)."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(view).alias("v"))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, (-F.col("b.s")).alias(score), F.col("b.v").alias(view))


def margin(df: DataFrame, group: list[str], score: str, id_col: str) -> DataFrame:
    """The first of each group, with its lead over the second (null if alone)."""
    w = Window.partitionBy(*group).orderBy(*order_of(score, id_col))
    led = df.withColumn("margin", F.col(score) - F.lead(score).over(w)).withColumn("_place", F.row_number().over(w))
    return led.filter("_place = 1").drop("_place")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_and_total(df: DataFrame, name: str, id_col: str, offset: int, limit: int) -> DataFrame:
    """A page of ``df`` in the order of names in lower case, then ids, with ``total``, how many rows there are in all."""
    return page(df, [F.lower(name), F.col(id_col)], offset, limit).withColumn("total", F.lit(df.count()))


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all parts; of a key that comes again, that of the first part."""
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = marked[0]
    for p in marked[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_part")
    return both.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place", "_part")


# ---- greedy over small groups (the boxes of an image, the cards of a deck): folds over a group's rows


def _listed(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """(group, rows): each group's rows as structs in the order of ``order``."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    listed = F.array_sort(F.collect_list(key)).alias("rows")
    return df.groupBy(group).agg(listed).select(F.transform("rows", lambda r: r["row"]).alias("rows"))


def _nothing(df: DataFrame) -> Column:
    return F.array().cast(f"array<{df.schema.simpleString()}>")


def suppress(boxes: DataFrame, group: str, most: float = 0.45) -> DataFrame:
    """Non-maximum suppression in each group: by score, boxes that overlap none kept so far by ``most`` or more."""

    def add(kept: Column, box: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(k, box) >= most), kept).otherwise(F.array_append(kept, box))

    listed = _listed(boxes, group, [-F.col("score"), F.col("box_id")])
    return listed.select(F.explode(F.aggregate("rows", _nothing(boxes), add)).alias("r")).select("r.*")


def match_one_to_one(pairs: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches of (left_id, right_id, overlap) in each group, best overlap first."""

    def add(kept: Column, pair: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["left_id"] == pair["left_id"]) | (k["right_id"] == pair["right_id"]))
        return F.when(taken, kept).otherwise(F.array_append(kept, pair))

    listed = _listed(pairs.filter(F.col("overlap") >= least), group, [-F.col("overlap"), F.col("left_id"), F.col("right_id")])
    return listed.select(F.explode(F.aggregate("rows", _nothing(pairs), add)).alias("r")).select("r.*")


def diversity_deck(pool: DataFrame, group: str, axes: list[str], id_col: str, seed: str, limit: int) -> DataFrame:
    """A deck of each group: in a seeded order, again and again the card that shows most unseen values of the axes.

    Cards with the same values on all axes differ by their order only, so of each such set the first ``limit`` are all that can be
    dealt; what a task gets is bounded by the sets of values.
    """

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", id_col])
        seen: set = set()
        deck: list = []
        left = list(rows.index)
        while left and len(deck) < limit:
            new = [sum((a, rows.at[i, a]) not in seen for a in axes) for i in left]
            pick = left.pop(new.index(max(new)))
            deck.append(pick)
            seen |= {(a, rows.at[pick, a]) for a in axes}
        out = rows.loc[deck].drop(columns="_order")
        out["place"] = range(1, len(out) + 1)
        return out

    shuffled = pool.withColumn("_order", F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col)), 256))
    first = Window.partitionBy(group, *axes).orderBy("_order", id_col)
    shuffled = shuffled.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit).drop("_n")
    schema = StructType([*pool.schema.fields, StructField("place", LongType())])
    return shuffled.groupBy(group).applyInPandas(deal, schema)
