"""Event logs: validation, and what they say of the present state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 200


def problems(name: Column, props: Column, names: list[str], forbidden: list[str]) -> Column:
    """What is wrong with an event (props: map of strings): unknown name, forbidden keys, over-long strings."""
    return F.filter(
        F.array(
            F.when(~F.coalesce(name.isin(*names), F.lit(False)), "unknown_name"),
            F.when(F.arrays_overlap(F.map_keys(props), F.array(*[F.lit(k) for k in forbidden])), "forbidden_key"),
            F.when(F.exists(F.map_values(props), lambda v: F.length(v) > LONGEST), "too_long"),
        ),
        lambda p: p.isNotNull(),
    )


def stamped(props: Column, version: str = "0.1") -> Column:
    """Props with a version where they have none."""
    return F.when(F.map_contains_key(props, "_v"), props).otherwise(F.map_concat(props, F.create_map(F.lit("_v"), F.lit(version))))


def profile(swipes: DataFrame, items: DataFrame, axes: list[str], style: str) -> DataFrame:
    """(user_id, likes, swipes, one column per axis, styles): the taste of each user.

    An axis is the sum of the liked items' values over the number of liked items, nulls as 0; without likes it is 0.5. Styles
    are the three most liked, by count, then name.
    """
    from . import ranking

    liked = swipes.filter("verdict = 'like'").join(items, "item_id")
    totals = liked.groupBy("user_id").agg(F.count(F.lit(1)).alias("likes"), *[F.sum(F.coalesce(F.col(a), F.lit(0.0))).alias(a) for a in axes])
    counts = swipes.groupBy("user_id").agg(F.count(F.lit(1)).alias("swipes"))
    by_style = liked.groupBy("user_id", F.col(style).alias("style")).agg(F.count(F.lit(1)).alias("n"))
    top = ranking.top_k(by_style, ["user_id"], "n", "style", 3)
    styles = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "style"))).alias("s"))
    met = counts.join(totals, "user_id", "left").join(styles, "user_id", "left")
    axis = lambda a: F.coalesce(F.round(F.col(a) / F.col("likes"), 4), F.lit(0.5)).alias(a)
    names = F.coalesce(F.transform("s", lambda x: x["style"]), F.array().cast("array<string>"))
    return met.select("user_id", F.coalesce("likes", F.lit(0)).alias("likes"), "swipes", *[axis(a) for a in axes], F.array_join(names, ",").alias("styles"))


def taste(swipes: DataFrame, items: DataFrame, axes: list[str], style: str) -> DataFrame:
    """(user_id, style, swipes, likes, one sum per axis): what ``profile`` is made of; on a stream of swipes it is kept up as they come.

    Swipes of unknown items have a null style and count as swipes only. ``items`` is a table.
    """
    met = swipes.join(items.withColumn("_known", F.lit(True)), "item_id", "left")
    liked = F.coalesce((F.col("verdict") == "like") & F.col("_known"), F.lit(False))
    sums = [F.sum(F.when(liked, F.coalesce(F.col(a), F.lit(0.0))).otherwise(0.0)).alias(a) for a in axes]
    return met.groupBy("user_id", F.col(style).alias("style")).agg(F.count(F.lit(1)).alias("swipes"), F.sum(liked.cast("long")).alias("likes"), *sums)


def profile_of(tastes: DataFrame, axes: list[str]) -> DataFrame:
    """The profiles that ``profile`` gives, of the sums that ``taste`` keeps."""
    from . import ranking

    totals = tastes.groupBy("user_id").agg(F.sum("likes").alias("likes"), F.sum("swipes").alias("swipes"), *[F.sum(a).alias(a) for a in axes])
    top = ranking.top_k(tastes.filter("likes > 0"), ["user_id"], "likes", "style", 3)
    styles = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "style"))).alias("s"))
    axis = lambda a: F.when(F.col("likes") > 0, F.round(F.col(a) / F.col("likes"), 4)).otherwise(0.5).alias(a)
    names = F.coalesce(F.transform("s", lambda x: x["style"]), F.array().cast("array<string>"))
    return totals.join(styles, "user_id", "left").select("user_id", "likes", "swipes", *[axis(a) for a in axes], F.array_join(names, ",").alias("styles"))


def toggled(events: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are on: toggled an odd number of times."""
    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select(*key)


def support(log: DataFrame, key: str, id_col: str, kind: str, ts: str, seconds: int) -> DataFrame:
    """(id, support): how many kinds the key's other rows have that lie within ``seconds`` of each row; a moving window, no pairs."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    held = log.select(F.col(key).alias("_k"), F.col(id_col), F.col(kind).alias("_kind"), at.alias("_at"))
    near = lambda *by: Window.partitionBy(*by).orderBy("_at").rangeBetween(-seconds * 1_000_000, seconds * 1_000_000)
    kinds = F.size(F.collect_set("_kind").over(near("_k")))
    alone = ((F.count(F.lit(1)).over(near("_k", "_kind")) == 1) & F.col("_kind").isNotNull()).cast("int")  # its own kind counts if another row has it
    return held.select(id_col, (kinds - alone).cast("long").alias("support"))
