"""Seeded, stable samples: by hashes of ids, so they don't depend on partitions or on a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(seed: str, id_: Column) -> Column:
    """A number from 0 to 1 for each id: the first eight hex digits of sha256(seed:id)."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), id_.cast("string")), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / 4294967295


def stable_order(*parts: Column) -> Column:
    """A key whose order tells nothing about ranks."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def halves(df: DataFrame, seed: str, id_col: str) -> DataFrame:
    """``fold`` 0 or 1: which half of the hash range an id falls in. Needs no global order."""
    return df.withColumn("fold", (hash_share(seed, F.col(id_col)) >= 0.5).cast("int"))


def unseen(ids: DataFrame, id_col: str, models: list[tuple[str, Column]]) -> DataFrame:
    """``ids`` that no model was trained on: a model (seed, trained) saw the first half by its seed of the ids that it was ``trained`` on."""
    kept = F.lit(True)
    for seed, trained in models:
        kept = kept & (~F.coalesce(trained, F.lit(False)) | (hash_share(seed, F.col(id_col)) >= 0.5))
    return ids.filter(kept)


def sample_per_key(pairs: DataFrame, key: str, id_col: str, seed: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(stable_order(F.lit(seed), F.col(key).cast("string"), F.col(id_col).cast("string")))
    return pairs.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def holdout(ids: DataFrame, seed: str, n: int) -> DataFrame:
    """``n`` ids, the same ones however often it is asked."""
    c = ids.columns[0]
    return ids.orderBy(stable_order(F.lit(seed), F.col(c).cast("string")), c).limit(n)


def deranged(df: DataFrame, group: str, id_col: str, seed: str) -> DataFrame:
    """``donor``: another id of the same group, each once, by a rotation of a seeded order; null for one that is alone."""
    w = Window.partitionBy(group).orderBy(stable_order(F.lit(seed), F.col(id_col).cast("string")), id_col)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = F.coalesce(F.lead(id_col).over(w), F.first(id_col).over(whole))
    return df.withColumn("donor", F.when(donor != F.col(id_col), donor))


def seeded_places(items: DataFrame, group: str, id_col: str, seed: str) -> DataFrame:
    """(group, id, place, total): the items' places from 0 in a seeded order of their group, and the group's size.

    Places are counted within the first hex digits of the order's key and shifted by what comes before, so no task sorts a whole group.
    """
    key = stable_order(F.lit(seed), F.col(id_col).cast("string"))
    held = items.select(group, id_col, key.alias("_key"), F.substring(key, 1, 3).alias("_bin"))
    bins = held.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("n"))  # 4,096 a group at most
    whole = Window.partitionBy(group)
    bins = bins.select(group, "_bin", F.coalesce(F.sum("n").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("n").over(whole).alias("total"))
    met = held.join(bins, [group, "_bin"])
    return met.select(group, id_col, (F.col("_before") + F.row_number().over(Window.partitionBy(group, "_bin").orderBy("_key", id_col)) - 1).alias("place"), "total")


def scenes(items: DataFrame, backgrounds: DataFrame, seed: str, per_item: int, most: int = 4, same_maker: float = 0.5) -> DataFrame:
    """(scene, id, file, neighbours, background, seed): ``per_item`` scenes of each item (id, maker, file), drawn by the seed alone.

    A scene has up to ``most`` other files, without repeats: with probability ``same_maker`` of the maker's files, else of all; of all too where the maker
    has no other. They stand next to each other in a seeded circle of the pool, from a drawn place on, so a scene looks up a few places and no
    pool is gathered. ``background`` is one of ``backgrounds`` (file), null if there are none. Items without a file give no scene.
    """
    held = items.filter("file IS NOT NULL")
    pool = lambda rows, name: seeded_places(rows.distinct(), "pool", "file", f"{seed}:{name}")
    makers = pool(held.filter("maker IS NOT NULL").select(F.concat(F.lit("m:"), F.col("maker").cast("string")).alias("pool"), "file"), "maker")
    everything = pool(held.select(F.lit("all").alias("pool"), "file"), "all")
    wide = everything.select("file", F.col("place").alias("_place"), F.col("total").alias("_total"))
    own = held.withColumn("pool", F.concat(F.lit("m:"), F.col("maker").cast("string"))).join(makers, ["pool", "file"], "left").join(wide, "file")
    scene = own.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_item)))).withColumn("scene", F.concat_ws("-", "id", "n"))
    draw = lambda what: hash_share(f"{seed}:{what}", F.col("scene"))
    narrow = (draw("pool") < same_maker) & (F.coalesce("total", F.lit(0)) > 1)
    pick = lambda a, b: F.when(narrow, F.col(a)).otherwise(F.col(b) if isinstance(b, str) else b)
    scene = scene.withColumns({"pool": pick("pool", F.lit("all")), "own": pick("place", "_place"), "others": pick("total", "_total") - 1})
    scene = scene.select("scene", "id", "file", "pool", "own", "others", F.least(F.floor(draw("count") * (most + 1)), F.lit(most), "others").cast("int").alias("count"), F.floor(draw("start") * F.col("others")).alias("start"))
    drawn = scene.filter("count > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    at = (F.col("start") + F.col("j")) % F.col("others")  # among the others, so the own place is stepped over
    drawn = drawn.withColumn("place", at + (at >= F.col("own")).cast("int"))
    found = drawn.join(makers.unionByName(everything).select("pool", "place", F.col("file").alias("neighbour")), ["pool", "place"])
    beside = found.groupBy("scene").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "neighbour"))), lambda x: x["neighbour"]).alias("neighbours"))
    behind = pool(backgrounds.filter("file IS NOT NULL").select(F.lit("back").alias("pool"), "file"), "back")
    total = behind.agg(F.max("total")).first()[0]
    out = scene.join(beside, "scene", "left").withColumn("place", F.floor(draw("back") * F.lit(total or 0)))
    out = out.withColumn("place", F.least("place", F.lit((total or 1) - 1))).drop("pool").join(behind.select("place", F.col("file").alias("background")), "place", "left")
    none = F.array().cast(f"array<{items.schema['file'].dataType.simpleString()}>")
    return out.select("scene", "id", "file", F.coalesce("neighbours", none).alias("neighbours"), "background", F.floor(draw("seed") * (2**31 - 1)).alias("seed"))


def without(pairs: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that no exclusion list names."""
    return pairs.join(excluded.select(*keys).distinct(), keys, "left_anti")


def views(items: DataFrame, n: int) -> DataFrame:
    """``n`` numbered views of every item."""
    return items.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(n))))
