"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import HOT, discard, materialise


def _with_least(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``rows`` with the least neighbour ``m`` of their ``u``; those of hubs (fewer than HOT nodes) are broadcast."""
    hub = F.col("degree") * HOT > links
    hubs = F.broadcast(least.filter(hub).select("u", F.col("m").alias("hub_m")))
    tagged = rows.join(hubs, "u", "left")
    met = tagged.filter("hub_m IS NULL").drop("hub_m").join(least.filter(~hub).select("u", "m"), "u")
    return met.unionByName(tagged.filter("hub_m IS NOT NULL").withColumnRenamed("hub_m", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return _with_least(both.filter("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    sides = _with_least(down, least, n).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
    return sides.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node that can be reached.

    ``edges`` has two columns of one ordered type; direction, repeats and loops don't matter, a null end drops the
    edge. Each round is written to the shared folder, so that a lost executor costs one round at most, and the round
    before is deleted. The links of a hub are never gathered in one task.
    """
    u, v = edges.columns
    now = materialise(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct(), "links")
    before, links = None, now.count()
    while True:
        wide = materialise(_large_star(now, links).distinct(), "large-stars")
        after = materialise(_small_star(wide, links).distinct(), "stars")
        discard(now)
        discard(wide)
        now = after
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, links = state, state[0]
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
