"""Intervals on a line: runs of coverage, borders half-way between centres, nearest centres; windows within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, group: str, low: str, high: str, least_gap: float) -> DataFrame:
    """(group, run, low, high, n): intervals that overlap, or lie less than ``least_gap`` apart, are one run; runs from 0 in order."""
    w = Window.partitionBy(group).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce((F.col(low) - reach >= least_gap).cast("int"), F.lit(0)))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("n"))


# Bins of a frame for rows and for columns, the least gap of columns, how wide rows are smoothed and how far from the middle their borders may lie.
ROW_BINS, COLUMN_BINS, COLUMN_GAP, SMOOTH, REACH = 500, 600, 0.02, 0.045, 0.4


def density(rows: DataFrame, group: str, low: str, high: str, size: Column | float, bins: int = COLUMN_BINS) -> DataFrame:
    """(group, size, cover): how many intervals cover each of ``bins`` parts of a frame from 0 to ``size``.

    An interval adds one at its first bin and takes one off after its last; these are summed by bin before a group is put together,
    so that is at most ``bins`` + 1 numbers, however many intervals it has. Intervals that cover no bin leave no trace.
    """
    wide = (size if isinstance(size, Column) else F.lit(float(size))).cast("double")
    held = rows.select(F.col(group), wide.alias("size"), F.greatest(F.lit(0), (F.col(low) / (wide / bins)).cast("int")).alias("_a"), F.least(F.lit(bins), F.ceil(F.col(high) / (wide / bins)).cast("int")).alias("_b"))
    ends = held.filter("_b > _a").select(group, "size", F.explode(F.array(F.struct(F.col("_a").alias("bin"), F.lit(1).alias("n")), F.struct(F.col("_b").alias("bin"), F.lit(-1).alias("n")))).alias("e"))
    steps = ends.groupBy(group, "size", "e.bin").agg(F.sum("e.n").alias("n"))
    by = steps.groupBy(group, "size").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("at"))
    level = lambda seen, b: F.array_append(seen, F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + F.coalesce(F.try_element_at(F.col("at"), b), F.lit(0)))
    cover = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.array().cast("array<bigint>"), level)
    return by.select(group, "size", cover.alias("cover"))


def covered(cover: Column, size: Column, least_gap: float = COLUMN_GAP, bins: int = COLUMN_BINS) -> Column:
    """Runs (low, high, center) of bins that something covers, from left to right; gaps of at most ``least_gap`` of the frame don't part them."""
    gap, width = max(1, int(least_gap * bins)), size / bins

    def add(runs: Column, b: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        near = last.isNotNull() & (b - last["stop"] <= gap)
        longer = F.array_append(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.struct(last["start"].alias("start"), (b + 1).alias("stop")))
        return F.when(near, longer).otherwise(F.array_append(runs, F.struct(b.alias("start"), (b + 1).alias("stop"))))

    filled = F.filter(F.transform(cover, lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    runs = F.aggregate(filled, F.array().cast("array<struct<start: int, stop: int>>"), add)
    return F.transform(runs, lambda r: F.struct((r["start"] * width).alias("low"), (r["stop"] * width).alias("high"), ((r["start"] + r["stop"]) / 2 * width).alias("center")))


def middle_band(cover: Column, size: Column, reach: float = REACH, smooth: float = SMOOTH, bins: int = ROW_BINS) -> Column:
    """(low, high) of the band around a frame's middle: the places of least smoothed cover on either side, the first of equal ones."""
    k, middle = max(3, int(smooth * bins)), min(bins - 1, bins // 2)
    before, after = k - 1 - (k - 1) // 2, (k - 1) // 2
    win = max(1, int(reach * bins))

    def weakest(start: int, stop: int) -> Column:
        near = lambda i: F.slice(cover, F.greatest(F.lit(1), i + 1 - before), F.least(i + 1 + after, F.lit(bins)) - F.greatest(F.lit(1), i + 1 - before) + 1)
        sums = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: F.struct(F.aggregate(near(i), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"), i.alias("i")))
        return F.array_min(sums)["i"]

    top, bottom = max(0, middle - win), min(bins, middle + win)
    return F.struct((weakest(top, middle) * (size / bins)).alias("low"), (weakest(middle, bottom) * (size / bins)).alias("high"))


def borders(centres: DataFrame, group: str, centre: str, low: Column | float, high: Column | float) -> DataFrame:
    """``centres`` with ``from`` and ``to``: half-way to the neighbours, the ends of the line beyond the first and the last."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    w = Window.partitionBy(group).orderBy(centre)
    half = lambda other: (F.col(centre) + other) / 2
    return centres.select("*", F.coalesce(half(F.lag(centre).over(w)), as_column(low)).alias("from"), F.coalesce(half(F.lead(centre).over(w)), as_column(high)).alias("to"))


def near_middle(centres: DataFrame, group: str, centre: str, width: float, tie: float) -> DataFrame:
    """The centre nearest to the middle of a frame, and its neighbour if that is about as near."""
    order = Window.partitionBy(group).orderBy(centre)
    apart = F.abs(F.col(centre) - 0.5 * width)
    placed = centres.withColumn("_i", F.row_number().over(order)).withColumn("_d", apart)
    w = Window.partitionBy(group).orderBy("_d", "_i")
    led = placed.withColumn("_n", F.row_number().over(w)).withColumn("_bi", F.first("_i").over(w)).withColumn("_bd", F.first("_d").over(w))
    second = (F.col("_n") == 2) & (F.abs(F.col("_i") - F.col("_bi")) == 1) & (F.col("_d") - F.col("_bd") <= tie * width)
    return led.filter((F.col("_n") == 1) | second).select(*centres.columns)


def clusters(rows: DataFrame, features: str, k: int = 32, rounds: int = 30, seed: int = 7):
    """k-means over vectors of numbers (MLlib)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return KMeans(k=k, maxIter=rounds, seed=seed).fit(rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features")))
