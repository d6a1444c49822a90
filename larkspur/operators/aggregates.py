"""Coverage, usage and censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_filled


def coverage(df: DataFrame) -> DataFrame:
    """(field, filled, percent) of every column, in one pass."""
    kinds = dict(df.dtypes)
    sums = [F.coalesce(F.sum(is_filled(F.col(c), kinds[c]).cast("long")), F.lit(0)).alias(c) for c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in df.columns])).alias("r")
    return one.select("_n", rows).select("r.field", "r.filled", F.round(100.0 * F.col("r.filled") / F.col("_n"), 2).alias("percent"))


def popular(df: DataFrame, elements: str, n: int) -> DataFrame:
    """(element, n): the most frequent elements of an array column."""
    return df.select(F.explode(elements).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "element").limit(n)


def usage(df: DataFrame, elements: str) -> DataFrame:
    """One row: how many rows have any element, and how many distinct elements there are."""
    return df.agg(
        F.sum((F.size(elements) > 0).cast("long")).alias("rows_with_any"),
        F.count(F.lit(1)).alias("rows"),
    ).crossJoin(F.broadcast(df.select(F.explode(elements).alias("e")).agg(F.countDistinct("e").alias("distinct_used"))))


def unused(df: DataFrame, elements: str, known: DataFrame) -> DataFrame:
    """The known elements (one column) that no row has."""
    name = known.columns[0]
    return known.join(df.select(F.explode(elements).alias(name)).distinct(), name, "left_anti")


def worst(df: DataFrame, group: str, score: str, least: int, n: int) -> DataFrame:
    """(group, n, mean): the ``n`` groups of ``least`` rows with the lowest mean."""
    by = df.groupBy(group).agg(F.count(score).alias("n"), F.avg(score).alias("mean")).filter(F.col("n") >= least)
    return by.orderBy("mean", group).limit(n)


def census(df: DataFrame, bucket: str, example: str, k: int = 5) -> DataFrame:
    """(bucket, n, examples): counts, and the first ``k`` examples by name without gathering all."""
    from . import ranking

    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    first = ranking.top_k(df.select(bucket, example).distinct().withColumn("_s", F.lit(0)), [bucket], "_s", example, k)
    named = first.groupBy(bucket).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return counts.join(named, bucket)


def merged_scores(lists: DataFrame, keys: list[str], score: str, mode: str = "max") -> DataFrame:
    """Scores of several lists merged by the largest or the mean of those present; absence costs nothing."""
    return lists.groupBy(*keys).agg((F.max(score) if mode == "max" else F.avg(score)).alias(score))


def latency(df: DataFrame, group: list[str], value: str, ok: str | None = None, limit: float | None = None) -> DataFrame:
    """Counts, mean, deviation and nearest-rank percentiles of a measure, its errors and the share within a limit."""
    from .metrics import at_places

    good = F.coalesce(F.col(ok), F.lit(False)) if ok else F.lit(True)
    v = F.when(good, F.col(value))
    out = [F.count(F.lit(1)).alias("n"), F.sum((~good).cast("long")).alias("errors"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.stddev_samp(v).alias("stdev")]
    if limit is not None:
        out.append(F.avg((v <= limit).cast("double")).alias("within"))
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    # the smallest value that a share of all is not above
    places = {name: F.greatest(F.lit(0), F.ceil(F.round(F.col("total") * share, 9)) - 1) for name, share in shares.items()}
    ranks = at_places(df.select(*group, v.alias("_value")), group, "_value", places).drop("total").withColumnsRenamed({g: f"_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return df.groupBy(*group).agg(*out).join(ranks, same, "left").drop(*[f"_{g}" for g in group])


def variation(values: str):
    """Population deviation over the mean of positive values; null with fewer than two of them."""
    positive = F.when(F.col(values) > 0, F.col(values))
    return F.when(F.count(positive) >= 2, F.try_divide(F.stddev_pop(positive), F.avg(positive)))


def report(rows: DataFrame, status: str, image: str, fields: list[str], numbers: list[str]) -> DataFrame:
    """(section, name, value, share): how many rows have each status, each of some fields, an image and different ones, and percentiles of
    numbers (0, 5, 50, 95, 100, by linear interpolation) over the rows with an image."""
    from .metrics import at_places

    total = rows.count()
    share = lambda n: F.try_divide(n.cast("double"), F.lit(total))
    row = lambda section, name, n, part: F.struct(section.alias("section"), name.alias("name"), n.cast("double").alias("value"), part.cast("double").alias("share"))
    by = rows.groupBy(F.coalesce(F.col(status).cast("string"), F.lit("none")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    out = by.select(row(F.lit("status"), F.col("s"), F.col("n"), share(F.col("n"))).alias("r"))
    counts = rows.agg(*[F.count(f).alias(f"f{i}") for i, f in enumerate(fields)], F.count(image).alias("i"), F.count_distinct(image).alias("d"))
    filled = [row(F.lit("filled"), F.lit(f), F.col(f"f{i}"), share(F.col(f"f{i}"))) for i, f in enumerate(fields)]
    images = [row(F.lit("images"), F.lit("with"), F.col("i"), share(F.col("i"))), row(F.lit("images"), F.lit("different"), F.col("d"), F.lit(None))]
    out = out.unionByName(counts.select(F.explode(F.array(*filled, *images)).alias("r")))
    for number in numbers:
        points, places = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}, {}
        for name, p in points.items():
            at = (F.col("total") - 1) * F.lit(p)
            places |= {f"{name}_low": F.floor(at), f"{name}_high": F.ceil(at)}
        found = at_places(rows.filter(F.col(image).isNotNull()), [], number, places)
        weight = lambda p: (F.col("total") - 1) * F.lit(p) - F.floor((F.col("total") - 1) * F.lit(p))
        value = lambda name, p: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * weight(p)
        out = out.unionByName(found.select(F.explode(F.array(*[row(F.lit(number), F.lit(n), value(n, p), F.lit(None)) for n, p in points.items()])).alias("r")))
    return out.select("r.*")


def flag_rate(rows: DataFrame, group: list[str], flag: str) -> DataFrame:
    """(group, total, flagged, rate, unreadable): of the rows whose flag is known how many have it, to four digits; null flags are unreadable."""
    on = F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0))
    known = F.count(flag)
    by = rows.groupBy(*group).agg(known.alias("total"), on.alias("flagged"), (F.count(F.lit(1)) - known).alias("unreadable"))
    rate = F.coalesce(F.round(F.try_divide(F.col("flagged"), F.col("total")), 4), F.lit(0.0))
    return by.select(*group, "total", "flagged", rate.alias("rate"), "unreadable")
