"""Evaluation: hits, ranks, F1, thresholds, intervals, percentiles. Sweeps are running sums over distinct thresholds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def share(condition: Column) -> Column:
    """The mean of a condition; null conditions count as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def hit(expected: Column, got: Column, any_: Column | bool = True) -> Column:
    """Whether results hold any (or all) expected ids; with none expected, whether there are no results."""
    any_ = F.lit(any_) if isinstance(any_, bool) else any_
    every = F.size(F.array_except(expected, got)) == 0
    return F.when(F.size(expected) == 0, F.size(got) == 0).when(any_, F.arrays_overlap(expected, got)).otherwise(every)


def rank_of(truth: Column, got: Column) -> Column:
    """The place of the truth from 1, null if it isn't there."""
    return F.nullif(F.array_position(got, truth), F.lit(0)).cast("int")


def reciprocal(rank: Column, most: int = 10) -> Column:
    return F.when(rank <= most, 1.0 / rank).otherwise(F.lit(0.0))


def macro_f1(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: f1, the mean over the true classes. ``predicted`` may be an array (a hit if it holds the truth); null is wrong."""
    many = dict(predictions.dtypes)[predicted].startswith("array")
    first = F.try_element_at(F.col(predicted), F.lit(1)) if many else F.col(predicted)
    right = F.coalesce(F.array_contains(predicted, F.col(truth)) if many else F.col(predicted) == F.col(truth), F.lit(False))
    rows = predictions.select(F.col(truth).alias("t"), F.when(right, F.col(truth)).otherwise(first).alias("p"), right.alias("ok"))
    per_true = rows.groupBy(F.col("t").alias("c")).agg(F.sum(F.col("ok").cast("int")).alias("tp"), F.sum((~F.col("ok")).cast("int")).alias("fn"))
    false = rows.filter("NOT ok AND p IS NOT NULL").groupBy(F.col("p").alias("c")).agg(F.count(F.lit(1)).alias("fp"))
    met = per_true.join(false, "c", "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return met.agg(F.avg(f1).alias("f1"))


def running(by: DataFrame, group: list[str], order: str, sums: list[str]) -> DataFrame:
    """``by`` (one row for each group and value of ``order``) with ``<sum>_upto``, the sums up to and with each row, and ``following``, the
    group's next value of ``order``.

    Rows are dealt to partitions by ranges and written; each range sums up by itself and adds what lies before it in its
    group, so a group of any number of values is no single task's.
    """
    dealt = by.repartitionByRange(int(by.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums], F.min(order).alias("_first"))
    over = Window.partitionBy(*group).orderBy("_part")  # a row for each range
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums], F.lead("_first").over(over).alias("_next"))
    met = dealt.join(parts.withColumnsRenamed({g: f"_{g}" for g in group} | {"_part": "_range"}), (F.col("_part") == F.col("_range")) & _same(group))
    w = Window.partitionBy(*group, "_part").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    added = [(F.sum(c).over(upto) + F.col(f"_{c}")).alias(f"{c}_upto") for c in sums]
    return met.select(*by.columns, *added, F.coalesce(F.lead(order).over(w), F.col("_next")).alias("following"))


def _same(group: list[str]) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return out


def abstention_sweep(rows: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(threshold, precision, recall, f1) for every distinct confidence: answers below it are withheld."""
    by = rows.groupBy((-F.col(confidence)).alias("low")).agg(F.sum(F.col(correct).cast("long")).alias("right"), F.count(F.lit(1)).alias("n"))
    by, total = running(by, [], "low", ["right", "n"]), rows.count()
    p, r = F.col("right_upto") / F.col("n_upto"), F.col("right_upto") / F.lit(max(1, total))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return by.select((-F.col("low")).alias("threshold"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def auroc(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """One row: auroc, by rank sums; equal scores share their mean rank."""
    by = running(rows.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")), [], score, ["n"])
    mean_rank = F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2
    sums = by.withColumn("rank", mean_rank).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("np"), F.sum("n").alias("all"))
    negatives = F.col("all") - F.col("np")
    return sums.select(F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * negatives).alias("auroc"))


def error_rates(rows: DataFrame, positive: str, score: str, thresholds: Column) -> DataFrame:
    """(threshold, fpr, fnr): negatives accepted and positives rejected at each of a few thresholds."""
    t = rows.select(positive, score, F.explode(thresholds).alias("threshold"))
    accepted, pos = F.col(score) >= F.col("threshold"), F.col(positive)
    fpr = F.avg(F.when(~pos, accepted.cast("double")))
    fnr = F.avg(F.when(pos, (~accepted).cast("double")))
    return t.groupBy("threshold").agg(fpr.alias("fpr"), fnr.alias("fnr"))


def recommended(rates: DataFrame, most_fpr: float = 0.05) -> DataFrame:
    """One row: the least threshold with few enough false positives, and the one where both rates are nearest."""
    gap = F.abs(F.col("fpr") - F.col("fnr"))
    return rates.agg(F.min(F.when(F.col("fpr") <= most_fpr, F.col("threshold"))).alias("threshold"), F.min_by("threshold", F.struct(gap, "threshold")).alias("equal_error"))


def refusal_threshold(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """One row: the midpoint between neighbouring distinct scores that tells most rows apart, the lowest of equals.

    Where the classes separate that is the midpoint of the gap between them. Null with fewer than two distinct scores.
    """
    by = rows.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    by = running(by, [], score, ["p", "n"]).withColumn("mid", (F.col(score) + F.col("following")) / 2)
    total = rows.agg(F.coalesce(F.sum(F.col(positive).cast("long")), F.lit(0))).first()[0]
    correct = (F.col("n_upto") - F.col("p_upto")) + F.lit(total) - F.col("p_upto")
    best = by.filter("mid IS NOT NULL").withColumn("correct", correct)
    return best.agg(F.min_by("mid", F.struct((-F.col("correct")).alias("c"), "mid")).alias("threshold"), F.max("correct").alias("correct"))


def open_set_confidences(candidates: DataFrame, query: str, visual: str, label: str, shared: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(kind, correct, confidence): each query's best candidate (``positive``), and that of the same query without its true one (``negative``).

    A candidate's confidence is ``score(visual, gap)``, its gap what it lacks to the best visual score, of the others only where the true
    one is taken out: the gap would tell that it is missing. A query without its true candidate, with no other, or
    whose picture is ``shared`` gives no negative. Candidates are one too many, so no second search is made; equal confidences
    go to a true candidate first.
    """
    w, truth = Window.partitionBy(query), F.col(label)
    top = lambda c: F.max(c).over(w)
    held = candidates.withColumn("_best", top(F.col(visual))).withColumn("_rest", top(F.when(~truth, F.col(visual))))
    conf = lambda best: score(F.col(visual), F.col(visual) - F.col(best))
    by = held.groupBy(query).agg(
        F.max(conf("_best")).alias("p"), F.max_by(truth, F.struct(conf("_best").alias("c"), truth.alias("t"))).alias("correct"),
        F.max(F.when(~truth, conf("_rest"))).alias("n"), F.bool_or(truth).alias("has"), F.bool_or(F.coalesce(F.col(shared), F.lit(False))).alias("shared"),
    )
    both = F.array(F.struct(F.lit("positive").alias("kind"), "correct", F.col("p").alias("confidence")), F.when(F.col("has") & ~F.col("shared"), F.struct(F.lit("negative").alias("kind"), F.lit(False).alias("correct"), F.col("n").alias("confidence"))))
    return by.select(F.explode(both).alias("r")).select("r.*").filter("confidence IS NOT NULL")


def open_set_sweep(confidences: DataFrame) -> DataFrame:
    """(threshold, accuracy, answered_right, rejected, rejected_outside) at every distinct confidence; answers are given from it on.

    Right are positives that are answered rightly and negatives that are refused; the other shares are of all positives, and of all negatives.
    """
    positive = F.col("kind") == "positive"
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    by = confidences.groupBy((-F.col("confidence")).alias("low")).agg(count(positive & F.col("correct")).alias("right"), count(positive).alias("inside"), count(~positive).alias("outside"))
    total = confidences.agg(count(positive), count(~positive)).first()
    inside, outside = total[0] or 0, total[1] or 0
    by = running(by, [], "low", ["right", "inside", "outside"])
    refused = F.lit(outside) - F.col("outside_upto")
    share_of = lambda c, n: F.coalesce(F.try_divide(c, F.lit(n)), F.lit(0.0))
    return by.select(
        (-F.col("low")).alias("threshold"), share_of(F.col("right_upto") + refused, inside + outside).alias("accuracy"), share_of(F.col("right_upto"), inside).alias("answered_right"),
        share_of(F.lit(inside) - F.col("inside_upto"), inside).alias("rejected"), share_of(refused, outside).alias("rejected_outside"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high): the 95 % interval of a share."""
    p, zz = k / n, z * z
    middle, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.struct(((middle - spread) / (1 + zz / n)).alias("low"), ((middle + spread) / (1 + zz / n)).alias("high"))


def at_places(rows: DataFrame, group: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(group, total, places): of each group's sorted values those at some places from 0, columns over ``total``, the number of values.

    Values are counted first, and looked up where the running count passes the places; no group's values are gathered.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    by = running(counted, group, "_v", ["n"])
    total = by.groupBy(*group).agg(F.max("n_upto").alias("total"))
    asked = total.select(*[F.col(g).alias(f"_{g}") for g in group], "total", *[c.cast("long").alias(f"_{k}") for k, c in places.items()])
    met = by.join(asked, _same(group))  # one row a group
    here = lambda at: (F.col("n_upto") > at) & (F.col("n_upto") - F.col("n") <= at)
    return met.groupBy(*group, "total").agg(*[F.max(F.when(here(F.col(f"_{k}")), F.col("_v"))).alias(k) for k in places])


def percentiles(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, linear, nearest_rank, rounded_index, floor_index, lower, higher): six definitions of a percentile that are in use."""
    n, position = F.col("total"), (F.col("total") - 1) * F.lit(p)
    inside = lambda i: F.greatest(F.lit(0), F.least(n - 1, i))
    places = {
        "low": F.floor(position), "next": inside(F.floor(position) + 1), "nearest_rank": inside(F.ceil(n * F.lit(p)) - 1),
        "rounded_index": inside(F.bround(position, 0)), "floor_index": inside(F.floor(n * F.lit(p))), "higher": inside(F.ceil(position)),
    }
    found = at_places(rows, [group], value, places)
    linear = F.col("low") + (F.col("next") - F.col("low")) * (position - F.floor(position))
    return found.select(group, linear.alias("linear"), "nearest_rank", "rounded_index", "floor_index", F.col("low").alias("lower"), "higher")


def best_by_lift(runs: DataFrame, group: str, config: str, score: str, n: str, weight: str, baseline: str, least: int = 5) -> DataFrame:
    """Per group the configuration with the largest lift over the group's baseline; then more rows, then less weight."""
    base = runs.filter(F.col(config) == baseline).select(F.col(group).alias("_g"), F.col(score).alias("_base"))
    lifted = runs.filter(F.col(n) >= least).join(base, F.col(group) == F.col("_g")).withColumn("lift", F.col(score) - F.col("_base"))
    return lifted.groupBy(group).agg(F.max_by(config, F.struct("lift", n, -F.col(weight))).alias("config"), F.max("lift").alias("lift"))


def half_tail(k: int, n: int) -> float:
    """The probability of at most ``k`` heads among ``n`` fair throws, as an incomplete beta function by its continued fraction; any size."""
    if k >= n:
        return 1.0
    a, b = n - k, k + 1  # I_1/2(a, b)
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) - (n + 1) * math.log(2))
    if a < b:  # the fraction converges on the other side
        return 1.0 - half_tail(n - k - 1, n)
    tiny, x = 1e-300, 0.5
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / ((1 + step * d) or tiny), (1 + step / c) or tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * value / a)


def sign_test(pairs: DataFrame, better: Column, worse: Column) -> DataFrame:
    """One row: fixed, broken, and the two-sided binomial p of as uneven a split, for any number of pairs."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    fixed, broken = pairs.agg(count(better & ~worse), count(worse & ~better)).first()
    p = min(1.0, 2 * half_tail(min(fixed, broken), fixed + broken)) if fixed + broken else 1.0
    return pairs.sparkSession.createDataFrame([(fixed, broken, p)], "fixed long, broken long, p double")
