"""Reports on results: why things were missed, verdicts with alternatives, funnels, yields; aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import at_places, percentiles, share


def miss_reason(indexed: Column, candidates: Column, same_maker: Column) -> Column:
    """Why a target wasn't found: not in the index, no candidates, a candidate of the same maker instead, ranked out."""
    return (
        F.when(~F.coalesce(indexed, F.lit(False)), "not_in_index").when(F.coalesce(candidates, F.lit(0)) == 0, "empty_result")
        .when(F.coalesce(same_maker, F.lit(False)), "family_or_vintage_twin").otherwise("other_ranked_out")
    )


def classify_misses(targets: DataFrame, indexed: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, target, reason) of the queries (query_id, target, maker) whose target isn't among their first ``k`` candidates (query_id, id, rank, maker)."""
    near = candidates.filter(F.col("rank") <= k)
    met = targets.join(near.select("query_id", F.col("id").alias("target"), F.lit(True).alias("hit")), ["query_id", "target"], "left").filter("hit IS NULL").drop("hit")
    counts = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    twins = near.select("query_id", F.lower(F.trim("maker")).alias("_m")).distinct().withColumn("twin", F.lit(True))
    met = met.join(indexed.select(F.col("id").alias("target"), F.lit(True).alias("known")), "target", "left").join(counts, "query_id", "left")
    met = met.withColumn("_m", F.lower(F.trim("maker"))).join(twins, ["query_id", "_m"], "left")
    return met.select("query_id", "target", "maker", miss_reason(F.col("known"), F.col("n"), F.col("twin")).alias("reason"))


def miss_summary(misses: DataFrame, most: int = 20) -> DataFrame:
    """(kind, value, n): misses by reason, and by the makers with most of them."""
    reasons = misses.groupBy(F.col("reason").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("kind"), "value", "n")
    makers = misses.groupBy(F.col("maker").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)
    return reasons.unionByName(makers.select(F.lit("maker").alias("kind"), "value", "n"))


def verdict(expected: Column, predicted: Column, labelled: Column) -> Column:
    """unlabelled, outside (nothing is expected), right (any of the alternatives parted by ``|``) or wrong."""
    options = F.filter(F.split(F.coalesce(expected, F.lit("")), r"\|"), lambda x: x != "")
    right = F.coalesce(F.array_contains(options, predicted), F.lit(False))
    return F.when(~labelled, "unlabelled").when(F.size(options) == 0, "outside").when(right, "right").otherwise("wrong")


def verdict_scores(rows: DataFrame) -> DataFrame:
    """(part, n, right, accuracy) of rows (verdict, status): in the catalog, of these the sure ones, outside, unlabelled."""
    known = F.col("verdict").isin("right", "wrong")
    parts = F.filter(
        F.array(
            F.when(known, "in_catalog"), F.when(known & (F.col("status") == "sure"), "in_catalog_sure"), F.when(known & (F.col("status") == "disputed"), "disputed"),
            F.when(F.col("verdict") == "outside", "outside"), F.when(F.col("verdict") == "unlabelled", "unlabelled"),
        ), lambda p: p.isNotNull(),
    )
    right = (F.col("verdict") == "right").cast("long")
    by = rows.select(F.explode(parts).alias("part"), right.alias("r")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("right"))
    counted = F.col("part").isin("in_catalog", "in_catalog_sure", "disputed")
    return by.select("part", "n", F.when(counted, F.col("right")).alias("right"), F.when(counted, F.round(F.col("right") / F.col("n"), 4)).alias("accuracy"))


def name_recall(expected: Column, read: Column) -> Column:
    """The share of a name's distinct words that were read; null for a name without words."""
    words = F.array_distinct(expected)
    return F.try_divide(F.size(F.array_intersect(words, read)), F.size(words))


def overlap_summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, the shares from 0.5 and from 0.7 on, and the 95th percentile, of overlaps (null counts as none)."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    held = rows.select(F.lit(0).alias("all"), v.alias("v"))
    base = held.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), share(F.col("v") >= 0.5).alias("half"), share(F.col("v") >= 0.7).alias("most"))
    return base.join(percentiles(held, "all", "v", 0.95).select("all", F.col("linear").alias("p95")), "all").drop("all")


def catalog_score(rating: Column, present: Column, total: Column, rating_weight: float, completeness_weight: float) -> Column:
    """(rating, completeness, composite) of a card: its rating of five and the share of optional fields that are there."""
    r, c = F.coalesce(rating / 5.0, F.lit(0.0)), F.coalesce(F.try_divide(present, total), F.lit(0.0))
    return F.struct(F.round(r, 4).alias("rating"), F.round(c, 4).alias("completeness"), F.round(rating_weight * r + completeness_weight * c, 4).alias("composite"))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that a card lacks, in order; a card with any isn't complete."""
    return F.filter(F.array(*[F.when(c.isNull() | (c.cast("string") == ""), F.lit(name)) for name, c in fields.items()]), lambda x: x.isNotNull())


def funnel(rows: DataFrame, stages: list[tuple[str, Column]], done: str = "correct") -> DataFrame:
    """(outcome, n): for each row the first stage whose condition holds, in order, else ``done``; stages that nothing falls into count 0."""
    out = None
    for name, condition in stages:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    counted = rows.groupBy(out.otherwise(F.lit(done)).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([(name,) for name, _ in stages] + [(done,)], "outcome string")
    return names.join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def proposal_report(proposals: DataFrame, asked: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(problem, n) of proposals (query_id, slot, id, evidence) against what was asked (query_id, slot) and the shortlist (query_id, id).

    ``unknown`` slots, ``duplicate`` answers to a slot, ids ``out_of_shortlist``, ``no_evidence``, and slots without an answer (``missing``).
    Questions and shortlists may be exploded from small tables, which Spark takes for their size, so they are not to be broadcast.
    """
    p = proposals.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "slot")))
    p = p.join(asked.withColumn("_asked", F.lit(True)).hint("merge"), ["query_id", "slot"], "left")
    p = p.join(shortlist.withColumn("_listed", F.lit(True)).hint("merge"), ["query_id", "id"], "left")
    problems = F.filter(
        F.array(
            F.when(F.col("_asked").isNull(), "unknown"), F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("_listed").isNull(), "out_of_shortlist"),
            F.when(F.col("evidence").isNull() | (F.trim("evidence") == ""), "no_evidence"),
        ), lambda x: x.isNotNull(),
    )
    found = p.select(F.explode(problems).alias("problem"))
    missing = asked.join(proposals.select("query_id", "slot").distinct().hint("merge"), ["query_id", "slot"], "left_anti").select(F.lit("missing").alias("problem"))
    return found.unionByName(missing).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def valid_answers(answers: DataFrame, slots: DataFrame) -> DataFrame:
    """Answers (crop_id, slot, evidence) that count: the crop is answered once, the slot is known, there is evidence."""
    once = answers.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("crop_id"))).filter("_n = 1").drop("_n")
    return once.join(slots.select("slot").distinct(), "slot", "left_semi").filter(F.trim(F.coalesce("evidence", F.lit(""))) != "").select(*answers.columns)


def ranking_summary(rows: DataFrame) -> DataFrame:
    """One row of rankings (rank of the truth, score, gap): n, top1, top5, mean and median score and gap, and the share of first ones with no rival (null gap)."""
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("rank") == 1).alias("top1"), share(F.col("rank") <= 5).alias("top5"), F.avg("score").alias("mean_score"),
        F.avg("gap").alias("mean_gap"), share(F.col("gap").isNull()).alias("dominant"),
    )
    total = F.col("total") - 1
    for c in ("score", "gap"):  # medians by counts, not by a map of all values in one task
        middle = at_places(rows, [], c, {"a": F.floor(total / 2), "b": F.ceil(total / 2)})
        one = one.join(middle.select(((F.col("a") + F.col("b")) / 2).alias(f"median_{c}")), how="left")  # a row each
    return one.select("n", "top1", "top5", "mean_score", "median_score", "mean_gap", "median_gap", "dominant")


def family_diagnostics(scores: DataFrame, members: DataFrame) -> DataFrame:
    """(family, indexed, missing, spread) of families (family, id): how many have a score (id, score), how many don't, and the widest difference of two."""
    met = members.join(scores, "id", "left")
    return met.groupBy("family").agg(F.count("score").alias("indexed"), (F.count(F.lit(1)) - F.count("score")).alias("missing"), (F.max("score") - F.min("score")).alias("spread"))


def yields(rows: DataFrame, text: str, tokens: str, distinct_tokens: str) -> DataFrame:
    """One row: how many texts, the shares that aren't empty and that have a telling token, mean length and mean number of tokens of those that aren't empty."""
    filled = F.length(F.trim(F.coalesce(text, F.lit("")))) > 0
    return rows.agg(
        F.count(F.lit(1)).alias("n"), share(filled).alias("non_empty"), share(F.size(distinct_tokens) > 0).alias("informative"),
        F.avg(F.when(filled, F.length(text))).alias("mean_length"), F.avg(F.when(filled, F.size(tokens))).alias("mean_tokens"),
    )


def triplet_summary(rows: DataFrame) -> DataFrame:
    """One row of (anchor, kind, other, family): anchors, positives, negatives, the triplets that they make, families."""
    by = rows.groupBy("anchor").agg(
        F.sum((F.col("kind") == "positive").cast("long")).alias("p"), F.sum((F.col("kind") != "positive").cast("long")).alias("n"), F.first("family").alias("family")
    )
    return by.agg(
        F.count(F.lit(1)).alias("anchors"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * F.col("n")).alias("triplets"),
        F.count_distinct("family").alias("families"),
    )


def at_least(values: Column, least: Column | float) -> Column:
    """How many of an array's values reach ``least``."""
    return F.size(F.filter(values, lambda x: x >= least))


def tuned(rows: DataFrame, configs: DataFrame, scored: Column, group: str, right: str, fold: str) -> DataFrame:
    """(config, fit, check): the configuration whose choices are right most often in fold 0, and how often they are in fold 1.

    Every row (group, fold, right, features) is scored under each of a few configurations (config, weights), the best row of a group is its
    choice (ties go to right ones last). Ties between configurations go to the smaller name.
    """
    tried = rows.crossJoin(F.broadcast(configs)).withColumn("_s", scored)  # a few configurations
    choice = tried.groupBy("config", fold, group).agg(F.max_by(right, F.struct("_s", (~F.col(right)).alias("w"))).alias("ok"))
    rates = choice.groupBy("config").agg(share(F.when(F.col(fold) == 0, F.col("ok"))).alias("_all"), F.avg(F.when(F.col(fold) == 0, F.col("ok").cast("int"))).alias("fit"), F.avg(F.when(F.col(fold) == 1, F.col("ok").cast("int"))).alias("check"))
    return rates.orderBy(F.desc("fit"), "config").limit(1).select("config", "fit", "check")


def self_matches(scores: DataFrame, quality: DataFrame) -> DataFrame:
    """(quality, n, top1, top5): where each item (query_id, id, rank) finds itself, by the quality (id, quality) of its reference."""
    own = quality.join(scores.filter("query_id = id").select("id", "rank"), "id", "left")
    return own.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), share(F.col("rank") == 1).alias("top1"), share(F.col("rank") <= 5).alias("top5"))
