"""Gates and choices over ranked candidates, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def evidence_gate(evidence: DataFrame, group: str, id_col: str, repeated: Column | bool = False) -> DataFrame:
    """The candidate of each group with enough geometric evidence and a lead of 8 inliers over the next."""
    repeated = F.lit(repeated) if isinstance(repeated, bool) else repeated
    w = Window.partitionBy(group).orderBy(F.desc("inliers"), id_col)
    led = evidence.withColumn("_next", F.coalesce(F.lead("inliers").over(w), F.lit(0))).withColumn("_place", F.row_number().over(w))
    enough = (F.col("inliers") >= F.when(repeated, 16).otherwise(20)) & (F.col("ratio") >= F.when(repeated, 0.5).otherwise(0.35)) & (F.col("coverage") >= 0.025)
    return led.filter((F.col("_place") == 1) & enough & (F.col("inliers") - F.col("_next") >= 8)).drop("_next", "_place")


def independent(e: dict[str, Column]) -> Column:
    """Whether evidence (inliers, matches, coverage) stands by itself."""
    finite = ~F.isnan(e["inliers"]) & ~F.isnan(e["matches"]) & ~F.isnan(e["coverage"])
    enough = (e["matches"] >= e["inliers"]) & (e["inliers"] >= 16) & (e["inliers"] / F.greatest(e["matches"], F.lit(1)) >= 0.25) & (e["coverage"] >= 0.025)
    return F.coalesce(finite & enough, F.lit(False))


def strongly_supported(chosen: DataFrame) -> DataFrame:
    """Of chosen evidence (inliers, matches, label_inliers) what a label supports too."""
    share = F.col("inliers") / F.greatest(F.col("matches"), F.lit(1))
    return chosen.filter((F.coalesce("label_inliers", F.lit(0)) >= 16) & (F.col("inliers") >= 24) & (share >= 0.4))


def rescue_queue(leaders: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of all disagreeing queries (query_id, label_inliers, inliers, matches): by the label's support of the visual leader, its
    inliers, and their share."""
    share = F.col("inliers") / F.greatest(F.col("matches"), F.lit(1))
    return leaders.orderBy(F.desc("label_inliers"), F.desc("inliers"), F.desc(share), "query_id").limit(most)


def rescue_candidates(visual: Column, local: Column, n: int = 3) -> Column:
    """The first of both lists, each once."""
    return F.array_distinct(F.concat(F.slice(visual, 1, n), F.slice(local, 1, n)))


def decide(visual: Column, score: Column, margin: Column, floors: tuple[float, float, float]) -> Column:
    """found, or not_found if anything is below its floor; a margin of null (no rival) is enough."""
    ok = (visual >= floors[0]) & (score >= floors[1]) & (margin.isNull() | (margin >= floors[2]))
    return F.when(F.coalesce(ok, F.lit(False)), "found").otherwise("not_found")


def bucket(score: Column, gap: Column, floor: float, least_gap: float = 0.03) -> Column:
    return F.when(score.isNull() | (score < floor), "failed").when(gap.isNull() | (gap >= least_gap), "confident").otherwise("unsure")


def choose(rule: str, local: Column, model: Column) -> Column:
    """One of two results (structs id, score, visual, confident) by a rule; a side without an id gives way to the other.

    ``merge`` takes the model's. ``max_score`` takes the local one if its score is larger. ``confident_else_cv`` takes the
    model's if that is confident. ``agree_else_llm`` takes the model's, and so does ``agree_else_cv`` unless the two differ and
    the local one has the larger visual score.
    """
    clearer = (local["id"] != model["id"]) & (local["visual"] > model["visual"])
    takes_local = {
        "merge": F.lit(False), "agree_else_llm": F.lit(False), "max_score": local["score"] > model["score"],
        "confident_else_cv": ~F.coalesce(model["confident"], F.lit(False)), "agree_else_cv": clearer,
    }[rule]
    out = F.when(local["id"].isNull(), model)
    if rule != "merge":
        out = out.when(model["id"].isNull(), local)
    return out.when(F.coalesce(takes_local, F.lit(False)), local).otherwise(model)


def route_near(hits: DataFrame, group: str, score: str, id_col: str, proximity: float, most: int = 5) -> DataFrame:
    """Candidates of each group within ``proximity`` of its best, the first ``most``."""
    w = Window.partitionBy(group)
    near = hits.filter(F.col(score).isNotNull()).withColumn("_top", F.max(score).over(w)).filter(F.col(score) >= F.col("_top") - proximity)
    return near.withColumn("_n", F.row_number().over(w.orderBy(F.desc(score), id_col))).filter(F.col("_n") <= most).drop("_top", "_n")


def strictly_best(scored: DataFrame, group: str, score: str) -> DataFrame:
    """The best of each group if no other has its score."""
    w = Window.partitionBy(group)
    best = scored.withColumn("_top", F.max(score).over(w)).filter(F.col(score) == F.col("_top"))
    return best.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n = 1").drop("_top", "_n")


def label_choice(tokens: Column, score: Column, lead: Column, grapes_conflict: Column) -> Column:
    """Whether label text decides: two specific tokens, a score of 5, a lead of 2, and no conflicting grapes."""
    return (F.size(tokens) >= 2) & (score >= 5) & (lead >= 2) & ~F.coalesce(grapes_conflict, F.lit(False))


def local_bonus(n: Column) -> Column:
    """ln(1 + min(n, 150)) / ln 151."""
    return F.log1p(F.least(n, F.lit(150))) / F.log(F.lit(151.0))


def learned_score(features: list[Column], mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    """A fitted linear model as an expression."""
    return sum(((f - m) / s * w for f, m, s, w in zip(features, mean, scale, weights, strict=True)), F.lit(bias))


def label_fields_score(card: dict[str, Column], said: dict[str, Column], weights: dict[str, tuple[float, float]]) -> Column:
    """Agreement of card and label: a gain for each equal field, a loss for each that differs, nothing where one is silent."""
    total = F.lit(0.0)
    for name, (gain, loss) in weights.items():
        a, b = F.lower(F.trim(card[name])), F.lower(F.trim(said[name]))
        total += F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, gain).otherwise(-loss)
    return total


def best_overlap(truth: DataFrame, seen: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """For each true box (group, box_id, box) the observation that overlaps it most, if by ``least``."""
    a = truth.select(group, F.col("box_id").alias("true_id"), F.col("box").alias("a"))
    b = seen.select(group, F.col("box_id").alias("seen_id"), F.col("box").alias("b"))
    met = a.join(b, group).withColumn("iou", V.iou(F.col("a"), F.col("b")))
    best = met.groupBy(group, "true_id").agg(F.min(F.struct((-F.col("iou")).alias("i"), "seen_id")).alias("m"))
    return best.select(group, "true_id", F.col("m.seen_id").alias("seen_id"), (-F.col("m.i")).alias("iou")).filter(F.col("iou") >= least)


def train_fusion(rows: DataFrame, features: list[str], label: str, reg: float = 0.01):
    """A balanced logistic regression over standardised features (MLlib pipeline model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    counts = {r[label]: r.n for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * max(1, counts.get(1, 0)))).otherwise(total / (2 * max(1, counts.get(0, 0))))
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol=label, weightCol="_w", regParam=reg),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_w", weight))
