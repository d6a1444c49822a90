"""Queries that evaluate. Predictions are made from hashes, so both engines have the same ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query

# A prediction for each labelled document: confidence from its id, right for most.
PRED = """p AS (SELECT doc_id, quality, toxic, ((doc_id * 7919 + 13) % 1000) / 1000.0::DOUBLE AS conf,
  CASE WHEN (doc_id * 31) % 10 < 7 THEN quality ELSE 1 - quality END AS pred FROM labels)"""


def _predictions(t):
    conf = ((F.col("doc_id") * 7919 + 13) % 1000) / 1000.0
    pred = F.when((F.col("doc_id") * 31) % 10 < 7, F.col("quality")).otherwise(1 - F.col("quality"))
    return t("labels").select("doc_id", "quality", "toxic", conf.cast("double").alias("conf"), pred.alias("pred"))


@query(f"WITH {PRED} SELECT quality AS truth, pred, count(*) AS n FROM p WHERE pred <> quality GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def confusions(t):
    wrong = _predictions(t).filter("pred <> quality").groupBy(F.col("quality").alias("truth"), "pred").agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "truth", "pred").limit(20)


@query(f"""WITH {PRED}, c AS (SELECT quality AS c, sum((pred = quality)::INT) AS tp, sum((pred <> quality)::INT) AS fn FROM p GROUP BY 1),
f AS (SELECT pred AS c, count(*) AS fp FROM p WHERE pred <> quality GROUP BY 1)
SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + coalesce(fp, 0) + fn)), 6) AS f1 FROM c LEFT JOIN f USING (c)""")
def macro_f1(t):
    return M.macro_f1(_predictions(t), "quality", "pred").select(F.round("f1", 6).alias("f1"))


@query(f"""WITH {PRED}, s AS (SELECT conf AS threshold, (SELECT sum((x.pred = x.quality)::INT) FROM p x WHERE x.conf >= y.conf) AS r,
  (SELECT count(*) FROM p x WHERE x.conf >= y.conf) AS n, (SELECT count(*) FROM p) AS a FROM (SELECT DISTINCT conf FROM p) y),
f AS (SELECT threshold, r / n::DOUBLE AS precision, r / a::DOUBLE AS recall FROM s)
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM f""")
def abstention_f1(t):
    rows = _predictions(t).withColumn("right", F.col("pred") == F.col("quality"))
    s = M.abstention_sweep(rows, "right", "conf")
    return s.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {PRED}, k AS (SELECT quality, round(conf, 1) AS c FROM p), r AS (SELECT quality, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE AS r FROM k),
n AS (SELECT sum(r) FILTER (WHERE quality = 1) AS s, count(*) FILTER (WHERE quality = 1)::DOUBLE AS p, count(*) FILTER (WHERE quality = 0) AS q FROM r)
SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auroc FROM n""")
def auroc_ties(t):
    rows = _predictions(t).select((F.col("quality") == 1).alias("positive"), F.round("conf", 1).alias("score"))
    return M.auroc(rows, "positive", "score").select(F.round("auroc", 6).alias("auroc"))


RATES = f"""{PRED}, th AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
r AS (SELECT threshold, avg((conf >= threshold)::INT) FILTER (WHERE toxic = 0) AS fpr, avg((conf < threshold)::INT) FILTER (WHERE toxic = 1) AS fnr FROM p, th GROUP BY 1)"""


def _rates(t):
    rows = _predictions(t).select((F.col("toxic") == 1).alias("positive"), "conf")
    return M.error_rates(rows, "positive", "conf", F.array(*[F.lit(i / 10) for i in range(10)]))


@query(f"WITH {RATES} SELECT threshold, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM r")
def threshold_sweep(t):
    return _rates(t).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("fnr", 6).alias("fnr"))


@query(f"WITH {RATES} SELECT min(threshold) FILTER (WHERE fpr <= 0.25) AS threshold, arg_min(threshold, (abs(fpr - fnr), threshold)) AS equal_error FROM r")
def threshold_choice(t):
    return M.recommended(_rates(t), 0.25)


@query(f"""WITH {PRED}, d AS (SELECT conf, lead(conf) OVER (ORDER BY conf) AS nxt FROM (SELECT DISTINCT conf FROM p)),
m AS (SELECT (conf + nxt) / 2 AS mid, (SELECT count(*) FROM p WHERE (quality = 1) = (p.conf > d.conf)) AS correct FROM d WHERE nxt IS NOT NULL)
SELECT arg_min(mid, (-correct, mid)) AS threshold, max(correct) AS correct FROM m""")
def refusal_calibration(t):
    return M.refusal_threshold(_predictions(t).withColumn("positive", F.col("quality") == 1), "positive", "conf")


@query(f"""WITH {PRED} SELECT count(*) AS n, round(avg(CASE WHEN conf < 0.3 THEN toxic = 1 ELSE toxic = 0 AND pred = quality END::INT), 6) AS accuracy,
  round(avg((conf >= 0.3)::INT), 6) AS accepted, round(sum((conf >= 0.3 AND pred = quality)::INT) / sum((conf >= 0.3)::INT)::DOUBLE, 6) AS precision FROM p""")
def open_set(t):
    """Accuracy with a floor: what is unknown (here: toxic) should be refused, the rest accepted and right."""
    p = _predictions(t)
    ok, right = F.col("conf") >= 0.3, F.col("pred") == F.col("quality")
    correct = F.when(~ok, F.col("toxic") == 1).otherwise((F.col("toxic") == 0) & right)
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.round(M.share(correct), 6).alias("accuracy"), F.round(M.share(ok), 6).alias("accepted"),
        F.round(F.sum((ok & right).cast("int")) / F.sum(ok.cast("int")), 6).alias("precision"),
    )


@query("""WITH v AS (SELECT event_type, list_sort(list(round(value, 4))) AS a, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
i AS (SELECT *, (n - 1) * 0.95::DOUBLE AS pos FROM v)
SELECT event_type, round(a[floor(pos)::INT + 1] + (a[least(n - 1, floor(pos) + 1)::INT + 1] - a[floor(pos)::INT + 1]) * (pos - floor(pos)), 6) AS linear,
  a[greatest(0, least(n - 1, ceil(n * 0.95::DOUBLE) - 1))::INT + 1] AS nearest_rank, a[round_even(pos, 0)::INT + 1] AS rounded_index,
  a[least(n - 1, floor(n * 0.95::DOUBLE))::INT + 1] AS floor_index, a[floor(pos)::INT + 1] AS lower, a[ceil(pos)::INT + 1] AS higher FROM i""")
def percentile_variants(t):
    v = t("events").select("event_type", F.round("value", 4).alias("value"))
    return M.percentiles(v, "event_type", "value", 0.95).withColumn("linear", F.round("linear", 6))


@query(f"""WITH {PRED}, s AS (SELECT unnest(list_concat(['all'], CASE WHEN toxic = 1 THEN ['toxic'] ELSE ['clean'] END)) AS stratum, pred = quality AS hit, conf FROM p)
SELECT stratum, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(avg(conf), 6) AS mean_conf FROM s GROUP BY 1""")
def stratified_metrics(t):
    tags = F.array(F.lit("all"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    s = _predictions(t).select(F.explode(tags).alias("stratum"), (F.col("pred") == F.col("quality")).alias("hit"), "conf")
    return s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(M.share(F.col("hit")), 6).alias("hit_rate"), F.round(F.avg("conf"), 6).alias("mean_conf"))


@query(f"""WITH {PRED}, k AS (SELECT toxic, sum((pred = quality)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM p GROUP BY 1)
SELECT toxic, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
  round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM k""")
def wilson_intervals(t):
    k = _predictions(t).groupBy("toxic").agg(F.sum((F.col("pred") == F.col("quality")).cast("double")).alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    k = k.withColumn("w", M.wilson(F.col("k"), F.col("n")))
    return k.select("toxic", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(f"""WITH {PRED}, c AS (SELECT CASE WHEN pred = quality THEN 'correct' WHEN toxic = 1 THEN 'not_in_catalog' WHEN conf > 0.8 THEN 'near_duplicate' WHEN conf < 0.1 THEN 'fallback' ELSE 'other' END AS kind FROM p)
SELECT kind, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM c GROUP BY 1""")
def error_types(t):
    kind = (
        F.when(F.col("pred") == F.col("quality"), "correct").when(F.col("toxic") == 1, "not_in_catalog")
        .when(F.col("conf") > 0.8, "near_duplicate").when(F.col("conf") < 0.1, "fallback").otherwise("other")
    )
    n = _predictions(t).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a few kinds


@query("""WITH r AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') + 1 AS rank, any_value(conv_id % 3) AS kind FROM conversations GROUP BY 1)
SELECT coalesce(kind::VARCHAR, 'all') AS kind, count(*) AS n, round(avg((rank = 1)::INT), 6) AS top1, round(avg(coalesce(rank <= 5, FALSE)::INT), 6) AS top5,
  round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM (SELECT conv_id, coalesce(rank, 99) AS rank, kind FROM r) GROUP BY ROLLUP (kind)""")
def hit_rates(t):
    """Hit rates and mean reciprocal rank by kind and over all; the rank is the place of the first assistant turn."""
    rank = (F.min(F.when(F.col("role") == "assistant", F.col("turn"))) + 1).alias("rank")
    r = t("conversations").groupBy("conv_id").agg(rank).withColumn("kind", (F.col("conv_id") % 3).cast("string"))
    rank = F.coalesce("rank", F.lit(99))
    out = r.rollup("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(M.share(rank == 1), 6).alias("top1"), F.round(M.share(rank <= 5), 6).alias("top5"),
        F.round(F.avg(M.reciprocal(rank)), 6).alias("mrr"),
    )
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))
