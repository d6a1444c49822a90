"""Queries of reports, profiles and records; predictions and profiles are made from the tables by rules that both engines follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import decisions, metrics, ranking, retrieval
from ..operators import diagnostics as D
from ..operators import profiles as P
from .registry import query

CAND = """c AS (SELECT o_custkey AS query_id, o_orderkey % 500 AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
near AS (SELECT c.*, p_brand AS maker FROM c JOIN part ON p_partkey = c.id WHERE rank <= 5), g AS (SELECT c_custkey AS query_id, c_custkey % 600 AS target, 'Brand#' || (11 + c_custkey % 5 * 10) AS maker FROM customer)"""
MISS = f"""{CAND}, m AS (SELECT g.*, CASE WHEN target NOT IN (SELECT p_partkey FROM part WHERE p_partkey < 550) THEN 'not_in_index' WHEN NOT EXISTS (SELECT 1 FROM near WHERE near.query_id = g.query_id) THEN 'empty_result'
  WHEN EXISTS (SELECT 1 FROM near WHERE near.query_id = g.query_id AND lower(near.maker) = lower(g.maker)) THEN 'family_or_vintage_twin' ELSE 'other_ranked_out' END AS reason
  FROM g WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.query_id = g.query_id AND near.id = g.target))"""


def _misses(t):
    c = t("orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 500).alias("id"), "o_totalprice", "o_orderkey")
    c = ranking.top_k(c, ["query_id"], "o_totalprice", "o_orderkey", 5).join(t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("maker")), "id")
    maker = F.concat(F.lit("Brand#"), (11 + F.col("c_custkey") % 5 * 10).cast("string"))
    g = t("customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 600).alias("target"), maker.alias("maker"))
    indexed = t("part").filter("p_partkey < 550").select(F.col("p_partkey").alias("id"))
    return D.classify_misses(g, indexed, c.select("query_id", "id", "rank", "maker"), 5)


@query(f"WITH {MISS} SELECT query_id, target, maker, reason FROM m")
def miss_reasons(t):
    return _misses(t)


@query(f"""WITH {MISS} SELECT 'reason' AS kind, reason AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'maker', maker, n FROM (SELECT maker, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, maker LIMIT 3)""")
def miss_summary(t):
    return D.miss_summary(_misses(t), 3)


VERD = """v AS (SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'outside' WHEN doc_id % 2 = quality OR doc_id % 3 = 0 THEN 'right' ELSE 'wrong' END AS verdict, CASE WHEN doc_id % 4 = 0 THEN 'disputed' ELSE 'sure' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"""WITH {VERD}, p AS (SELECT unnest(list_filter([CASE WHEN verdict IN ('right', 'wrong') THEN 'in_catalog' END, CASE WHEN verdict IN ('right', 'wrong') THEN CASE status WHEN 'sure' THEN 'in_catalog_sure' ELSE 'disputed' END END,
  CASE WHEN verdict IN ('outside', 'unlabelled') THEN verdict END], lambda x: x IS NOT NULL)) AS part, verdict FROM v), s AS (SELECT part, count(*) AS n, count(*) FILTER (WHERE verdict = 'right') AS r FROM p GROUP BY 1)
SELECT part, n, CASE WHEN part LIKE 'in%' OR part = 'disputed' THEN r END AS "right", CASE WHEN part LIKE 'in%' OR part = 'disputed' THEN round(r / n::DOUBLE, 4) END AS accuracy FROM s""")
def verdict_scores(t):
    """Predictions against labels with alternatives: a third of the rows has two that count."""
    d = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    quality = F.col("quality").cast("string")
    expected = F.when(F.col("toxic") == 1, "").when(F.col("doc_id") % 3 == 0, "0|1").otherwise(quality)
    found = d.select(
        D.verdict(expected, (F.col("doc_id") % 2).cast("string"), F.col("quality").isNotNull()).alias("verdict"), F.when(F.col("doc_id") % 4 == 0, "disputed").otherwise("sure").alias("status")
    )
    return D.verdict_scores(found)


@query("""WITH s AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 400000 THEN 'large' WHEN o_custkey % 10 = 0 THEN 'tenth' ELSE 'correct' END AS outcome FROM orders)
SELECT x AS outcome, (SELECT count(*) FROM s WHERE s.outcome = x) AS n FROM (SELECT unnest(['pending', 'never', 'large', 'tenth', 'correct']) AS x)""")
def outcome_funnel(t):
    stages = [("pending", F.col("o_orderstatus") == "P"), ("never", F.lit(False)), ("large", F.col("o_totalprice") > 400000), ("tenth", F.col("o_custkey") % 10 == 0)]
    return D.funnel(t("orders"), stages)


@query("""WITH p AS (SELECT o_custkey AS q, o_orderkey % 7 AS slot, o_orderkey % 40 AS id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderstatus END AS ev FROM orders), a AS (SELECT c_custkey AS q, unnest([0, 1, 2, 3, 4]) AS slot FROM customer),
x AS (SELECT *, count(*) OVER (PARTITION BY q, slot) AS n FROM p), s AS (SELECT unnest(list_filter([CASE WHEN slot > 4 THEN 'unknown' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN id >= 20 THEN 'out_of_shortlist' END, CASE WHEN trim(ev) = '' THEN 'no_evidence' END], lambda z: z IS NOT NULL)) AS problem FROM x)
SELECT problem, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'missing', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.q = a.q AND p.slot = a.slot)""")
def proposal_report(t):
    p = t("orders").select(
        F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 7).alias("slot"), (F.col("o_orderkey") % 40).alias("id"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderstatus")).alias("evidence")
    )
    asked = t("customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)])).alias("slot"))
    listed = t("customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("id"))
    return D.proposal_report(p, asked, listed)


@query("""WITH a AS (SELECT o_custkey AS crop_id, o_orderkey % 7 AS slot, nullif(o_orderstatus, 'P') AS ev, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT crop_id, slot, ev AS evidence FROM a WHERE n = 1 AND slot < 5 AND ev IS NOT NULL""")
def valid_answers(t):
    a = t("orders").select(F.col("o_custkey").alias("crop_id"), (F.col("o_orderkey") % 7).alias("slot"), F.nullif("o_orderstatus", F.lit("P")).alias("evidence"))
    return D.valid_answers(a, t("orders").filter("o_orderkey % 7 < 5").select((F.col("o_orderkey") % 7).alias("slot")))


@query("""WITH r AS (SELECT (l_linenumber % 8) + 1 AS rank, l_discount AS score, CASE WHEN l_tax > 0.01 THEN l_tax END AS gap FROM lineitem)
SELECT count(*) AS n, round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS top5, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, round(avg(gap), 6) AS mean_gap, round(median(gap), 6) AS median_gap, round(avg((gap IS NULL)::INT), 6) AS dominant FROM r""")
def ranking_summary(t):
    r = t("lineitem").select((F.col("l_linenumber") % 8 + 1).alias("rank"), F.col("l_discount").alias("score"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("gap"))
    s = D.ranking_summary(r)
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@query("""SELECT p_brand AS family, count(*) FILTER (WHERE p_size >= 5) AS indexed, count(*) FILTER (WHERE p_size < 5) AS missing, round(max(p_retailprice) FILTER (WHERE p_size >= 5) - min(p_retailprice) FILTER (WHERE p_size >= 5), 4) AS spread FROM part GROUP BY 1""")
def family_diagnostics(t):
    p = t("part")
    scores = p.filter("p_size >= 5").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return D.family_diagnostics(scores, p.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"))).withColumn("spread", F.round("spread", 4))


@query("""WITH d AS (SELECT text, string_split(trim(coalesce(text, '')), ' ') AS w FROM documents) SELECT count(*) AS n, round(avg((length(trim(coalesce(text, ''))) > 0)::INT), 6) AS non_empty, round(avg((len(list_filter(w, lambda x: length(x) >= 14)) > 0)::INT), 6) AS informative,
  round(avg(length(text)) FILTER (WHERE length(trim(coalesce(text, ''))) > 0), 4) AS mean_length, round(avg(len(w)) FILTER (WHERE length(trim(coalesce(text, ''))) > 0), 4) AS mean_tokens FROM d""")
def text_yields(t):
    w = F.split(F.trim(F.coalesce("text", F.lit(""))), " ")
    d = t("documents").select("text", w.alias("w"), F.filter(w, lambda x: F.length(x) >= 14).alias("long"))
    s = D.yields(d, "text", "w", "long")
    return s.select("n", F.round("non_empty", 6).alias("non_empty"), F.round("informative", 6).alias("informative"), F.round("mean_length", 4).alias("mean_length"), F.round("mean_tokens", 4).alias("mean_tokens"))


@query("""WITH r AS (SELECT l_orderkey AS anchor, CASE WHEN l_linenumber % 3 = 0 THEN 'positive' WHEN l_linenumber % 3 = 1 THEN 'family' ELSE 'neighbour' END AS kind FROM lineitem), a AS (SELECT anchor, count(*) FILTER (WHERE kind = 'positive') AS p, count(*) FILTER (WHERE kind <> 'positive') AS n FROM r GROUP BY 1)
SELECT count(*) AS anchors, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, sum(p * n)::BIGINT AS triplets, count(DISTINCT anchor % 97) AS families FROM a""")
def triplet_summary(t):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "positive").when(F.col("l_linenumber") % 3 == 1, "family").otherwise("neighbour")
    return D.triplet_summary(t("lineitem").select(F.col("l_orderkey").alias("anchor"), kind.alias("kind"), (F.col("l_orderkey") % 97).alias("family")))


@query("""SELECT vec_id, len(list_filter(embedding::DOUBLE[], lambda x: x >= 0.1))::INT AS large FROM embeddings""")
def large_components(t):
    return t("embeddings").select("vec_id", D.at_least(V.doubles("embedding"), 0.1).alias("large"))


@query("""WITH c AS (SELECT unnest([{'config': 'a', 'x': 1.0::DOUBLE, 'y': 0.0::DOUBLE}, {'config': 'b', 'x': 0.0, 'y': 1.0}, {'config': 'c', 'x': 1.0, 'y': -1.0}]) AS c), s AS (SELECT c.config AS config, l_orderkey % 2 AS fold, l_orderkey AS g, l_linenumber % 2 = 1 AS ok, round(c.x * l_discount + c.y * l_tax, 9) AS s FROM lineitem, c),
b AS (SELECT config, fold, g, arg_max(ok, (s, NOT ok)) AS ok FROM s GROUP BY 1, 2, 3), r AS (SELECT config, avg(ok::INT) FILTER (WHERE fold = 0) AS fit, avg(ok::INT) FILTER (WHERE fold = 1) AS chk FROM b GROUP BY 1)
SELECT config, round(fit, 6) AS fit, round(chk, 6) AS "check" FROM r ORDER BY fit DESC, config LIMIT 1""")
def tuned_rule(t):
    """The best of three rules on one fold, and how it does on the other."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_orderkey") % 2).alias("fold"), (F.col("l_linenumber") % 2 == 1).alias("ok"), "l_discount", "l_tax")
    configs = rows.sparkSession.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 1.0, -1.0)], "config string, x double, y double")
    scored = F.round(F.col("x") * F.col("l_discount") + F.col("y") * F.col("l_tax"), 9)
    best = D.tuned(rows, configs, scored, "g", "ok", "fold")
    return best.select("config", F.round("fit", 6).alias("fit"), F.round("check", 6).alias("check"))


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM (SELECT b.vec_id AS q, a.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0))
SELECT label AS quality, count(*) AS n, round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS top5 FROM v JOIN embeddings e ON e.vec_id = q WHERE q = id GROUP BY 1""")
def self_matches(t):
    """Where vectors find themselves among all, by their label."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"), F.lit(0).alias("group"))
    asked = e.filter("id % 100 = 0").select((-1 - F.col("id")).alias("query_id"), "vector", "group")  # other ids, so that nothing is left out
    found = retrieval.nearest(e, asked, 5).select((-1 - F.col("query_id")).alias("query_id"), "id", "rank")
    quality = t("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("quality"))
    out = D.self_matches(found, quality)
    return out.select("quality", "n", F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


@query("""WITH o AS (SELECT (l_discount * 10)::DOUBLE AS v FROM lineitem), s AS (SELECT list_sort(list(v)) AS a, count(*) AS n FROM o), p AS (SELECT *, (n - 1) * 0.95::DOUBLE AS pos FROM s)
SELECT n, round((SELECT avg(v) FROM o), 6) AS mean, round((SELECT avg((v >= 0.5)::INT) FROM o), 6) AS half, round((SELECT avg((v >= 0.7)::INT) FROM o), 6) AS most, round(a[floor(pos)::INT + 1] + (a[floor(pos)::INT + 2] - a[floor(pos)::INT + 1]) * (pos - floor(pos)), 6) AS p95 FROM p""")
def overlap_summary(t):
    s = D.overlap_summary(t("lineitem").select((F.col("l_discount") * 10).alias("iou")), "iou")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "half", "most", "p95")])


@query("""WITH k AS (SELECT count(*) FILTER (WHERE quality = 0 AND doc_id % 3 = 0 AND toxic = 0) AS f, count(*) FILTER (WHERE toxic = 1 AND NOT (quality = 0 AND doc_id % 3 = 0)) AS b FROM labels)
SELECT f AS fixed, b AS broken, round(CASE WHEN f + b = 0 THEN 1 ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(f + b + 1) - lgamma(i + 1) - lgamma(f + b - i + 1) - (f + b) * ln(2.0::DOUBLE))) FROM range(least(f, b) + 1) t(i))) END, 6) AS p FROM k""")
def paired_sign_test(t):
    """One verdict right (poor, of a third of the ids) and another (toxic), over all labels."""
    better = (F.col("quality") == 0) & (F.col("doc_id") % 3 == 0)
    return metrics.sign_test(t("labels"), better, F.col("toxic") == 1).withColumn("p", F.round("p", 6))


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size < 10 THEN 'size' END, CASE WHEN p_type = 'PROMO' THEN 'type' END], lambda x: x IS NOT NULL) AS missing, round(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size % 5 / 5.0::DOUBLE END, 4) AS rating,
  round(0.7::DOUBLE * CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size % 5 / 5.0::DOUBLE END + 0.3::DOUBLE * (p_size % 4) / 4, 4) AS composite FROM part""")
def card_scores(t):
    """Cards by rating and completeness, with the fields that they lack."""
    p = t("part")
    score = D.catalog_score(F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 5).cast("double")), F.col("p_size") % 4, F.lit(4), 0.7, 0.3)
    missing = D.missing_fields({"size": F.when(F.col("p_size") >= 10, F.col("p_size")), "type": F.nullif("p_type", F.lit("PROMO"))})
    return p.select("p_partkey", missing.alias("missing"), score.alias("s")).select("p_partkey", "missing", "s.rating", "s.composite")


# ---- profiles


@query("""WITH t AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS name FROM part), p AS (SELECT name, length(name) / 10.0::DOUBLE AS a, CASE WHEN length(name) % 2 = 0 THEN length(name) / 20.0::DOUBLE END AS b FROM (SELECT DISTINCT name FROM t) WHERE length(name) > 4)
SELECT id, round(avg(a), 3) AS a, round(avg(b), 3) AS b, avg(a) IS NOT NULL AND avg(b) IS NOT NULL AS usable, CASE WHEN id % 3 = 0 THEN 'catalog' WHEN avg(a) IS NOT NULL AND avg(b) IS NOT NULL THEN 'sensory' WHEN id % 3 = 1 THEN 'heuristic' ELSE 'unavailable' END AS basis FROM t LEFT JOIN p USING (name) GROUP BY 1""")
def averaged_profiles(t):
    """Means of the profiles of an item's words, and what its profile may rest on."""
    names = F.split("p_name", " ")
    words = t("part").select(F.explode(names).alias("name")).distinct().filter(F.length("name") > 4)
    n = F.length("name")
    profiles = words.select("name", (n / 10.0).alias("a"), F.when(n % 2 == 0, n / 20.0).alias("b"))
    found = P.averaged_profile(t("part").withColumn("names", names), "p_partkey", "names", profiles, ["a", "b"])
    ok = P.usable([F.col("a"), F.col("b")])
    return found.select("id", "a", "b", ok.alias("usable"), P.basis([("catalog", F.col("id") % 3 == 0), ("sensory", ok), ("heuristic", F.col("id") % 3 == 1)]).alias("basis"))


@query("""WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_type = 'PROMO' THEN 2 WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS tier, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 10 END AS fit, p_retailprice FROM part)
SELECT p_brand, p_partkey, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier DESC, fit DESC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey) AS place FROM s) WHERE place <= 5""")
def shelf_order(t):
    items = t("part").select("p_brand", "p_partkey", "p_type", "p_size", "p_retailprice", F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 10).alias("fit"))
    out = P.shelf_order(items, "p_brand", F.col("p_type") == "PROMO", F.col("p_size") % 2 == 0, "fit", "p_retailprice", "p_partkey")
    return out.filter("place <= 5").select("p_brand", "p_partkey", "tier", "place")


@query("""WITH s(slug, color, sugar) AS (VALUES ('a', NULL, '1'), ('b', 'PROMO', NULL), ('c', 'ECONOMY', '2')), i AS (SELECT p_partkey AS id, unnest(CASE p_size % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b', 'c'] WHEN 2 THEN ['c', 'c'] ELSE [] END) AS slug, p_type AS color, (p_size % 3)::VARCHAR AS sugar, p_retailprice AS score FROM part)
SELECT slug, id, rank FROM (SELECT i.slug, id, row_number() OVER (PARTITION BY i.slug ORDER BY score DESC, id) AS rank FROM (SELECT DISTINCT * FROM i) i JOIN s ON s.slug = i.slug AND (s.color IS NULL OR s.color = i.color) AND (s.sugar IS NULL OR s.sugar = i.sugar)) WHERE rank <= 5""")
def style_analogs(t):
    styles = t("part").sparkSession.createDataFrame([("a", None, None, "1"), ("b", "PROMO", None, None), ("c", "ECONOMY", None, "2")], "slug string, color string, still boolean, sugar string")
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    of = F.when(F.col("p_size") % 4 == 0, arr("a", "b")).when(F.col("p_size") % 4 == 1, arr("b", "c")).when(F.col("p_size") % 4 == 2, arr("c", "c")).otherwise(arr())
    items = t("part").select(F.col("p_partkey").alias("id"), of.alias("styles"), F.col("p_type").alias("color"), F.lit(True).alias("still"), (F.col("p_size") % 3).cast("string").alias("sugar"), F.col("p_retailprice").alias("score"))
    return P.analogs(items, styles, 5)


# ---- records


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'guest' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 WHEN c_custkey % 3 = 0 THEN 2 END AS confirmed, c_custkey % 3 = 0 AS registered FROM customer WHERE c_custkey % 5 <> 0""")
def upgraded_guests(t):
    """Guests that are not deleted, with their accounts' fields; a confirmation that was there before stays."""
    c = t("customer").select("c_custkey", F.lit("guest").alias("name"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("confirmed"), F.when(F.col("c_custkey") % 5 == 0, 1).alias("deleted_at"))
    accounts = t("customer").filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("name"), F.lit(2).alias("confirmed"))
    return P.upgraded(P.alive(c), accounts, "c_custkey", "confirmed").drop("deleted_at")


@query("""SELECT user_id, list(event_id ORDER BY ts, event_id) AS events FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def ordered_purchases(t):
    e = t("events").filter("event_type = 'purchase'").withColumn("order", F.struct("ts", "event_id"))
    return P.ordered_values(e, "user_id", "event_id", "order").withColumnRenamed("values", "events")


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS id, l_discount * 5 AS score FROM lineitem), s AS (SELECT query_id, max(score) AS best FROM r GROUP BY 1) SELECT query_id, count(*) AS n, max(best) AS best FROM r JOIN s USING (query_id) WHERE best >= 0.4 GROUP BY 1""")
def refused_questions(t):
    """Hits of the questions whose best score is good enough."""
    r = t("lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_discount") * 5).alias("score"))
    return retrieval.refuse(r, "score", 0.4).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 0.0::DOUBLE WHEN p_size % 6 = 1 THEN 2.0 WHEN p_size % 6 = 2 THEN -1.0 ELSE 1.0 END AS agreement, round(ln(1 + least(p_size, 150)) / ln(151), 6) AS bonus FROM part""")
def label_agreement(t):
    """Fields of a card and a label that agree, differ, or are silent."""
    m = F.col("p_size") % 6
    card = {"year": F.lit("2019"), "color": F.when(m != 0, "red")}
    said = {"year": F.when(m == 1, "2019").when(m == 2, "2018"), "color": F.when(m == 1, " Red ").when(m > 2, "RED")}
    score = decisions.label_fields_score(card, said, {"year": (1.0, 1.0), "color": (1.0, 0.5)})
    return t("part").select("p_partkey", score.alias("agreement"), F.round(decisions.local_bonus(F.col("p_size")), 6).alias("bonus"))


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::VARCHAR WHEN l_linenumber % 3 = 0 THEN '' END AS a FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS n FROM lineitem) WHERE n = 1)
SELECT k, arg_min(a, seq) FILTER (WHERE a <> '') AS a FROM p GROUP BY 1""")
def earliest_filled(t):
    """Of each order the first line's value that isn't empty."""
    n = F.col("l_linenumber")
    one = ranking.capped(t("lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_quantity")], 1)
    p = one.select(F.col("l_orderkey").alias("k"), n.alias("seq"), F.when(n % 2 == 0, F.col("l_shipdate").cast("string")).when(n % 3 == 0, "").alias("a"))
    return ranking.earliest_filled(p, "k", ["a"], "seq")


@query("""WITH u AS (SELECT c_custkey AS k, 'customer' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'order' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) SELECT * FROM u""")
def first_of_parts(t):
    """Keys of two tables; of one that is in both the first table's row."""
    c = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    return ranking.union_first([c, t("orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin")).distinct()], "k")
