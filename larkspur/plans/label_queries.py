"""Queries of boxes, matching and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import decisions, families, labels, matching
from .registry import query


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem)
SELECT k, n, CASE WHEN n % 5 = 0 THEN 'm' WHEN a > b THEN 'l' ELSE 'm' END AS max_score, CASE WHEN n % 5 = 0 THEN 'm' WHEN b >= 0.4 THEN 'm' ELSE 'l' END AS confident_else_cv,
  CASE WHEN n % 5 = 0 OR n % 3 = 0 THEN 'm' WHEN a > b THEN 'l' ELSE 'm' END AS agree_else_cv, 'm' AS agree_else_llm FROM s""")
def choice_rules(t):
    """One of two results by four rules: scores, sureness, agreement (a third of the lines); without a local result (a fifth) the model's."""
    s = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"))
    same = F.when(F.col("n") % 3 == 0, "same")
    side = lambda name, score, gone, sure: F.struct(F.when(~gone, F.coalesce(same, F.lit(name))).alias("id"), score.alias("score"), score.alias("visual"), sure.alias("confident"), F.lit(name).alias("side"))
    local = side("l", F.col("a"), F.col("n") % 5 == 0, F.lit(False))
    model = side("m", F.col("b"), F.lit(False), F.col("b") >= 0.4)
    return s.select("k", "n", *[decisions.choose(r, local, model)["side"].alias(r) for r in ("max_score", "confident_else_cv", "agree_else_cv", "agree_else_llm")])


@query("""WITH b AS (SELECT l_orderkey AS image, l_linenumber * 10000000 + l_partkey AS box_id, greatest(l_discount * 10, 0.05)::DOUBLE AS score, l_quantity::DOUBLE AS x0, l_linenumber::DOUBLE AS y0, l_quantity + 10 + l_linenumber * 8::DOUBLE AS x1, l_linenumber + 20::DOUBLE AS y1 FROM lineitem),
k AS (SELECT * FROM (SELECT *, max((score >= 0.15)::INT) OVER (PARTITION BY image) AS any_sure FROM b) WHERE score >= 0.15 OR any_sure = 0),
h AS (SELECT k.image, k.box_id, count(o.box_id) AS held FROM k LEFT JOIN k o ON o.image = k.image AND o.box_id <> k.box_id AND o.score >= 0.5 * k.score
  AND greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0)) / ((o.x1 - o.x0) * (o.y1 - o.y0)) >= 0.8 GROUP BY 1, 2),
w AS (SELECT image, box_id, score * sqrt(least(0.1::DOUBLE, (x1 - x0) * (y1 - y0) / 10000)) * (0.1::DOUBLE + 0.9::DOUBLE * (1 - least(1.0::DOUBLE, abs((x0 + x1) / 2 / 100 - 0.5::DOUBLE) * 2))) * CASE WHEN held >= 2 THEN 0.5::DOUBLE ELSE 1 END AS weight FROM k JOIN h USING (image, box_id)),
f AS (SELECT *, round(ln(greatest(weight, 1e-9::DOUBLE) / (CASE WHEN max(weight) OVER (PARTITION BY image) = 0 THEN 1e-9::DOUBLE ELSE max(weight) OVER (PARTITION BY image) END)), 6) AS log_prior, row_number() OVER (PARTITION BY image ORDER BY weight DESC, box_id) AS place FROM w)
SELECT image, box_id, round(weight, 6) AS weight, log_prior FROM f WHERE place = 1""")
def main_boxes(t):
    """The box of each image that weighs most: sure, large, near the middle, no group of others."""
    q = F.col("l_quantity").cast("double")
    n = F.col("l_linenumber").cast("double")
    b = t("lineitem").select(
        F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("box_id"), F.greatest(F.col("l_discount") * 10, F.lit(0.05)).alias("score"),
        q.alias("x0"), n.alias("y0"), (q + 10 + n * 8).alias("x1"), (n + 20).alias("y1"),
    )
    hundred = F.lit(100.0)
    held = labels.box_weights(b, "image", hundred, hundred).withColumn("top1", F.lit(0.0)).withColumn("margin", F.lit(0.0))
    chosen = labels.choose_box(labels.box_features(held, "image", hundred, hundred), "image")
    return chosen.select("image", "box_id", F.round("weight", 6).alias("weight"), F.round("log_prior", 6).alias("log_prior"))


@query("""WITH b AS (SELECT l_orderkey AS image, l_linenumber AS id, l_quantity::DOUBLE AS x0, l_quantity + 10 + l_linenumber::DOUBLE AS x1 FROM lineitem),
p AS (SELECT a.image, a.id AS true_id, b.id AS seen_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS both_, a.x1 - a.x0 AS wa, b.x1 - b.x0 AS wb FROM b a JOIN b ON a.image = b.image WHERE a.id % 2 = 1 AND b.id % 2 = 0),
i AS (SELECT image, true_id, seen_id, both_ / (wa + wb - both_) AS iou FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY image, true_id ORDER BY iou DESC, seen_id) AS n FROM i)
SELECT image, true_id, seen_id, round(iou, 6) AS iou FROM r WHERE n = 1 AND iou >= 0.5""")
def overlapping_boxes(t):
    """For each true box (odd lines) the observed one (even lines) that overlaps it most."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    box = F.struct(q.alias("x0"), F.lit(0.0).alias("y0"), (q + 10 + n).alias("x1"), F.lit(1.0).alias("y1"))
    b = t("lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box_id"), box.alias("box"))
    found = decisions.best_overlap(b.filter("box_id % 2 = 1"), b.filter("box_id % 2 = 0"), "image")
    return found.withColumn("iou", F.round("iou", 6))


@query("""WITH c AS (SELECT user_id AS key, event_id AS item, event_id * 10 + g AS grp, ts + to_minutes((g * 900)::INT) AS ts FROM events, range(2) r(g) WHERE event_type = 'view'),
a AS (SELECT user_id AS key, ts FROM events WHERE event_type = 'purchase'), d AS (SELECT item, grp, min(abs(epoch_us(c.ts) - epoch_us(a.ts))) / 3.6e9 AS hours FROM c JOIN a USING (key) GROUP BY 1, 2),
r AS (SELECT *, lead(hours) OVER (PARTITION BY item ORDER BY hours, grp) AS next_hours, row_number() OVER (PARTITION BY item ORDER BY hours, grp) AS n FROM d)
SELECT item, grp AS "group", round(hours, 6) AS hours, round(next_hours, 6) AS next_hours FROM r WHERE n = 1 AND hours <= 8 AND next_hours >= 9""")
def nearest_groups(t):
    """Of two candidate times of a view the one near to a purchase of the user, if the other is far from all."""
    e = t("events")
    c = e.filter("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("item"), F.explode(F.array(F.lit(0), F.lit(1))).alias("g"), "ts")
    c = c.select("key", "item", (F.col("item") * 10 + F.col("g")).alias("group"), (F.col("ts") + F.col("g") * F.expr("INTERVAL 900 MINUTES")).cast("timestamp").alias("ts"))
    a = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    found = matching.clearly_nearest(c, a, "key", 8, 9)
    return found.select("item", "group", F.round("hours", 6).alias("hours"), F.round("next_hours", 6).alias("next_hours"))


@query("""WITH RECURSIVE d AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(p_name, ' ') || [p_name || p_brand])) AS token FROM part), g AS (SELECT token, min(id) AS first FROM d GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
e0 AS (SELECT DISTINCT id AS u, first AS v FROM d JOIN g USING (token) WHERE id <> first), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0),
r(u, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u), c AS (SELECT u AS node, min(root) AS root FROM r GROUP BY 1)
SELECT node, root, dense_rank() OVER (ORDER BY root) AS group_id FROM c""")
def token_groups(t):
    """Parts that share a token which few have, and the groups' numbers."""
    tokens = F.concat(F.split("p_name", " "), F.array(F.concat("p_name", "p_brand")))
    return matching.dense_ids(matching.token_clusters(t("part").withColumn("tokens", tokens), "p_partkey", "tokens", 2, 4)).select("node", "root", "group_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' WHEN o_orderkey % 10 = 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def overridden_rows(t):
    """A tenth of the orders has its status overridden, a tenth emptied."""
    o = t("orders").select("o_orderkey", "o_orderstatus")
    fixed = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "X").alias("o_orderstatus"))
    return matching.overridden(o, fixed, "o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey AS key, 'unknown key' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT c_custkey, 'unknown value' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def unknown_overrides(t):
    known = t("orders").select("o_custkey").distinct()
    values = t("nation").filter("n_regionkey < 3").select("n_nationkey")
    return matching.unknown_overrides(t("customer"), "c_custkey", "c_nationkey", known, values).select("key", "problem")


@query("""SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2) THEN 'first second' WHEN c_nationkey = 3 THEN 'third' ELSE c_nationkey::VARCHAR END AS alias_text FROM customer""")
def alias_texts(t):
    """Values of one group of aliases read as all of them."""
    spark = t("customer").sparkSession
    aliases = spark.createDataFrame([("g", "first"), ("g", "second"), ("h", "third")], "group string, alias string")
    name = F.when(F.col("c_nationkey") == 1, " FIRST").when(F.col("c_nationkey") == 2, "second").when(F.col("c_nationkey") == 3, "Third").otherwise(F.col("c_nationkey").cast("string"))
    return matching.alias_text(t("customer").select("c_custkey", name.alias("n")), "n", aliases).select("c_custkey", "alias_text")


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name) || '-' || (1990 + p_size), '[^a-z0-9]+', '-', 'g'), '-(19|20)[0-9]{2}$', '') AS base, 1990 + p_size AS year FROM part WHERE p_size < 60""")
def slugs_by_year(t):
    """The year in a slug, and the slug without it."""
    slug = T.slug(F.concat("p_name", F.lit("-"), (F.col("p_size") + 1990).cast("string")), "page")
    year, base = families.year_and_base(slug)
    return t("part").filter("p_size < 60").select("p_partkey", base.alias("base"), year.alias("year"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n, e FROM v)
SELECT vec_id, round(e[1] / n, 6) AS first, round(sqrt((e[1] - e[3]) * (e[1] - e[3]) + (e[2] - e[4]) * (e[2] - e[4])), 6) AS apart FROM m""")
def unit_vectors(t):
    e = t("embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    axes = lambda i: F.struct(F.col("e")[i].alias("a"), F.col("e")[i + 1].alias("b"))
    return e.select("vec_id", F.round(V.unit(F.col("e"))[0], 6).alias("first"), F.round(V.masked_distance(axes(0), axes(2), ["a", "b"]), 6).alias("apart"))


@query("""SELECT p_partkey, 'size=' || printf('%.2f', p_size::DOUBLE) || ' price=' || printf('%.2f', p_retailprice) AS shown, '[1] ' || p_name || chr(10) || '[2] ' || p_brand AS block, CASE WHEN p_size % 3 = 0 THEN 'host' WHEN p_size % 3 = 1 THEN '1.2.3.4' ELSE 'unknown' END AS ip,
  split_part(p_name || '__' || p_size, '__', 1) AS slug FROM part""")
def scalar_texts(t):
    """Vectors and excerpts as text, client addresses, slugs of file names."""
    m = F.col("p_size") % 3
    ip = S.client_ip(F.when(m == 1, " 1.2.3.4, 9.9.9.9").when(m == 2, " "), F.when(m == 0, "host"))
    shown = S.vector_text(["size", "price"], F.struct(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")))
    return t("part").select("p_partkey", shown.alias("shown"), S.excerpts(F.array("p_name", "p_brand")).alias("block"), ip.alias("ip"), S.slug_of_file(F.concat_ws("__", "p_name", "p_size")).alias("slug"))


@query("""WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x, p_partkey % 13 / 13.0::DOUBLE AS u, p_partkey % 7 / 7.0::DOUBLE AS v FROM part)
SELECT p_partkey, round(greatest(0, least(x + 10, 40) - greatest(x, 20)) / 10, 6) AS inside, len(list_distinct([floor(u * 6) * 6 + floor(v * 6), floor(v * 6) * 6 + floor(u * 6), 35])) / 36.0::DOUBLE AS covered FROM b""")
def box_shares(t):
    """How much of a box lies in another, and how many cells of a grid points fall into."""
    x, u, v = F.col("p_size").cast("double"), F.col("p_partkey") % 13 / 13.0, F.col("p_partkey") % 7 / 7.0
    box = lambda a, b: F.struct(a.alias("x0"), F.lit(0.0).alias("y0"), b.alias("x1"), F.lit(1.0).alias("y1"))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    points = F.array(point(u, v), point(v, u), point(F.lit(1.0), F.lit(1.0)))
    return t("part").select("p_partkey", F.round(V.inside_share(box(x, x + 10), box(F.lit(20.0), F.lit(40.0))), 6).alias("inside"), V.grid_coverage(points).alias("covered"))


@query("""WITH l AS (SELECT p_brand, list({'l': p_partkey % 7, 'r': p_partkey % 5, 'o': p_size / 50.0::DOUBLE} ORDER BY p_size DESC, p_partkey % 7, p_partkey % 5) AS ps FROM part WHERE p_size >= 25 GROUP BY 1),
k AS (SELECT p_brand, list_reduce(list_transform(ps, lambda p: [p]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda k: k.l = v[1].l OR k.r = v[1].r)) > 0 THEN acc ELSE list_concat(acc, v) END) AS kept FROM l), u AS (SELECT p_brand, unnest(kept) AS m FROM k)
SELECT p_brand, m.l AS left_id, m.r AS right_id, m.o AS overlap FROM u""")
def one_to_one_matches(t):
    """Greedy matches of two sides in each brand, best overlap first."""
    from ..operators import ranking

    pairs = t("part").select("p_brand", (F.col("p_partkey") % 7).alias("left_id"), (F.col("p_partkey") % 5).alias("right_id"), (F.col("p_size") / 50.0).alias("overlap"))
    return ranking.match_one_to_one(pairs, "p_brand", 0.5)


@query("""WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS m FROM documents), x AS (SELECT doc_id, ('0x' || substr(m, 1, 8))::BIGINT AS a, ('0x' || substr(m, 9, 8))::BIGINT AS b, ('0x' || substr(m, 17, 8))::BIGINT AS c, ('0x' || substr(m, 25, 8))::BIGINT AS d FROM h)
SELECT doc_id, (bit_count(xor(a, c)) + bit_count(xor(b, d)))::INT AS apart FROM x""")
def hex_distances(t):
    """Differing bits of the halves of a digest, as hexadecimal texts with the top bit in use."""
    m = F.md5(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", V.hamming_hex(F.substring(m, 1, 16), F.substring(m, 17, 16)).alias("apart"))
