"""Queries over parts, orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, events, joins, ranking, recommend, rules
from .registry import query


@query("""WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*)::DOUBLE AS n FROM d),
c AS (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS field,
  unnest([count(doc_id), count(nullif(text, '')), count(nullif(lang, '')), count(nullif(source, '')), count(n_chars), count(quality), count(toxic)]) AS filled FROM d)
SELECT field, filled, round(100 * filled / n, 2) AS percent FROM c, n""")
def field_coverage(t):
    return aggregates.coverage(t("documents").join(t("labels"), "doc_id", "left"))


TAGS = "tags AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS tags FROM part)"


def _tags(t):
    return t("part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("tags"))


@query(f"WITH {TAGS}, e AS (SELECT unnest(tags) AS element FROM tags) SELECT element, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, element LIMIT 10")
def popular_elements(t):
    return aggregates.popular(_tags(t), "tags", 10)


@query(f"WITH {TAGS} SELECT sum((len(tags) > 0)::INT)::BIGINT AS rows_with_any, count(*) AS rows, (SELECT count(DISTINCT e) FROM (SELECT unnest(tags) AS e FROM tags)) AS distinct_used FROM tags")
def style_usage(t):
    return aggregates.usage(_tags(t), "tags")


SWIPES = """s AS (SELECT user_id, CAST(props->>'k' AS BIGINT) AS item_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'like' ELSE 'pass' END AS verdict FROM events),
i AS (SELECT p_partkey AS item_id, p_brand AS style, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 49.0::DOUBLE END AS size_axis, p_retailprice / 1999.0::DOUBLE AS price_axis FROM part)"""


@query(f"""WITH {SWIPES}, l AS (SELECT user_id, i.* FROM s JOIN i USING (item_id) WHERE verdict = 'like'),
a AS (SELECT user_id, count(*) AS likes, sum(coalesce(size_axis, 0)) AS sa, sum(price_axis) AS pa FROM l GROUP BY 1), c AS (SELECT user_id, count(*) AS swipes FROM s GROUP BY 1),
st AS (SELECT user_id, style, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, style) AS r FROM l GROUP BY 1, 2),
sj AS (SELECT user_id, string_agg(style, ',' ORDER BY r) AS styles FROM st WHERE r <= 3 GROUP BY 1)
SELECT user_id, coalesce(likes, 0) AS likes, swipes, coalesce(round(sa / likes, 4), 0.5) AS size_axis, coalesce(round(pa / likes, 4), 0.5) AS price_axis, coalesce(styles, '') AS styles
FROM c LEFT JOIN a USING (user_id) LEFT JOIN sj USING (user_id)""")
def taste_profile(t):
    return events.profile(*swipes_and_items(t("events"), t("part")), ["size_axis", "price_axis"], "style")


def swipes_and_items(e, part):
    """Events as verdicts on parts, and parts as items with a style and two axes."""
    verdict = F.when(F.col("event_type").isin("click", "purchase"), "like").otherwise("pass")
    swipes = e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), verdict.alias("verdict"))
    items = part.select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("style"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 49.0).alias("size_axis"),
        (F.col("p_retailprice") / 1999.0).alias("price_axis"),
    )
    return swipes, items


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(t):
    return ranking.latest(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_by_scope(t):
    return ranking.latest(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT event_id, list_aggregate(list_filter([CASE WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'unknown_name' END,
  CASE WHEN CAST(props->>'k' AS INT) = 7 THEN 'forbidden_key' END, CASE WHEN length(repeat(props, 25)) > 200 THEN 'too_long' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS problems FROM events""")
def event_validation(t):
    k = F.get_json_object("props", "$.k").cast("int")
    props = F.create_map(F.when(k == 7, "email").otherwise("k"), F.repeat("props", F.lit(25)))
    found = events.problems(F.col("event_type"), props, ["click", "purchase", "view"], ["email"])
    return t("events").select("event_id", F.nullif(F.array_join(found, ","), F.lit("")).alias("problems"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM r WHERE n <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def caps_per_group(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.capped(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 50)


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS tier FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY tier, c_acctbal DESC, c_custkey) AS n FROM c)
SELECT c_custkey, c_nationkey, c_acctbal, tier FROM r WHERE n <= 2 ORDER BY tier, c_acctbal DESC, c_custkey LIMIT 20""")
def tiered_caps(t):
    c = t("customer").select("c_custkey", "c_nationkey", "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("tier"))
    return ranking.capped(c, ["c_nationkey"], [F.asc("tier"), F.desc("c_acctbal"), F.asc("c_custkey")], 2, 20)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_type) = 'promo' AND contains(lower(p_name), 'ring') ORDER BY lower(p_name), p_partkey LIMIT 10 OFFSET 5")
def browse_page(t):
    found = t("part").filter((F.lower("p_type") == "promo") & F.contains(F.lower("p_name"), F.lit("ring")))
    return ranking.page(found.select("p_partkey", "p_name", "p_type"), [F.lower("p_name"), F.asc("p_partkey")], 5, 10)


@query("""SELECT 'order_customer' AS ref, o_custkey AS key, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'line_order', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
UNION ALL SELECT 'event_part', CAST(props->>'k' AS BIGINT) + 1950, count(*) FROM events WHERE CAST(props->>'k' AS BIGINT) + 1950 NOT IN (SELECT p_partkey FROM part) GROUP BY 2""")
def ref_integrity(t):
    part_of = t("events").select((F.get_json_object("props", "$.k").cast("long") + 1950).alias("k"))
    checks = (
        ("order_customer", t("orders").select("o_custkey"), t("customer").select("c_custkey")),
        ("line_order", t("lineitem").select("l_orderkey"), t("orders").select("o_orderkey")),
        ("event_part", part_of, t("part").select("p_partkey")),
    )
    found = [joins.integrity(r, e).select(F.lit(n).alias("ref"), F.col(r.columns[0]).alias("key"), "n_rows") for n, r, e in checks]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH l AS (SELECT user_id, event_id AS l_id, ts AS l_ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS r_id, ts AS r_ts FROM events WHERE event_type = 'view'),
m AS (SELECT user_id, l_id, r_id, abs(epoch_us(l_ts) - epoch_us(r_ts)) AS micros FROM l JOIN r USING (user_id) WHERE abs(epoch_us(l_ts) - epoch_us(r_ts)) <= 21600000000)
SELECT user_id, l_id, r_id, micros, place FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY micros, r_id) AS place FROM m) WHERE place <= 12""")
def nearest_time_join(t):
    """For each purchase the user's views within six hours, nearest first."""
    e = t("events")
    left = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("l_id"), F.col("ts").alias("l_ts"))
    right = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("r_id"), F.col("ts").alias("r_ts"))
    return joins.near_in_time(left, right, "user_id", 6 * 3600, 12).select("user_id", "l_id", "r_id", "micros", "place")


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts FROM events),
s AS (SELECT a.event_id, count(DISTINCT b.event_type) AS support FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 GROUP BY 1)
SELECT event_id, support, support >= 2 AS supported FROM s""")
def batch_support(t):
    """How many kinds of the user's other events lie within an hour of each event."""
    return events.support(t("events"), "user_id", "event_id", "event_type", "ts", 3600).withColumn("supported", F.col("support") >= 2)


@query("""WITH x AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), p AS (SELECT p_partkey, p_brand, p_size, round(coalesce(q, 0), 2) AS q FROM part LEFT JOIN x ON l_partkey = p_partkey),
d AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC, q DESC) - 1 AS r FROM p), s AS (SELECT *, r / nullif(max(r) OVER (PARTITION BY p_brand), 0)::DOUBLE AS share FROM d)
SELECT p_partkey, p_brand, q, CASE WHEN coalesce(share, 0) * 3 < 1 THEN 'high' WHEN share * 3 < 2 THEN 'medium' ELSE 'low' END AS band FROM s""")
def relevance_bands(t):
    sold = t("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    p = t("part").join(sold, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "p_brand", "p_size", F.round(F.coalesce("q", F.lit(0.0)), 2).alias("q"))
    return ranking.bands(p, ["p_brand"], [F.desc("p_size"), F.desc("q")]).select("p_partkey", "p_brand", "q", "band")


# Rules of our own, to try every form that a rule can have.
DISHES = [("curry", 0.8, 0.5, 0.6), ("stew", 0.1, 0.7, 0.9), ("toast", 0.0, 0.3, 0.2), ("wings", 0.45, 0.65, 0.3)]
RULES = [
    {"id": "heat", "when": {"dish.heat": ">=0.35"}, "require": {"wine.cool": ">=dish.heat"}, "weight": 0.7, "explain": "cools the dish"},
    {"id": "oil", "when": {"dish.oil": ">=0.55"}, "require": {"wine.sharp": ">=0.4"}, "weight": 1.1, "explain": "cuts the oil"},
    {"id": "bulk", "when": {"always": True}, "require": {"wine.mass": "~=dish.bulk ± 0.25"}, "weight": 0.6, "explain": "as full as the dish"},
    {"id": "drown", "when": {"dish.bulk": "<=0.35"}, "penalize": {"wine.mass": ">=0.7"}, "weight": 0.5, "explain": "drowns the dish"},
]
BLOCKS = [{"condition": {"dish.heat": ">=0.75", "wine.cool": "<=0.2"}}]


def _paired(t):
    body = F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 11 / 11.0)
    wine = F.named_struct(F.lit("cool"), F.col("p_size") % 10 / 10.0, F.lit("sharp"), F.col("p_partkey") % 7 / 7.0, F.lit("mass"), body)
    dishes = F.array(*[F.struct(F.lit(n).alias("tag"), F.named_struct(F.lit("heat"), F.lit(s), F.lit("oil"), F.lit(f), F.lit("bulk"), F.lit(h)).alias("dish")) for n, s, f, h in DISHES])
    pairs = t("part").select("p_partkey", wine.alias("wine"), F.explode(dishes).alias("d")).select("p_partkey", "wine", "d.tag", "d.dish")
    return rules.scored(pairs, RULES, BLOCKS)


RULED = """w AS (SELECT p_partkey, p_size % 10 / 10.0::DOUBLE AS cool, p_partkey % 7 / 7.0::DOUBLE AS sharp, CASE WHEN p_size % 6 <> 0 THEN p_size % 11 / 11.0::DOUBLE END AS mass FROM part),
d(tag, heat, oil, bulk) AS (VALUES ('curry', 0.8::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE), ('stew', 0.1, 0.7, 0.9), ('toast', 0.0, 0.3, 0.2), ('wings', 0.45, 0.65, 0.3)),
f AS (SELECT *, heat >= 0.35 AS on1, heat >= 0.35 AND cool >= heat AS r1, oil >= 0.55 AS on2, oil >= 0.55 AND sharp >= 0.4 AS r2, coalesce(abs(mass - bulk) <= 0.25, FALSE) AS r3,
  bulk <= 0.35 AS on4, bulk <= 0.35 AND coalesce(mass >= 0.7, FALSE) AS r4 FROM w, d WHERE NOT (heat >= 0.75 AND cool <= 0.2)),
g AS (SELECT *, greatest(0, least(1, (r1::INT * 0.7::DOUBLE + r2::INT * 1.1::DOUBLE + r3::INT * 0.6::DOUBLE - r4::INT * 0.5::DOUBLE) / (on1::INT * 0.7::DOUBLE + on2::INT * 1.1::DOUBLE + 0.6::DOUBLE + on4::INT * 0.5::DOUBLE))) AS score FROM f)"""


@query(f"WITH {RULED}, h AS (SELECT p_partkey, tag, round(score, 6) AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 6) DESC, tag) AS rank FROM g WHERE round(score, 6) > 0) SELECT * FROM h WHERE rank <= 3")
def rule_scores(t):
    s = _paired(t).withColumn("score", F.round("score", 6))
    return rules.best_tags(s, "p_partkey", "tag").select("p_partkey", "tag", "score", "rank")


@query(f"WITH {RULED} SELECT p_partkey, tag, CASE WHEN r2 THEN 'cuts the oil' WHEN r1 THEN 'cools the dish' WHEN r3 THEN 'as full as the dish' END AS why FROM g WHERE round(score, 6) > 0")
def rule_explain(t):
    s = _paired(t).filter(F.round("score", 6) > 0)
    return s.select("p_partkey", "tag", rules.best_explanation(F.col("why")).alias("why"))


@query("""WITH i AS (SELECT p_partkey, p_type, p_size / 50.0::DOUBLE AS a, p_retailprice / 2000.0::DOUBLE AS b, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 100 / 100.0::DOUBLE END AS c, p_brand FROM part),
s(style, st, sa, sb, sc, brand) AS (VALUES ('bold', 'PROMO', 0.9::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 'Brand#1'), ('light', NULL, 0.2, 0.5, 0.3, 'Brand#2'), ('plain', NULL, 0.5, 0.5, 0.5, 'Brand#3')),
m AS (SELECT p_partkey, style, least(1, 1 - (0.5 * (abs(a - sa) + abs(b - sb) + abs(c - sc)) / 3 + 0.5 * greatest(abs(a - sa), abs(b - sb), abs(c - sc))) + CASE WHEN p_brand = brand THEN 0.1 ELSE 0 END) AS score
  FROM i, s WHERE (st IS NULL OR st = p_type) AND c IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 6) DESC, style DESC) AS rank FROM m)
SELECT p_partkey, style, round(score, 6) AS score, rank FROM r WHERE rank <= 3 AND round(score, 6) >= 0.8""")
def style_match(t):
    third = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 100 / 100.0)
    item = F.named_struct(F.lit("a"), F.col("p_size") / 50.0, F.lit("b"), F.col("p_retailprice") / 2000.0, F.lit("c"), third)
    styles = [("bold", "PROMO", 0.9, 0.7, 0.8, "Brand#1"), ("light", None, 0.2, 0.5, 0.3, "Brand#2"), ("plain", None, 0.5, 0.5, 0.5, "Brand#3")]
    rows = F.array(*[F.struct(F.lit(n).alias("style"), F.lit(k).cast("string").alias("kind"), F.named_struct(F.lit("a"), F.lit(a), F.lit("b"), F.lit(b), F.lit("c"), F.lit(c)).alias("axes"), F.lit(p).alias("brand")) for n, k, a, b, c, p in styles])
    pairs = t("part").select("p_partkey", "p_type", "p_brand", item.alias("item"), F.explode(rows).alias("s"))
    pairs = pairs.filter(F.col("s.kind").isNull() | (F.col("s.kind") == F.col("p_type")))
    score = recommend.style_score(F.col("item"), F.col("s.axes"), ["a", "b", "c"], F.col("p_brand") == F.col("s.brand"))
    found = pairs.select("p_partkey", F.col("s.style").alias("style"), F.round(score, 6).alias("score"))
    return recommend.match_styles(found, "p_partkey", "style").select("p_partkey", "style", "score", "rank")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS maker, p_type AS kind, p_size % 4 AS step, string_split(p_name, ' ') AS tags FROM part),
s AS (SELECT a.id AS item, b.id AS other, b.maker, 1 + 3.0::DOUBLE * len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))
  + CASE abs(a.step - b.step) WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0 END AS score FROM p a JOIN p b ON a.kind = b.kind AND a.maker <> b.maker WHERE a.id % 100 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY item, maker ORDER BY round(score, 6) DESC, other) AS m FROM s), r AS (SELECT item, other, maker, round(score, 6) AS score, row_number() OVER (PARTITION BY item ORDER BY round(score, 6) DESC, other) AS rank FROM f WHERE m = 1)
SELECT * FROM r WHERE rank <= 6""")
def analog_jaccard(t):
    """The six parts most like each hundredth one, of other brands: by the words of their names and by a step."""
    none = F.create_map().cast("map<string, double>")
    cards = t("part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("maker"), F.col("p_type").alias("category"), F.lit(False).alias("sparkling"), F.split("p_name", " ").alias("grapes"),
        (F.col("p_size") % 4).alias("sweetness"), F.lit(None).cast("string").alias("region"), none.alias("vector"),
    )
    return recommend.analogs(cards, cards.filter("id % 100 = 0")).drop("reasons")


_WORDED = """p AS (SELECT p_partkey AS id, p_brand AS maker, p_type AS category, p_size % 6 = 0 AS sparkling, list_filter(list_distinct(string_split(p_name, ' ')), lambda x: p_size % 5 > 0) AS grapes, CASE WHEN p_size % 7 > 0 THEN p_size % 4 END AS step,
  CASE WHEN p_size % 8 > 0 THEN p_size % 3 END AS region, list_concat(string_split(p_name, ' '), ['w' || (p_size % 9), 'w' || (p_partkey % 11), 'w' || (p_partkey % 4)]) AS words FROM part)"""


@query(f"""WITH {_WORDED}, tf AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(words) AS word FROM p) GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), nd AS (SELECT count(*) AS n FROM p),
w AS (SELECT id, word, (1 + ln(tf)) * ln((1 + n) / (1 + df)::DOUBLE) AS w FROM tf JOIN df USING (word), nd), v AS (SELECT id, word, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
m AS (SELECT a.id AS item, b.id AS other, b.maker, b.sparkling, len(list_intersect(a.grapes, b.grapes)) / nullif(len(list_distinct(list_concat(a.grapes, b.grapes))), 0)::DOUBLE AS share, CASE abs(a.step - b.step) WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0 END AS near,
  coalesce(a.region = b.region, FALSE) AS here, round(coalesce((SELECT sum(x.w * y.w) FROM v x JOIN v y USING (word) WHERE x.id = a.id AND y.id = b.id), 0), 9) AS alike FROM p a JOIN p b ON a.category = b.category AND a.sparkling = b.sparkling AND a.maker <> b.maker AND a.id <> b.id WHERE a.id % 100 = 0),
s AS (SELECT *, round(1 + 3.0::DOUBLE * coalesce(share, 0) + near + here::INT + 2.0::DOUBLE * alike, 6) AS score FROM m),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item, maker ORDER BY score DESC, other) = 1)
SELECT item, other, maker, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, other)::INT AS rank,
  list_filter(['color', CASE WHEN share > 0 THEN 'grapes' END, CASE WHEN near = 2 THEN 'sweetness' END, CASE WHEN sparkling THEN 'sparkling' END, CASE WHEN here THEN 'region' END, CASE WHEN alike >= 0.25 THEN 'description' END], lambda x: x IS NOT NULL) AS reasons FROM o QUALIFY rank <= 6""")
def card_analogs(t):
    """The parts most like each hundredth one with their reasons: grapes, sweetness, region and the words of their descriptions."""
    size, key = F.col("p_size"), F.col("p_partkey")
    word = lambda c: F.concat(F.lit("w"), c.cast("string"))
    cards = t("part").select(
        key.alias("id"), F.col("p_brand").alias("maker"), F.col("p_type").alias("category"), (size % 6 == 0).alias("sparkling"), F.filter(F.split("p_name", " "), lambda _: size % 5 > 0).alias("grapes"), F.when(size % 7 > 0, size % 4).alias("sweetness"),
        F.when(size % 8 > 0, size % 3).alias("region"), F.concat(F.split("p_name", " "), F.array(word(size % 9), word(key % 11), word(key % 4))).alias("words"),
    )
    return recommend.analogs(cards.join(recommend.description_vectors(cards.select("id", "words")), "id"), cards.filter("id % 100 = 0"))


@query("""SELECT event_type, count(*) AS n, sum((value < 5)::INT)::BIGINT AS errors, round(min(value) FILTER (WHERE value >= 5), 6) AS least, round(avg(value) FILTER (WHERE value >= 5), 6) AS mean,
  max(value) FILTER (WHERE value >= 5) AS most, round(stddev_samp(value) FILTER (WHERE value >= 5), 6) AS stdev, quantile_disc(value, 0.5) FILTER (WHERE value >= 5) AS p50, quantile_disc(value, 0.9) FILTER (WHERE value >= 5) AS p90,
  quantile_disc(value, 0.95) FILTER (WHERE value >= 5) AS p95, quantile_disc(value, 0.99) FILTER (WHERE value >= 5) AS p99, round(avg((value <= 30)::INT) FILTER (WHERE value >= 5), 6) AS within FROM events GROUP BY 1""")
def latency_summary(t):
    e = t("events").withColumn("ok", F.col("value") >= 5)
    out = aggregates.latency(e, ["event_type"], "value", "ok", 30.0)
    return out.select(*[F.round(c, 6).alias(c) if c in ("least", "mean", "stdev", "within") else c for c in out.columns])


@query("""WITH n AS (SELECT p_type || '_' || p_size % 3 AS bucket, p_name AS name FROM part), c AS (SELECT bucket, count(*) AS n FROM n GROUP BY 1),
d AS (SELECT bucket, name, row_number() OVER (PARTITION BY bucket ORDER BY name) AS r FROM (SELECT DISTINCT bucket, name FROM n))
SELECT bucket, n, string_agg(name, '|' ORDER BY name) AS examples FROM c JOIN d USING (bucket) WHERE r <= 5 GROUP BY 1, 2""")
def noise_census(t):
    n = t("part").select(F.concat_ws("_", "p_type", F.col("p_size") % 3).alias("bucket"), F.col("p_name").alias("name"))
    return aggregates.census(n, "bucket", "name").withColumn("examples", F.array_join("examples", "|"))
