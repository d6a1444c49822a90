"""Further operators as queries: keys, samples, families, merges and set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import aggregates, decisions, events, families, joins, ranking, retrieval, sampling
from .registry import query


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  regexp_replace(lower(p_name || p_brand), '[^0-9a-z]', '', 'g') AS key, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'), lambda t: length(t) >= 2))) AS tokens FROM part""")
def name_keys(t):
    name = F.concat_ws(" #", "p_name", "p_brand")
    tokens = F.array_sort(F.array_distinct(T.match_tokens(F.concat_ws(" ", "p_name", "p_brand"))))
    return t("part").select("p_partkey", T.slug(name, "page").alias("slug"), T.name_key(F.concat("p_name", "p_brand")).alias("key"), tokens.alias("tokens"))


@query("""WITH RECURSIVE p AS (SELECT p_brand AS g, p_partkey AS id, p_name AS name FROM part),
e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id WHERE levenshtein(a.name, b.name) <= least(2, greatest(1, least(length(a.name), length(b.name)) // 3))),
r(u, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u)
SELECT root AS family_id, count(*) AS members FROM (SELECT u, min(root) AS root FROM r GROUP BY 1) GROUP BY 1""")
def name_families(t):
    p = t("part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    edges = joins.similar_name_links(p, "g", "id", "name")
    return families.families(p, edges, "id")


@query("""WITH s AS (SELECT user_id, event_id, sha256('7:' || user_id || ':' || event_id) AS h FROM events)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h) AS n FROM s) WHERE n <= 3""")
def sample_per_key(t):
    return sampling.sample_per_key(t("events").select("user_id", "event_id"), "user_id", "event_id", "7", 3)


@query("""WITH o AS (SELECT p_brand, p_partkey, row_number() OVER w AS n, lead(p_partkey) OVER w AS nxt, first_value(p_partkey) OVER w AS fst FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY sha256('s:' || p_partkey), p_partkey))
SELECT p_brand, p_partkey, nullif(coalesce(nxt, fst), p_partkey) AS donor FROM o""")
def deranged_donors(t):
    return sampling.deranged(t("part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", "s")


@query("""SELECT doc_id, (('0x' || substr(sha256('half:' || doc_id), 1, 8))::BIGINT / 4294967295 >= 0.5)::INT AS fold FROM documents""")
def seeded_halves(t):
    return sampling.halves(t("documents").select("doc_id"), "half", "doc_id")


@query("""SELECT c_custkey AS key FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT -c_custkey - 1 FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def key_sets(t):
    """Customers without orders, and (as negative keys) those with."""
    c, o = t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.subtract(o).select(F.col("c_custkey").alias("key")).unionByName(c.intersect(o).select((-F.col("c_custkey") - 1).alias("key")))


@query("""WITH l AS (SELECT user_id, event_type, value FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, round(max(value), 6) AS best, round(sum(CASE event_type WHEN 'view' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END * value), 4) AS weighted FROM l GROUP BY 1""")
def merged_scores(t):
    e = t("events").filter(F.col("event_type").isin("view", "click"))
    best = aggregates.merged_scores(e, ["user_id"], "value").select("user_id", F.round("value", 6).alias("best"))
    weight = F.when(F.col("event_type") == "view", 0.3).otherwise(0.7)
    return best.join(e.groupBy("user_id").agg(F.round(F.sum(weight * F.col("value")), 4).alias("weighted")), "user_id")


@query("""SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'view') WHERE place <= 50""")
def recent_history(t):
    """The newest fifty views of each user."""
    views = t("events").filter("event_type = 'view'").withColumn("order", F.struct("ts", "event_id"))
    return ranking.top_k(views, ["user_id"], "order", "event_id", 50, "place").select("user_id", "event_id", "place")


@query("SELECT user_id, CAST(props->>'k' AS INT) AS item FROM events WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggled_items(t):
    clicks = t("events").filter("event_type = 'click'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item"))
    return events.toggled(clicks, ["user_id", "item"])


@query("""WITH w AS (SELECT event_type, round(stddev_pop(value) FILTER (WHERE value > 0) / avg(value) FILTER (WHERE value > 0), 6) AS cv FROM events GROUP BY 1) SELECT * FROM w""")
def variation_by_type(t):
    return t("events").groupBy("event_type").agg(F.round(aggregates.variation("value"), 6).alias("cv"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.03 THEN 'failed' WHEN l_tax >= 0.03 THEN 'confident' ELSE 'unsure' END AS bucket,
  CASE WHEN l_discount >= 0.05 AND l_quantity >= 10 AND l_tax >= 0.02 THEN 'found' ELSE 'not_found' END AS decision FROM lineitem""")
def decision_buckets(t):
    b = decisions.bucket(F.col("l_discount"), F.col("l_tax"), 0.03)
    d = decisions.decide(F.col("l_discount"), F.col("l_quantity"), F.col("l_tax"), (0.05, 10, 0.02))
    return t("lineitem").select("l_orderkey", "l_linenumber", b.alias("bucket"), d.alias("decision"))


@query("""WITH s AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice AS score FROM orders), m AS (SELECT *, max(score) OVER (PARTITION BY g) AS top FROM s)
SELECT g, id, score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS n FROM m WHERE score >= top - 50000) WHERE n <= 5""")
def near_routing(t):
    o = t("orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return decisions.route_near(o, "g", "score", "id", 50_000)


@query("""WITH f AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top FROM f)
SELECT p_brand, min(p_size) AS p_size, max(n) AS n FROM m WHERE n = top GROUP BY 1 HAVING count(*) = 1""")
def clear_winner(t):
    f = t("part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return decisions.strictly_best(f, "p_brand", "n").select("p_brand", "p_size", "n")


@query(r"""WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents), d AS (SELECT term, count(DISTINCT id)::DOUBLE AS df FROM tok GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n FROM documents) SELECT round(list_sort(list(i))[len(list(i)) // 2 + 1], 6) AS upper_median FROM (SELECT ln(1 + n / (1 + df)) AS i FROM d, n)""")
def distinctive_threshold(t):
    """The upper median of the vocabulary's plain inverse frequencies, from counts by value."""
    values = retrieval.idf_table(retrieval.build_index(t("documents"), "doc_id", "text"), "plain").groupBy("df", "idf").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.orderBy("idf")  # over distinct document frequencies
    upto = values.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.round(F.min("idf"), 6).alias("upper_median"))


@query("""SELECT o_orderkey, (year(DATE '2000-02-28') - year(o_orderdate) - (strftime(DATE '2000-02-28', '%m%d') < strftime(o_orderdate, '%m%d'))::INT)::INT AS age,
  sha256(o_orderstatus || ':2000-02-28') AS hashed FROM orders""")
def ages_and_hashes(t):
    day = F.lit("2000-02-28").cast("date")
    return t("orders").select("o_orderkey", S.age(F.col("o_orderdate"), day).alias("age"), S.salted_hash(F.col("o_orderstatus"), day).alias("hashed"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round_even(x / list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y))) * 127, 0)::INT) AS q FROM embeddings)
SELECT vec_id, list_sum(q)::BIGINT AS total, list_max(list_transform(q, lambda x: abs(x)))::INT AS most FROM b""")
def quantised_vectors(t):
    q = t("embeddings").select("vec_id", F.transform(V.quantise(F.col("embedding")), lambda x: x.cast("int")).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("vec_id", total.alias("total"), F.array_max(F.transform("q", lambda x: F.abs(x))).alias("most"))


@query("""SELECT c.c_custkey, coalesce(nullif(n.n_name, 'FRANCE'), r.r_name, 'none') AS place FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def fallback_names(t):
    n, r = t("nation"), t("region")
    primary = n.select(F.col("n_nationkey").alias("k"), F.nullif("n_name", F.lit("FRANCE")).alias("place"))
    secondary = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("r_name").alias("place"))
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return joins.with_fallback(c, primary, secondary, "k", ["place"]).select("c_custkey", F.coalesce("place", F.lit("none")).alias("place"))


@query("""WITH l AS (SELECT l_orderkey AS image, list({'id': l_linenumber, 'x': l_quantity, 'y': l_linenumber::DOUBLE} ORDER BY l_extendedprice DESC, l_linenumber, l_quantity) AS bs FROM lineitem GROUP BY 1),
k AS (SELECT image, list_reduce(list_transform(bs, lambda b: [b]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda k: greatest(0, 10 - abs(k.x - v[1].x)) * greatest(0, 4 - abs(k.y - v[1].y))
  / (80 - greatest(0, 10 - abs(k.x - v[1].x)) * greatest(0, 4 - abs(k.y - v[1].y))) >= 0.45)) > 0 THEN acc ELSE list_concat(acc, v) END) AS kept FROM l), u AS (SELECT image, unnest(kept) AS b FROM k) SELECT image, b.id AS box_id FROM u""")
def suppressed_boxes(t):
    """Boxes made of order lines, thinned per order."""
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    b = t("lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box_id"), F.col("l_extendedprice").alias("score"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 4).alias("y1"))
    return ranking.suppress(b, "image").select("image", "box_id")


@query("""WITH RECURSIVE p AS (SELECT p_brand, p_partkey, p_type, p_size % 5 AS size, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('2024-01-01:' || p_partkey), p_partkey) AS o FROM part),
r(p_brand, place, ids, types, sizes) AS (SELECT p_brand, 0, []::BIGINT[], []::VARCHAR[], []::INT[] FROM (SELECT DISTINCT p_brand FROM p)
  UNION ALL SELECT r.p_brand, r.place + 1, list_append(ids, c.id), list_append(types, c.p_type), list_append(sizes, c.size) FROM r, LATERAL (SELECT arg_min(x, x.k) AS c FROM (SELECT p_partkey AS id, p_type, size,
    ((list_contains(r.types, p_type))::INT + (list_contains(r.sizes, size))::INT) * 1000000 + o AS k FROM p WHERE p.p_brand = r.p_brand AND NOT list_contains(r.ids, p_partkey)) x) y WHERE r.place < 10 AND c IS NOT NULL)
SELECT p_brand, ids[-1] AS p_partkey, place::BIGINT AS place FROM r WHERE place > 0""")
def diversity_deck(t):
    """A deck of ten parts for each brand, as many new sizes and types first as there are."""
    p = t("part").select("p_brand", "p_partkey", "p_type", (F.col("p_size") % 5).alias("size"))
    return ranking.diversity_deck(p, "p_brand", ["p_type", "size"], "p_partkey", "2024-01-01", 10).select("p_brand", "p_partkey", "place")
