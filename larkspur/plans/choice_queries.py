"""Queries of lookups, filters, gates and scores over rows that the tables make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import decisions, documents, families, joins, labels, matching, metrics, retrieval, sampling
from ..operators import diagnostics as D
from .registry import query
from .vector_queries import SCORES

# ---- lookups


@query("""SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20""")
def nation_lookup(t):
    """Customers with their nation's name and region, where the table of nations has it."""
    dim = t("nation").filter("n_nationkey < 20")
    c = t("customer").select("c_custkey", "c_nationkey")
    return joins.lookup(c, dim, F.col("c_nationkey") == F.col("n_nationkey"), ["n_name", "n_regionkey"]).drop("c_nationkey")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey >= 20 GROUP BY 1")
def unknown_nations(t):
    """Keys of nations that the table doesn't have, and how many customers have them."""
    dim = t("nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"))
    return joins.unknown(t("customer"), dim, "c_nationkey")


@query("SELECT c_custkey, c_name, c_acctbal, o.orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def merged_customers(t):
    """Customers with their number of orders; either side must have a customer once."""
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return matching.merged_one_to_one(t("customer").select("c_custkey", "c_name", "c_acctbal"), o, "c_custkey")


@query("""WITH d AS (SELECT p_name || '.jpg' AS key, max(p_partkey) AS found FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT p_type, -1 FROM part WHERE p_type <> 'PROMO'),
a AS (SELECT p_partkey, nullif(CASE WHEN p_size % 7 <> 0 THEN p_name || '.jpg' END, '') AS k1, p_type AS k2 FROM part)
SELECT p_partkey, coalesce(x.found, y.found) AS found FROM a LEFT JOIN d x ON x.key = k1 LEFT JOIN d y ON y.key = k2""")
def photo_lookup(t):
    """Parts by the first of two keys that a table has: a file's name, else a type."""
    p = t("part")
    d = p.filter("p_size % 2 = 0").groupBy(F.concat("p_name", F.lit(".jpg")).alias("key")).agg(F.max("p_partkey").alias("found"))
    d = d.unionByName(p.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("key")).distinct().withColumn("found", F.lit(-1).cast("long")))
    rows = p.select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.concat("p_name", F.lit(".jpg"))).alias("k1"), F.col("p_type").alias("k2"))
    return joins.by_key_or(rows, d, [F.col("k1"), F.col("k2")], "key", ["found"]).select("p_partkey", "found")


_FILES = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'thumbnail_' WHEN p_partkey % 3 = 1 THEN 'Small_' ELSE '' END || replace(p_name, ' ', '_') || (p_size % 4) || CASE WHEN p_partkey % 5 = 0 THEN '.pdf' ELSE '.jpg' END AS file FROM part"


def _files(t):
    return t("part").select("p_partkey", F.explode(F.array(F.expr(_FILES[_FILES.index("CASE") : _FILES.index(" AS file")]))).alias("file"))


@query(f"""WITH f AS ({_FILES}) SELECT p_partkey, file FROM f WHERE regexp_matches(lower(file), '^(thumbnail|small)_') AND regexp_replace(lower(file), '^(thumbnail|small)_', '') IN (SELECT file FROM f)""")
def thumbnail_files(t):
    """Files whose names are those of thumbnails of files that are there."""
    f = _files(t)
    return joins.thumbnails(f, "file", T.original_of(F.col("file")))


@query(f"""WITH f AS ({_FILES}) SELECT p_partkey, file FROM f WHERE NOT regexp_matches(lower(file), '^(thumbnail|small|medium|large)_') AND file LIKE '%.jpg' AND file NOT IN (SELECT file FROM f WHERE p_partkey % 4 = 0)""")
def orphan_files(t):
    """Pictures that are no thumbnails and that no fourth part uses."""
    f = _files(t)
    ext = T.stem_and_extension(F.col("file"))[1]
    return matching.orphans(f, f.filter("p_partkey % 4 = 0"), T.is_variant_name(F.col("file")), ext, ("jpg", "png"))


_CYRILLIC = "upper(substr(p_name, 1, 1)) || translate(substr(p_name, 2), 'abcdefghijklmnopqrstuvwxyz', 'абцдёфгхийклмнопярстувшъщь') || ' «' || p_size || '»'"


def _latin(table: dict[str, str], text: str) -> str:
    for letter, latin in table.items():
        text = f"replace({text}, '{letter}', '{latin}')"
    return text


def _slug_sql(scheme: str, mark: str) -> str:
    said = _latin(T.TABLES[scheme], f"lower({_CYRILLIC})")
    return f"trim(regexp_replace({said}, '[^a-z0-9]+', '{mark}', 'g'), '{mark}')"


@query(f"""SELECT p_partkey, {_slug_sql("maker", "-")} AS maker, {_slug_sql("page", "-")} AS page, {_slug_sql("census", "_")} AS census FROM part""")
def cyrillic_keys(t):
    """Names in Cyrillic letters as keys by three tables."""
    d = t("part").select("p_partkey", F.explode(F.array(F.expr(_CYRILLIC))).alias("x"))
    return d.select("p_partkey", T.slug_or_null(F.col("x"), "maker").alias("maker"), T.slug(F.col("x"), "page").alias("page"), T.census_key(F.col("x")).alias("census"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS token FROM part),
s AS (SELECT token, translate(translate(replace(replace(replace(replace(replace(token, 'ch', 'sh'), 'sch', 'sh'), 'ph', 'f'), 'th', 't'), 'x', 'ks'), 'cqwyjz', 'kkviis'), 'aeiou', '') AS s FROM w)
SELECT token, list_reduce(list_prepend('', list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i > 1 AND s[i] = s[i - 1] THEN '' ELSE s[i] END)), lambda a, b: a || b) AS skeleton FROM s""")
def word_skeletons(t):
    """The consonants by sound of all words of names and types."""
    words = t("part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("token")).distinct()
    return words.select("token", T.skeleton(F.col("token")).alias("skeleton"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 5) AS total FROM part WHERE p_size > 5 ORDER BY lower(p_name), p_partkey LIMIT 20 OFFSET 40")
def catalog_page(t):
    """The third page of twenty parts by name, and how many there are."""
    from ..operators import ranking

    return ranking.page_and_total(t("part").filter("p_size > 5").select("p_partkey", "p_name"), "p_name", "p_partkey", 40, 20)


# ---- filters


@query(f"""WITH {SCORES}, w AS (SELECT *, (query_id // 100 * 3) % 13 AS wish FROM s),
t AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, 'strict' AS tier FROM w WHERE label = wish),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, 'relaxed' AS tier FROM w WHERE query_id NOT IN (SELECT query_id FROM t))
SELECT * FROM t WHERE rank <= 3 UNION ALL SELECT * FROM r WHERE rank <= 3""")
def relaxed_search(t):
    """The nearest vectors of the label that each hundredth vector wishes for; of any label where there is no such label."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"), F.col("label").alias("group"))
    asked = e.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    wish = F.floor(F.col("query_id") / 100) * 3 % 13
    best, every = retrieval.nearest(e, asked.withColumn("group", wish.cast("int")), 3, own_group=True), retrieval.nearest(e, asked, 3)
    strict = best.withColumn("color", F.col("group")).filter(retrieval.matched(color=wish)).drop("color")
    return retrieval.relax(strict, every).select("query_id", F.col("id").alias("vec_id"), "score", "rank", "tier")


@query(f"""WITH {SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, score, rank FROM t WHERE rank <= 10 AND vec_id % 3 = 0""")
def allowed_hits(t):
    """Of the ten nearest vectors those that are allowed, with the ranks that they had."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"), F.lit(0).alias("group"))
    hits = retrieval.nearest(e, e.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), 10)
    return hits.join(e.filter("id % 3 = 0").select("id"), "id", "left_semi").select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query("""SELECT p_partkey, kind, CASE WHEN kind IN ('wine', 'winery', 'other') THEN p_name END AS source, CASE WHEN kind IN ('wine', 'other') THEN p_type END AS derived, CASE WHEN kind IN ('chunk', 'other') THEN p_brand END AS title, CASE WHEN kind = 'other' THEN p_size END AS secret
FROM (SELECT *, ['wine', 'chunk', 'winery', 'other'][p_partkey % 4 + 1] AS kind FROM part)""")
def public_records(t):
    """What is shown of records, by their kind."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("wine", "chunk", "winery", "other")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    d = t("part").withColumn("kind", kind)
    shown = documents.public(F.col("kind"), {"source": F.col("p_name"), "derived": F.col("p_type"), "title": F.col("p_brand"), "secret": F.col("p_size")})
    return d.select("p_partkey", "kind", shown.alias("s")).select("p_partkey", "kind", "s.*")


# ---- gates and scores

_EVIDENCE = "SELECT l_orderkey AS query_id, l_linenumber * 10000000 + l_partkey AS id, l_quantity AS inliers, l_discount * 10 AS ratio, l_tax AS coverage, l_quantity + l_partkey % 60 AS matches, l_suppkey % 40 AS label_inliers FROM lineitem"


def _evidence(t):
    return t("lineitem").selectExpr("l_orderkey AS query_id", "l_linenumber * 10000000 + l_partkey AS id", "l_quantity AS inliers", "l_discount * 10 AS ratio", "l_tax AS coverage", "l_quantity + l_partkey % 60 AS matches", "l_suppkey % 40 AS label_inliers")


@query(f"""WITH e AS ({_EVIDENCE}), o AS (SELECT *, row_number() OVER w AS n, coalesce(lead(inliers) OVER w, 0) AS next FROM e WINDOW w AS (PARTITION BY query_id ORDER BY inliers DESC, id))
SELECT query_id, id, inliers FROM o WHERE n = 1 AND inliers - next >= 8 AND coverage >= 0.025 AND CASE WHEN query_id % 2 = 0 THEN inliers >= 16 AND ratio >= 0.5 ELSE inliers >= 20 AND ratio >= 0.35 END""")
def evidence_choices(t):
    """The line of each order with enough evidence and a lead; every second order is a repeated look."""
    found = decisions.evidence_gate(_evidence(t), "query_id", "id", F.col("query_id") % 2 == 0)
    return found.select("query_id", "id", "inliers")


@query(f"""WITH e AS ({_EVIDENCE}) SELECT query_id, id, matches >= inliers AND inliers >= 16 AND inliers / greatest(matches, 1) >= 0.25 AND coverage >= 0.025 AS alone, label_inliers >= 16 AND inliers >= 24 AND inliers / greatest(matches, 1) >= 0.4 AS supported FROM e""")
def evidence_strength(t):
    """Which evidence stands by itself, and which a label supports."""
    e = _evidence(t)
    alone = decisions.independent({c: F.col(c) for c in ("inliers", "matches", "coverage")})
    strong = decisions.strongly_supported(e)
    both = strong.withColumn("supported", F.lit(True)).unionByName(e.exceptAll(strong).withColumn("supported", F.lit(False)))
    return both.select("query_id", "id", alone.alias("alone"), "supported")


@query(f"""WITH e AS ({_EVIDENCE}), s AS (SELECT *, 0.5::DOUBLE + (inliers - 25.0::DOUBLE) / 14 * 0.8 + (ratio - 0.5::DOUBLE) / 0.3 * -0.4 + (coverage - 0.04::DOUBLE) / 0.02 * 1.1 AS logit FROM e)
SELECT query_id, id, round(logit, 6) AS logit, round(coverage + 0.3::DOUBLE * ratio + 0.2::DOUBLE * coalesce(CASE WHEN id % 2 = 0 THEN inliers / 50 END, 0), 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(logit, 6) DESC, id)::INT AS rank FROM s""")
def learned_ranking(t):
    """Lines of orders ranked by a linear model over standardised features, and by a plain weighted sum."""
    from ..operators import ranking

    e = _evidence(t)
    logit = decisions.learned_score([F.col("inliers"), F.col("ratio"), F.col("coverage")], [25.0, 0.5, 0.04], [14.0, 0.3, 0.02], [0.8, -0.4, 1.1], 0.5)
    plain = labels.fused(F.col("coverage"), F.col("ratio"), F.when(F.col("id") % 2 == 0, F.col("inliers") / 50), 0.3, 0.2)
    scored = e.select("query_id", "id", F.round(logit, 6).alias("logit"), F.round(plain, 6).alias("fused"))
    return ranking.top_k(scored, ["query_id"], "logit", "id", 1000)


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS name, [lower(p_type)] AS maker, p_size % 4 AS year, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS sweet FROM part),
m AS (SELECT a.*, list_concat(b.name, b.maker) AS seen, b.year AS said_year, b.sweet AS said_sweet FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round(len(list_intersect(name, seen)) / len(list_distinct(name))::DOUBLE + 0.5::DOUBLE * list_contains(seen, maker[1])::INT + CASE WHEN year = said_year THEN 0.3::DOUBLE ELSE -0.3 END
  + CASE WHEN sweet IS NULL OR said_sweet IS NULL THEN 0 WHEN sweet = said_sweet THEN 0.2::DOUBLE ELSE -0.2 END, 6) AS score FROM m""")
def label_scores(t):
    """How like a part's card is to the next part's label."""
    p = t("part").select("p_partkey", F.split("p_name", " ").alias("name"), F.array(F.lower("p_type")).alias("winery"), (F.col("p_size") % 4).alias("year"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3).alias("sweetness"))
    label = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("name", "winery").alias("seen"), F.col("year").alias("y"), F.col("sweetness").alias("s"))
    card = {"name": F.col("name"), "winery": F.col("winery"), "grapes": F.array().cast("array<string>"), "year": F.col("year"), "sweetness": F.col("sweetness")}
    return p.join(label, "p_partkey").select("p_partkey", F.round(labels.card_score(card, F.col("seen"), {"year": F.col("y"), "sweetness": F.col("s")}, ["the"]), 6).alias("score"))


@query(f"""WITH v AS (SELECT b.vec_id // 100 AS query_id, a.vec_id AS id, max(round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 100 < 3 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM v) SELECT query_id, id, score, CASE WHEN rank <= 4 THEN rank END AS rank FROM r WHERE rank <= 4 OR id = query_id * 100 + 50""")
def several_vectors(t):
    """The best of each hundred's first three vectors: the four nearest items, and one that is asked for by name."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"))
    asked = e.filter("id % 100 < 3").select(F.floor(F.col("id") / 100).alias("query_id"), F.col("id").alias("part"), "vector")
    extra = asked.select("query_id").distinct().withColumn("id", F.col("query_id") * 100 + 50)
    # ids of vectors and of questions are numbers of different things, so vectors are named by texts
    named = e.withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string")))
    found = retrieval.nearest_of_several(named, asked, 4, extra.withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string"))))
    return found.select("query_id", F.substring("id", 2, 20).cast("long").alias("id"), "score", "rank")


# ---- families, samples, measures


@query("""WITH RECURSIVE b AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT AS lo FROM embeddings),
h AS (SELECT vec_id, xor(lo % 64, (vec_id % 5)) AS bits FROM b), d AS (SELECT bits, min(vec_id) AS v FROM h GROUP BY 1), e AS (SELECT a.v AS u, b.v AS v FROM d a JOIN d b ON bit_count(xor(a.bits, b.bits)) <= 1),
r(u, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u), c AS (SELECT u, min(root) AS root FROM r GROUP BY 1)
SELECT h.vec_id, c.root AS family FROM h JOIN d USING (bits) JOIN c ON c.u = d.v""")
def hash_families(t):
    """Components of short hashes that are a bit apart at most; equal hashes are one."""
    power = lambda i: F.lit(1 << i).cast("long")
    lo = sum((F.when(F.col("embedding")[i] > 0, power(i)).otherwise(F.lit(0).cast("long")) for i in range(6)), F.lit(0).cast("long"))
    h = t("embeddings").select("vec_id", lo.bitwiseXOR(F.col("vec_id") % 5).alias("bits"))
    first = h.groupBy("bits").agg(F.min("vec_id").alias("v"))
    near = joins.near_hashes(h, h, "vec_id", "bits", 1).select(F.col("a").alias("u"), F.col("b").alias("v"))
    star = h.join(first, "bits").select(F.col("vec_id").alias("u"), "v")
    return families.family_of(h.select("vec_id"), families.components(star.unionByName(near)), "vec_id")


@query("""SELECT doc_id FROM documents ORDER BY sha256('holdout:' || doc_id), doc_id LIMIT 25""")
def fixed_holdout(t):
    """The same 25 documents, however often it is asked."""
    return sampling.holdout(t("documents").select("doc_id"), "holdout", 25)


@query("""WITH p AS (SELECT a.p_partkey AS anchor, b.p_partkey AS other FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 6) SELECT anchor, other FROM p
WHERE NOT EXISTS (SELECT 1 FROM part x JOIN part y ON x.p_brand = y.p_brand WHERE x.p_partkey = anchor AND y.p_partkey = other) AND (anchor + other) % 7 <> 0""")
def sampled_negatives(t):
    """The next six parts of each but for those of its family (brand) and those that were chosen before."""
    p = t("part").select("p_partkey", "p_brand")
    pairs = p.select(F.col("p_partkey").alias("anchor"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 6)).alias("other"))
    pairs = pairs.join(p.select(F.col("p_partkey").alias("other")), "other", "left_semi").select("anchor", "other")
    named = pairs.join(p.select(F.col("p_partkey").alias("anchor"), F.col("p_brand").alias("a")), "anchor").join(p.select(F.col("p_partkey").alias("other"), F.col("p_brand").alias("b")), "other")
    excluded = named.filter("a = b").select("anchor", "other").unionByName(pairs.filter("(anchor + other) % 7 = 0"))
    return sampling.without(pairs, excluded, ["anchor", "other"])


@query("""WITH l AS (SELECT o_custkey, list(o_orderkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS got FROM orders GROUP BY 1), k AS (SELECT o_custkey, o_custkey % 50 AS truth, got[1:20] AS got FROM l),
r AS (SELECT *, nullif(list_position(got, truth), 0)::INT AS rank FROM k)
SELECT o_custkey, rank, CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END AS reciprocal, CASE WHEN o_custkey % 4 = 0 THEN len(got) = 0 WHEN o_custkey % 4 = 1 THEN list_has_any(got, [truth, truth + 1]) ELSE list_has_all(got, [truth, truth + 1]) END AS hit FROM r""")
def truth_ranks(t):
    """The place of each customer's truth in a list, its reciprocal, and whether any or all expected ones are there; a fourth expects nothing."""
    whole = F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("low"), F.col("o_orderkey").alias("k"))))
    lists = t("orders").groupBy("o_custkey").agg(F.slice(F.transform(whole, lambda x: x["k"] % 50), 1, 20).alias("got"))
    truth, m = F.col("o_custkey") % 50, F.col("o_custkey") % 4
    expected = F.when(m == 0, F.array().cast("array<bigint>")).otherwise(F.array(truth, truth + 1))
    rank = metrics.rank_of(truth, F.col("got"))
    return lists.select("o_custkey", rank.alias("rank"), metrics.reciprocal(rank).cast("double").alias("reciprocal"), metrics.hit(expected, F.col("got"), m == 1).alias("hit"))


@query("""WITH n AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS words FROM part) SELECT a.p_partkey, round(len(list_intersect(list_distinct(a.words), b.words)) / len(list_distinct(a.words))::DOUBLE, 6) AS recall FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1""")
def name_recalls(t):
    """The share of each part's words that the next one's label has."""
    n = t("part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("words"))
    after = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("words").alias("read"))
    return n.join(after, "p_partkey").select("p_partkey", F.round(D.name_recall(F.col("words"), F.col("read")), 6).alias("recall"))


@query("""WITH r AS (SELECT l_suppkey AS grp, l_linenumber AS config, round(avg(l_discount), 9) AS score, count(*) AS n FROM lineitem GROUP BY 1, 2), l AS (SELECT r.*, round(r.score - b.score, 9) AS lift FROM r JOIN r b ON b.grp = r.grp AND b.config = 1 WHERE r.n >= 5)
SELECT grp, arg_max(config, (lift, n, -config)) AS config, max(lift) AS lift FROM l GROUP BY 1""")
def best_configurations(t):
    """Of each supplier the line number whose discounts lie most above those of the first."""
    runs = t("lineitem").groupBy(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("config")).agg(F.round(F.avg("l_discount"), 9).alias("score"), F.count(F.lit(1)).alias("n")).withColumn("weight", F.col("config"))
    base = runs.withColumn("score", F.col("score").cast("decimal(12,9)"))
    found = metrics.best_by_lift(base, "grp", "config", "score", "n", "weight", 1)
    return found.select("grp", "config", F.col("lift").cast("double").alias("lift"))
