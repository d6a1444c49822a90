"""Queries over the vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import joins, metrics, retrieval, stages
from ..operators import ranking as R
from ..sources.scratch import folder
from ..sources.segments import Segments, point_id
from .registry import query

DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _nearest(t, k: int, where: str = "true", **options):
    """The nearest of the vectors that ``where`` takes, for every vector whose id is divisible by 100."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"), F.col("label").alias("group"))
    asked = e.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = retrieval.nearest(e.withColumnRenamed("group", "label").filter(where).withColumnRenamed("label", "group"), asked, k, **options)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("group").alias("label"), "score", "rank")


SCORES = f"""s AS (SELECT b.vec_id AS query_id, b.label AS query_label, a.vec_id, a.label, round({DOT}, 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0)"""
TOP = "SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE {0}) WHERE rank <= {1}"


@query(f"WITH {SCORES} {TOP.format('label < 8', 10)}")
def vec_topk_filtered(t):
    return _nearest(t, 10, "label < 8")


@query(f"WITH {SCORES} {TOP.format('true', 5)}")
def vec_neighbors_excl_self(t):
    return _nearest(t, 5)


BEST = f"{SCORES}, b AS (SELECT query_id, label, max(score) AS score, arg_min(vec_id, (-score, vec_id)) AS vec_id FROM s GROUP BY 1, 2)"


def _best(t):
    """The best view of each label."""
    return _nearest(t, 1, per_group=True).drop("rank")


@query(f"WITH {BEST} SELECT query_id, label, score, vec_id FROM b")
def vec_best_view_per_label(t):
    return _best(t)


@query(f"""WITH {BEST}, f AS (SELECT *, coalesce((lag(score) OVER w - score > 0.03)::INT, 0) AS fell FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, label))
SELECT query_id, label, score, CAST(sum(fell) OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INT) AS cluster FROM f""")
def score_chain_clusters(t):
    return R.chain_groups(_best(t).drop("vec_id"), ["query_id"], "score", "label", 0.03)


@query(f"""WITH {BEST}, f AS (SELECT *, coalesce((lag(score) OVER w - score > 0.03)::INT, 0) AS fell FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, label)),
c AS (SELECT query_id, label, score, CAST(sum(fell) OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INT) AS cluster FROM f),
m AS (SELECT query_id, cluster, max(score) AS best FROM c GROUP BY 1, 2)
SELECT c.query_id, c.label, c.score, c.cluster, round(c.score - m.best, 6) AS gap FROM c LEFT JOIN m ON m.query_id = c.query_id AND m.cluster = c.cluster + 1""")
def gap_next_group(t):
    c = R.chain_groups(_best(t).drop("vec_id"), ["query_id"], "score", "label", 0.03)
    return R.gap_to_next_cluster(c, ["query_id"], "score").withColumn("gap", F.round("gap", 6))


@query(f"""WITH {BEST}, r AS (SELECT *, CASE WHEN label % 4 = 3 THEN 100 + label ELSE label % 4 END AS fam, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS n FROM b)
SELECT a.query_id, a.label, a.score, CASE WHEN a.label % 4 = 3 THEN NULL ELSE a.label % 4 END AS family,
  round(a.score - (SELECT arg_min(x.score, x.n) FROM r x WHERE x.query_id = a.query_id AND x.n > a.n AND x.fam <> a.fam), 6) AS gap FROM r a""")
def gap_next_family(t):
    b = _best(t).withColumn("family", F.when(F.col("label") % 4 != 3, F.col("label") % 4))
    return R.gap_to_next_family(b, ["query_id"], "score", "label", "family").select("query_id", "label", "score", "family", F.round("gap", 6).alias("gap"))


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
p AS (SELECT e.vec_id, e.label AS truth, c.label, sum(e.embedding[c.i]::DOUBLE * c.x) / sqrt(sum(c.x * c.x)) AS score FROM embeddings e, c GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS margin FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, label))
SELECT vec_id, truth, label, round(score, 6) AS score, round(margin, 6) AS margin, margin >= 0.05 AS sure FROM r WHERE n = 1""")
def zero_shot_margin(t):
    e = t("embeddings").select("vec_id", F.col("label").alias("truth"), V.doubles("embedding").alias("v"))
    means = e.select("truth", F.posexplode("v").alias("i", "x")).groupBy("truth", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy(F.col("truth").alias("label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    top = retrieval.nearest_centres(e.select(F.struct("vec_id", "truth").alias("id"), F.col("v").alias("vector")), means.select(F.col("label").alias("centre"), F.col("m").alias("vector")))
    best = R.margin(top.select("id.*", F.col("centre").alias("label"), "score"), ["vec_id"], "score", "label")
    return best.select("vec_id", "truth", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), (F.col("margin") >= 0.05).alias("sure"))


# The sign bits of 32 components each, and the same with up to five of them flipped by a rule.
HALF = "list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i + {0}] > 0 THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT"
BITS = f"""h AS (SELECT vec_id, {HALF.format(0)} AS lo, {HALF.format(32)} AS hi FROM embeddings),
a AS (SELECT lo, hi, min(vec_id) AS a, count(*) AS a_copies FROM h GROUP BY 1, 2),
f AS (SELECT vec_id, xor(lo, (1::BIGINT << (vec_id % 16)::INT) | (1::BIGINT << (vec_id % 7)::INT) | (1::BIGINT << (vec_id % 5)::INT)) AS lo, hi FROM h),
b AS (SELECT lo, hi, min(vec_id) AS b, count(*) AS b_copies FROM f GROUP BY 1, 2)"""


@query(f"""WITH {BITS}, p AS (SELECT a, b, a_copies, b_copies, (bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)))::INT AS distance FROM a, b)
SELECT *, CASE WHEN distance <= 2 THEN 'same' ELSE 'near' END AS bucket FROM p WHERE distance <= 6""")
def hamming_pairs(t):
    """Hashes and altered hashes within 6 bits: pairs of the first of each class of equal hashes, with the sizes of their classes."""
    h = t("embeddings").select("vec_id", V.sign_bits(F.col("embedding")).alias("bits"))
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("vec_id") % m).cast("int"))
    altered = h.select("vec_id", F.col("bits").bitwiseXOR(bit(16).bitwiseOR(bit(7)).bitwiseOR(bit(5))).alias("bits"))
    found = joins.near_hashes(h, altered, "vec_id", "bits", 6)
    return found.withColumn("bucket", F.when(F.col("distance") <= 2, "same").otherwise("near"))


@query(f"""WITH {SCORES}, fam AS (SELECT vec_id AS anchor, label FROM embeddings WHERE vec_id % 100 = 0),
same AS (SELECT f.anchor, e.vec_id, row_number() OVER (PARTITION BY f.anchor ORDER BY e.vec_id) AS place FROM fam f JOIN embeddings e ON e.label = f.label AND e.vec_id <> f.anchor),
near AS (SELECT query_id AS anchor, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label <> query_label)
SELECT 'family' AS kind, * FROM same WHERE place <= 3 UNION ALL SELECT 'neighbour', * FROM near WHERE place <= 3""")
def hard_negatives(t):
    """For anchors: members of the same family, and nearest vectors outside it."""
    e = t("embeddings").select("vec_id", "label")
    anchors = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor"), "label")
    # one more than is asked, as an anchor may be among them
    members = R.capped(e, ["label"], [F.col("vec_id")], 4)
    same = members.join(anchors, "label").filter("vec_id <> anchor").select("anchor", "vec_id", (-F.col("vec_id")).alias("score"))
    same = R.top_k(same, ["anchor"], "score", "vec_id", 3, "place").select(F.lit("family").alias("kind"), "anchor", "vec_id", "place")
    near = _nearest(t, 3, other_groups=True)
    return same.unionByName(near.select(F.lit("neighbour").alias("kind"), F.col("query_id").alias("anchor"), "vec_id", F.col("rank").alias("place")))


@query("""WITH n AS (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 11 <> 4),
s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_dot_product(n.v, q.v), 6) AS score FROM n JOIN n q ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def segmented_search(t):
    """The nearest vectors in a table that grew by batches: a fifth added, a seventh turned round, an eleventh removed, one batch twice; as after a rebuild."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"))
    table = Segments(e.sparkSession, f"{folder(e.sparkSession)}/segments-{uuid.uuid4().hex}", 64)
    turned = e.withColumn("vector", F.transform("vector", lambda x: -x))
    table.create(e.filter("id % 5 <> 0"))
    table.upsert(e.filter("id % 5 = 0"), 1)
    table.upsert(turned.filter("id % 7 = 3"), 2)
    table.remove(e.filter("id % 11 = 4").select("id"), 3)
    table.upsert(turned.filter("id % 7 = 3"), 2)
    now = table.read().select("id", "vector", F.lit(0).alias("group"))
    found = retrieval.nearest(now, now.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), 5)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query("""WITH h AS (SELECT vec_id, sha1(unhex('SPACE') || encode(vec_id::VARCHAR)) AS h FROM embeddings)
SELECT vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point FROM h""".replace("SPACE", uuid.uuid5(uuid.NAMESPACE_URL, "larkspur:points").hex))
def point_ids(t):
    """The keys under which vectors are put into a table."""
    return t("embeddings").select("vec_id", point_id(F.col("vec_id")).alias("point"))


_PART = "list_dot_product(a.embedding[1:{0}]::DOUBLE[], b.embedding[1:{0}]::DOUBLE[])"


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, round({_PART.format(8)}, 6) AS score, round({_PART.format(24)}, 6) AS coarse, round({DOT}, 6) AS costly
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 24),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, rank) AS place, max(coarse) OVER (PARTITION BY query_id) AS top FROM r),
f AS (SELECT * FROM p WHERE top >= 0.2 AND (place <= 3 OR rank <= 2))
SELECT query_id, id, rank, coarse, costly, row_number() OVER (PARTITION BY query_id ORDER BY costly DESC, CASE WHEN place <= 3 THEN place ELSE 100 + rank END)::INT AS final FROM f""")
def stage_cascade(t):
    """Vectors by 8 components, then by 24, then whole for the few that are left."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"))
    first = e.select("id", F.slice("vector", 1, 8).alias("vector"), F.lit(0).alias("group"))
    found = retrieval.nearest(first, first.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), 24)

    def scored(n: int, name: str):
        part = F.slice("vector", 1, n).alias("v")

        def add(rows):
            met = rows.join(e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), part.alias("q")), "query_id").join(e.select("id", part), "id")
            return met.withColumn(name, F.round(V.dot(F.col("v"), F.col("q")), 6)).drop("v", "q")

        return add

    return stages.staged(found, scored(24, "coarse"), scored(64, "costly"), gate=0.2)


@query(f"""WITH {BEST}, c AS (SELECT b.*, label = q AS truth, query_id % 300 = 0 AS shared FROM b JOIN (SELECT vec_id AS query_id, label AS q FROM embeddings) USING (query_id)),
g AS (SELECT *, score - max(score) OVER w AS gap, score - max(score) FILTER (WHERE NOT truth) OVER w AS gap_rest, bool_or(truth) OVER w AS has FROM c WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, round(score + 0.5::DOUBLE * gap + 0.03::DOUBLE * (vec_id % 10), 6) AS conf, round(score + 0.5::DOUBLE * gap_rest + 0.03::DOUBLE * (vec_id % 10), 6) AS conf_rest FROM g),
v AS (SELECT 'positive' AS kind, max(conf) AS confidence, bool_or(truth) FILTER (WHERE conf = m) AS correct FROM (SELECT *, max(conf) OVER (PARTITION BY query_id) AS m FROM z) GROUP BY query_id
  UNION ALL SELECT 'negative', max(conf_rest), FALSE FROM z WHERE NOT truth AND has AND NOT shared GROUP BY query_id),
n AS (SELECT count(*) FILTER (WHERE kind = 'positive') AS p, count(*) FILTER (WHERE kind = 'negative') AS n FROM v)
SELECT t.confidence AS threshold, round((count(*) FILTER (WHERE kind = 'positive' AND correct AND v.confidence >= t.confidence) + count(*) FILTER (WHERE kind = 'negative' AND v.confidence < t.confidence)) / any_value(n.p + n.n)::DOUBLE, 6) AS accuracy,
  round(count(*) FILTER (WHERE kind = 'positive' AND correct AND v.confidence >= t.confidence) / any_value(n.p)::DOUBLE, 6) AS answered_right, round(count(*) FILTER (WHERE kind = 'positive' AND v.confidence < t.confidence) / any_value(n.p)::DOUBLE, 6) AS rejected,
  round(count(*) FILTER (WHERE kind = 'negative' AND v.confidence < t.confidence) / any_value(n.n)::DOUBLE, 6) AS rejected_outside FROM (SELECT DISTINCT confidence FROM v) t, v, n GROUP BY t.confidence""")
def open_set_sweep(t):
    """Labels of vectors as an open set: every vector once with its own label among the candidates, once without it and its gaps anew."""
    own = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q"))
    c = _best(t).join(own, "query_id").withColumns({"truth": F.col("label") == F.col("q"), "shared": F.col("query_id") % 300 == 0})
    score = lambda visual, gap: F.round(visual + 0.5 * gap + 0.03 * (F.col("vec_id") % 10), 6)
    sweep = metrics.open_set_sweep(metrics.open_set_confidences(c, "query_id", "score", "truth", "shared", score))
    return sweep.select("threshold", *[F.round(x, 6).alias(x) for x in ("accuracy", "answered_right", "rejected", "rejected_outside")])
