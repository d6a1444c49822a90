"""Queries of this subpackage: one per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .annulus import cluster
from .chat import format_preferences, partnered_pairs
from .exact_dedup import exact_groups
from .fingerprint import document_fingerprints
from .kneser_ney import quality
from .langid import held_out, identify, train
from .mixing import mix
from .neardup import near_duplicates
from .negatives import hard_negatives
from .packing import pack
from .pii import find_pii
from .sharding import place, rendezvous
from .tables import load
from .toxicity import score_toxicity


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(load(spark, sf_dir, "documents"))


def op2_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(partnered_pairs(load(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return made.withColumns({c: spans(c) for c in ("chosen_spans", "rejected_spans")})


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS p,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
draw AS (
  SELECT conv_id, count(*) AS n, list(p ORDER BY p) FILTER (WHERE role = 'assistant') AS told,
         md5(arg_min(role || chr(10) || text, p)) AS opening,
         ('0x' || substr(md5('branch:' || conv_id), 1, 8))::BIGINT AS b, ('0x' || substr(md5('order:' || conv_id), 1, 8))::BIGINT AS place,
         ('0x' || substr(md5('circle:' || conv_id), 1, 8))::BIGINT AS c
  FROM t GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') > 0),
sized AS (SELECT *, told[b % len(told) + 1] - 1 AS branch, count(*) OVER (PARTITION BY opening) AS size FROM draw),
grouped AS (SELECT *, size = 1 AS lone, CASE WHEN size = 1 THEN '' ELSE opening END AS g FROM sized),
placed AS (SELECT *, c % CAST(ceil(count(*) OVER (PARTITION BY g) / 512.0) AS BIGINT) AS circle FROM grouped),
pair AS (
  SELECT conv_id, lone, branch, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS partner
  FROM placed WINDOW w AS (PARTITION BY g, circle ORDER BY place, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
two AS (SELECT a.*, b.branch AS their_branch FROM pair a JOIN pair b ON b.conv_id = a.partner),
chosen AS (SELECT conv_id, p, role, text FROM t SEMI JOIN pair USING (conv_id)),
rejected AS (
  SELECT a.conv_id, t.p, t.role, t.text FROM two a JOIN t ON t.conv_id = a.partner WHERE NOT lone
  UNION ALL SELECT a.conv_id, t.p, t.role, t.text FROM two a JOIN t ON t.conv_id = a.conv_id WHERE lone AND t.p <= branch
  UNION ALL SELECT a.conv_id, t.p - their_branch + branch, t.role, t.text FROM two a JOIN t ON t.conv_id = a.partner WHERE lone AND t.p > their_branch),
sides AS (
  SELECT conv_id, p, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM chosen c FULL JOIN rejected r USING (conv_id, p)),
prefix AS (
  SELECT conv_id, coalesce(min(p) FILTER (WHERE c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text) - 1, max(p)) AS k FROM sides GROUP BY conv_id),
shown AS (
  SELECT s.*, k, coalesce('<|' || c_role || '|>' || chr(10) || c_text || chr(10) || '<|end|>' || chr(10), '') AS c,
         coalesce('<|' || r_role || '|>' || chr(10) || r_text || chr(10) || '<|end|>' || chr(10), '') AS r
  FROM sides s JOIN prefix USING (conv_id)),
placed_ AS (
  SELECT *, sum(CASE WHEN p > k THEN length(c) ELSE 0 END) OVER w AS c_end,
         sum(CASE WHEN p > k THEN length(r) ELSE 0 END) OVER w AS r_end
  FROM shown WINDOW w AS (PARTITION BY conv_id ORDER BY p))
SELECT conv_id, any_value(partner) AS partner, CAST(max(k) AS INTEGER) AS prefix_turns,
  coalesce(string_agg(c, '' ORDER BY p) FILTER (WHERE p <= k), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY p) FILTER (WHERE p > k), '') AS chosen_completion,
  coalesce(string_agg(r, '' ORDER BY p) FILTER (WHERE p > k), '') AS rejected_completion,
  coalesce(string_agg(CAST(CAST(c_end - length(c) + length(c_role) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(c_end - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY p)
    FILTER (WHERE p > k AND c_role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(CAST(r_end - length(r) + length(r_role) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(r_end - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY p)
    FILTER (WHERE p > k AND r_role = 'assistant'), '') AS rejected_spans
FROM placed_ JOIN pair USING (conv_id) GROUP BY conv_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out() & F.col("lang").isNotNull()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").filter(~held_out())
    scored = score_toxicity(load(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "toxic_tokens", "spans")


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = load(spark, sf_dir, "labels").filter("quality = 1").filter(~held_out())
    places = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0  # a fifth of the training labels places the thresholds
    return quality(load(spark, sf_dir, "documents"), trusted.filter(~places), trusted.filter(places))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(load(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept,
       text_sha256
FROM d
"""



def op11_annulus_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(load(spark, sf_dir, "embeddings"))
    written = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written, 256).alias("centroid_sha256"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds unrolled: c0 the first centroids, a0 the first assignment, and so on."""
    parts = [
        """e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS k, v FROM e QUALIFY k < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, e.v, k, (list_inner_product(e.v, e.v) - 2 * list_inner_product(e.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS d
  FROM e CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  WITH s AS (SELECT k, j, floor(sum(v[j]) / count(*)) AS m FROM a{i} CROSS JOIN range(1, 65) r(j) GROUP BY k, j)
  SELECT k, list(m ORDER BY j) AS v FROM s GROUP BY k
  UNION ALL SELECT k, v FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


#: Shards of the query, all of one weight; `grown_shard` has one more.
SHARDS = 24


def op12_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = load(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
    return place(facts, [1.0] * SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_quantised_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP13_SQL = r"""
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""

QUERIES = {
    "op1_pii_boosting": op1_pii_boosting,
    "op2_preference_formatting": op2_preference_formatting,
    "op3_language_id": op3_language_id,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_toxicity_crf": op5_toxicity_crf,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_source_mixing": op8_source_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_annulus_clustering": op11_annulus_clustering,
    "op12_rendezvous_sharding": op12_rendezvous_sharding,
    "op13_quantised_negatives": op13_quantised_negatives,
}
ORACLES = {"op2_preference_formatting": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op11_annulus_clustering": _op11_sql(), "op13_quantised_negatives": OP13_SQL}
