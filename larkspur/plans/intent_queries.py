"""Queries of filters, fallbacks and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intents as I
from .registry import query

@query("""WITH i AS (SELECT p_partkey AS id, ['wines', 'wineries', 'knowledge'][p_partkey % 3 + 1] AS kind, p_type, p_brand FROM part)
SELECT id, kind FROM i WHERE CASE kind WHEN 'wines' THEN p_type = 'PROMO' AND p_brand = 'Brand#11' WHEN 'wineries' THEN p_brand = 'Brand#11' ELSE TRUE END""")
def filter_modes(t):
    """Items of three collections: by all filters, by one, by none."""
    kind = F.element_at(F.array(F.lit("wines"), F.lit("wineries"), F.lit("knowledge")), (F.col("p_partkey") % 3 + 1).cast("int"))
    items = t("part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), "p_type", "p_brand")
    region = F.col("p_brand") == "Brand#11"
    return items.filter(I.passes(F.col("kind"), (F.col("p_type") == "PROMO") & region, region)).select("id", "kind")


@query("""WITH o AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_orderstatus = 'F' AS first, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) AS r1,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r2 FROM orders), n AS (SELECT query_id, count(*) FILTER (WHERE first) AS n FROM o GROUP BY 1)
SELECT query_id, id, (CASE WHEN n >= 3 THEN r1 ELSE r2 END)::INT AS rank FROM o JOIN n USING (query_id) WHERE CASE WHEN n >= 3 THEN first AND r1 <= 3 ELSE r2 <= 3 END""")
def pairing_fallback(t):
    """The three largest finished orders of a customer with that many, else the three largest of all."""
    from ..operators import ranking

    o = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    top = lambda df: ranking.top_k(df, ["query_id"], "o_totalprice", "id", 3)
    return I.first_or_wider(top(o.filter("o_orderstatus = 'F'")), top(o), 3).select("query_id", "id", "rank")


# ---- names to what they stand for: names of parts, which questions misspell


def _likeness_sql(pairs: str) -> str:
    """The token set ratio of ``pairs`` (a, b and further columns) as ``score``; common subsequences by bits of a wide integer."""
    return f"""t AS MATERIALIZED (SELECT *, list_sort(list_distinct(string_split(a, ' '))) AS s, list_sort(list_distinct(string_split(b, ' '))) AS t,
  list_sort(list_intersect(s, t)) AS c FROM ({pairs})),
l AS (SELECT *, array_to_string(list_concat(c, list_filter(s, lambda x: NOT list_contains(c, x))), ' ') AS x, array_to_string(list_concat(c, list_filter(t, lambda x: NOT list_contains(c, x))), ' ') AS y,
  length(array_to_string(c, ' ')) AS n, (1::HUGEINT << length(x)) - 1 AS ones FROM t),
m AS (SELECT *, list_transform(string_split(y, ''), lambda d: list_sum(list_transform(range(length(x)), lambda i: CASE WHEN x[i + 1] = d THEN 1::HUGEINT << i::INT ELSE 0 END))::HUGEINT) AS masks FROM l),
w AS (SELECT *, 2.0 * (length(x) - bit_count(list_reduce(masks, lambda r, k: ((r + (r & k)) | (r - (r & k))) & ones, ones))) / (length(x) + length(y)) AS whole FROM m),
scored AS (SELECT *, floor(1e6 * CASE WHEN n > 0 AND len(c) IN (len(s), len(t)) THEN 1 WHEN n > 0 THEN greatest(whole, 2.0 * n / (n + least(length(x), length(y)))) ELSE whole END + 0.5) / 1e4 AS score FROM w)"""


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]', ' ', 'g'))"
_SQUEEZED = "regexp_replace({}, ' +', ' ', 'g')"
_NAME, _ASKED = "p_name || ', ' || p_type || ' ' || p_brand", "substr(p_brand, 2) || ' ' || substr(p_name, 2) || ' ' || p_size"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, {_SQUEEZED.format(_PLAIN.format(_ASKED))} AS a FROM part WHERE p_partkey % 100 = 0),
n AS (SELECT p_partkey AS id, {_SQUEEZED.format(_PLAIN.format(_NAME))} AS b FROM part),
{_likeness_sql("SELECT * FROM q, n")}
SELECT query_id, id, score, score < 75 AS low_confidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored WHERE score >= 52 QUALIFY rank <= 5""")
def resolved_labels(t):
    """The five parts most like each hundredth part's label as it was read: brand first, the first letters of brand and name lost, the size added."""
    p = t("part")
    asked = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.expr(_ASKED).alias("text"))
    names = p.select(F.col("p_partkey").alias("id"), F.expr(_NAME).alias("name"))
    return I.resolved(asked, names, I.LABEL, 5, I.SURE_LABEL).select("query_id", "id", "score", "low_confidence", "rank")


@query(f"""WITH q AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN upper(p_brand) || ' ' WHEN 2 THEN substr(p_type, 2) ELSE p_name END AS text FROM part),
tags AS (SELECT DISTINCT p_type AS tag FROM part), words AS (SELECT p_brand AS word, min(p_type) AS tag FROM part GROUP BY p_brand),
e AS (SELECT query_id, tag FROM q JOIN tags ON lower(trim(text)) = lower(tag)),
k AS (SELECT query_id, tag FROM q JOIN words ON lower(trim(text)) = lower(word)),
d AS (SELECT DISTINCT {_SQUEEZED.format(_PLAIN.format("text"))} AS a FROM q),
{_likeness_sql(f"SELECT a, tag, {_PLAIN.format('tag')} AS b FROM d, tags")},
f AS (SELECT a, tag FROM scored WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, tag) = 1)
SELECT q.query_id, coalesce(e.tag, k.tag, f.tag) AS tag FROM q LEFT JOIN e USING (query_id) LEFT JOIN k USING (query_id) LEFT JOIN f ON f.a = {_SQUEEZED.format(_PLAIN.format("q.text"))}
WHERE coalesce(e.tag, k.tag, f.tag) IS NOT NULL""")
def resolved_categories(t):
    """Types of parts from what is said of them: the type in other case, a brand as its synonym, the type without its first letter, a name that says nothing."""
    p = t("part")
    said = "CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN upper(p_brand) || ' ' WHEN 2 THEN substr(p_type, 2) ELSE p_name END"
    asked = p.select(F.col("p_partkey").alias("query_id"), F.expr(said).alias("text"))
    words = p.groupBy(F.col("p_brand").alias("word")).agg(F.min("p_type").alias("tag"))
    return I.resolve_category(asked, p.select(F.col("p_type").alias("tag")).distinct(), words, 80)


@query(f"""WITH y AS (SELECT DISTINCT lower(p_type) || '-' || p_size AS slug, p_type || ' of ' || p_brand AS name FROM part), q AS (SELECT p_partkey AS query_id, {_SQUEEZED.format(_PLAIN.format("substr(p_type, 2) || ' love ' || p_brand"))} AS a FROM part WHERE p_partkey % 100 = 0),
n AS (SELECT slug, {_SQUEEZED.format(_PLAIN.format("name"))} AS b FROM y UNION SELECT slug, replace(slug, '-', ' ') FROM y),
{_likeness_sql("SELECT * FROM q, n")}
SELECT query_id, slug, score FROM scored WHERE score >= 55 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) = 1""")
def resolved_styles(t):
    """The style that a wish names by its name or its slug, the wish's first letter lost."""
    p = t("part")
    asked = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.expr("substr(p_type, 2) || ' love ' || p_brand").alias("text"))
    styles = p.select(F.expr("lower(p_type) || '-' || p_size").alias("slug"), F.expr("p_type || ' of ' || p_brand").alias("name")).distinct()
    return I.resolve_style(asked, styles)
