"""Queries of rules: what names, wishes and labels say, which candidate stands, and reports of a catalog; texts are made of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates, labels, matching, retrieval, sampling
from ..operators import profiles as P
from .intent_queries import _likeness_sql
from .registry import query
from .text_queries import FUSED, fused_scores

# ---- names of files

_FILE = """CASE p_partkey % 9 WHEN 0 THEN replace(p_name, ' ', '_') || '_' || substr(md5(p_name), 1, 10) || '_' || substr(md5(p_brand), 1, 10) || '.JPG' WHEN 1 THEN 'DSC_' || p_partkey || '.webp'
  WHEN 2 THEN substr(md5(p_name), 1, 20) || '.png' WHEN 3 THEN p_name || '.svg' WHEN 4 THEN p_name || '.tiff' WHEN 5 THEN 'thumbnail_' || p_name || '.jpeg'
  WHEN 6 THEN p_name || '.mp4' WHEN 7 THEN p_name ELSE p_type || '.' || p_brand || '.png' END"""


@query(rf"""WITH f AS (SELECT p_partkey, {_FILE} AS file FROM part), e AS (SELECT *, regexp_extract(file, '(?i)^(.+)\.(webp|png|jpg|jpeg|jfif|heic|tif|tiff|gif|avif|bmp)$', ['s', 'e']) AS x, lower(regexp_extract(file, '^.+\.([^.]+)$', 1)) AS any_ext FROM f),
s AS (SELECT *, CASE WHEN x.e = '' THEN file ELSE x.s END AS stem, regexp_replace(CASE WHEN any_ext = '' THEN file ELSE regexp_extract(file, '^(.+)\.[^.]+$', 1) END, '(_[0-9a-f]{{10}})+$', '') AS bare FROM e),
h AS (SELECT *, regexp_extract(stem, '^(.*)_([0-9a-f]{{10}})$', ['b', 'h']) AS p FROM s)
SELECT p_partkey, CASE WHEN p.h = '' THEN stem ELSE p.b END AS base, nullif(p.h, '') AS file_hash, lower(x.e) AS ext, regexp_replace(lower(CASE WHEN p.h = '' THEN stem ELSE p.b END), '[^0-9a-z]', '', 'g') AS key,
  regexp_matches(lower(file), '^(thumbnail_|small_|medium_|large_)') AS variant,
  CASE WHEN any_ext = 'svg' THEN 'svg_logo' WHEN any_ext IN ('tif', 'tiff') THEN 'tif_scan' WHEN any_ext NOT IN ('webp', 'jpg', 'jpeg', 'png') THEN 'other_ext_' || coalesce(nullif(any_ext, ''), 'none')
    WHEN regexp_matches(lower(bare), '^(dsc|img|pxl|mg)[_-]?[0-9]') THEN 'camera_original'
    WHEN NOT regexp_matches(bare, '[_ -]') AND length(bare) >= 16 AND regexp_matches(bare, '[A-Z]')::INT + regexp_matches(bare, '[a-z]')::INT + regexp_matches(bare, '[0-9]')::INT >= 2 THEN 'random_s3_name' ELSE 'other_photo' END AS noise FROM h""")
def upload_names(t):
    """Parts as names of uploaded files: what they are of, their hash, whether a thumbnail, and what kind of noise they look like."""
    names = t("part").select("p_partkey", F.explode(F.array(F.expr(_FILE))).alias("file"))  # made once, not once for each use
    d = names.withColumn("p", T.upload_parts(F.col("file")))
    return d.select("p_partkey", "p.base", "p.file_hash", "p.ext", "p.key", T.is_variant_name(F.col("file")).alias("variant"), T.noise_class(F.col("file")).alias("noise"))


# ---- wishes and profiles

_WISH = """p_name || CASE p_partkey % 7 WHEN 0 THEN ' без красного' WHEN 1 THEN ', не Сладкое' WHEN 2 THEN ' не хочу полусладкое и белое вино' WHEN 3 THEN ' красное сухое' WHEN 4 THEN ' белое без сухого' WHEN 5 THEN ' не без затей' ELSE '' END"""
_COLOR = "CASE p_size % 5 WHEN 0 THEN 'красное' WHEN 1 THEN 'Белое' WHEN 2 THEN 'розовое' WHEN 3 THEN 'оранжевое' END"
_SUGAR = "CASE p_size % 6 WHEN 0 THEN 'сухое' WHEN 1 THEN 'полусухое' WHEN 2 THEN 'Полусладкое' WHEN 3 THEN 'сладкое' WHEN 4 THEN 'брют' END"
_HERE = r"(^|[^\p{L}])"


def _says(column: str, ladder: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{_HERE}{w}') THEN '{v}'" for w, v in ladder) + " END"


_COLORS, _SUGARS = [("красн", "красное"), ("бел", "белое"), ("розов", "розовое"), ("оранж", "оранжевое")], [("экстра.?брют", "экстра брют"), ("полусух", "полусухое"), ("полуслад", "полусладкое"), ("брют", "брют"), ("сух", "сухое"), ("сладк", "сладкое")]
_NOT = r"(^|[^\p{L}])(не(\s+(хочу|люблю|надо))?|без)\s+((красн|бел|розов|сладк|полусладк|сух)[\p{L}\p{N}_]*)"


@query(rf"""WITH w AS (SELECT p_partkey, {_WISH} AS said, lower({_COLOR}) AS color, lower({_SUGAR}) AS sugar FROM part),
n AS (SELECT *, regexp_extract_all(lower(said), '{_NOT}', 5) AS unwanted, regexp_replace(said, '(?i){_NOT}', '\1', 'g') AS wish FROM w),
a AS (SELECT *, {_says("lower(wish)", _COLORS)} AS c, {_says("lower(wish)", _SUGARS)} AS s FROM n),
x AS (SELECT p_partkey, bool_or(coalesce({_says("u", _COLORS)} = color, FALSE) OR coalesce({_says("u", _SUGARS)} = sugar, FALSE)) AS barred FROM (SELECT p_partkey, color, sugar, unnest(unwanted) AS u FROM a) GROUP BY p_partkey)
SELECT p_partkey, wish, array_to_string(unwanted, ',') AS unwanted, (c IS NULL OR c = coalesce(color, '')) AND (s IS NULL OR s = coalesce(sugar, '')) AND NOT coalesce(barred, FALSE) AS chosen FROM a LEFT JOIN x USING (p_partkey)""")
def negated_wishes(t):
    """Wishes made of parts' names: what they exclude, what is left of them, and whether the part is one that is asked for."""
    d = t("part").select("p_partkey", F.explode(F.array(F.expr(_WISH))).alias("said"), F.expr(_COLOR).alias("color"), F.expr(_SUGAR).alias("sugar"))
    w = P.without_negatives(F.col("said"))
    chosen = P.chosen_by(F.col("said"), F.col("color"), F.col("sugar"), F.lit(None).cast("string"), {})
    return d.select("p_partkey", w["wish"].alias("wish"), F.array_join(w["unwanted"], ",").alias("unwanted"), chosen.alias("chosen"))


_TASTE = "CASE p_partkey % 9 WHEN 0 THEN ' Полусладкое' WHEN 1 THEN ' Prosecco' WHEN 2 THEN ' брют, игристое' WHEN 3 THEN ' Десертное' WHEN 4 THEN ' Ликёрное Cava' WHEN 5 THEN ' DRY' WHEN 6 THEN ' сухое Пет-Нат' WHEN 7 THEN ' Asti сладкое' ELSE '' END"
_WORDS = " ".join(f"WHEN contains(said, '{w}') THEN {v}::DOUBLE" for w, v in P.SWEETNESS_WORDS.items())
_TABLE = ", ".join(f"('{c}', {str(still).upper()}, {', '.join(f'{v}::DOUBLE' for v in values)})" for (c, still), values in P.BY_COLOR.items())


@query(f"""WITH b AS (SELECT p_partkey, lower(trim(' ' || {_COLOR} || ' ')) AS color, lower(p_name || ' ' || {_TASTE}) AS said, CASE WHEN p_size % 3 = 0 THEN p_size / 4.0::DOUBLE END AS abv FROM part),
t(color, still, {", ".join(P.AXES)}) AS (VALUES {_TABLE}),
s AS (SELECT *, NOT regexp_matches(said, '{"|".join(P.SPARKLING_WORDS)}') AS still, CASE {_WORDS} END AS sweet FROM b)
SELECT p_partkey, coalesce(sweet, sweetness) AS sweetness, acidity, tannin, body, oak, aromatic_intensity, bubbles, coalesce(abv, 12.5::DOUBLE) AS abv_percent FROM s JOIN t ON t.color = s.color AND t.still = s.still""")
def heuristic_profiles(t):
    """Axes of parts by a color and by the words of their names; parts without a color have none."""
    name = F.concat("p_name", F.expr(_TASTE))
    color = F.concat(F.lit(" "), F.expr(_COLOR), F.lit(" "))
    found = P.heuristic_profile(color, name, F.lit(None).cast("string"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 4.0))
    return t("part").select("p_partkey", found.alias("p")).filter("p IS NOT NULL").select("p_partkey", "p.*")


_CARD = """p_partkey AS id, p_brand AS maker, p_name AS name, p_type AS category, CASE p_size % 4 WHEN 0 THEN 'dry' WHEN 1 THEN 'semi_dry' WHEN 2 THEN 'sweet' END AS sweetness, p_size % 6 = 0 AS sparkling,
  'r' || p_partkey % 3 AS region, p_name || CASE p_partkey % 7 WHEN 0 THEN ' rislin' WHEN 1 THEN ' saperavi' ELSE '' END AS grapes, CASE WHEN p_partkey % 5 = 0 THEN 'v dubovoj bochke' ELSE p_name END AS description"""
_RULES = [("meat", "category", "PROMO", 1.5), ("meat", "category", "SMALL", 0.5), ("meat", "sweetness", "dry", 1.0), ("meat", "sweetness", "semi_dry", 0.6), ("meat", "grape", "gear", 1.0), ("meat", "grape", "saperavi", 1.2), ("fish", "category", "ECONOMY", 1.5), ("fish", "sparkling", "true", 2.5), ("fish", "grape", "rislin", 0.6)]
_REQUESTS = [(1, "meat", None, None, None, None, [3, 4, 5]), (2, "fish", "ECONOMY", None, None, "light", []), (3, None, None, "sweet", None, "full", []), (4, "meat", None, None, "r1", "full", None), (5, None, None, None, None, None, [])]


def _text(v) -> str:
    return "NULL" if v is None else f"'{v}'"


@query(f"""WITH c AS (SELECT {_CARD} FROM part), r(dish, field, value, weight) AS (VALUES {", ".join(f"('{d}', '{f}', '{v}', {w}::DOUBLE)" for d, f, v, w in _RULES)}),
q(request_id, dish, category, sweetness, region, body, excluded) AS (VALUES {", ".join(f"({i}, {_text(d)}, {_text(c)}, {_text(s)}, {_text(g)}, {_text(b)}, {x or []}::INT[])" for i, d, c, s, g, b, x in _REQUESTS)}),
m AS (SELECT request_id, c.*, dish, body, CASE WHEN dish IS NULL THEN 0 ELSE coalesce((SELECT weight FROM r WHERE r.dish = q.dish AND field = 'category' AND value = c.category), -1) END AS wc,
  coalesce((SELECT weight FROM r WHERE r.dish = q.dish AND field = 'sweetness' AND value = c.sweetness), 0) AS ws, coalesce((SELECT max(weight) FROM r WHERE r.dish = q.dish AND field = 'grape' AND contains(c.grapes, value)), 0) AS wg,
  CASE WHEN sparkling THEN coalesce((SELECT max(weight) FROM r WHERE r.dish = q.dish AND field = 'sparkling'), 0) ELSE 0 END AS wb, description LIKE '%dub%' AS oak
  FROM q JOIN c ON coalesce(q.category = c.category, q.category IS NULL) AND coalesce(q.sweetness = c.sweetness, q.sweetness IS NULL) AND coalesce(q.region = c.region, q.region IS NULL) AND NOT list_contains(q.excluded, c.id)),
b AS (SELECT *, contains(grapes, 'rislin') AND NOT oak AS light, contains(grapes, 'saperavi') OR oak AS heavy FROM m),
s AS (SELECT *, round(wc + ws + wg + wb + CASE body WHEN 'light' THEN CASE WHEN light THEN 1 ELSE -0.5 END WHEN 'full' THEN CASE WHEN heavy THEN 1 ELSE -0.5 END ELSE 0 END, 6)::DOUBLE AS score,
  list_filter([CASE WHEN dish IS NOT NULL AND wc > 0 AND (ws > 0 OR wg > 0) THEN 'dish' END, CASE WHEN wg > 0 THEN 'grape' END, CASE WHEN body = 'light' AND light THEN 'light' END, CASE WHEN body = 'full' AND heavy THEN 'full' END, CASE WHEN body = 'full' AND oak THEN 'oak' END], lambda x: x IS NOT NULL) AS reasons FROM b),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY request_id, maker ORDER BY score DESC, name, id) = 1)
SELECT request_id, id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, name, id)::INT AS rank, reasons FROM o QUALIFY rank <= 3""")
def questionnaire(t):
    """Suggestions of different makers by weights of a dish, by body and wishes, with their reasons."""
    spark = t("part").sparkSession
    asked = spark.createDataFrame(_REQUESTS, "request_id int, dish string, category string, sweetness string, region string, body string, excluded array<bigint>")
    cards = t("part").selectExpr(*_CARD_COLUMNS)
    return P.suggest(cards, asked, spark.createDataFrame(_RULES, "dish string, field string, value string, weight double"), 3)


_CARD_COLUMNS = [
    "p_partkey AS id", "p_brand AS maker", "p_name AS name", "p_type AS category", "CASE p_size % 4 WHEN 0 THEN 'dry' WHEN 1 THEN 'semi_dry' WHEN 2 THEN 'sweet' END AS sweetness", "p_size % 6 = 0 AS sparkling",
    "'r' || p_partkey % 3 AS region", "p_name || CASE p_partkey % 7 WHEN 0 THEN ' rislin' WHEN 1 THEN ' saperavi' ELSE '' END AS grapes", "CASE WHEN p_partkey % 5 = 0 THEN 'v dubovoj bochke' ELSE p_name END AS description",
]


@query("""WITH a AS (SELECT p_partkey AS id, lower(p_type) AS slug FROM part WHERE p_partkey % 50 = 0),
i AS (SELECT p_partkey AS item, lower(p_type) AS slug, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_size % 2 = 0)
SELECT a.id, 'label ' || slug AS label, slug || '-style' AS slug, item, rank::INT AS rank FROM a JOIN i USING (slug) WHERE rank <= 12""")
def foreign_analogs(t):
    """What stands in for labels that name a part's type: the style of that type, and its dearest parts of an even size."""
    p = t("part")
    kinds = p.select(F.lower("p_type").alias("k")).distinct()
    references = kinds.select(F.col("k").alias("phrase"), F.col("k").alias("slug"), F.concat(F.lit("label "), "k").alias("label"), F.concat("k", F.lit(" in style")).alias("resolve_query"))
    styles = kinds.select(F.concat("k", F.lit("-style")).alias("slug"), F.concat(F.lit("Style "), F.initcap("k")).alias("name"), F.lit(None).cast("string").alias("color"), F.lit(True).alias("still"), F.lit(None).cast("string").alias("sugar"))
    items = p.select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lower("p_type"), F.lit("-style"))).alias("styles"), F.lit("c").alias("color"), (F.col("p_size") % 2 == 0).alias("still"), F.lit("s").alias("sugar"), F.col("p_retailprice").alias("score"))
    texts = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("A bottle of "), "p_type", F.lit(", 2019")).alias("text"))
    return P.foreign_analogs(texts, references, styles, items)


# ---- names and labels

_KEYS = "SELECT DISTINCT CASE WHEN length(name) % 3 = 0 THEN name WHEN length(name) % 3 = 1 THEN left(name, length(name) - 2) ELSE 'x' || split_part(name, '_', 2) || 'yy' END AS key FROM n WHERE hash % 3 <> 0"


@query(f"""WITH n AS (SELECT name, ('0x' || substr(md5(name), 1, 4))::INT AS hash FROM (SELECT DISTINCT replace(lower(p_name || ' ' || p_type), ' ', '_') AS name FROM part)), k AS ({_KEYS}),
e AS (SELECT name, name AS key FROM n JOIN k ON k.key = n.name), l AS (SELECT * FROM n WHERE name NOT IN (SELECT name FROM e)),
c AS (SELECT name, key FROM l, k WHERE length(name) >= 6 AND length(key) >= 6 AND (contains(key, name) OR contains(name, key)) AND least(length(name), length(key)) >= 0.5 * greatest(length(name), length(key))),
u AS (SELECT name, count(*) AS n, min(key) AS key FROM c GROUP BY 1), w AS (SELECT DISTINCT name FROM (SELECT name, unnest(string_split(name, '_')) AS word FROM l), k WHERE length(word) >= 4 AND contains(key, word)),
f AS (SELECT min(key) AS first, max(key) AS last FROM k),
m AS (SELECT name, key, 'exact' AS status FROM e UNION ALL SELECT l.name, CASE WHEN u.n = 1 THEN u.key END, CASE WHEN u.n = 1 THEN 'substring' WHEN u.n > 1 THEN 'ambiguous' WHEN w.name IS NOT NULL THEN 'weak_overlap' ELSE 'no_ref' END FROM l LEFT JOIN u USING (name) LEFT JOIN w USING (name)),
o AS (SELECT m.name, CASE WHEN key IS NULL AND hash % 4 = 1 THEN first ELSE key END AS key, CASE WHEN key IS NULL AND hash % 4 = 1 THEN 'override' ELSE status END AS status, hash FROM m JOIN n USING (name), f)
SELECT name, CASE hash % 10 WHEN 0 THEN last WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE key END AS key, CASE hash % 10 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'rejected' ELSE status END AS status, CASE hash % 10 WHEN 0 THEN first ELSE '' END AS extra FROM o, f""")
def match_cascade(t):
    """Names to keys: by equality, by the one key that is a part of them, by a hand-made list; the rest by why not; lists that were looked through always hold."""
    name, digits = F.replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit(" "), F.lit("_")), F.conv(F.substring(F.md5("name"), 1, 4), 16, 10).cast("int")
    n = t("part").select(name.alias("name")).distinct().withColumn("hash", digits)
    size = F.length("name")
    key = F.when(size % 3 == 0, F.col("name")).when(size % 3 == 1, F.left("name", size - 2)).otherwise(F.concat(F.lit("x"), F.split_part("name", F.lit("_"), F.lit(2)), F.lit("yy")))
    k = n.filter("hash % 3 <> 0").select(key.alias("key")).distinct()
    ends = k.agg(F.min("key").alias("first"), F.max("key").alias("last")).first()
    said = n.filter("hash % 2 = 1").select("name", F.when(F.col("hash") % 4 == 1, ends["first"]).otherwise("not a key").alias("key"))
    lists = F.when(F.col("hash") % 10 == 0, F.array(F.lit("gone"), F.lit(ends["last"]), F.lit(ends["first"]))).when(F.col("hash") % 10 == 1, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    found = matching.cascade(n, k, said, n.filter("hash % 10 < 3").select("name", lists.alias("keys")))
    return found.withColumn("extra", F.array_join("extra", ","))


_TOKENS = "lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b, lower(p_type) AS maker"


@query(f"""WITH c AS (SELECT p_partkey AS id, {_TOKENS} FROM part), r AS (SELECT c.id, c.a, c.b, c.maker, d.a || 's' AS ra, d.b AS rb, CASE WHEN c.id % 4 = 0 THEN 'reserve' ELSE c.maker || 'x' END AS rmaker, CASE WHEN c.id % 3 = 0 THEN c.b ELSE d.b END AS heard FROM c JOIN c d ON d.id = c.id + 1),
v AS (SELECT DISTINCT unnest([a, b, maker, a || 's', maker || 'x', 'reserve', 'red', 'white', 'rose', 'dry', 'sweet', 'semi', 'line']) AS w FROM c),
{_likeness_sql("SELECT x.w AS a, y.w AS b FROM v x, v y")},
k AS (SELECT a, b FROM scored WHERE a = b OR (length(a) >= 4 AND length(b) >= 4 AND (score >= 80 OR (length(a) >= 5 AND length(b) >= 5 AND (starts_with(a, b) OR starts_with(b, a)))))),
g AS (SELECT DISTINCT a FROM k WHERE b IN ('reserve', 'red', 'white', 'rose', 'dry', 'sweet', 'semi', 'line')),
p AS (SELECT r.*, list_filter([a, b], lambda t: t NOT IN (SELECT a FROM g)) AS known0, list_filter([ra, rb], lambda t: t NOT IN (SELECT a FROM g)) AS said0 FROM r),
e AS (SELECT id, list_contains(list(k.b), maker) AS same FROM r JOIN k ON k.a = r.rmaker GROUP BY id, maker)
SELECT r.id, coalesce(e.same, FALSE) AND rmaker NOT IN (SELECT a FROM g) AND maker NOT IN (SELECT a FROM g) AND (SELECT count(*) FROM (SELECT unnest([a, b]) AS t) WHERE t NOT IN (SELECT a FROM g) AND t NOT IN (SELECT a FROM k WHERE b IN (maker, rmaker))) > 0
  AND (SELECT count(*) FROM (SELECT unnest([ra, rb]) AS t) WHERE t NOT IN (SELECT a FROM g) AND t NOT IN (SELECT a FROM k WHERE b IN (maker, rmaker))) > 0
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest([ra, rb]) AS s) x, (SELECT unnest([a, b]) AS t) y JOIN k ON TRUE WHERE k.a = s AND k.b = t AND s NOT IN (SELECT a FROM g) AND t NOT IN (SELECT a FROM g) AND s NOT IN (SELECT a FROM k WHERE b IN (maker, rmaker)) AND t NOT IN (SELECT a FROM k WHERE b IN (maker, rmaker)))
  AND EXISTS (SELECT 1 FROM (SELECT unnest([ra, rb]) AS s) JOIN k ON k.a = s AND k.b = heard WHERE s NOT IN (SELECT a FROM g) AND s NOT IN (SELECT a FROM k WHERE b IN (maker, rmaker)))
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest([a, b]) AS s) JOIN k ON k.a = s AND k.b = heard WHERE s NOT IN (SELECT a FROM g) AND s NOT IN (SELECT a FROM k WHERE b IN (maker, rmaker))) AS conflict
FROM r LEFT JOIN e ON e.id = r.id""")
def name_conflicts(t):
    """Whether the next part's name, read with a letter more, speaks against a part; a quarter has no maker that was read, a third was heard apart as itself."""
    c = t("part").select(F.col("p_partkey").alias("id"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("a"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("b"), F.lower("p_type").alias("maker"))
    d = c.select((F.col("id") - 1).alias("id"), F.concat("a", F.lit("s")).alias("ra"), F.col("b").alias("rb"))
    r = c.join(d, "id")
    none = F.array().cast("array<string>")
    card = {"name": F.array("a", "b"), "winery": F.array("maker"), "grapes": none}
    read_maker = F.when(F.col("id") % 4 == 0, "reserve").otherwise(F.concat("maker", F.lit("x")))
    read = {"name": F.array("ra", "rb"), "winery": F.array(read_maker), "grapes": none}
    heard = F.array(F.when(F.col("id") % 3 == 0, F.col("b")).otherwise(F.col("rb")))
    return r.select("id", labels.name_conflicts(read, card, heard).alias("conflict"))


# ---- candidates


@query(f"""WITH {FUSED}, y AS (SELECT query_id, id, cv, relative * CASE WHEN (id * 7 + query_id) % 10 / 10.0::DOUBLE < 0.5 THEN 0.6::DOUBLE ELSE 1 END AS relative FROM f),
z AS (SELECT query_id, id, cv, round(cv + 0.2::DOUBLE * relative, 6) AS final, CASE WHEN id % 3 <> 0 THEN id % 2 END AS family FROM y),
o AS (SELECT *, row_number() OVER w AS n, first_value(family) OVER w AS best FROM z WINDOW w AS (PARTITION BY query_id ORDER BY final DESC, id)),
b AS (SELECT query_id, max(id) FILTER (WHERE n = 1) AS id, max(cv) FILTER (WHERE n = 1) AS cv, max(final) FILTER (WHERE n = 1) AS final, max(final) FILTER (WHERE n > 1 AND NOT coalesce(family = best, FALSE)) AS next FROM o GROUP BY 1)
SELECT query_id, id, round(cv, 6) AS cv, final, round(final - next, 6) AS gap, cv >= 0.8 AND (next IS NULL OR round(final - next, 6) >= 0.03) AS confident FROM b""")
def fusion_family_gate(t):
    """The best of each question by sight and text, text that doesn't confirm the maker at less weight, with its lead over another family."""
    visual, mass = fused_scores(t)
    ids = visual.select("query_id", "id").unionByName(mass.select("query_id", "id")).distinct()
    makers = ids.withColumn("recall", (F.col("id") * 7 + F.col("query_id")) % 10 / 10.0)
    fused = retrieval.fuse_scores(visual, mass, makers=makers, unconfirmed=0.6).withColumn("final", F.round("final", 6))
    families = ids.select("id").distinct().filter("id % 3 <> 0").withColumn("family", F.col("id") % 2)
    best = retrieval.confident(fused, families)
    gap = F.round("gap", 6)
    return best.select("query_id", "id", F.round("cv", 6).alias("cv"), "final", gap.alias("gap"), ((F.col("cv") >= 0.8) & (gap.isNull() | (gap >= 0.03))).alias("confident"))


_LABEL, _READ = "lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' '))", "lower(substr(p_name, 2) || ' ' || p_type || ' ' || p_size)"


@query(f"""WITH c AS (SELECT p_partkey AS id, {_LABEL} AS text FROM part), words AS (SELECT id, unnest(list_distinct(string_split(text, ' '))) AS word FROM c), nd AS (SELECT count(*) AS n FROM c),
i AS (SELECT word, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM words, nd GROUP BY word), med AS (SELECT list(idf ORDER BY idf)[count(*) // 2 + 1] AS m FROM i),
q AS (SELECT p_partkey AS query_id, {_READ} AS a FROM part WHERE p_partkey % 100 = 0),
h AS (SELECT query_id, a, query_id + j AS id, round(1 - j / 50.0::DOUBLE, 6) AS score, j::INT AS rank FROM q, range(1, 13) r(j) WHERE query_id + j IN (SELECT id FROM c)),
p AS (SELECT query_id, h.id, a, c.text AS b FROM h JOIN c USING (id) WHERE rank <= 10 AND EXISTS (SELECT 1 FROM i, med WHERE idf >= m AND list_contains(string_split(h.a, ' '), word))),
{_likeness_sql("SELECT * FROM p")},
g AS (SELECT query_id, id, (SELECT sum(CASE WHEN list_contains(string_split(a, ' '), word) THEN idf ELSE 0 END) / sum(idf) FROM words JOIN i USING (word) WHERE words.id = scored.id) AS share, score_1 FROM (SELECT query_id, id, a, 100 * CASE WHEN n > 0 AND len(c) IN (len(s), len(t)) THEN 1 WHEN n > 0 THEN greatest(whole, 2.0::DOUBLE * n / (n + least(length(x), length(y)))) ELSE whole END AS score_1 FROM scored) scored),
f AS (SELECT h.query_id, h.id, h.score, rank AS was, CASE WHEN rank <= 10 THEN round(h.score + 0.5::DOUBLE * coalesce(share + 0.35::DOUBLE * score_1 / 100, 0), 6) ELSE h.score END AS final FROM h LEFT JOIN g USING (query_id, id))
SELECT query_id, id, score, final, row_number() OVER (PARTITION BY query_id ORDER BY was > 10, CASE WHEN was <= 10 THEN -final END, was)::INT AS rank FROM f""")
def text_rerank(t):
    """The first ten of twelve candidates of each hundredth part, ordered anew by what was read of its label."""
    p = t("part")
    cards = p.select(F.col("p_partkey").alias("id"), F.expr(_LABEL).alias("text"))
    asked = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.expr(_READ).alias("text"))
    near = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank")).withColumn("id", F.col("query_id") + F.col("rank"))
    hits = near.join(cards.select("id"), "id", "left_semi").withColumn("score", F.round(1 - F.col("rank") / 50.0, 6))
    words = cards.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    n = cards.count()
    idf = words.groupBy("word").agg((F.log((n + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    found = retrieval.rerank_by_text(hits, asked, cards, idf, 10, 0.5, retrieval.distinctive_idf(idf))
    return found.withColumn("final", F.round("final", 6))


# ---- reports


@query("""WITH r AS (SELECT CASE p_size % 4 WHEN 0 THEN 'unique' WHEN 1 THEN 'missing' ELSE 'batch' END AS status, CASE WHEN p_size % 4 <> 1 THEN p_name END AS image, CASE WHEN p_size > 10 THEN p_size END AS year, p_retailprice FROM part),
n AS (SELECT count(*) AS n FROM r), c AS (SELECT * FROM r WHERE image IS NOT NULL), y AS (SELECT list(p_retailprice ORDER BY p_retailprice) AS v, count(*) AS k FROM c),
q AS (SELECT unnest([0, 0.05, 0.5, 0.95, 1]) AS p), z AS (SELECT p, v, (k - 1) * p::DOUBLE AS pos FROM q, y)
SELECT 'status' AS section, status AS name, count(*)::DOUBLE AS value, round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM r, n GROUP BY status
UNION ALL SELECT 'filled', 'year', count(year), round(count(year) / any_value(n)::DOUBLE, 6) FROM r, n
UNION ALL SELECT 'images', 'with', count(image), round(count(image) / any_value(n)::DOUBLE, 6) FROM r, n UNION ALL SELECT 'images', 'different', count(DISTINCT image), NULL FROM r
UNION ALL SELECT 'p_retailprice', CASE p WHEN 0 THEN 'p0' WHEN 0.05 THEN 'p5' WHEN 0.5 THEN 'p50' WHEN 0.95 THEN 'p95' ELSE 'p100' END, round(v[floor(pos)::INT + 1] + (v[ceil(pos)::INT + 1] - v[floor(pos)::INT + 1]) * (pos - floor(pos)), 6), NULL FROM z""")
def catalog_report(t):
    """Statuses, filled fields, images and percentiles of a catalog in one table."""
    status = F.when(F.col("p_size") % 4 == 0, "unique").when(F.col("p_size") % 4 == 1, "missing").otherwise("batch")
    rows = t("part").select(status.alias("status"), F.when(F.col("p_size") % 4 != 1, F.col("p_name")).alias("image"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("year"), "p_retailprice")
    found = aggregates.report(rows, "status", "image", ["year"], ["p_retailprice"])
    return found.select("section", "name", F.round("value", 6).alias("value"), F.round("share", 6).alias("share"))


@query("""SELECT source, count(fell) AS total, count(*) FILTER (WHERE fell) AS flagged, coalesce(round(count(*) FILTER (WHERE fell) / nullif(count(fell), 0)::DOUBLE, 4), 0) AS rate, count(*) - count(fell) AS unreadable
FROM (SELECT source, CASE WHEN n_chars > 100 THEN text LIKE '%@%' END AS fell FROM documents) GROUP BY source""")
def fallback_rates(t):
    """How many documents of a source fall back (have an @), and how many can't be told (are short)."""
    fell = F.when(F.col("n_chars") > 100, F.contains("text", F.lit("@")))
    return aggregates.flag_rate(t("documents").select("source", fell.alias("fell")), ["source"], "fell")


@query("""SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('a:' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE >= 0.5 AND (doc_id % 3 = 0 OR ('0x' || substr(sha256('b:' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE >= 0.5)""")
def unseen_by_both(t):
    """Documents that neither of two models saw: not in the first one's half, nor in the second's, which was trained on two thirds of the table only."""
    ids = t("documents").select("doc_id")
    return sampling.unseen(ids, "doc_id", [("a", F.lit(True)), ("b", F.col("doc_id") % 3 != 0)])
