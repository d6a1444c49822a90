"""Queries over raw pages and long texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from .registry import query


@query("""SELECT page_id, list_sort(list_distinct(list_filter(regexp_extract_all(html, 'href="/([^"/?#]+)', 1), lambda x: x NOT IN ('map', 'page')))) AS links FROM pages""")
def html_links(t):
    return t("pages").select("page_id", F.array_sort(X.targets(F.col("html"), "/", ("map", "page"))).alias("links"))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
  sha256(html) AS content_hash, length(html) AS chars FROM pages""")
def html_meta(t):
    lang = F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit(""))
    return t("pages").select("page_id", X.title(F.col("html")).alias("title"), lang.alias("lang"), F.sha2("html", 256).alias("content_hash"), F.length("html").cast("long").alias("chars"))


@query()
def html_blocks(t):
    """Blocks of each page, by tag; a parser walks them, so no SQL."""
    found = X.blocks(t("pages"), "page_id", "html").select("id", F.explode("blocks").alias("b"))
    return found.groupBy(F.col("id").alias("page_id"), F.col("b.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("b.text")).alias("chars"))


@query()
def html_sections(t):
    return X.sections(X.blocks(t("pages"), "page_id", "html"), "id", "blocks").select(F.col("id").alias("page_id"), "section", "heading", F.length("text").alias("chars"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(parts, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[-1]) + 2 + length(x[1]) <= 2000 THEN list_concat(acc[:-2], [acc[-1] || chr(10) || chr(10) || x[1]]) ELSE list_concat(acc, x) END) AS chunks FROM p WHERE len(parts) > 0),
i AS (SELECT doc_id, chunks, unnest(range(len(chunks))) AS i FROM f) SELECT doc_id || '#' || i AS chunk_id, doc_id AS id, i::INT AS chunk, chunks[i + 1] AS text FROM i""")
def chunk_articles(t):
    return X.chunk_paragraphs(t("documents"), "doc_id", "text")


@query("""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'untitled') AS name,
  CASE WHEN nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') IS NOT NULL THEN 'title' ELSE 'default' END AS name_from FROM pages""")
def layered_fields(t):
    """Fields from the first layer that has them, with the layer's name."""
    layers = {"title": {"name": X.title(F.col("html"))}, "default": {"name": F.lit("untitled")}}
    return t("pages").select("page_id", *X.layered(layers, ["name"]))


# Pages have no linked or meta data of their own; heads made of their titles and urls stand before them, in the forms that sites use.
_HEAD = [
    """<meta property="og:title" content="{t}"><meta name="og:title" content="not this">""",
    """<meta content='{t}' property='og:title' /><meta property="og:title" content="nor the second">""",
    """<META data-x="a > b" name=og:title content="{t}">""",
    """<meta property="og:title" content=" "><meta content="{t}" name='og:title'>""",
]
_LINKED = [
    """<script type="application/ld+json">{"@type": "NewsArticle", "url": "{u}"}</script>""",
    """<script id=x type='application/ld+json'>[{"@type": "Thing"}, {"@type": "Article", "url": "{u}"}, {"@type": "Article", "url": "no"}]</script>""",
    """<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type": "BlogPosting", "url": "{u}"}</script>""",
    """<script type="application/ld+json">{"@type": "Thing", "url": "{u}"}</script>""",
]


def _form(forms: list[str], mark: str, value):
    """A page's form by its id, with ``mark`` replaced by a value."""
    return F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("page_id") % 4 + 1).cast("int")), F.lit(mark), value)


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CASE WHEN page_id % 4 <> 3 THEN url END AS linked,
  CASE WHEN page_id % 4 = 0 THEN 'NewsArticle' WHEN page_id % 4 = 1 THEN 'Article' WHEN page_id % 4 = 2 THEN 'BlogPosting' END AS kind FROM pages""")
def page_heads(t):
    """Titles by meta tags with attributes in any order and either quotes, and linked data single, in lists or after broken ones."""
    said = X.title(F.col("html"))
    for sign, entity in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;")):
        said = F.replace(said, F.lit(sign), F.lit(entity))
    made = t("pages").withColumn("page", F.concat(_form(_HEAD, "{t}", said), _form(_LINKED, "{u}", F.col("url")), "html"))
    ld = X.json_ld(F.col("page"), ["Article", "NewsArticle", "BlogPosting"])
    return made.select("page_id", X.meta(F.col("page"), "og:title").alias("title"), F.try_variant_get(ld, "$.url", "string").alias("linked"), F.try_variant_get(ld, "$['@type']", "string").alias("kind"))


@query(r"""WITH p AS (SELECT p.page_id, p.url, coalesce(n.url, '/es/map') AS next, regexp_extract(p.html, '<html lang="([a-z]+)"', 1) AS lang FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1),
l AS (SELECT page_id, lang, regexp_extract(url, '/([a-z]+)/([a-z0-9_-]+)', ['l', 's']) AS a, regexp_extract(next, '/([a-z]+)/([a-z0-9_-]+)', ['l', 's']) AS b FROM p),
m AS (SELECT page_id, list_distinct(list_filter([CASE WHEN a.l = lang THEN a.s END, CASE WHEN b.l = lang THEN b.s END], lambda s: s IS NOT NULL AND s <> (page_id % 10)::VARCHAR AND s <> 'map')) AS s FROM l)
SELECT page_id, list_sort(s) AS slugs FROM m""")
def entity_links(t):
    """Slugs of a page's language that its own and the next page's url lead to; absolute links, either quotes, the own one left out."""
    own = t("pages").select("page_id", "url", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    after = t("pages").select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    both = own.join(after, "page_id", "left").fillna("/es/map", "next")
    page = F.concat(F.lit("<a href='"), "url", F.lit("'>a</a><a href=\""), "next", F.lit("\">b</a><a href=/"), "lang", F.lit("/page>c</a>"))
    return both.select("page_id", F.array_sort(X.links(page, F.col("lang"), (F.col("page_id") % 10).cast("string"))).alias("slugs"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(html, '(?:<[^>]*>)+', chr(10) || chr(10), 'g') AS body, regexp_extract_all(html, '<(?:h[1-4]|li)[^>]*>(?:<a [^>]*>)?([^<]+)<', 1) AS hs FROM pages),
h AS (SELECT page_id, body, strpos(body, h) - 1 AS pos, h FROM (SELECT page_id, body, unnest(hs) AS h FROM p) WHERE strpos(body, h) > 0),
c AS (SELECT page_id, pos, h, body, lead(pos, 1, length(body)) OVER (PARTITION BY page_id ORDER BY pos, h) AS stop FROM h
  UNION ALL SELECT page_id, -1, NULL, any_value(body), min(pos) FROM h GROUP BY page_id),
s AS (SELECT page_id, pos, h, regexp_replace(substr(body, greatest(pos, 0) + 1, stop - greatest(pos, 0)), '^\s+|\s+$', '', 'g') AS text FROM c
  UNION ALL SELECT page_id, -1, NULL, body FROM p WHERE page_id NOT IN (SELECT page_id FROM h)),
q AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM s WHERE text <> ''),
f AS (SELECT page_id, pos, h, CASE WHEN length(text) <= 2000 OR len(parts) = 0 THEN [text] ELSE list_reduce(list_transform(parts, lambda x: [x]), lambda acc, x:
  CASE WHEN length(acc[-1]) + 2 + length(x[1]) <= 2000 THEN list_concat(acc[:-2], [acc[-1] || chr(10) || chr(10) || x[1]]) ELSE list_concat(acc, x) END) END AS texts FROM q),
u AS (SELECT page_id, pos, h, unnest(texts) AS text, generate_subscripts(texts, 1) AS i FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, h, i) - 1 AS chunk FROM u)
SELECT page_id || '#' || chunk AS chunk_id, page_id AS id, chunk::INT AS chunk, h AS heading, text FROM n""")
def section_chunks(t):
    """Texts of pages cut at their headings and list entries, long parts by paragraphs."""
    body = F.regexp_replace("html", r"(?:<[^>]*>)+", "\n\n")
    headings = F.regexp_extract_all(F.col("html"), F.lit(r"<(?:h[1-4]|li)[^>]*>(?:<a [^>]*>)?([^<]+)<"), F.lit(1))
    return X.chunk_sections(t("pages"), "page_id", body, headings)


@query(r"""SELECT page_id, 'wine' || page_id || ' {' AS name, url AS description, (page_id % 7 + 8)::VARCHAR || '.5' AS abv, CASE WHEN page_id % 3 = 0 THEN (1990 + page_id % 30)::VARCHAR END AS vintage,
  CASE WHEN page_id % 3 = 0 THEN lang ELSE 'a"b,' || lang END AS grapes, page_id % 3 = 2 AS cut FROM (SELECT *, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)""")
def pushed_data(t):
    """Fields of objects pushed into pages: escaped, in several pushes, with braces and quotes in their values, own or under ``attributes``."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    quoted = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.concat(
        F.lit('{"attributes": {"title": "wine'), F.col("page_id").cast("string"), F.lit(' {", "text": "'), F.col("url"), F.lit('", "alcohol": '), (F.col("page_id") % 7 + 8).cast("string"),
        F.lit('.5, "grapes": ['), F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.lit('"a\\"b", ')), F.lit('{"name": "'), lang, F.lit('"}]'),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(', "year": "'), (1990 + F.col("page_id") % 30).cast("string"), F.lit('"'))).otherwise(""), F.lit("}}"),
    )
    escaped = quoted(F.concat(F.lit('1:["$", {"x": "}"}, '), body, F.lit("]")))
    push = lambda text: F.concat(F.lit('<script>self.__next_f.push([1,"'), text, F.lit('"])</script>'))
    cut = F.col("page_id") % 3 == 2
    page = F.concat(F.col("html"), push(F.when(cut, F.substring(escaped, 1, 8)).otherwise(escaped)), F.when(cut, push(F.substring(escaped, F.lit(9), F.length(escaped)))).otherwise(F.lit("")))
    found = t("pages").select("page_id", cut.alias("cut"), X.pushed_fields(X.push_payloads(page)).alias("f"))
    return found.select("page_id", "f.name", "f.description", "f.abv", "f.vintage", F.array_join("f.grapes", ",").alias("grapes"), "cut")
