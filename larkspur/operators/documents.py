"""Pages to typed documents, layer by layer, and broken records of models made good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extraction as X

# Texts shorter than these are no paragraphs of a maker's or an article's page.
MAKER_PARAGRAPH, ARTICLE_PARAGRAPH = 140, 120


def block_texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: b["text"])


def texts_of(blocks: Column, tags: list[str]) -> Column:
    """Texts of blocks of some tags, in order."""
    return F.transform(F.filter(blocks, lambda b: b["tag"].isin(*tags)), lambda b: b["text"])


def paragraphs(blocks: Column, longer: int) -> Column:
    """Distinct paragraphs longer than ``longer`` characters, in order, parted by empty lines; null if there are none."""
    found = F.array_distinct(F.filter(texts_of(blocks, ["p"]), lambda p: F.length(p) > longer))
    return F.nullif(F.array_join(found, "\n\n"), F.lit(""))


def headings(blocks: Column, tail_markers: list[str]) -> Column:
    """Distinct headings (h2, h3) in order, up to the first that begins a page's tail."""
    found = texts_of(blocks, ["h2", "h3"])
    tail = F.array_min(F.filter(F.transform(found, lambda h, i: F.when(h.isin(*tail_markers), i)), lambda i: i.isNotNull()))
    return F.array_distinct(F.slice(found, F.lit(1), F.coalesce(tail, F.size(found))))


def area(text: Column) -> Column:
    """Hectares of a text like ``1 250,5 га``."""
    said = F.regexp_extract(text, r"([\d  ]+(?:[.,]\d+)?)\s*(?:га|ha)", 1)
    return F.replace(F.regexp_replace(said, r"[\s ]", ""), F.lit(","), F.lit(".")).try_cast("double")


def founded(text: Column) -> Column:
    """The year in which something was founded, by the words before it."""
    return F.nullif(F.regexp_extract(text, r"(?iuU)(?:основан\w*|создан\w*|founded)\D{0,40}(1[89]\d\d|20[0-4]\d)", 1), F.lit("")).cast("int")


def _parsed(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``pages`` (id, html) with their blocks."""
    walked = X.blocks(pages, id_col, html_col).select(F.col("id").alias("_id"), "ok", "blocks")
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(walked, F.col("id") == F.col("_id")).drop("_id")


def makers(pages: DataFrame, id_col: str, html_col: str, labels: dict[str, list[str]]) -> DataFrame:
    """(id, name, name_from, region_name, locality, climate, area, about, founded, neighbours) of makers' pages; values stand after their ``labels``.

    The name comes from the page's meta data, else from its first heading.
    """
    p = _parsed(pages, id_col, html_col).withColumn("texts", block_texts(F.col("blocks")))
    first = F.try_element_at(texts_of(F.col("blocks"), ["h1"]), F.lit(1))
    name = X.layered({"meta": {"name": X.meta(F.col("html"), "og:title")}, "dom": {"name": first}}, ["name"])
    value = lambda field, longest=400: X.value_after(F.col("texts"), labels[field], longest)
    about = paragraphs(F.col("blocks"), MAKER_PARAGRAPH)
    near = X.links(F.col("html"), "wineries", F.col("id"))
    return p.select(
        "id", *name, value("region", 60).alias("region_name"), value("locality").alias("locality"), value("climate").alias("climate"),
        area(value("area", 40)).alias("area"), about.alias("about"), founded(about).alias("founded"), near.alias("neighbours"),
    )


def articles(pages: DataFrame, id_col: str, html_col: str, tail_markers: list[str]) -> DataFrame:
    """(id, title, title_from, lead, body, body_from, author, published_at, date, year, headings) of articles: linked data, then meta data, then the page itself."""
    p = _parsed(pages, id_col, html_col).withColumn("ld", X.json_ld(F.col("html"), ["Article", "NewsArticle", "BlogPosting"]))
    said = lambda path: F.try_variant_get("ld", path, "string")
    first = F.try_element_at(texts_of(F.col("blocks"), ["h1"]), F.lit(1))
    layers = {
        "jsonld": {"title": said("$.headline"), "lead": said("$.description"), "body": said("$.articleBody")},
        "meta": {"title": X.meta(F.col("html"), "og:title"), "lead": F.coalesce(X.meta(F.col("html"), "og:description"), X.meta(F.col("html"), "description"))},
        "dom": {"title": first, "body": paragraphs(F.col("blocks"), ARTICLE_PARAGRAPH)},
    }
    date = F.nullif(F.regexp_extract(said("$.datePublished"), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    # an author is a text or has a name
    author = F.coalesce(said("$.author.name"), F.when(~F.startswith(said("$.author"), F.lit("{")), said("$.author")))
    return p.select(
        "id", *X.layered(layers, ["title", "lead", "body"]), F.trim(author).alias("author"), said("$.datePublished").alias("published_at"),
        date.alias("date"), F.substring(date, 1, 4).cast("int").alias("year"), headings(F.col("blocks"), tail_markers).alias("headings"),
    ).drop("lead_from")


def items(pages: DataFrame, id_col: str, html_col: str, suffix: str, labels: dict[str, list[str]]) -> DataFrame:
    """(id, name, fields, similar) of items' pages: the name without a suffix of the site, values by label, linked items without the page's own."""
    p = _parsed(pages, id_col, html_col).withColumn("texts", block_texts(F.col("blocks")))
    first = F.try_element_at(texts_of(F.col("blocks"), ["h1"]), F.lit(1))
    name = F.trim(F.regexp_replace(F.coalesce(X.meta(F.col("html"), "og:title"), first), suffix, ""))
    fields = F.struct(*[X.value_after(F.col("texts"), words).alias(field) for field, words in labels.items()])
    similar = X.links(F.col("html"), "wines", F.col("id"))
    return p.select("id", F.nullif(name, F.lit("")).alias("name"), fields.alias("fields"), similar.alias("similar"))


def salvaged(raw: Column) -> Column:
    """(winery, name, year, color, sweetness, sparkling, grapes, text) of a model's answer: a JSON object, whole or cut off.

    A value is what stands after its name in quotes, closed or not; a year must lie from 1950 to 2049; ``null`` and ``none`` are nothing. An
    answer without an object is all text.
    """
    key = lambda name: rf'"{name}"\s*:\s*'
    text = lambda name: F.nullif(F.trim(F.regexp_extract(raw, key(name) + r'"((?:[^"\\]|\\.)*)', 1)), F.lit(""))
    real = lambda name: F.when(~F.lower(text(name)).isin("null", "none"), text(name))
    year = F.regexp_extract(raw, key("year") + r'"?(\d{1,9})', 1).try_cast("int")
    flag = F.regexp_extract(raw, key("sparkling") + "(true|false)", 1)
    listed = F.regexp_extract(raw, key("grapes") + r"\[([^\]]*)", 1)
    grapes = F.filter(F.regexp_extract_all(listed, F.lit('"([^"]+)"'), F.lit(1)), lambda g: F.trim(g) != "")
    whole = F.when(~F.contains(raw, F.lit("{")), F.substring(F.trim(raw), 1, 300))
    return F.struct(
        real("winery").alias("winery"), real("name").alias("name"), F.when(year.between(1950, 2049), year).alias("year"), real("color").alias("color"),
        real("sweetness").alias("sweetness"), F.when(flag != "", flag == "true").alias("sparkling"), grapes.alias("grapes"), F.coalesce(whole, real("text")).alias("text"),
    )


def public(kind: Column, payload: dict[str, Column]) -> Column:
    """What is shown of an item, by its kind: a wine's source and derived fields, a chunk's place, a maker's source; all of any other."""
    shown = {"wine": ["source", "derived"], "chunk": ["article_id", "title", "heading", "rubric"], "winery": ["source"]}
    fields = []
    for name, column in payload.items():
        kinds = [k for k, names in shown.items() if name in names]
        fields.append(F.when(kind.isin(*kinds) | ~kind.isin(*shown), column).alias(name))
    return F.struct(*fields)
