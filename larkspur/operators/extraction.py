"""Semi-structured pages to typed rows. Regular parts are built-in expressions; only the block walk parses in Python."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The tags whose text makes a block.
BLOCK_TAGS = ("div", "span", "p", "li", "td", "dt", "dd", "h1", "h2", "h3", "h4")
#: Tags that end an open one of the same set when they begin.
SIBLINGS = ({"p"}, {"li"}, {"dt", "dd"}, {"td"})
CHUNK = 2000


class _Blocks(HTMLParser):
    """Texts of block tags in the order in which the tags begin, white space squeezed; a block's text has that of the blocks in it.

    A block is (tag, text, leaf): a leaf holds no other block with text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.spans: list[list] = []  # tag, first piece, end, number of the block
        self.open: list[list] = []
        self.silent = 0

    def shut(self, depth: int) -> None:
        for span in self.open[depth:]:
            span[2] = len(self.pieces)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in BLOCK_TAGS:
            for group in SIBLINGS:
                if self.open and self.open[-1][0] in group and (tag in group or (group == {"p"} and tag not in ("span",))):
                    self.shut(len(self.open) - 1)
            span = [tag, len(self.pieces), None]
            self.spans.append(span)
            self.open.append(span)
        elif tag == "br":
            self.pieces.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCK_TAGS:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] == tag:
                    self.shut(depth)
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append(data)

    def blocks(self) -> list[tuple[str, str, bool]]:
        self.shut(0)
        texts = [" ".join("".join(self.pieces[a:b]).split()) for _, a, b in self.spans]
        out = []
        for i, (tag, _, end) in enumerate(self.spans):
            # what begins after it and before its end is in it; those come next
            inner = i + 1
            while inner < len(self.spans) and not texts[inner]:
                inner += 1
            if texts[i]:
                out.append((tag, texts[i], inner == len(self.spans) or self.spans[inner][1] >= end))
        return out


def parse_blocks(html: str | None) -> list[tuple[str, str, bool]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.blocks()


def blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, ok, error, blocks): the block texts of each page as (tag, text, leaf); a page that fails keeps its row and says why."""
    item = pa.struct([("tag", pa.string()), ("text", pa.string()), ("leaf", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, error, out = [], [], []
            for html in batch.column(1):
                try:
                    out.append([{"tag": a, "text": b, "leaf": c} for a, b, c in parse_blocks(html.as_py())])
                    ok.append(True)
                    error.append(None)
                except (ValueError, AssertionError) as e:
                    out.append([])
                    ok.append(False)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok), pa.array(error, pa.string()), pa.array(out, pa.list_(item))], ["id", "ok", "error", "blocks"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ok boolean, error string, blocks array<struct<tag: string, text: string, leaf: boolean>>")


def value_after(texts: Column, labels: list[str], longest: int = 400, look: int = 4) -> Column:
    """The first text that is no label itself among the ``look`` after a label (with or without a colon); null if too long.

    Where only labels follow a label, the next place where one stands is tried.
    """
    is_label = lambda t: t.isin(*labels) | F.rtrim(t, F.lit(":")).isin(*labels)
    after = lambda i: F.try_element_at(F.filter(F.slice(texts, i + 2, F.lit(look)), lambda t: ~is_label(t)), F.lit(1))
    values = F.filter(F.transform(texts, lambda t, i: F.when(is_label(t), after(i))), lambda v: v.isNotNull())
    found = F.try_element_at(values, F.lit(1))
    return F.when(F.length(found) <= longest, found)


_META = r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag's text, in either quotes or none, its basic entities resolved; empty if it isn't there."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])  # one of them at most
    for entity, sign in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(sign))
    return value


def meta(html: Column, name: str) -> Column:
    """The content of the first meta tag with that property, else of the first with that name; attributes in any order."""
    tags = F.regexp_extract_all(html, F.lit(_META), F.lit(0))
    content = lambda attr: attribute(F.try_element_at(F.filter(tags, lambda t: attribute(t, attr) == name), F.lit(1)), "content")
    return F.coalesce(*[F.nullif(stripped(content(attr)), F.lit("")) for attr in ("property", "name")])


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def json_ld(html: Column, types: list[str]) -> Column:
    """The first JSON-LD object of one of the types, as variant, single or in a list; broken blocks are passed over."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.transform(found, lambda j: F.try_parse_json(j))
    each = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    kind = lambda v: F.try_variant_get(v, "$['@type']", "string")
    return F.try_element_at(F.filter(each, lambda v: kind(v).isin(*types)), F.lit(1))


# Keys that tell an object of a page's pushed data.
PUSHED = ("wine", "attributes", "grapeSorts", "gastronomy")
_PUSH = re.compile(r'self\.__next_f\.push\(\[1,\s*"((?:[^"\\]|\\.)*)"\]\)', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)


def pushed_objects(html: str | None, keys: tuple[str, ...] = PUSHED) -> list[str]:
    """The texts of the JSON objects in a page's pushed data that have one of the keys themselves, in the order in which they end.

    Pushes are parts of one text. Braces are matched by a scan that passes over strings with their escapes, so braces in
    values don't count. What isn't JSON is passed over.
    """
    joined = "".join(_PUSH.findall(html or ""))
    try:
        joined = json.loads(f'"{joined}"', strict=False)
    except json.JSONDecodeError:
        return []
    found, open_ = [], []
    for token in _TOKEN.finditer(joined):
        if token[0] == "{":
            open_.append([token.start(), False])
        elif token[0] == "}":
            if open_:
                start, wanted = open_.pop()
                if wanted and _is_json(joined[start : token.end()]):
                    found.append(joined[start : token.end()])
        elif open_ and token[0][1:-1] in keys and joined[token.end() :].lstrip().startswith(":"):
            open_[-1][1] = True
    return found


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except json.JSONDecodeError:
        return False
    return True


@F.pandas_udf(ArrayType(StringType()))
def push_payloads(html: pd.Series) -> pd.Series:
    """The objects of pushed data in each page, as JSON texts."""
    return html.map(pushed_objects)


def pushed_fields(payloads: Column) -> Column:
    """(name, description, abv, rating, vintage, grapes, food) of payloads: of each the first filled value, in an object's ``attributes`` or itself."""
    held = F.transform(payloads, lambda p: F.try_parse_json(p))
    inner = F.transform(held, lambda v: F.when(F.startswith(F.try_variant_get(v, "$.attributes", "string"), F.lit("{")), F.try_variant_get(v, "$.attributes", "variant")).otherwise(v))
    first = lambda values: F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))
    of = lambda *names: first(F.transform(inner, lambda v: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])))

    def listed(*names: str) -> Column:
        each = lambda v, n: F.transform(F.try_variant_get(v, f"$.{n}", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.when(~F.startswith(F.try_variant_get(x, "$", "string"), F.lit("{")), F.try_variant_get(x, "$", "string"))))
        return F.filter(first(F.transform(inner, lambda v: F.coalesce(*[each(v, n) for n in names]))), lambda x: F.coalesce(x != "", F.lit(False)))

    return F.struct(
        of("name", "title").alias("name"), of("description", "text", "content").alias("description"), of("alcohol", "strength", "abv").alias("abv"),
        of("rating", "publicRating").alias("rating"), of("year", "vintage").alias("vintage"), listed("grapeSorts", "grapes", "sorts").alias("grapes"),
        listed("gastronomy", "foodPairings", "dishes").alias("food"),
    )


def targets(html: Column, prefix: str = "/", exclude: tuple[str, ...] = ()) -> Column:
    """Distinct link targets under a prefix, in order of first appearance, without the excluded ones."""
    found = F.regexp_extract_all(html, F.lit(rf'(?i)href="{prefix}([^"/?#]+)'), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(e) for e in exclude]).cast("array<string>"))


def links(html: Column, entity: Column | str, exclude: Column | str | None = None) -> Column:
    """Distinct slugs of links to an entity (``/entity/slug`` wherever it stands), in order of first appearance.

    Left out are the page's own one (``exclude``), and ``map`` and ``page``, which are no entities.
    """
    column = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    found = F.regexp_extract_all(html, F.concat(F.lit("/"), column(entity), F.lit(r"/([a-z0-9_\-]+)")), F.lit(1))
    no = F.array_compact(F.array(F.lit("map"), F.lit("page"), column(exclude).cast("string")))
    return F.array_except(F.array_distinct(found), no)


def layered(layers: dict[str, dict[str, Column]], fields: list[str]) -> list[Column]:
    """Per field the first filled value of the layers in order, and ``<field>_from``, the layer that gave it."""
    out = []
    for field in fields:
        filled = [(name, F.nullif(F.trim(cols[field]), F.lit(""))) for name, cols in layers.items() if field in cols]
        source = None
        for name, value in filled:
            source = F.when(value.isNotNull(), name) if source is None else source.when(value.isNotNull(), name)
        out += [F.coalesce(*[v for _, v in filled]).alias(field), source.alias(f"{field}_from")]
    return out


def number(text: Column) -> Column:
    """The first number of a text, decimal comma or point."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def range_of(text: Column) -> Column:
    """[low, high] of the first two whole numbers, or null."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(found) >= 2, F.transform(F.slice(found, 1, 2), lambda x: x.cast("int")))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _packed(parts: Column, longest: int) -> Column:
    """Paragraphs put together in order, parted by empty lines, as long as the text stays within ``longest``."""

    def add(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 2 + F.length(p) <= longest)
        joined = F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.concat(last, F.lit("\n\n"), p))
        return F.when(fits, joined).otherwise(F.array_append(done, p))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def chunk_paragraphs(docs: DataFrame, id_col: str, text_col: str, longest: int = CHUNK, split: str = "\n") -> DataFrame:
    """(chunk_id, id, chunk, text): paragraphs packed in order into chunks of at most ``longest`` characters.

    A longer paragraph is a chunk of its own, whole. A fold over the paragraphs of each text, without a shuffle.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), split), lambda p: F.trim(p)), lambda p: p != "")
    out = docs.select(F.col(id_col).alias("id"), F.posexplode(_packed(parts, longest)).alias("chunk", "text"))
    return out.select(F.concat_ws("#", "id", "chunk").alias("chunk_id"), "id", "chunk", "text")


def chunk_sections(docs: DataFrame, id_col: str, body: Column, headings: Column, longest: int = CHUNK) -> DataFrame:
    """(chunk_id, id, chunk, heading, text): bodies cut where their headings first stand, long parts packed by paragraphs.

    What stands before the first heading is a chunk without one. Headings that the body doesn't hold are passed over; of two at
    one place the later by name gets the text. Parts longer than ``longest`` are cut at empty lines and packed; a longer
    paragraph stays whole. Empty bodies give nothing. All within the row: no shuffle, however many headings.
    """
    held = docs.select(F.col(id_col).alias("id"), body.alias("body"), F.coalesce(headings, F.array().cast("array<string>")).alias("hs"))
    held = held.filter("body <> ''")
    place = F.transform("hs", lambda h: F.struct((F.position(h, F.col("body")) - 1).alias("at"), h.alias("heading")))
    held = held.withColumn("found", F.array_sort(F.filter(place, lambda p: p["at"] >= 0)))
    chunk = lambda heading, text: F.struct(heading.cast("string").alias("heading"), text.alias("text"))
    size, whole = F.length("body"), F.array(chunk(F.lit(None), F.col("body")))
    lead = chunk(F.lit(None), stripped(F.substring("body", F.lit(1), F.try_element_at("found", F.lit(1))["at"])))
    stop = lambda i: F.coalesce(F.try_element_at("found", i + 2)["at"], size)
    parts = F.transform("found", lambda p, i: chunk(p["heading"], stripped(F.substring("body", p["at"] + 1, stop(i) - p["at"]))))
    cut = F.filter(F.array_insert(parts, 1, lead), lambda c: c["text"] != "")
    held = held.select("id", F.when(F.size("found") == 0, whole).otherwise(cut).alias("chunks"))

    def split(c: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(c["text"], r"\n{2,}"), stripped), lambda p: p != "")
        packed = F.transform(_packed(paragraphs, longest), lambda text: chunk(c["heading"], text))
        return F.when((F.length(c["text"]) <= longest) | (F.size(packed) == 0), F.array(c)).otherwise(packed)

    out = held.select("id", F.posexplode(F.flatten(F.transform("chunks", split))).alias("chunk", "c"))
    return out.select(F.concat_ws("#", "id", "chunk").alias("chunk_id"), "id", "chunk", "c.heading", "c.text")


def sections(texts: DataFrame, id_col: str, block_col: str) -> DataFrame:
    """(id, section, heading, text) of blocks (tag, text, leaf): a section begins at each heading, the lead one has none.

    Text comes from leaves only, so none comes twice.
    """
    leaves = F.filter(F.col(block_col), lambda b: b["leaf"] | b["tag"].rlike("^h[1-4]$"))
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(leaves).alias("pos", "b")).select("id", "pos", "b.tag", "b.text")
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("tag").rlike("^h[1-4]$")
    rows = rows.withColumn("section", F.sum(is_heading.cast("int")).over(w))
    pieces = F.sort_array(F.collect_list(F.when(~is_heading, F.struct("pos", "text"))))
    heading = F.max(F.when(is_heading, F.col("text")))
    return rows.groupBy("id", "section").agg(heading.alias("heading"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n\n").alias("text"))
