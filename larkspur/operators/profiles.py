"""Profiles of items from what is known of them, questionnaires, negated wishes, shelf order, and records of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .joins import skewed


def averaged_profile(rows: DataFrame, id_col: str, names: str, profiles: DataFrame, axes: list[str], digits: int = 3) -> DataFrame:
    """(id, axes): per axis the mean of the profiles (name, axes) of an item's names, null where none of them says it."""
    named = rows.select(F.col(id_col).alias("id"), F.explode_outer(names).alias("name"))
    met = named.join(profiles, "name", "left")
    return met.groupBy("id").agg(*[F.round(F.avg(a), digits).alias(a) for a in axes])


def usable(axes: list[Column]) -> Column:
    """Whether every axis is a number: a vector with a hole is none."""
    out = F.lit(True)
    for a in axes:
        out = out & a.isNotNull() & ~F.isnan(a)
    return out


def basis(bases: list[tuple[str, Column]], default: str = "unavailable") -> Column:
    """The first basis whose condition holds."""
    out = None
    for name, condition in bases:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default))


# Sweetness by words, the first that is there; words of sparkling wines; strength where none is given; axes by color, still and sparkling.
SWEETNESS_WORDS = {
    "полусладк": 0.55, "сладк": 0.85, "десертн": 0.85, "ликёрн": 0.85, "ликерн": 0.85, "полусух": 0.35, "брют": 0.05, "brut": 0.05, "сух": 0.10, "dry": 0.10,
}
SPARKLING_WORDS = (
    "игрист", "шампан", "champagne", "просекко", "prosecco", "асти", "asti", "креман", "cremant", "пет-нат", "pet-nat", "petnat", "cava", "кава",
)
STRENGTH = 12.5
AXES = ("sweetness", "acidity", "tannin", "body", "oak", "aromatic_intensity", "bubbles")
BY_COLOR = {
    ("белое", True): (0.20, 0.69, 0.05, 0.58, 0.17, 0.69, 0.00), ("белое", False): (0.29, 0.71, 0.05, 0.49, 0.08, 0.68, 0.73),
    ("красное", True): (0.15, 0.63, 0.62, 0.72, 0.38, 0.75, 0.00), ("красное", False): (0.27, 0.60, 0.38, 0.55, 0.15, 0.75, 0.67),
    ("розовое", True): (0.13, 0.62, 0.17, 0.51, 0.06, 0.60, 0.00), ("розовое", False): (0.20, 0.72, 0.17, 0.49, 0.08, 0.65, 0.78),
    ("оранжевое", True): (0.05, 0.69, 0.42, 0.64, 0.18, 0.68, 0.00), ("оранжевое", False): (0.05, 0.69, 0.42, 0.64, 0.18, 0.68, 0.60),
}


def keyword_sweetness(text: Column) -> Column:
    """The sweetness (0 to 1) of the first of the words that a text has in it, null if none."""
    out = F.lit(None).cast("double")
    for word, value in reversed(SWEETNESS_WORDS.items()):
        out = F.when(F.contains(F.lower(text), F.lit(word)), value).otherwise(out)
    return out


def keyword_sparkling(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(SPARKLING_WORDS)), F.lit(False))


def heuristic_profile(color: Column, name: Column, description: Column, abv: Column) -> Column:
    """The axes by color and by the words of name and description, with ``abv_percent``; null without one of the known colors."""
    text = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))
    known = F.lower(F.trim(color))
    rows = [(F.lit(f"{c}:{still}"), F.array(*[F.lit(float(v)) for v in values])) for (c, still), values in BY_COLOR.items()]
    table = F.create_map(*[x for row in rows for x in row])
    axes = F.try_element_at(table, F.concat_ws(":", known, F.when(keyword_sparkling(text), "False").otherwise("True")))
    first = F.coalesce(keyword_sweetness(text), axes[0]).alias(AXES[0])
    whole = F.struct(first, *[axes[i].alias(a) for i, a in enumerate(AXES) if i], F.coalesce(abv.cast("double"), F.lit(STRENGTH)).alias("abv_percent"))
    return F.when(known.isin(*{c for c, _ in BY_COLOR}), whole)


def vector_of(color: Column, still: Column, table: dict[tuple[str, bool], dict[str, float]], overrides: dict[str, Column]) -> Column:
    """A profile by a table of colors and stillness; an axis that an override knows is the override's."""
    axes = sorted({a for v in table.values() for a in v})
    fields = []
    for axis in axes:
        value = None
        for (c, s), v in table.items():
            hit = (color == c) & (still == F.lit(s))
            value = F.when(hit, v.get(axis)) if value is None else value.when(hit, v.get(axis))
        fields.append(F.coalesce(overrides.get(axis, F.lit(None).cast("double")), value.cast("double")).alias(axis))
    return F.struct(*fields)


# What a wish may exclude, with the words before it, and what the excluded words stand for.
EXCLUDES = r"(?iuU)\b(?:не(?:\s+(?:хочу|люблю|надо))?|без)\s+(красн\w*|бел\w*|розов\w*|сладк\w*|полусладк\w*|сух\w*)"


def without_negatives(wish: Column, pattern: str = EXCLUDES) -> Column:
    """(wish, unwanted): the words that a wish excludes, in lower case, and the wish without them and what stands before them."""
    found = F.regexp_extract_all(F.coalesce(wish, F.lit("")), F.lit(pattern), F.lit(1))
    return F.struct(F.regexp_replace(F.coalesce(wish, F.lit("")), pattern, "").alias("wish"), F.transform(found, F.lower).alias("unwanted"))


def excluded(fields: list[Column], unwanted: Column) -> Column:
    """Whether any field has one of the unwanted words in it, by its first four letters; for wishes in free words, without filters."""
    joined = F.lower(F.concat_ws(" ", *fields))
    return F.exists(unwanted, lambda w: F.contains(joined, F.substring(w, 1, 4)))


def chosen_by(wish: Column, color: Column, sugar: Column, region: Column, regions: dict[str, str]) -> Column:
    """Whether an item is one that a wish asks for: its color, sweetness and region where the wish names them, and none that it excludes.

    What a wish excludes are filters too: an excluded word bars the color or the sweetness that it stands for.
    """
    from . import intents

    parted = without_negatives(F.trim(wish))
    asked = intents.extracted_filters(parted["wish"], regions)
    fits = F.lit(True)
    for name, actual in (("color", color), ("sugar", sugar), ("region", region)):
        fits = fits & (asked[name].isNull() | (F.lower(F.coalesce(actual, F.lit(""))) == F.lower(asked[name])))
    barred = lambda word: intents.extracted_filters(word, {})
    off = lambda w: F.coalesce(barred(w)["color"] == F.lower(color), F.lit(False)) | F.coalesce(barred(w)["sugar"] == F.lower(sugar), F.lit(False))
    return fits & ~F.exists(parted["unwanted"], off)


# Grapes of light and of full wines, and what tells of oak, as Latin tokens.
LIGHT_GRAPES = ("pino nuar", "aligote", "rislin", "sovinon blan", "kokur", "gamaj")
FULL_GRAPES = ("kaberne sovinon", "saperavi", "krasnostop", "sira", "shiraz", "malbek")
OAK_TOKENS = ("dub", "dubov", "bochk", "barrik", "vyderzh", "tanin")


def suggest(cards: DataFrame, requests: DataFrame, rules: DataFrame, k: int = 3) -> DataFrame:
    """(request_id, id, score, rank, reasons): the best cards for each request, of different makers; equal scores go by name, then id.

    Cards: id, maker, name, category, sweetness, sparkling, region, grapes and description (both as texts of Latin tokens). Requests:
    request_id, dish, category, sweetness, region, body (``light``, ``full``) and excluded (ids); a filled field of the first three must
    be the card's. Rules (dish, field, value, weight) are weights of a dish for ``category``, ``sweetness``, ``grape``, ``sparkling``: a category
    that has none counts -1, of several grapes the largest counts. A body adds 1 where the grapes or oak bear it out, else takes off
    0.5. Reasons: ``dish``, ``grape``, ``light``, ``full``, ``oak``.

    Requests and rules are few rows and go to the cards; what is shuffled is the best card of each maker for a request, as tasks see it.
    """
    by_value = F.map_from_entries(F.collect_list(F.struct("value", "weight")))
    tables = rules.groupBy("dish").pivot("field", ["category", "sweetness", "grape", "sparkling"]).agg(by_value)
    asked = requests.withColumnsRenamed({c: f"r_{c}" for c in ("category", "sweetness", "region")}).join(tables.withColumnsRenamed({c: f"w_{c}" for c in ("category", "sweetness", "grape", "sparkling")}), "dish", "left")
    one = lambda name: F.col(f"r_{name}").isNull() | F.coalesce(F.col(name) == F.col(f"r_{name}"), F.lit(False))
    met = cards.join(F.broadcast(asked), one("category") & one("sweetness") & one("region") & ~F.coalesce(F.array_contains("excluded", F.col("id")), F.lit(False)))
    weight = lambda table, key, none: F.coalesce(F.try_element_at(F.col(table), key), F.lit(none))
    ruled = F.col("dish").isNotNull()
    category = F.when(ruled, weight("w_category", F.coalesce("category", F.lit("")), -1.0)).otherwise(0.0)
    sweet = weight("w_sweetness", F.coalesce("sweetness", F.lit("")), 0.0)
    text, said = F.coalesce("grapes", F.lit("")), F.split(F.coalesce("description", F.lit("")), " ")
    grape = F.coalesce(F.array_max(F.map_values(F.map_filter(F.col("w_grape"), lambda g, _: F.contains(text, g)))), F.lit(0.0))
    bubbles = F.when(F.coalesce("sparkling", F.lit(False)), weight("w_sparkling", F.lit("true"), 0.0)).otherwise(0.0)
    among = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    whole = F.array_join(said, " ")
    oak = F.exists(F.array(*[F.lit(w) for w in OAK_TOKENS]), lambda w: F.contains(whole, w))
    light, full = among(LIGHT_GRAPES) & ~oak, among(FULL_GRAPES) | oak
    body = F.when(F.col("body") == "light", F.when(light, 1.0).otherwise(-0.5)).when(F.col("body") == "full", F.when(full, 1.0).otherwise(-0.5)).otherwise(0.0)
    reasons = F.array_compact(F.array(
        F.when(ruled & (category > 0) & ((sweet > 0) | (grape > 0)), "dish"), F.when(grape > 0, "grape"), F.when((F.col("body") == "light") & light, "light"),
        F.when((F.col("body") == "full") & full, "full"), F.when((F.col("body") == "full") & full & oak, "oak"),
    ))
    scored = met.select("request_id", "id", "maker", "name", F.round(category + sweet + grape + bubbles + body, 6).alias("score"), reasons.alias("reasons"))
    best = scored.groupBy("request_id", "maker").agg(F.min(F.struct((-F.col("score")).alias("low"), "name", "id", "reasons")).alias("b")).select("request_id", "b.*")
    order = Window.partitionBy("request_id").orderBy("low", "name", "id")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("request_id", "id", F.round(-F.col("low"), 3).alias("score"), "rank", "reasons")


def shelf_order(items: DataFrame, group: str, tagged: Column, ruled: Column, fit: str, relevance: str, id_col: str) -> DataFrame:
    """``items`` with ``tier`` (2: the catalog's own tags, 1: rules, 0: nothing) and ``place``: by tier, fit, relevance, then id."""
    tier = F.when(F.coalesce(tagged, F.lit(False)), 2).when(F.coalesce(ruled, F.lit(False)), 1).otherwise(0)
    w = Window.partitionBy(group).orderBy(F.desc("tier"), F.desc_nulls_last(fit), F.desc_nulls_last(relevance), id_col)
    return items.withColumn("tier", tier).withColumn("place", F.row_number().over(w))


def analogs(items: DataFrame, styles: DataFrame, k: int) -> DataFrame:
    """(slug, id, rank): items (id, styles, color, still, sugar, score) that are of a style (slug, color, still, sugar), whose color, stillness and sweetness
    are the style's where it says them; the best ``k`` by score."""
    own = items.select("*", F.explode(F.array_distinct("styles")).alias("slug")).alias("i")
    s = styles.alias("s")
    agrees = F.lit(True)
    for c in ("color", "still", "sugar"):
        agrees = agrees & (F.col(f"s.{c}").isNull() | F.coalesce(F.col(f"i.{c}") == F.col(f"s.{c}"), F.lit(False)))
    met = own.join(s, F.col("i.slug") == F.col("s.slug")).filter(agrees).select("i.slug", "i.id", "i.score")
    w = Window.partitionBy("slug").orderBy(F.desc_nulls_last("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("slug", "id", "rank")


def phrases_found(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, slug, step): the entry (phrase, slug) that a text (id, text) names: by two words that follow each other, else by one, else by one
    that is an edit away (of five letters at least). Of several the first in the text counts. Each distinct word is looked up once."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    held = texts.select("id", words.alias("w")).filter(F.size("w") > 0)
    singles = F.transform("w", lambda w, i: F.struct(F.lit(1).alias("step"), i.alias("pos"), w.alias("p")))
    doubles = F.filter(
        F.transform("w", lambda w, i: F.struct(F.lit(0).alias("step"), i.alias("pos"), F.concat(w, F.lit(" "), F.try_element_at("w", i + 2)).alias("p"))), lambda s: s["p"].isNotNull()
    )
    asked = held.select("id", F.explode(F.concat(doubles, singles)).alias("a")).select("id", "a.*")
    counts = written(asked.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "words")
    known = written(phrases.select(F.lower("phrase").alias("p"), "slug").dropDuplicates(["p"]), "phrases")
    # an edit leaves one of the halves as it was, at its place from the start or from the end
    half = lambda c: F.array(F.concat(F.lit("a"), F.substring(c, 1, 2)), F.concat(F.lit("z"), F.right(c, F.lit(2))))
    single = (F.length("p") >= 5) & ~F.contains(F.col("p"), F.lit(" "))
    one = counts.filter(single).select("p", F.explode(half(F.col("p"))).alias("k"))
    other = known.filter(single).select(F.col("p").alias("q"), "slug", F.explode(half(F.col("p"))).alias("k"))
    near = one.hint("merge").join(other, "k").filter((F.abs(F.length("p") - F.length("q")) <= 1) & (F.levenshtein("p", "q") == 1)).groupBy("p").agg(F.min("slug").alias("_near"))
    told = counts.hint("merge").join(known.withColumn("_known", F.lit(True)), "p", "left").hint("merge").join(near, "p", "left")
    step = F.when(F.col("_known"), 0).when(F.col("_near").isNotNull(), 2)
    told = told.select("p", "n", F.coalesce("slug", "_near").alias("slug"), step.alias("_least"))
    # words that tell nothing are in the table too, so that frequent ones among them are not shuffled
    met = skewed(asked, written(told, "told"), "p", "n").filter("_least IS NOT NULL").withColumn("step", F.greatest("step", "_least"))
    return met.groupBy("id").agg(F.min(F.struct("step", "pos", "slug")).alias("m")).select("id", "m.slug", "m.step")


def foreign_analogs(texts: DataFrame, references: DataFrame, styles: DataFrame, items: DataFrame, k: int = 12) -> DataFrame:
    """(id, label, slug, item, rank): what stands in for labels of elsewhere: the entry that a text (id, text) names, the style that it is asked for by, that style's items.

    ``references`` (phrase, slug, label, resolve_query), ``styles`` (slug, name, color, still, sugar) and ``items`` as for ``analogs``. Texts that
    name no entry, and entries whose query resolves to no style, give nothing.
    """
    from . import intents

    known = references.withColumn("entry", F.col("slug"))
    found = phrases_found(texts, known.select("phrase", "slug")).select("id", F.col("slug").alias("entry"))
    entries = known.dropDuplicates(["entry"]).select("entry", "label", "resolve_query")
    asked = entries.join(found.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("query_id"), F.col("resolve_query").alias("text"))
    style = intents.resolve_style(asked, styles).select(F.col("query_id").alias("entry"), "slug")  # one an entry, not one a text
    ranked = analogs(items, styles.select("slug", "color", "still", "sugar"), k).select("slug", F.col("id").alias("item"), "rank")
    return found.join(entries.select("entry", "label"), "entry").join(style, "entry").join(ranked, "slug").select("id", "label", "slug", "item", "rank")


# ---- records of users


def alive(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(deleted).isNull())


def exported(parts: dict[str, DataFrame], user: str, ts: str) -> DataFrame:
    """(user, ts, kind, record): all rows of all tables as JSON, to be read in the order of time."""
    rows = [df.select(F.col(user).alias("user"), F.col(ts).alias("ts"), F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("record")) for kind, df in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def upgraded(guests: DataFrame, accounts: DataFrame, key: str, first: str) -> DataFrame:
    """``guests`` with the fields of their accounts (same key) where there are any; of ``first`` the value that was there before stays."""
    names = [c for c in accounts.columns if c != key]
    new = accounts.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in names])
    met = guests.join(new, F.col(key) == F.col("_k"), "left")
    value = lambda c: (F.coalesce(F.col(c), F.col(f"_{c}")) if c == first else F.coalesce(F.col(f"_{c}"), F.col(c))) if c in names else F.col(c)
    return met.select(*[value(c).alias(c) for c in guests.columns], F.col("_k").isNotNull().alias("registered"))


def ordered_values(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): each key's values in an order, nulls left out."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return df.groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias("values"))
