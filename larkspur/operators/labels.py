"""Text of labels: tokens with look-alike letters, categories, coverage scores, fusion and vetoes; columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import close_token, like_tokens, unlike_tokens, token_similarity
from ..functions.text import transliterate

# Capital, small, digit and Greek look-alikes and the Cyrillic letters they stand for.
CAPITALS = ("ABCEHKMOPTXY", "АВСЕНКМОРТХУ")
SMALL = ("aceopxyui", "асеорхуии")
DIGITS = ("306", "ЗОб")
GREEK = ("ΛΓΠΔΦΑΒΕΗΚΜΟΡΤΥΧ", "ЛГПДФАВЕНКМОРТУХ")
YEAR = r"^(19[5-9]\d|20[0-3]\d)$"
# Words for sweetness in other languages, and what they are read as, in this order.
FOREIGN_SWEETNESS = [
    (r"\b(semi[\s-]?dry|demi[\s-]?sec|halbtrocken)\b", " polusuhoe "), (r"\b(semi[\s-]?sweet|moelleux|halbs[uü]ss|lieblich)\b", " polusladkoe "),
    (r"\bextra[\s-]?brut\b", " ekstra bryut "), (r"\b(dry|sec|trocken|secco)\b", " suhoe "), (r"\b(sweet|dolce|doux)\b", " sladkoe "),
    (r"\bbrut\b", " bryut "),
]
# Sweetness by parts of a slug, else by a photo's name or the item's.
SLUG_SWEETNESS = [
    ("ekstra-bryut", "ekstra bryut"), ("polusuhoe", "polusuhoe"), ("polusladkoe", "polusladkoe"), ("bryut", "bryut"), ("desertn", "desertnoe"),
    ("(^|-)suhoe", "suhoe"), ("(^|-)sladkoe", "sladkoe"),
]
PHOTO_SWEETNESS = [
    (r"(экстра\s?брют|extra\s?brut)", "ekstra bryut"), (r"(п\.\s?сух|п\s сух|полусух|semi[\s-]?dry|semidry)", "polusuhoe"),
    (r"(п\.\s?сл|полусл|semi[\s-]?sweet)", "polusladkoe"), (r"(брют|brut)", "bryut"), (r"(сух|\bdry\b)", "suhoe"), (r"(сладк|\bсл\.)", "sladkoe"),
]
# Words of colors.
COLOR_WORDS = {
    "white": r"\b(бел(ое|ый|ая)|white|blanc)\b", "red": r"\b(красн(ое|ый|ая)|red|rouge)\b", "rose": r"\b(розов(ое|ый|ая)|розе|rose|rosé)\b",
}

_unicode = "(?iuU)"


def homoglyph_variant(token: Column) -> Column:
    """The Cyrillic reading of a token with look-alike letters, or null if it has none.

    Latin letters in a Cyrillic word; words of look-alike capitals only; of look-alike letters with a digit among them; Cyrillic words with
    a digit inside.
    """
    has = lambda letters: token.rlike(letters)
    cyrillic, latin, greek, digit = has("[а-яёА-ЯЁ]"), has("[A-Za-z]"), has(f"[{GREEK[0]}]"), has(f"[{DIGITS[0]}]")
    letters = F.regexp_replace(token, r"\P{L}", "")
    only = lambda kinds: letters.rlike(f"^[{kinds}]+$")
    read = lambda *tables: F.translate(token, "".join(t[0] for t in tables), "".join(t[1] for t in tables))
    foreign = (latin | greek) & ~cyrillic
    return (
        F.when(latin & cyrillic, read(CAPITALS, SMALL)).when(foreign & only(CAPITALS[0] + GREEK[0]), read(CAPITALS, GREEK, DIGITS))
        .when(foreign & only(CAPITALS[0] + SMALL[0]) & digit, read(CAPITALS, SMALL, DIGITS)).when(~latin & cyrillic & digit, read(DIGITS))
    )


def query_tokens(text: Column) -> Column:
    """The distinct tokens of read label text: each with its Cyrillic readings, in Latin letters, of three characters or a year."""
    out = F.coalesce(text, F.lit(""))
    for pattern, word in FOREIGN_SWEETNESS:
        out = F.regexp_replace(out, _unicode + pattern, word)
    raw = F.transform(F.split(out, r"[\s·,;:/|()\"«»]+"), lambda t: F.btrim(t, F.lit(".-'’`")))

    def readings(t: Column) -> Column:
        plain = F.translate(t, *GREEK)
        return F.array(t, homoglyph_variant(t), F.when(plain != t, plain), F.when(plain != t, homoglyph_variant(plain)))

    found = F.filter(F.flatten(F.transform(raw, readings)), lambda t: t.isNotNull() & (t != ""))
    latin = F.flatten(F.transform(found, lambda t: F.regexp_extract_all(transliterate(t, "label"), F.lit("([a-z0-9]+)"), F.lit(1))))
    number = lambda t: t.rlike(r"^\d+$") & ~t.rlike(YEAR)
    return F.array_distinct(F.filter(latin, lambda t: ~number(t) & (F.length(t) >= 3)))


def _ladder(text: Column, steps: list[tuple[str, str]]) -> Column:
    out = None
    for pattern, value in steps:
        hit = text.rlike(_unicode + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def sweetness_of(slug: Column, photos: Column, name: Column) -> Column:
    """Sweetness by the slug, else by the first of the photo names and the name that says it; empty if none does."""
    said = F.transform(F.concat(photos, F.array(name)), lambda x: _ladder(F.coalesce(x, F.lit("")), PHOTO_SWEETNESS))
    first = F.try_element_at(F.filter(said, lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(_ladder(slug, SLUG_SWEETNESS), first, F.lit(""))


def text_color(text: Column) -> Column:
    """The color that a text names, if it is exactly one."""
    found = F.filter(F.array(*[F.when(text.rlike(_unicode + p), c) for c, p in COLOR_WORDS.items()]), lambda c: c.isNotNull())
    return F.when(F.size(found) == 1, found[0])


def coverage(field: Column, seen: Column, stop: list[str], least: float = 0.8) -> Column:
    """The share of a field's significant tokens (no stop words, no numbers) that are on the label, spelled about alike.

    Both are arrays; ``seen`` must hold the label's tokens that are alike (see ``covered``).
    """
    telling = F.filter(F.array_distinct(field), lambda t: ~t.isin(*stop) & ~t.rlike(r"^\d+$"))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(telling, seen)), F.size(telling)), F.lit(0.0))


def covered(cards: DataFrame, tokens: str, label: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, id, found): of each card (query_id, id, tokens) the tokens that a token of its label (query_id, token) is like.

    Each pair of different tokens is compared once, however many cards have it.
    """
    own = cards.select("query_id", "id", F.explode(F.array_distinct(tokens)).alias("t"))
    pairs = own.select("query_id", "t").distinct().join(label, "query_id")
    pairs = pairs.select("t", "token").distinct().filter(token_similarity(F.col("t"), F.col("token")) >= least)
    met = own.join(label, "query_id").join(pairs, ["t", "token"], "left_semi")
    return met.groupBy("query_id", "id").agg(F.collect_set("t").alias("found"))


def card_score(card: dict[str, Column], seen: Column, said: dict[str, Column], stop: list[str]) -> Column:
    """Likeness of a label and a card, about -0.5 to 1.8: name, half of the maker, 0.3 of the grapes, and what year and sweetness say.

    ``card`` has name, winery and grapes as tokens, year and sweetness; ``said`` the label's year and sweetness.
    """
    score = coverage(card["name"], seen, stop) + 0.5 * coverage(card["winery"], seen, stop) + 0.3 * coverage(card["grapes"], seen, stop)
    for field, weight in (("year", 0.3), ("sweetness", 0.2)):
        both = said[field].isNotNull() & card[field].isNotNull()
        score = score + F.when(both, F.when(said[field] == card[field], weight).otherwise(-weight)).otherwise(0.0)
    return score


def fused(visual: Column, bonus: Column, text: Column, local_weight: float = 0.0, text_weight: float = 0.0) -> Column:
    return visual + local_weight * F.coalesce(bonus, F.lit(0.0)) + text_weight * F.coalesce(text, F.lit(0.0))


def vocabulary_matches(queries: DataFrame, vocabulary: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, token, word, likeness): the words (word) of a vocabulary that a query's tokens (query_id, token) are like.

    Words that are alike share one of their pairs of neighbouring letters, or a start of five; equal ones are 1.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    size = F.length("token")
    q = queries.select("token").distinct().withColumn("k", F.explode(grams(F.col("token")))).withColumn("size", F.explode(F.sequence(F.floor(size * 2 / 3), F.ceil(size * 3 / 2))))
    v = vocabulary.select("word").distinct().withColumn("k", F.explode(grams(F.col("word")))).withColumn("size", F.length("word").cast("long"))
    start = queries.select("token").distinct().filter(F.length("token") >= 5).withColumn("s", F.substring("token", 1, 5))
    same = start.join(vocabulary.select("word").distinct().withColumn("s", F.substring("word", 1, 5)), "s").select("token", "word")
    met = q.join(v, ["k", "size"]).select("token", "word").unionByName(same).distinct()
    alike = met.withColumn("likeness", close_token(F.col("token"), F.col("word"))).filter(F.col("likeness") >= least)
    return queries.join(alike, "token").select("query_id", "token", "word", "likeness")


def fuzzy_mass(queries: DataFrame, cards: DataFrame, idf: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, id, mass): for each word (id, word) of a card that a query (query_id, token) has, spelled about alike, likeness times idf (word, idf).

    Of several tokens that are like one word the most alike counts.
    """
    found = vocabulary_matches(queries, idf.select("word"), least)
    best = found.groupBy("query_id", "word").agg(F.max("likeness").alias("likeness"))
    weighed = best.join(idf, "word").select("query_id", "word", (F.col("likeness") * F.col("idf")).alias("w"))
    return weighed.join(cards.select("id", "word").distinct(), "word").groupBy("query_id", "id").agg(F.sum("w").alias("mass"))


# Words that tell nothing of whose or which wine it is.
GENERIC = (
    "вино винное wine wines winery vineyards estate family семейная винодельня усадьба поместье урожай vintage reserve резерв резерва коллекция collection серия "
    "series терруар terroir линия line вторая second авторское красное белое розовое red white rose сухое полусухое сладкое полусладкое dry sweet semi brut брют "
    "игристое sparkling выдержанное"
)


def name_conflicts(read: dict[str, Column], card: dict[str, Column], ocr: Column) -> Column:
    """Whether the label names another item of the same maker, and the text that was read apart bears it out.

    All are arrays of Latin tokens; they are told apart by likeness, from 0.8 on. Numbers and generic words say nothing. Of the card's maker half of
    the tokens at least must be read; the names, without what makers and grapes say, must both be there and have none that is alike; the
    text must have one like the read name's and none like the card's. What isn't read is no conflict.
    """
    none = F.array().cast("array<string>")
    held = lambda side, field: F.coalesce(side[field], none)
    generic = query_tokens(F.lit(GENERIC))
    own = lambda tokens: unlike_tokens(F.filter(F.array_distinct(tokens), lambda t: ~t.rlike("^[0-9]+$")), generic)
    maker, said_maker = own(held(card, "winery")), own(held(read, "winery"))
    context = F.array_distinct(F.concat(held(card, "winery"), held(card, "grapes"), held(read, "winery"), held(read, "grapes")))
    said, known = unlike_tokens(own(held(read, "name")), context), unlike_tokens(own(held(card, "name")), context)
    same = F.coalesce(F.try_divide(F.size(like_tokens(maker, said_maker)), F.size(maker)) >= 0.5, F.lit(False)) & (F.size(said_maker) > 0)
    apart = (F.size(said) > 0) & (F.size(known) > 0) & (F.size(like_tokens(said, known)) == 0)
    text = F.coalesce(ocr, none)
    return same & apart & (F.size(like_tokens(said, text)) > 0) & (F.size(like_tokens(known, text)) == 0)


def distinctive(tokens: Column, idf: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, any): whether a query (query_id, token) has a word of at least that inverse frequency (word, idf)."""
    met = queries.join(idf, queries["token"] == idf["word"], "left")
    return met.groupBy("query_id").agg(F.bool_or(F.coalesce(F.col("idf") >= least, F.lit(False))).alias("any"))


# ---- boxes of an image


def box_weights(boxes: DataFrame, image: str, width: Column, height: Column, least: float = 0.15, cap: float = 0.1, floor: float = 0.1, penalty: float = 0.5) -> DataFrame:
    """``boxes`` (image, box_id, score, x0, y0, x1, y1) that count, with ``weight``: sure, large, near the middle, and no group of others.

    Boxes under ``least`` count where an image has no better ones. A box that holds two or more others of at least half its score is a
    group. The others of a box are met within its image only.
    """
    w = Window.partitionBy(image)
    kept = boxes.withColumn("_any", F.max((F.col("score") >= least).cast("int")).over(w)).filter((F.col("score") >= least) | (F.col("_any") == 0)).drop("_any")
    other = kept.select(F.col(image).alias("_image"), F.col("box_id").alias("_id"), F.col("score").alias("_score"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.greatest(F.lit(0.0), F.least("x1", "_x1") - F.greatest("x0", "_x0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "_y1") - F.greatest("y0", "_y0"))
    area = (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    inside = F.coalesce(F.try_divide(wide * high, area), F.lit(0.0)) >= 0.8
    met = kept.join(other, (F.col(image) == F.col("_image")) & (F.col("box_id") != F.col("_id")) & (F.col("_score") >= 0.5 * F.col("score")) & inside, "left")
    held = met.groupBy(*kept.columns).agg(F.count("_id").alias("_held"))
    share = F.least(F.lit(cap), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (width * height))
    middle = centrality(width)
    factor = F.when(F.col("_held") >= 2, penalty).otherwise(1.0)
    weight = F.col("score") * F.sqrt(share) * (floor + (1 - floor) * middle) * factor
    return held.withColumn("weight", weight).drop("_held")


# What a text box of a label must have (score, middle third of the width, height), where labels are, how boxes hang together, and margins.
SURE, LEFT, RIGHT, LOWEST = 0.5, 0.18, 0.82, 0.008
CENTRE_Y, FAR, LINE_GAP, SIDE_SLACK = 0.58, 1.5, 6.0, 0.1
MARGIN_X, MARGIN_Y, MARGIN = 0.18, 0.15, 0.02
LEAST_WIDTH, LEAST_HEIGHT, GROW_UP = 0.45, 0.32, 0.3


def grown_regions(boxes: DataFrame, image: str, width: Column, height: Column) -> DataFrame:
    """(image, x0, y0, x1, y1): the region of an image's label, grown from one of its text boxes (image, x0, y0, x1, y1, score).

    It starts at a large box near where labels are, and takes in whatever box lies within some line heights above or below and beside
    it, until none is left that does; then come margins and a least size, within the image. Images without a box that counts
    give no row. An image's boxes are put together, so they must be as few as a picture has.
    """
    w, h = width.cast("double"), height.cast("double")
    x = (F.col("x0") + F.col("x1")) / 2
    counts = (F.col("score") >= SURE) & x.between(LEFT * w, RIGHT * w) & (F.col("y1") - F.col("y0") >= LOWEST * h)
    held = boxes.filter(counts).groupBy(image).agg(F.max(w).alias("w"), F.max(h).alias("h"), F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))).alias("bs"))
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    held = held.withColumn("_most", F.array_max(F.transform("bs", area)))
    off = lambda b: F.hypot(((b["x0"] + b["x1"]) / 2 - 0.5 * F.col("w")) / F.col("w"), ((b["y0"] + b["y1"]) / 2 - CENTRE_Y * F.col("h")) / F.col("h"))
    rated = F.transform("bs", lambda b, i: F.struct((area(b) / F.col("_most") - FAR * off(b)).alias("fit"), (-i).alias("i"), b.alias("b")))
    tall = F.array_sort(F.transform("bs", lambda b: b["y1"] - b["y0"]))
    n = F.size("bs")
    held = held.withColumns({"seed": F.array_max(rated)["b"], "_line": (F.element_at(tall, ((n + 1) / 2).cast("int")) + F.element_at(tall, (n / 2).cast("int") + 1)) / 2})

    def grow(r: Column, _: Column) -> Column:
        slack = SIDE_SLACK * F.col("w")
        near = lambda b: (F.greatest(b["y0"] - r["y1"], r["y0"] - b["y1"], F.lit(0.0)) <= LINE_GAP * F.col("_line")) & (F.least(b["x1"], r["x1"] + slack) > F.greatest(b["x0"], r["x0"] - slack))
        met = F.filter("bs", near)
        edge = lambda c, pick, best: pick(r[c], F.coalesce(best(F.transform(met, lambda b: b[c])), r[c])).alias(c)
        return F.struct(edge("x0", F.least, F.array_min), edge("y0", F.least, F.array_min), edge("x1", F.greatest, F.array_max), edge("y1", F.greatest, F.array_max))

    # each step takes in a box at least, if any is left that lies near
    region = F.aggregate(F.sequence(F.lit(1), n), F.col("seed"), grow)
    held = held.select(image, "w", "h", region.alias("r")).select(image, "w", "h", "r.*")
    mx, my = MARGIN_X * (F.col("x1") - F.col("x0")) + MARGIN * F.col("w"), MARGIN_Y * (F.col("y1") - F.col("y0")) + MARGIN * F.col("h")
    held = held.select(image, "w", "h", (F.col("x0") - mx).alias("x0"), (F.col("y0") - my).alias("y0"), (F.col("x1") + mx).alias("x1"), (F.col("y1") + my).alias("y1"))
    wide, more = LEAST_WIDTH * F.col("w"), LEAST_HEIGHT * F.col("h") - (F.col("y1") - F.col("y0"))
    narrow, middle = F.col("x1") - F.col("x0") < wide, (F.col("x0") + F.col("x1")) / 2
    x0, x1 = F.when(narrow, middle - wide / 2).otherwise(F.col("x0")), F.when(narrow, middle + wide / 2).otherwise(F.col("x1"))
    y0, y1 = F.when(more > 0, F.col("y0") - GROW_UP * more).otherwise(F.col("y0")), F.when(more > 0, F.col("y1") + (1 - GROW_UP) * more).otherwise(F.col("y1"))
    zero = F.lit(0.0)
    return held.select(image, F.greatest(zero, x0).alias("x0"), F.greatest(zero, y0).alias("y0"), F.least(F.col("w"), x1).alias("x1"), F.least(F.col("h"), y1).alias("y1"))


def centrality(width: Column) -> Column:
    return 1.0 - F.least(F.lit(1.0), F.abs((F.col("x0") + F.col("x1")) / 2 / width - 0.5) * 2)


def box_features(boxes: DataFrame, image: str, width: Column, height: Column) -> DataFrame:
    """``boxes`` (with weight, top1, margin) and the eleven features of a ranker, some against the best of the image."""
    w = Window.partitionBy(image)
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    best = F.max("weight").over(w)
    best = F.when(best == 0, 1e-9).otherwise(best)
    return boxes.select(
        "*", F.ln(F.greatest(F.col("weight"), F.lit(1e-9)) / best).alias("log_prior"),
        (F.row_number().over(w.orderBy(F.desc("weight"), "box_id")) - 1).alias("place"), (wide * high / (width * height)).alias("area"),
        centrality(width).alias("centrality"), ((F.col("y0") + F.col("y1")) / 2 / height).alias("cy"),
        (high / F.greatest(wide, F.lit(1.0))).alias("aspect"), (wide / width).alias("wide"), (F.col("top1") - F.max("top1").over(w)).alias("top1_gap"),
    )


def choose_box(features: DataFrame, image: str, prior: float = 1.0, top1: float = 0.0, margin: float = 0.0) -> DataFrame:
    """The box of each image with the largest weighted sum, the first of equals."""
    value = prior * F.col("log_prior") + top1 * F.col("top1") + margin * F.col("margin")
    w = Window.partitionBy(image).orderBy(F.desc("value"), "place")
    return features.withColumn("value", value).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def train_box_ranker(features: DataFrame, columns: list[str], label: str, seed: int = 0):
    """Gradient-boosted trees that tell the right box from the others (MLlib); ``score`` is the probability of the right one."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTClassifier(labelCol=label, maxIter=20, maxDepth=3, seed=seed)]).fit(features)
