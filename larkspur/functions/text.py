"""Text keys, tokens and attributes. Patterns match as the catalog's keys were made, so the tables stay apart."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The five transliterations, each whole; keys of different tables must not be mixed.
TABLES = {
    "page": {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
        "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "cz", "ч": "ch", "ш": "sh", "щ": "shh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    },
    "maker": {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
        "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    },
    "upload": {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
        "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "cz", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "є": "ye",
        "і": "i", "ї": "yi", "ґ": "g", "№": "",
    },
    "census": {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
        "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "cz", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    },
    "label": {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
        "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    },
}
# Endings of images, starts of thumbnails' names, accented letters, years and volumes in names.
IMAGE_EXTENSIONS = ("webp", "png", "jpg", "jpeg", "jfif", "heic", "tif", "tiff", "gif", "avif", "bmp")
VARIANT_PREFIXES = ("thumbnail_", "small_", "medium_", "large_")
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")

YEAR = r"(?<!\d)(19[5-9]\d|20[0-4]\d)(?!\d)"
VOLUME = r"(?<![\d.,])(0[.,]\d{1,3}|1[.,]5|3[.,]0)(?:\s*л)?(?![\d.,])"


def transliterate(text: Column, scheme: str) -> Column:
    """Lower-cased text with Cyrillic letters in Latin ones by one of TABLES; other characters stay."""
    table = TABLES[scheme]
    out = F.lower(text)
    for letter, latin in table.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in table.items() if len(v) == 1}
    dropped = "".join(k for k, v in table.items() if not v)
    out = F.translate(out, "".join(single) + dropped, "".join(single.values()))
    return F.translate(out, *ACCENTS) if scheme == "upload" else out


def slug(text: Column, scheme: str, mark: str = "-") -> Column:
    """Runs of anything but a-z and 0-9 become ``mark``, none at the ends."""
    return F.trim(F.regexp_replace(transliterate(F.trim(text), scheme), "[^a-z0-9]+", mark), F.lit(mark))


def slug_or_null(text: Column, scheme: str) -> Column:
    return F.nullif(slug(text, scheme), F.lit(""))


def stem_and_extension(name: Column) -> tuple[Column, Column]:
    """A file name without its image extension, and that in lower case; other endings belong to the name."""
    pattern = r"(?i)^(.+)\.(" + "|".join(IMAGE_EXTENSIONS) + ")$"
    trimmed = F.trim(name)
    extension = F.lower(F.regexp_extract(trimmed, pattern, 2))
    return F.when(extension == "", trimmed).otherwise(F.regexp_extract(trimmed, pattern, 1)), extension


def name_key(stem: Column) -> Column:
    return F.regexp_replace(transliterate(stem, "upload"), "[^0-9a-z]", "")


def photo_key(name: Column) -> Column:
    return name_key(stem_and_extension(name)[0])


def separator_key(stem: Column) -> Column:
    return slug(stem, "upload", "_")


def census_key(text: Column) -> Column:
    return slug(text, "census", "_")


def without_hashes(stem: Column) -> Column:
    """A stem without the chain of ten-digit hash suffixes that repeated uploads leave."""
    return F.regexp_replace(stem, "(_[0-9a-f]{10})+$", "")


def upload_parts(name: Column) -> Column:
    """(base, file_hash, ext, key) of an uploaded file's name; the last hash suffix only."""
    stem, ext = stem_and_extension(name)
    pattern = "^(.*)_([0-9a-f]{10})$"
    digest = F.regexp_extract(stem, pattern, 2)
    base = F.when(digest == "", stem).otherwise(F.regexp_extract(stem, pattern, 1))
    return F.struct(base.alias("base"), F.nullif(digest, F.lit("")).alias("file_hash"), ext.alias("ext"), name_key(base).alias("key"))


def is_variant_name(name: Column) -> Column:
    return F.lower(name).rlike("^(" + "|".join(VARIANT_PREFIXES) + ")")


def original_of(name: Column) -> Column:
    """The name of the image that a thumbnail is of; other names are null."""
    pattern = "(?i)^(" + "|".join(VARIANT_PREFIXES) + ")(.+)$"
    return F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яА-ЯёЁ]")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def label_text(text: Column) -> Column:
    """The canonical form of label text: lower case, no punctuation, Latin letters, single spaces."""
    plain = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), r"[^a-zа-яё0-9\s]", " ")
    return squeeze(transliterate(plain, "label"))


def label_tokens(text: Column) -> Column:
    return F.filter(F.split(label_text(text), " "), lambda t: t != "")


def match_tokens(text: Column) -> Column:
    """Latin tokens of two characters or more."""
    found = F.regexp_extract_all(transliterate(F.coalesce(text, F.lit("")), "upload"), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) >= 2)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


# The endings of the Russian stemmer of the Snowball family, by step.
GERUND = "(?<=[ая])(?:в|вши|вшись)|ив|ивши|ившись|ыв|ывши|ывшись"
REFLEXIVE = "ся|сь"
ADJECTIVE = "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE = "(?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ"
VERB = (
    "(?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю"
)
NOUN = "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"


_vowels = "аеиоуыэюя"
_head = re.compile(f"[^{_vowels}]*[{_vowels}]")
# behind the second group of vowels and the consonant after it
_second = re.compile(f"[^{_vowels}]*[{_vowels}]+[^{_vowels}]+[{_vowels}]+[^{_vowels}]")
_gerund, _reflexive, _verb, _noun = (re.compile(f"(?:{x})$") for x in (GERUND, REFLEXIVE, VERB, NOUN))
_adjectival = re.compile(f"(?:{PARTICIPLE})?(?:{ADJECTIVE})$")
_derived, _superlative = re.compile("(?:ость|ост)$"), re.compile("(?:ейше|ейш)$")
_token = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def stem_word(word: str) -> str:
    """The stem of a Russian word in lower case; words without Cyrillic letters stay as they are.

    Endings are taken off behind the first vowel only, derivational ones behind the second group of vowels and consonants.
    """
    plain = word.replace("ё", "е")
    if not (start := _head.match(plain)):
        return plain
    head, rest = plain[: start.end()], plain[start.end() :]
    if (without := _gerund.sub("", rest)) == rest:
        rest = _reflexive.sub("", rest)
        endings = (_adjectival, _verb, _noun)
        without = next((x for e in endings if (x := e.sub("", rest)) != rest), rest)
    rest = without.removesuffix("и")
    second = _second.match(plain)
    if second and len(head) + len(shorter := _derived.sub("", rest)) >= second.end():
        rest = shorter
    if rest.endswith("нн"):
        rest = rest[:-1]
    elif (shorter := _superlative.sub("", rest)) != rest:
        rest = shorter[:-1] if shorter.endswith("нн") else shorter
    else:
        rest = rest.removesuffix("ь")
    return head + rest


def word_list(text: str | None) -> list[str]:
    """The words of an index: runs of letters and digits in lower case, Russian ones by their stem."""
    return [w if w.isascii() else stem_word(w) for w in _token.findall((text or "").lower())]


@F.pandas_udf(ArrayType(StringType()))
def words(text: pd.Series) -> pd.Series:
    return text.map(word_list)


def skeleton(token: Column) -> Column:
    """The consonants by sound: vowels go, like-sounding letters meet, repeats are squeezed."""
    out = token
    # Letters that sound alike.
    for a, b in (("ch", "sh"), ("sch", "sh"), ("ph", "f"), ("th", "t"), ("x", "ks")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(F.translate(out, "cqwyjz", "kkviis"), "aeiou", ""), r"(.)\1+", "$1")


def year_of(name: Column, slug_: Column | None = None) -> Column:
    """The first year from 1950 to 2049 in the name, else in the slug."""
    found = lambda c: F.nullif(F.regexp_extract(c, YEAR, 1), F.lit("")).cast("int")
    return found(name) if slug_ is None else F.coalesce(found(name), found(F.replace(slug_, F.lit("-"), F.lit(" "))))


def volume_of(name: Column) -> Column:
    return F.try_to_number(F.replace(F.nullif(F.regexp_extract(name, VOLUME, 1), F.lit("")), F.lit(","), F.lit(".")), F.lit("9.999")).cast("double")


# What tells sweetness and sparkle in transliterated names.
SWEETNESS = (("brut", "bryut|brut"), ("semi_dry", "polusuh|semisec"), ("semi_sweet", "poluslad"), ("sweet", "sladk|sweet|dolce"), ("dry", "suh|dry|secco"))
SPARKLING = "bryut|brut|igristoe|shampanskoe|spumante|petnat|frizzante|prosecco|kremant|cremant|kava|cava|sekt|shipuchee|millesimato"


def _sweetness(joined: Column) -> Column:
    out = F.when(joined.rlike(r"\b(ekstra|extra) (bryut|brut)\b"), "extra_brut").when(joined.rlike(r"\b(bryut|brut) (natyur|nature)\b"), "brut_nature")
    for label, starts in SWEETNESS:
        out = out.when(joined.rlike(rf"(^| )({starts})"), label)
    return out


def _sparkling(joined: Column) -> Column:
    return joined.rlike(rf"(^| )({SPARKLING})( |$)") | joined.rlike(r"(^| )(blanc|blan) de( |$)")


def attributes(name: Column, slug_: Column) -> Column:
    """(year, sweetness, sparkling, volume_l) of a catalog name and slug; what isn't said is null (sparkling: false)."""
    named = F.array_join(F.regexp_extract_all(transliterate(name, "upload"), F.lit("([a-z0-9]+)"), F.lit(1)), " ")
    slugged = F.replace(F.lower(slug_), F.lit("-"), F.lit(" "))
    return F.struct(
        year_of(name, slug_).alias("year"), F.coalesce(_sweetness(named), _sweetness(slugged)).alias("sweetness"),
        (_sparkling(named) | _sparkling(slugged)).alias("sparkling"), volume_of(name).alias("volume_l"),
    )


def is_filled(c: Column, kind: str = "string") -> Column:
    """Neither null nor an empty string, array or map: the one meaning of a value being there."""
    if kind.startswith(("array", "map")):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


def citations(text: Column, n: Column) -> Column:
    """Numbers cited as [1] that are at most ``n``, each once, in order; all from 1 to ``n`` if none is."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    valid = F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n)))
    everything = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(valid) > 0, valid).otherwise(everything)


def json_object(text: Column) -> Column:
    """The outermost {...} of a text that may have fences or talk around it."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def first_match(text: Column, ladder: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that matches, specific ones first."""
    out = None
    for pattern, label in ladder:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


# Kinds of files that are told by their extension, and extensions of photos.
EXTENSION_KINDS = {
    "svg": "svg_logo", "geojson": "geojson_map", "xml": "xml_sitemap", "pdf": "pdf_doc", "tif": "tif_scan", "tiff": "tif_scan", "heic": "heic_photo", "jfif": "jfif_photo",
}
PHOTO_EXTENSIONS = ("webp", "jpg", "jpeg", "png")


def noise_class(name: Column) -> Column:
    """What a file that belongs to nothing looks like: by extension, then a camera's name, then a long one of mixed signs without a break, else a photo.

    Extensions that are no photo's give ``other_ext_`` with them, or with ``none``.
    """
    ext = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))
    stem = F.when(ext == "", name).otherwise(F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1))
    base = without_hashes(stem)
    kinds = sum((base.rlike(p).cast("int") for p in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}")), F.lit(0))
    random = ~base.rlike("[_ -]") & (F.length(base) >= 16) & (kinds >= 2)
    told = F.create_map(*[F.lit(x) for kv in EXTENSION_KINDS.items() for x in kv])[ext]
    other = F.when(~ext.isin(*PHOTO_EXTENSIONS), F.concat(F.lit("other_ext_"), F.when(ext == "", "none").otherwise(ext)))
    return F.coalesce(told, other, F.when(base.rlike(r"(?i)^(dsc|img|pxl|mg)[_-]?\d"), "camera_original").when(random, "random_s3_name").otherwise("other_photo"))
