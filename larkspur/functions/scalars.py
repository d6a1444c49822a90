"""Small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age(born: Column, today: Column) -> Column:
    """Full years; who was born on 29 February turns a year older on 1 March."""
    early = (F.date_format(today, "MMdd") < F.date_format(born, "MMdd")).cast("int")
    return F.year(today) - F.year(born) - early


def client_ip(forwarded: Column, host: Column) -> Column:
    first = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(host), F.lit("")), F.lit("unknown"))


def salted_hash(value: Column, day: Column) -> Column:
    """The SHA-256 of a value and the day's date, which is the salt."""
    return F.sha2(F.concat_ws(":", value, F.date_format(day, "yyyy-MM-dd")), 256)


def seconds_of(text: Column) -> Column:
    """30, 30s, 5m, 2h or a sum like 1m30s as seconds; null for anything else, and for parts that sum up to nothing."""
    raw, part = F.lower(F.trim(text)), r"(\d+(?:\.\d+)?)\s*([hms])"
    parts = F.regexp_extract_all(raw, F.lit(r"(\d+(?:\.\d+)?\s*[hms])"), F.lit(1))
    unit = lambda p: F.when(p.endswith("h"), 3600).when(p.endswith("m"), 60).otherwise(1)
    one = lambda p: F.trim(F.regexp_replace(p, "[hms]", "")).cast("double") * unit(p)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + one(p))
    only_parts = F.trim(F.regexp_replace(raw, part, "")) == ""
    return F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.try_cast("double")).when(only_parts & (total > 0), total)


def size_of(text: Column) -> Column:
    """(width, height) of a size like 1200x1600, or null."""
    sides = [F.regexp_extract(F.lower(text), r"^\s*(\d+)\s*x\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2)]
    return F.when(sides[0].isNotNull(), F.struct(sides[0].alias("width"), sides[1].alias("height")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form for a number."""
    last, teens = n % 10, (n % 100).between(11, 14)
    return F.when((last == 1) & ~teens, one).when(last.between(2, 4) & ~teens, few).otherwise(many)


def slug_of_file(name: Column) -> Column:
    return F.split(name, "__")[0]


def vector_text(names: list[str], vector: Column) -> Column:
    return F.concat_ws(" ", *[F.format_string(f"{n}=%.2f", vector[n]) for n in names])


def excerpts(texts: Column) -> Column:
    """Texts as a numbered block."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")


def clean_number(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)
