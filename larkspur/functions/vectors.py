"""Vectors as arrays of numbers, and boxes as four corners; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(doubles(v), lambda x: x / size)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def quantise(v: Column) -> Column:
    """Signed bytes, scaled by the largest absolute component; halves go to the even neighbour."""
    most = F.aggregate(doubles(v), F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    return F.transform(doubles(v), lambda x: F.when(most > 0, F.bround(x / most * 127, 0)).otherwise(F.lit(0.0)).cast("tinyint"))


def project(v: Column, rows: list[list[float]]) -> Column:
    """``v`` times a fixed matrix, at length one."""
    return unit(F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in rows]))


def sign_bits(v: Column) -> Column:
    """The signs of up to 64 components as bits of a long, the first component lowest; longer vectors are an error."""
    bits = F.transform(doubles(v), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    joined = F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.when(F.size(v) > 64, F.raise_error(F.lit("more than 64 components")).cast("long")).otherwise(joined)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex strings, by halves: the top bit doesn't fit a signed long."""
    half = lambda c, at: F.conv(F.substring(F.lpad(c, 16, "0"), at, 8), 16, 10).cast("long")
    return hamming(half(a, 1), half(b, 1)) + hamming(half(a, 9), half(b, 9))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x0, y0, x1, y1); 0 where both are empty."""
    both = overlap(a, b)
    return F.coalesce(F.try_divide(both, box_area(a) + box_area(b) - both), F.lit(0.0))


def inside_share(inner: Column, outer: Column) -> Column:
    return F.coalesce(F.try_divide(overlap(inner, outer), box_area(inner)), F.lit(0.0))


def grid_coverage(points: Column, side: int = 6) -> Column:
    """The share of side x side cells of the unit square that hold a point (structs x, y)."""
    cell = lambda p: F.least(F.floor(p["x"] * side), F.lit(side - 1)) * side + F.least(F.floor(p["y"] * side), F.lit(side - 1))
    return F.size(F.array_distinct(F.transform(points, cell))) / float(side * side)


def masked_distance(a: Column, b: Column, axes: list[str]) -> Column:
    """Euclidean distance over the axes that both structs have; 1.0 if there are none."""
    shared = [a[x].isNotNull() & b[x].isNotNull() for x in axes]
    total = sum((F.coalesce((a[x] - b[x]) ** 2, F.lit(0.0)) for x in axes), F.lit(0.0))
    seen = sum((s.cast("int") for s in shared), F.lit(0))
    return F.when(seen == 0, F.lit(1.0)).otherwise(F.sqrt(total))
