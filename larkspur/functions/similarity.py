"""String similarities that have no built-in: small Arrow UDFs, for candidates that a join has already narrowed."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .text import skeleton


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp: twice the matching characters over all; null with null."""
    pairs = zip(a, b, strict=True)
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, with a bit for each character of ``a``: one step a character of ``b``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; two empty strings are equal."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set(a: str, b: str) -> float:
    """0 to 100: the best indel ratio among shared tokens, shared with the first's rest, shared with the second's rest."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both = " ".join(sorted(s & t))
    if both and (s <= t or t <= s):
        return 100.0
    left, right = (" ".join(filter(None, [both, " ".join(sorted(x))])) for x in (s - t, t - s))
    pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
    return 100 * max(indel(x, y) for x, y in pairs)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_similarity(a: Column, b: Column) -> Column:
    """1 for equal tokens, 0 for different numbers, else the better of the spelling's and the skeleton's ratio.

    Skeletons under three letters count only if equal (0.85).
    """
    sa, sb = skeleton(a), skeleton(b)
    short = F.least(F.length(sa), F.length(sb)) < 3
    shape = F.when(short, F.when((sa == sb) & (F.length(sa) >= 2), 0.85).otherwise(0.0)).otherwise(matching_ratio(sa, sb))
    number = a.rlike("^[0-9]+$") | b.rlike("^[0-9]+$")
    return F.when(a == b, 1.0).when(number, 0.0).otherwise(F.greatest(matching_ratio(a, b), shape))


def close_token(query: Column, word: Column) -> Column:
    """1 for equal tokens; numbers and tokens under four letters 0; ratios from 0.8 on; 0.85 if one of five letters or more begins the other."""
    # as many letters as the shorter one has can be common, so most pairs need no count
    bound = 2 * F.least(F.length(query), F.length(word)) / (F.length(query) + F.length(word))
    ratio = F.when(bound >= 0.8, indel_ratio(query, word))
    prefix = (F.least(F.length(query), F.length(word)) >= 5) & (F.startswith(query, word) | F.startswith(word, query))
    never = query.rlike("^[0-9]+$") | word.rlike("^[0-9]+$") | (F.least(F.length(query), F.length(word)) < 4)
    return F.when(query == word, 1.0).when(never, 0.0).when(ratio >= 0.8, ratio).when(prefix, 0.85).otherwise(0.0)


def likeness(a: str, b: str) -> float:
    """``close_token`` of two tokens that are at hand."""
    if a == b:
        return 1.0
    shorter = min(len(a), len(b))
    if a.isdigit() or b.isdigit() or shorter < 4:
        return 0.0
    if 10 * shorter >= 4 * (len(a) + len(b)) and (ratio := indel(a, b)) >= 0.8:
        return ratio
    return 0.85 if shorter >= 5 and (a.startswith(b) or b.startswith(a)) else 0.0


def _parted(a: pd.Series, b: pd.Series, alike: bool) -> pd.Series:
    return pd.Series([[x for x in s if any(likeness(x, y) >= 0.8 for y in t) == alike] for s, t in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def like_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """The tokens of ``a`` that are like one of ``b``; both arrays of a row's few tokens."""
    return _parted(a, b, True)


@F.pandas_udf(ArrayType(StringType()))
def unlike_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """The tokens of ``a`` that are like none of ``b``."""
    return _parted(a, b, False)
