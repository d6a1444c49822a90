"""Pairing rules as column expressions: a rule file is compiled once, then Catalyst evaluates it over all rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar of a rule file.
_COMPARED = re.compile(r"(>=|<=)\s*(?:(-?\d+(?:\.\d+)?)|(\w+)\.(\w+))")
_NEAR = re.compile(r"~=\s*(\w+)\.(\w+)\s*±\s*(-?\d+(?:\.\d+)?)")
_SAME = re.compile(r"matches\s+(\w+)\.(\w+)")


def _field(space: str, name: str) -> Column:
    """An axis of a side; what a dish doesn't say is 0, what a wine doesn't say is null."""
    column = F.col(space)[name]
    return F.coalesce(column, F.lit(0.0)) if space == "dish" else column


def condition(spec: dict, known: dict[str, set[str]]) -> Column:
    """All entries of ``spec`` hold; an entry about a null or an unknown axis of a wine doesn't.

    ``known`` lists the axes that the structs ``dish`` and ``wine`` have.
    """

    def value(space: str, name: str) -> Column:
        if name in known[space]:
            return _field(space, name)
        return F.lit(0.0) if space == "dish" else F.lit(None).cast("double")

    tests = []
    for key, wanted in spec.items():
        if key == "always":
            tests.append(F.lit(bool(wanted)))
            continue
        left = value(*key.split(".", 1))
        if m := _COMPARED.fullmatch(wanted):
            right = F.lit(float(m[2])) if m[2] else value(m[3], m[4])
            test = left >= right if m[1] == ">=" else left <= right
        elif m := _NEAR.fullmatch(wanted):
            test = F.abs(left - value(m[1], m[2])) <= float(m[3])
        elif m := _SAME.fullmatch(wanted):
            test = left == value(m[1], m[2])
        else:
            raise ValueError(f"{key}: {wanted!r} is no condition")
        tests.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def scored(pairs: DataFrame, rules: list[dict], blocks: list[dict] = (), known: dict[str, set[str]] | None = None) -> DataFrame:
    """``pairs`` (structs dish and wine, and any columns) with ``score`` and ``why``, without blocked ones.

    A rule applies where its ``when`` holds: its weight counts in full if it has neither ``require`` nor ``penalize``, is added
    where ``require`` holds and taken away where ``penalize`` does. The score is what came together over all that applied, from
    0 to 1. ``why`` has (id, explain, weight) of the rules that spoke for the pair, in their order.
    """
    known = known or {s: set(pairs.schema[s].dataType.names) for s in ("dish", "wine")}
    for block in blocks:
        pairs = pairs.filter(~condition(block["condition"], known))
    applicable, raw, why = F.lit(0.0), F.lit(0.0), []
    for rule in rules:
        on, weight = condition(rule["when"], known), float(rule["weight"])
        plain = "require" not in rule and "penalize" not in rule
        fits = on & (condition(rule["require"], known) if "require" in rule else F.lit(plain))
        against = on & condition(rule["penalize"], known) if "penalize" in rule else F.lit(False)
        applicable += F.when(on, weight).otherwise(0.0)
        raw += F.when(fits, weight).otherwise(0.0) - F.when(against, weight).otherwise(0.0)
        said = F.struct(F.lit(rule["id"]).alias("id"), F.lit(rule["explain"]).alias("explain"), F.lit(weight).alias("weight"))
        why.append(F.when(fits, said))
    share = F.coalesce(F.try_divide(raw, applicable), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return pairs.withColumn("score", score).withColumn("why", F.filter(F.array(*why), lambda r: r.isNotNull()))


def best_tags(scored_: DataFrame, item: str, tag: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(item).orderBy(F.desc("score"), tag)
    return scored_.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_explanation(why: Column) -> Column:
    """The explanation of the weightiest rule, the first of equals."""
    most = F.aggregate(why, F.lit(-1.0), lambda m, r: F.greatest(m, r["weight"]))
    return F.try_element_at(F.filter(why, lambda r: r["weight"] == most), F.lit(1))["explain"]
