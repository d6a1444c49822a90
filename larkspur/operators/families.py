"""Families of near-equal items: edges, connected components, differentiators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .joins import skewed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (two columns): the smallest node that each can reach.

    Every node takes the least label among itself and its neighbours and then its label's label, until none changes;
    jumping labels makes long chains settle in logarithmic rounds. The links of a hub are met by a bounded broadcast; nothing else is,
    as files of ten megabytes can hold more rows than the driver has room for.
    """
    a, b = edges.columns
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    links = written(links.union(links.select("v", "u")).distinct())
    held = written(links.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("root"), F.count(F.lit(1)).alias("degree")))
    while True:
        labels = held.select("node", "root", "degree")
        # of as many links as a node has, so many ask for its label
        asked = labels.select(F.col("node").alias("v"), F.col("root").alias("near"), "degree")
        near = skewed(links, asked, "v", "degree").groupBy("u").agg(F.min("near").alias("near"))
        step = written(labels.hint("merge").join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"), "degree"))
        shares = step.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        jump = written(step.select(F.col("node").alias("root"), F.col("root").alias("far")).hint("merge").join(shares, "root"))
        after = written(skewed(step, jump, "root", "n").select("node", "was", F.least("root", "far").alias("root"), "degree"))
        for old in (held, step, jump):  # the last round's labels and what led from them to these
            discard(old)
        held = after
        if not after.filter("root <> was").limit(1).count():
            discard(links)
            return after.select("node", "root")


def families(items: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(family_id, members) of components of two or more: the smallest member and how many there are."""
    c = components(edges)
    known = c.hint("merge").join(items.select(F.col(id_col).alias("node")), "node", "left_semi")
    return known.groupBy(F.col("root").alias("family_id")).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")


def family_of(ids: DataFrame, components_: DataFrame, id_col: str) -> DataFrame:
    """Every id with its family, itself if it is alone."""
    met = ids.join(components_.hint("merge"), ids[id_col] == components_["node"], "left")
    return met.select(*[ids[c] for c in ids.columns], F.coalesce("root", ids[id_col]).alias("family"))


def year_and_base(slug: Column) -> tuple[Column, Column]:
    """The first year among a slug's parts, and the slug without it."""
    parts = F.split(slug, "-")
    is_year = lambda p: p.rlike("^(19|20)[0-9]{2}$")
    year = F.try_element_at(F.filter(parts, is_year), F.lit(1))
    return year.cast("int"), F.array_join(F.filter(parts, lambda p: ~is_year(p)), "-")
