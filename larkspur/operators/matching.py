"""Matching of names to cards in steps, synonyms, overrides, groups of equal content; each step joins only what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import families, joins


def resolve_synonyms(rows: DataFrame, name: str, synonyms: DataFrame) -> DataFrame:
    """``rows`` with ``card``: what a name or any of its synonyms (word, card) stands for, whatever the case and the blanks around it; null if unknown."""
    words = synonyms.select(F.lower(F.trim("word")).alias("_word"), "card").dropDuplicates(["_word"])
    return rows.join(words, F.lower(F.trim(F.col(name))) == F.col("_word"), "left").drop("_word")


def expand_names(rows: DataFrame, id_col: str, names: str, synonyms: DataFrame, ignored: DataFrame, joint: str = r"\s+и\s+") -> DataFrame:
    """(id, names): each list of names made ready for lookup, in order: ignored ones (word) go, those in brackets lose them,
    and one that joins several is split if all of them are known."""
    key = lambda c: F.lower(F.trim(c))
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    one = rows.select(F.col(id_col).alias("id"), F.posexplode(names).alias("pos", "name")).withColumn("name", F.trim("name")).filter("name <> ''")
    one = one.join(ignored.select(F.lower(F.trim("word")).alias("_i")).distinct(), key(F.col("name")) == F.col("_i"), "left_anti")
    known = synonyms.select(F.lower(F.trim("word")).alias("_k")).distinct()
    parts = F.transform(F.split("name", joint), bare)
    tries = F.array(
        F.struct(F.lit(0).alias("step"), F.array("name").alias("out")), F.struct(F.lit(1).alias("step"), F.array(bare(F.col("name"))).alias("out")),
        F.struct(F.lit(2).alias("step"), F.when(F.size(parts) > 1, parts).alias("out")),
    )
    tried = one.select("id", "pos", "name", F.explode(tries).alias("t")).select("id", "pos", "name", "t.*").filter("out IS NOT NULL")
    words = tried.select("id", "pos", "step", "name", "out", F.explode("out").alias("w")).join(known, key(F.col("w")) == F.col("_k"), "left")
    whole = words.groupBy("id", "pos", "name", "step").agg(F.bool_and(F.col("_k").isNotNull()).alias("ok"), F.first("out").alias("out"))
    best = whole.groupBy("id", "pos", "name").agg(F.min(F.when(F.col("ok"), F.struct("step", "out"))).alias("m"))
    listed = best.select("id", "pos", F.coalesce("m.out", F.array("name")).alias("out")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("l"))
    return listed.select("id", F.flatten(F.transform("l", lambda x: x["out"])).alias("names"))


def merged_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails if a key comes more than once on either side."""
    once = lambda df, side: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn(
        key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated on the {side}: "), F.col(key).cast("string"))).cast(dict(df.dtypes)[key])).otherwise(F.col(key))
    ).drop("_n")
    return once(left, "left").join(once(right, "right"), key, "left")


def cascade(names: DataFrame, keys: DataFrame, overrides: DataFrame | None = None, reviewed: DataFrame | None = None, least: int = 6) -> DataFrame:
    """(name, key, status, extra): the key that each name belongs to, by the first step that finds one.

    Steps: ``exact``; ``substring`` (contained in, or containing, exactly one key of ``least`` characters); ``override`` (name, key) for names
    that are still without one, if there is such a key. What is left is ``ambiguous`` where several keys contain it, ``weak_overlap`` where one has a
    word of it (of four letters, parted by ``_``) in it, else ``no_ref``. A ``reviewed`` row (name, keys) always holds: the first of its keys that
    there are, the others in ``extra``; without any the name is ``rejected``.
    """
    n, k = names.select("name").distinct(), keys.select("key").distinct()
    none = F.lit(None).cast(dict(k.dtypes)["key"])
    exact = n.join(k, n["name"] == k["key"]).select("name", "key", F.lit("exact").alias("status"))
    left = n.join(k, n["name"] == k["key"], "left_anti")
    near = joins.containing(left, k, least).groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_k"))
    weak = joins.sharing_words(left, k).withColumn("_weak", F.lit(True))
    status = F.when(F.col("_n") == 1, "substring").when(F.col("_n") > 1, "ambiguous").when(F.col("_weak"), "weak_overlap").otherwise("no_ref")
    rest = left.join(near, "name", "left").join(weak, "name", "left").select("name", F.when(F.col("_n") == 1, F.col("_k")).alias("key"), status.alias("status"))
    if overrides is not None:
        said = overrides.select("name", F.col("key").alias("_said")).join(k.select(F.col("key").alias("_said")), "_said", "left_semi")
        rest = rest.join(said, "name", "left")
        fill = F.col("key").isNull() & F.col("_said").isNotNull()
        rest = rest.select("name", F.when(fill, F.col("_said")).otherwise(F.col("key")).alias("key"), F.when(fill, "override").otherwise(F.col("status")).alias("status"))
    out = exact.unionByName(rest).withColumn("extra", F.array().cast(f"array<{dict(k.dtypes)['key']}>"))
    if reviewed is None:
        return out
    listed = reviewed.select("name", F.posexplode_outer("keys").alias("_at", "key")).join(k.withColumn("_known", F.lit(True)), "key", "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("_known"), F.struct("_at", "key"))))
    vetted = listed.groupBy("name").agg(F.transform(kept, lambda x: x["key"]).alias("_keys"))
    met = out.join(vetted, "name", "left")
    first, decided = F.try_element_at("_keys", F.lit(1)), F.col("_keys").isNotNull()
    named = F.when(decided & first.isNotNull(), "reviewed").when(decided, "rejected").otherwise(F.col("status"))
    more = F.when(decided, F.slice("_keys", 2, F.greatest(F.lit(1), F.size("_keys")))).otherwise(F.col("extra"))
    return met.select("name", F.when(decided, first).otherwise(F.col("key")).alias("key"), named.alias("status"), more.alias("extra"))


def shared_keys(matched: DataFrame) -> DataFrame:
    """(key, names): keys that several names were given, with these in order."""
    by = matched.filter("key IS NOT NULL").groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return by.filter(F.size("names") > 1)


def clearly_nearest(candidates: DataFrame, anchors: DataFrame, key: str, most_hours: float, runner_up_hours: float) -> DataFrame:
    """(item, group, hours, next_hours): of an item's groups (key, item, group, ts) the one nearest in time to any anchor (key, ts) of its key,
    if it is near and the next group is far.

    For each candidate only the last anchor before it and the first after it count, found by a running window over both.
    """
    both = candidates.select(key, "item", "group", "ts", F.lit(None).cast("timestamp").alias("anchor")).unionByName(
        anchors.select(key, F.lit(None).cast(dict(candidates.dtypes)["item"]).alias("item"), F.lit(None).cast(dict(candidates.dtypes)["group"]).alias("group"), "ts", F.col("ts").alias("anchor"))
    )
    order = Window.partitionBy(key).orderBy("ts")
    before = F.last("anchor", True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("anchor", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    apart = lambda a: F.abs(F.unix_micros("ts") - F.unix_micros(a)) / 3.6e9
    near = both.withColumn("b", before).withColumn("a", after).filter("item IS NOT NULL").withColumn("hours", F.least(apart(F.col("b")), apart(F.col("a"))))
    groups = near.groupBy("item", "group").agg(F.min("hours").alias("hours"))
    w = Window.partitionBy("item").orderBy("hours", "group")
    led = groups.withColumn("next_hours", F.lead("hours").over(w)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return led.filter((F.col("hours") <= most_hours) & (F.col("next_hours") >= runner_up_hours))


def overridden(rows: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with the overrides' (key, column) value where there is one."""
    o = overrides.select(F.col(key).alias("_k"), F.col(column).alias("_v"), F.lit(True).alias("_set"))
    met = rows.join(o, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.when(F.col("_set"), F.col("_v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def unknown_overrides(overrides: DataFrame, key: str, column: str, keys: DataFrame, values: DataFrame) -> DataFrame:
    """(key, value, problem) of overrides for keys, or with values, that don't exist (one column each); a null value is allowed."""
    o = overrides.select(F.col(key).alias("key"), F.col(column).alias("value"))
    bad = o.join(keys.toDF("key"), "key", "left_anti").select("key", "value", F.lit("unknown key").alias("problem"))
    return bad.unionByName(o.filter("value IS NOT NULL").join(values.toDF("value"), "value", "left_anti").select("key", "value", F.lit("unknown value").alias("problem")))


def alias_text(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with ``alias_text``: all aliases (group, alias) of the group that a value belongs to, in order; itself if it is in none."""
    listed = aliases.groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("alias_text"))
    word = aliases.select("group", F.lower(F.trim("alias")).alias("_a")).dropDuplicates(["_a"]).join(listed, "group").drop("group")
    met = rows.join(word, F.lower(F.trim(F.col(column))) == F.col("_a"), "left").drop("_a")
    return met.withColumn("alias_text", F.coalesce("alias_text", F.col(column)))


def content_groups(files: DataFrame, group: str, most: int = 6) -> DataFrame:
    """(group, file, root): files (group, file, digest, bits, score, area, mtime) of a group that are equal, or whose hashes are ``most`` bits apart at most, directly
    or through others; root is the group's file with the best score, then area, then time, then name.

    Equal digests, and equal hashes, meet as stars; different hashes of a group are linked within pairs of blocks, so a large group is no square.
    """
    edges = joins.near_hash_links(files, group, "file", "bits", most).toDF("u", "v")
    for key in ("digest", "bits"):
        keyed = files.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col("file").alias("u"), F.struct(group, key).alias("k"))
        firsts = written(keyed.groupBy("k").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
        edges = edges.unionByName(joins.skewed(keyed, firsts, "k", "n").filter("u <> v").select("u", "v"))
    members = families.family_of(files, families.components(edges), "file")
    best = Window.partitionBy("family").orderBy(F.desc("score"), F.desc("area"), F.desc("mtime"), "file")
    return members.withColumn("root", F.first("file").over(best)).select(group, "file", "root")


def dense_ids(components: DataFrame) -> DataFrame:
    """``components`` (node, root) with ``group_id`` from 1 in the order of the roots.

    The rank is over distinct roots, in ranges of them, so no task orders them all.
    """
    from .metrics import running

    roots = components.select("root").distinct().withColumn("one", F.lit(1).cast("long"))
    return components.join(running(roots, [], "root", ["one"]).select("root", F.col("one_upto").alias("group_id")), "root")


def token_clusters(rows: DataFrame, id_col: str, tokens: str, low: int, high: int) -> DataFrame:
    """(node, root) of the items that share a distinctive token: one of ``low`` to ``high`` items has it."""
    own = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens)).alias("token"))
    telling = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter(F.col("n").between(low, high))
    return families.components(own.join(telling, "token").select("id", "first").filter("id <> first"))


def orphans(files: DataFrame, used: DataFrame, is_variant: Column, extension: Column, allowed: tuple[str, ...]) -> DataFrame:
    """Files (file) that nothing uses (file): no thumbnails, and of an allowed kind."""
    return files.filter(~is_variant & extension.isin(*allowed)).join(used.select("file").distinct(), "file", "left_anti")
