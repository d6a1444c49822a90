"""Joins that a catalog needs: lookups with fallbacks, nearest in time, containment, integrity."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import written


def lookup(df: DataFrame, dim: DataFrame, on: Column, adds: list[str]) -> DataFrame:
    """A left join to a dimension that Spark broadcasts by its own size check."""
    return df.join(dim, on, "left").select(*[df[c] for c in df.columns], *[dim[c] for c in adds])


#: A key of more than one in HOT rows is hot; there are fewer than HOT such keys, which bounds what is broadcast for them.
HOT = 1024


def skewed(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with ``table``, whose ``key`` is unique and whose ``weight`` counts the rows that have it.

    Keys with more than one in HOT rows are met by a broadcast (HOT rows at most), all others by a shuffle, so no task
    gets the rows of a hot key, and no other rows are broadcast, however small Spark takes them to be. Rows without a partner are left out;
    ``table`` is read twice.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot, adds = F.col(weight) * HOT > total, [c for c in table.columns if c not in (key, weight)]
    few = F.broadcast(table.filter(hot).select(key, F.struct(F.lit(1).alias("_one"), *adds).alias("_hot")))
    tagged = rows.join(few, key, "left")
    done = tagged.filter("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in adds])
    rest = tagged.filter("_hot IS NULL").select(*rows.columns).join(table.filter(~hot).select(key, *adds).hint("merge"), key)
    return done.unionByName(rest)


def with_fallback(df: DataFrame, primary: DataFrame, secondary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the primary card, else the secondary's, else null."""
    p = primary.select(F.col(key).alias("_p"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    s = secondary.select(F.col(key).alias("_s"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    met = df.join(p, df[key] == F.col("_p"), "left").join(s, df[key] == F.col("_s"), "left")
    return met.select(*[df[c] for c in df.columns], *[F.coalesce(f"_p_{c}", f"_s_{c}").alias(c) for c in columns])


def unknown(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """(key, n): values of a key that a dimension doesn't have, and how many rows have them."""
    return df.filter(F.col(key).isNotNull()).join(dim.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def by_key_or(df: DataFrame, dim: DataFrame, keys: list[Column], dim_key: str, adds: list[str]) -> DataFrame:
    """``df`` with columns of a dimension, met by the first of several keys that it has."""
    d = dim.select(F.col(dim_key).alias("_d"), F.struct(*adds).alias("_a"))
    out = df.withColumn("_row", F.monotonically_increasing_id())
    asked = out.select("_row", F.posexplode(F.array(*keys)).alias("_step", "_key")).filter("_key IS NOT NULL")
    best = asked.join(d, F.col("_key") == F.col("_d")).groupBy("_row").agg(F.min_by("_a", "_step").alias("_a"))
    return out.join(best, "_row", "left").select(*df.columns, *[F.col(f"_a.{c}").alias(c) for c in adds])


def thumbnails(files: DataFrame, name: str, original: Column) -> DataFrame:
    """``files`` that are thumbnails of an image that is there."""
    held = files.withColumn("_original", original)
    return held.join(files.select(F.col(name).alias("_original")).distinct(), "_original", "left_semi").select(*files.columns)


def supplement(known: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``known`` and the rows of ``more`` whose key it doesn't have."""
    return known.unionByName(more.join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def integrity(referenced: DataFrame, existing: DataFrame) -> DataFrame:
    """References to nothing, with how many rows make them; each side one column."""
    r, e = referenced.columns[0], existing.columns[0]
    return referenced.filter(F.col(r).isNotNull()).join(existing, referenced[r] == existing[e], "left_anti").groupBy(r).agg(F.count(F.lit(1)).alias("n_rows"))


def near_in_time(left: DataFrame, right: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """For each left row (key, l_id, l_ts) the right rows (key, r_id, r_ts) of its key within ``seconds``, nearest first.

    Time is cut into slots of that length and a left row asks its own and both neighbouring slots, so it is an equi-join
    whose partners are bounded by the rows of three slots.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(micros(c) / (seconds * 1_000_000))
    asks = left.withColumn("_slot", F.explode(F.array(*[slot("l_ts") + d for d in (-1, 0, 1)])))
    met = asks.join(right.withColumn("_slot", slot("r_ts")), [key, "_slot"])
    apart = F.abs(micros("l_ts") - micros("r_ts"))
    met = met.withColumn("micros", apart).filter(F.col("micros") <= seconds * 1_000_000)
    w = Window.partitionBy("l_id").orderBy("micros", "r_id")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("_slot")


def containing(names: DataFrame, keys: DataFrame, least: int = 6, ratio: float = 0.5) -> DataFrame:
    """(name, key): names that contain, or are contained in, a key; both of ``least`` characters, the shorter ``ratio`` of the longer at least.

    The shorter one's first ``least`` characters must stand somewhere in the longer one, so pieces of that length are the
    equi-join's keys: names and keys each offer all their pieces and their own first one.
    """
    n, k = names.columns[0], keys.columns[0]
    a = names.select(F.col(n).alias("name")).filter(F.length("name") >= least).distinct()
    b = keys.select(F.col(k).alias("key")).filter(F.length("key") >= least).distinct()
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least))))
    head = lambda c: F.substring(c, 1, least)
    inside = a.select("name", head("name").alias("p")).join(b.select("key", F.explode(pieces(F.col("key"))).alias("p")), "p")
    around = a.select("name", F.explode(pieces(F.col("name"))).alias("p")).join(b.select("key", head("key").alias("p")), "p")
    met = inside.unionByName(around).select("name", "key").distinct()
    within = F.contains(F.col("key"), F.col("name")) | F.contains(F.col("name"), F.col("key"))
    long_enough = F.least(F.length("name"), F.length("key")) >= ratio * F.greatest(F.length("name"), F.length("key"))
    return met.filter(within & long_enough)


def contained(names: DataFrame, keys: DataFrame, least: int = 6, ratio: float = 0.5) -> DataFrame:
    """(name, key) of ``containing`` for the names that have exactly one key."""
    met = containing(names, keys, least, ratio)
    return met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("_n = 1").drop("_n")


def sharing_words(names: DataFrame, keys: DataFrame, least: int = 4, mark: str = "_") -> DataFrame:
    """(name): names with a word (of ``least`` letters, parted by ``mark``) that stands anywhere in a key.

    A word is looked up by the piece of ``least`` letters of it that fewest keys have; a word without such a piece is in none.
    """
    n, k = names.columns[0], keys.columns[0]
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least))))
    word = names.select(F.col(n).alias("name"), F.explode(F.array_distinct(F.split(F.col(n), mark))).alias("word")).filter(F.length("word") >= least)
    held = keys.select(F.col(k).alias("key")).filter(F.length("key") >= least).distinct().select("key", F.explode(pieces(F.col("key"))).alias("p"))
    counts = held.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    each = word.select("word").distinct().select("word", F.explode(pieces(F.col("word"))).alias("p")).join(counts, "p", "left")
    rarest = each.groupBy("word").agg(F.min_by("p", F.struct(F.coalesce("n", F.lit(0)), "p")).alias("p"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    found = rarest.join(held, "p").filter(F.contains(F.col("key"), F.col("word"))).select("word").distinct()
    return word.join(found, "word", "left_semi").select("name").distinct()


def _piece(part: int, start: Column, end: Column):
    return lambda d: F.struct(F.lit(part).alias("part"), F.substring("name", F.greatest(F.lit(1), start + 1 + d), end - start).alias("piece"))


#: Parts into which the rows of a name are dealt where its pairs are made.
PARTS = 16


def _similar(names: DataFrame, most: int) -> DataFrame:
    """(g, name, name2, edits): of distinct names (g, name) the pairs within min(most, max(1, shorter // 3)) edits, name before name2.

    Names are cut into most + 1 pieces, of which one stands unchanged within ``most`` places of where it stood, and pairs meet on
    such a piece, so a large group isn't compared pair by pair. Both sides are many times the rows that Spark counts on, so they are not to be broadcast.
    """
    parts, length = most + 1, F.length("name")
    cut = lambda i: F.floor(length * i / parts)
    own = F.array(*[F.struct(F.lit(i).alias("part"), length.alias("of"), F.substring("name", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(parts)])
    offers = names.select("g", "name", F.explode(own).alias("k")).select("g", "name", "k.*")
    asks = names.withColumn("of", F.explode(F.sequence(F.greatest(F.lit(0), length - most), length + most)))
    of = F.col("of")
    at = lambda i: F.floor(of * i / parts)
    shifts = F.array(*[F.lit(d) for d in range(-most, most + 1)])
    windows = F.flatten(F.array(*[F.transform(shifts, _piece(i, at(i), at(i + 1))) for i in range(parts)]))
    asked = asks.select("g", "name", "of", F.explode(F.array_distinct(windows)).alias("k")).select("g", F.col("name").alias("name2"), "of", "k.*")
    met = offers.hint("merge").join(asked, ["g", "part", "of", "piece"]).filter("name <> name2")
    met = met.select("g", F.least("name", "name2").alias("name"), F.greatest("name", "name2").alias("name2")).distinct()
    allowed = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.least(F.length("name"), F.length("name2")) / 3)))
    return met.withColumn("edits", F.levenshtein("name", "name2")).filter(F.col("edits") <= allowed)


def _named(rows: DataFrame, group: str, id_col: str, name: str) -> DataFrame:
    """(g, id, name) without nulls, once each."""
    base = rows.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(name).alias("name"))
    return base.filter("name IS NOT NULL AND g IS NOT NULL").distinct()


def similar_names(rows: DataFrame, group: str, id_col: str, name: str, most: int = 2) -> DataFrame:
    """(group, a, b, edits): pairs of a group whose names are equal, or within min(most, max(1, shorter // 3)) edits.

    Distinct names are compared, and their pairs then made into those of all rows; the rows of a name are dealt into PARTS for that, so one that very
    many rows have is more than a task's work.
    """
    base = _named(rows, group, id_col, name)
    names = written(base.select("g", "name").distinct(), "names")
    pairs = _similar(names, most).unionByName(names.select("g", "name", F.col("name").alias("name2"), F.lit(0).alias("edits")))
    first = pairs.hint("merge").join(base.withColumnRenamed("id", "a"), ["g", "name"]).withColumn("_part", F.pmod(F.xxhash64("a"), F.lit(PARTS)))
    others = base.select("g", F.col("name").alias("name2"), F.col("id").alias("b"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])).alias("_part"))
    met = first.hint("merge").join(others, ["g", "name2", "_part"]).filter((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("name") < F.col("name2"))))
    return met.select(F.col("g").alias(group), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "edits")


def similar_name_links(rows: DataFrame, group: str, id_col: str, name: str, most: int = 2) -> DataFrame:
    """(a, b): links that join what the pairs of ``similar_names`` join: rows of a name to its first, and the first ones of similar names."""
    base = _named(rows, group, id_col, name).withColumn("k", F.struct("g", "name"))
    firsts = written(base.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "names")
    stars = skewed(base, firsts, "k", "n").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    of = lambda name, out: firsts.select(F.col("k.g").alias("g"), F.col("k.name").alias(name), F.col("first").alias(out))
    near = _similar(firsts.select("k.*"), most).hint("merge").join(of("name", "a"), ["g", "name"]).hint("merge").join(of("name2", "b"), ["g", "name2"])
    return stars.unionByName(near.select("a", "b"))


def _block_pairs(most: int) -> list[int]:
    """Masks of all pairs of ``most`` + 2 blocks of 64 bits; hashes at most ``most`` bits apart are equal in one pair at least."""
    cuts = [64 * i // (most + 2) for i in range(most + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in itertools.combinations(blocks, 2))]


def near_hashes(left: DataFrame, right: DataFrame, id_col: str, bits: str, most: int) -> DataFrame:
    """(a, b, a_copies, b_copies, distance): pairs of 64-bit hashes (longs) of two tables at most ``most`` bits apart.

    Equal hashes are one class, named by its smallest id and counted. The bits are cut into ``most`` + 2 blocks, of which two at
    least are equal in such a pair, so classes meet on pairs of blocks; a pair is kept where its first two equal blocks are.
    """
    parts = most + 2
    cuts = [64 * i // parts for i in range(parts + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    blocks = [signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = [(i, j) for i in range(parts) for j in range(i + 1, parts)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.groupBy(F.col(bits).alias(f"{name}_bits")).agg(F.min(id_col).alias(name), F.count(F.lit(1)).alias(f"{name}_copies"))
        keys = [F.struct(F.lit(n).alias("table"), F.col(f"{name}_bits").bitwiseAND(F.lit(blocks[i] | blocks[j])).alias("key")) for n, (i, j) in enumerate(pairs)]
        return one.filter(F.col(f"{name}_bits").isNotNull()).withColumn("k", F.explode(F.array(*keys))).select("*", "k.*").drop("k")

    met = keyed(left, "a").join(keyed(right, "b"), ["table", "key"])
    apart = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    equal = F.filter(F.array(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(blocks)]), lambda i: i.isNotNull())
    first = F.array(*[F.lit(i * parts + j) for i, j in pairs])
    here = F.element_at(first, F.col("table") + 1) == F.element_at(equal, 1) * parts + F.element_at(equal, 2)
    met = met.withColumn("distance", F.bit_count(apart)).filter((F.col("distance") <= most) & here)
    return met.select("a", "b", "a_copies", "b_copies", "distance")


def near_hashes_within(rows: DataFrame, group: str, id_col: str, bits: str, most: int) -> DataFrame:
    """(group, a, b): of each group the pairs of different 64-bit hashes at most ``most`` bits apart, each hash named by its smallest id.

    Hashes meet on pairs of blocks of their bits, as in ``near_hashes``.
    """
    parts = most + 2
    cuts = [64 * i // parts for i in range(parts + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    blocks = [signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = [(i, j) for i in range(parts) for j in range(i + 1, parts)]
    one = rows.filter(F.col(bits).isNotNull()).groupBy(group, F.col(bits).alias("bits")).agg(F.min(id_col).alias("id"))
    keys = F.array(*[F.struct(F.lit(n).alias("table"), F.col("bits").bitwiseAND(F.lit(blocks[i] | blocks[j])).alias("key")) for n, (i, j) in enumerate(pairs)])
    keyed = one.withColumn("k", F.explode(keys)).select(group, "id", "bits", "k.*")
    other = keyed.select(group, F.col("id").alias("b"), F.col("bits").alias("b_bits"), "table", "key")
    met = keyed.withColumnRenamed("id", "a").join(other, [group, "table", "key"]).filter("a < b")
    return met.filter(F.bit_count(F.col("bits").bitwiseXOR(F.col("b_bits"))) <= most).select(group, "a", "b").distinct()


def _linked(bits: np.ndarray, most: int) -> np.ndarray:
    """Of each hash the first one that it is linked to by steps of ``most`` bits at most.

    Each is compared with those that nothing is linked to yet, so hashes that are all near each other are no square.
    """
    first, left = np.arange(len(bits)), np.arange(len(bits))
    while len(left):
        start, left = left[0], left[1:]
        asked = [start]
        while asked and len(left):
            near = np.bitwise_count(bits[left] ^ bits[asked.pop()]) <= most
            hit, left = left[near], left[~near]
            first[hit] = start
            asked.extend(hit)
    return first


def near_hash_links(rows: DataFrame, group: str, id_col: str, bits: str, most: int) -> DataFrame:
    """(a, b): links between different 64-bit hashes of a group, each named by its smallest id, that join the same hashes as all pairs at most ``most`` bits apart do.

    Hashes meet on pairs of blocks of their bits, as in ``near_hashes``; those that share a pair of blocks are linked to the first of their kind, not pair by pair.
    """
    one = rows.filter(F.col(bits).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(bits).alias("bits")).agg(F.min(id_col).alias("id"))
    keys = F.array(*[F.struct(F.lit(n).alias("table"), F.col("bits").bitwiseAND(F.lit(mask)).alias("key")) for n, mask in enumerate(_block_pairs(most))])
    keyed = one.withColumn("k", F.explode(keys)).select("g", "k.*", "bits", "id").repartition("g", "table", "key").sortWithinPartitions("g", "table", "key", "id")
    kind = keyed.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last bucket so far
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if rows is None:
                return
            new = np.zeros(len(rows), bool)
            for c in range(3):
                column = rows.column(c)
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
            starts = np.flatnonzero(new)
            end = len(rows) if batch is None else int(starts[-1]) if len(starts) else 0
            held = rows.slice(end)
            bounds = np.unique([0, *starts[starts < end], end])
            hashes, a, b = rows.column(3).to_numpy().view(np.uint64), [], []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                at = bounds[i]
                first = _linked(hashes[at : bounds[i + 1]], most)
                own = np.flatnonzero(first != np.arange(len(first)))
                a.append(own + at)
                b.append(first[own] + at)
            if a:
                yield pa.RecordBatch.from_arrays([rows.column(4).take(pa.array(np.concatenate(x))).combine_chunks().cast(to_arrow_type(kind)) for x in (a, b)], ["a", "b"])

    return keyed.mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}").distinct()
