"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

The mix is made of equal blocks of words. Highest quotients share the blocks out among the sources by their targets, then
each source's blocks among its shards by their words, so every shard has an integer quota. Within a shard the documents
lie in a seeded order on a line of blocks; the quota takes the whole line as often as it goes in and then a run of
consecutive blocks from a seeded start, round the end. So a document is taken whole, but for those at a run's ends, and
what is taken of it follows from its place alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

#: Words of a block; words of a shard, about (a shard's documents are put in order in one task); most epochs.
BLOCK, SHARD, EPOCHS = 16, 1 << 20, 3
#: Sources up to which their table is broadcast (about 100 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Runs of what isn't ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def apportion(votes: DataFrame, group: list[str], key: str, vote: str, seats: str) -> DataFrame:
    """Adds ``quota``: Sainte-Lague's share, for each row of ``group``, of the group's seats (a column, same in a group).

    Ties go to the smaller key. Seats that a lower bound already gives are not enumerated: with divisor total / (seats -
    n / 2), rounding gives no row more than its final share and leaves at most n seats, n being the rows of the group; a
    row's final share is at most what the divisor total / (seats + n / 2) gives. Between the two lie about 2 n quotients,
    of which the highest win. Rows without votes get no seats.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    df = votes.withColumn("_total", F.sum(vote).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    share = F.when(F.col("_total") > 0, F.col(vote) / F.col("_total")).otherwise(F.lit(0.0))
    low = F.when(F.col(seats) > F.col("_n"), F.floor(share * (F.col(seats) - F.col("_n") / 2) + 0.5 - 1e-9)).otherwise(F.lit(0))
    high = F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5 + 1e-9)
    df = df.withColumn("_low", F.greatest(low - 1, F.lit(0)).cast("long")).withColumn("_high", F.when(F.col(vote) > 0, high + 1).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    bids = df.filter("_high > _low").select(
        *group, key, "_left", F.col(vote).alias("_vote"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_seat")
    )
    order = w.orderBy(F.desc(F.col("_vote") / (2 * F.col("_seat") - 1)), F.col(key).asc_nulls_last())
    won = (
        bids.withColumn("_place", F.row_number().over(order))
        .filter("_place <= _left")
        .groupBy(*[F.col(c).alias(f"_{c}") for c in [*group, key]])
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    same = [df[c].eqNullSafe(won[f"_{c}"]) for c in [*group, key]]
    return df.join(won, same, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).select(*votes.columns, "quota")


def targets(sources: DataFrame, total: int, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): ``total`` shared by weight, none above ``epochs`` times its size.

    What is above is shared again by weight among the others until none is above. Each round adds a scalar sum; there are as
    many as different rounds of sources reach their limit.
    """
    limit = F.col("source_size") * epochs
    level = 0.0
    while True:
        open_ = limit > F.col("weight") * F.lit(level)
        weight, held = sources.agg(
            F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(~open_, limit).otherwise(F.lit(0)))
        ).first()
        after = (total - (held or 0)) / weight if weight else level
        if not weight or after <= level:
            break
        level = after
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level))))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def mix(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    block: int = BLOCK,
    shard: int = SHARD,
    epochs: int = EPOCHS,
    seed: int = 8,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    ``size`` counts words (null text: 0). Sources in code point order, null last, weigh ``weights`` in turn, and
    together they are to give as many words as there are. ``taken`` is the words that the mix takes of a document, repeats
    counted, ``epochs`` times its size at most; a document without words gives none. Repeated rows are rows of their own
    and may be taken differently. The same rows give the same mix however they are partitioned, but for which of two
    wholly equal (id, text) rows is which. Texts are counted whole, however long; only id, text and source are read, so other
    columns may have any names. Up to BROADCAST_ROWS sources their table is broadcast, beyond it is shuffled: the rows are the same.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    sized = materialise(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: the order of the sources is a global one
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialise(sources.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int"))), "sources")
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    aimed = targets(sources, total, epochs).withColumn("seats", F.lit(round(total / block)).cast("long"))
    aimed = apportion(aimed, [], "source", "target", "seats").select(
        F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("source_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).alias("shards"),
    )
    aimed = materialise(aimed, "aimed")
    side = F.broadcast(aimed) if n <= BROADCAST_ROWS else aimed
    met = sized.join(side, sized["source"].eqNullSafe(aimed["_source"]))
    empty = met.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))  # they have no place on a line
    dealt = met.filter("size > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "size", "tie"), F.col("shards")))

    line = dealt.groupBy("_source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    quotas = apportion(line, ["_source"], "shard", "words", "source_quota").select(
        F.col("_source").alias("q_source"), F.col("shard").alias("q_shard"), "words", "quota"
    )
    quotas = materialise(quotas, "quotas")

    order = Window.partitionBy("_source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size", "tie")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = placed.join(quotas, placed["_source"].eqNullSafe(quotas["q_source"]) & (placed["shard"] == quotas["q_shard"]))

    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block))
    quota = F.least("quota", blocks * epochs)
    whole, rest = F.floor(quota / blocks), quota % blocks
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "shard"), blocks)
    a, b = F.col("end") - F.col("size"), F.col("end")
    run_end = first + rest  # in blocks; what is beyond the line's end goes on at its start
    run = _overlap(a, b, first * block, F.least(run_end * block, F.col("words"))) + F.when(
        run_end > blocks, _overlap(a, b, F.lit(0), (run_end - blocks) * block)
    ).otherwise(F.lit(0))
    names = ["id", "size", "source_size", "target", "taken", "source"]
    out = met.withColumn("taken", (F.col("size") * whole + run).cast("long")).select(*names).unionByName(empty.select(*names))
    return out.withColumnsRenamed({"id": id_col, "source": source_col})


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as documents, with all columns of ``docs``: each as often as ``taken / size`` says, rounded half up.

    Only the documents at the ends of a run are taken in part; they come whole or not at all. Ids name documents: of
    rows that repeat an id, each comes as often as the id's largest ``taken / size`` says.
    """
    taken = mix(docs, text_col, id_col, **options).filter("taken > 0")
    times = taken.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("_times"))
    met = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(times.filter("_times > 0"), F.col(f"row.`{id_col}`").eqNullSafe(F.col("_id")))
    return met.select("row", F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).select("row.*")
