"""Document fingerprints: SimHash of weighted terms, with permuted block tables to search them.

Terms are word pairs; each votes with its weight on 64 signed bits. The 64 bits are cut into radius + 2 blocks, so two
fingerprints within the radius agree in two blocks at least: there is one table for each pair of blocks, keyed by what
stands in them (26 bits for radius 3), and fingerprints meet where their keys are equal. Whole distances decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .exact_dedup import misra_gries
from .tables import join_hot, materialise, width

RADIUS = 3
CELLS = 1 << 22  # comparisons made at once
#: Fingerprints of one key that are compared within a task; more are compared block by block, in many tasks.
CROWD = 8192
#: Bytes of text of a bucket of ids, about, and ids of the sample that bounds are taken from, for each bucket.
BUCKET, BOUND_SAMPLE = 16 << 20, 32


def simhash(text: str) -> int:
    """The unsigned fingerprint of a text: 0 without words; equal texts have equal fingerprints.

    A-Z are lower-cased; a text of one word has that word as its term. A term that comes n times weighs 1 + ln n.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    terms = [a + b" " + b for a, b in pairwise(words)] or words
    seen, times = np.unique(np.frombuffer(b"".join([xxh64_digest(t, 7) for t in terms]), ">u8"), return_counts=True)
    weight = np.rint(64 * (1 + np.log(times)))  # whole numbers: their sums don't depend on the order
    votes = np.zeros(64)
    for at in range(0, len(seen), 1 << 14):
        bits = np.unpackbits(seen[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1)
        votes += weight[at : at + (1 << 14)] @ bits
    return int.from_bytes(np.packbits(2 * votes > weight.sum()).tobytes(), "big")


def _likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


# ---- fingerprints of documents, of their edited texts, and of the documents that follow them


def _bucket_of(key: Column, bounds: DataFrame) -> tuple[Column, int]:
    """How many of ``bounds`` (one column of structs, sorted; few) are below a key, by bisection, and the number of buckets."""
    found = [r[0] for r in bounds.collect()]
    if not found:
        return F.lit(0), 1
    kinds = bounds.schema[0].dataType
    listed = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kinds, strict=True)]) for b in found])
    n, steps = len(found), [1 << i for i in reversed(range(len(found).bit_length()))]
    step = lambda at, s: F.when((at + s <= n) & (F.element_at(listed, F.least(at + s, F.lit(n))) < key), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step), n + 1


def _bucketed(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, int]:
    """(bucket, tail, id, tie, text): ranges of (id, tie), each with the row that follows it in descending order as its tail.

    ``tie`` is a hash of the text, so equal and null ids are parted too. Only bucket bounds, from a sample, and the first key
    of each bucket pass through the driver; the number of buckets grows with the texts, so that a bucket doesn't.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.struct("id", F.xxhash64("text").alias("tie"))
    total = rows.count()
    mean = rows.sample(min(1.0, 4096 / max(1, total)), seed=3).agg(F.avg(F.octet_length("text"))).first()[0] or 0
    n = max(4 * width(docs), int(total * mean) // BUCKET)
    sampled = rows.sample(min(1.0, BOUND_SAMPLE * n / max(1, total)), seed=4).select(key.alias("key"))
    place = F.floor((F.percent_rank().over(Window.orderBy("key"))) * n)  # the sample is in one partition: a few rows a bucket
    bounds = sampled.withColumn("place", place).groupBy("place").agg(F.min("key").alias("key")).select("key").distinct().orderBy("key")
    bucket, n = _bucket_of(key, bounds)
    rows = rows.select(bucket.alias("bucket"), "id", key["tie"].alias("tie"), "text")
    head = F.struct("id", "tie")
    heads = rows.groupBy("bucket").agg(F.max(head).alias("head")).orderBy("bucket").collect()
    follows = [(h.bucket, heads[i - 1].head.id, heads[i - 1].head.tie) for i, h in enumerate(heads)]
    kind = rows.schema["id"].dataType.simpleString()
    tails = F.broadcast(docs.sparkSession.createDataFrame(follows, f"to int, head_id {kind}, head_tie long"))
    same = rows["id"].eqNullSafe(tails["head_id"]) & (rows["tie"] == tails["head_tie"])
    met = rows.join(tails, same, "left")
    both = F.array(F.struct(F.lit(False).alias("tail"), F.col("bucket").alias("bucket")), F.struct(F.lit(True).alias("tail"), F.col("to").alias("bucket")))
    placed = met.select(F.explode(F.filter(both, lambda x: x["bucket"].isNotNull())).alias("at"), "id", "tie", "text")
    return placed.select("at.bucket", "at.tail", "id", "tie", "text"), n


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) for each row; see ``document_fingerprints``."""
    rows, buckets = _bucketed(docs, text_col, id_col)
    # one bucket a partition: neighbours by hash would make some partitions several times as large as others
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.desc_nulls_last("id"), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: bucket, id, text, fp; it is done when the next of its bucket has come
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i) for i in range(3)] + [batch.column(4)]
            for bucket, tail, id_, text in zip(*(c.to_pylist() for c in columns), strict=True):
                fp = simhash(text)
                if last and last[0] == bucket:
                    _, past_id, past, past_fp = last
                    half = len(past) // 2
                    edited = past[: len(past) - half] + text[:half]
                    edited_fp = simhash(edited)
                    digest = sha256(edited.encode()).hexdigest()
                    out.append((past_id, len(past), digest, past_fp, edited_fp, _likeness(past_fp, edited_fp), _likeness(past_fp, fp)))
                last = None if tail else (bucket, id_, text, fp)
            if out:
                id_, n, digest, fp, edited_fp, near_edited, near_next = zip(*out, strict=True)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, edited_fp)]
                arrays = [pa.array(id_, batch.schema.field(2).type), pa.array(n, pa.int64()), pa.array(digest), *signed, pa.array(near_edited), pa.array(near_next)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
    )


# ---- permuted block tables


def block_tables(radius: int = RADIUS) -> list[int]:
    """The mask of each table: two of radius + 2 near-equal blocks."""
    parts = radius + 2
    cuts = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(cuts)]
    return [x | y for x, y in combinations(blocks, 2)]


def _met(own: np.ndarray, fps: np.ndarray, copies: np.ndarray, table: int, masks: np.ndarray, radius: int) -> np.ndarray:
    """For each of ``own``, the copies of others among ``fps``, of the same key of ``table``, within the radius.

    A pair that an earlier table also brings together is that table's.
    """
    found = np.zeros(len(own), np.int64)
    step = max(1, CELLS // max(1, len(fps)))
    for at in range(0, len(own), step):
        apart = own[at : at + step, None] ^ fps[None, :]
        near = (np.bitwise_count(apart) <= radius) & (apart != 0)
        for mask in masks[:table]:
            near &= (apart & mask) != 0
        found[at : at + step] = near @ copies
    return found


def _crowded(tables: DataFrame, crowd: int) -> DataFrame:
    """(table, key, n): the keys of more than ``crowd`` rows among those that Misra-Gries summaries find; 1,023 rows at most."""
    hashed = tables.select("table", "key", F.xxhash64("table", "key").alias("at"))
    found = materialise(misra_gries(hashed, "at"), "frequent-keys")
    counted = hashed.join(F.broadcast(found.select("at")), "at").groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counted.filter(F.col("n") > crowd), "crowded-keys")


def neighbour_counts(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(fp, near): for each fp of ``distinct`` (fp, copies), how many rows have another one within the radius.

    Only counts leave a task, never pairs. Of a key that more than ``crowd`` fingerprints share, blocks of about that many are
    compared two by two, each in a task of its own; keys of more than a five-hundredth of all rows go to their blocks from
    where they are read, so no task gets all of such a key.
    """
    masks = np.array(block_tables(radius), np.uint64)
    signed = masks.view(np.int64).tolist()
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    tables = distinct.select("fp", "copies", F.explode(keys).alias("at")).select("at.table", "at.key", "fp", "copies")
    here = Window.partitionBy("table", "key")
    crowded = _crowded(tables, crowd) if distinct.count() > crowd else None  # else no key can have so many
    known = tables.withColumn("n", F.lit(None).cast("long")) if crowded is None else tables.join(F.broadcast(crowded), ["table", "key"], "left").select("table", "key", "fp", "copies", "n")
    rest = known.filter("n IS NULL").repartition(width(distinct), "table", "key").withColumn("n", F.count(F.lit(1)).over(here))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, runs in _runs(batches):
            outs = []
            for asks, asked, fp, copies in runs:
                others = fp[asked]
                near = _met(fp[asks].view(np.uint64), others.view(np.uint64), copies[asked], table, masks, radius)
                outs.append((fp[asks][near > 0], near[near > 0]))
            found, near = (np.concatenate(x) for x in zip(*outs, strict=True))
            if len(found):
                yield pa.RecordBatch.from_pydict({"fp": found, "near": near})

    both = [F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(True).alias("asks"), F.lit(True).alias("asked")]
    few = rest.filter((F.col("n") > 1) & (F.col("n") <= crowd)).select("table", "key", *both, "fp", "copies")
    blocks = F.ceil(F.col("n") / crowd).cast("int")
    many = rest.filter(F.col("n") > crowd)
    if crowded is not None:
        many = many.unionByName(known.filter("n IS NOT NULL"))
    many = many.withColumn("mine", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # block a asks block b
    side = lambda a, b, asks: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(asks).alias("asks"), F.lit(not asks).alias("asked"))
    many = many.select("table", "key", F.explode(F.array(side("mine", "other", True), side("other", "mine", False))).alias("at"), "fp", "copies")
    many = many.select("table", "key", "at.*", "fp", "copies")
    many = many.repartition(width(distinct), "table", "key", "a", "b").sortWithinPartitions("table", "key", "a", "b")
    near = [x.mapInArrow(compare, "fp long, near long") for x in (few, many)]
    return near[0].unionByName(near[1]).groupBy("fp").agg(F.sum("near").alias("near"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(table, [(asks, asked, fp, copies) of each run of equal keys]) of sorted batches; a run may span several of them."""
    held: list[list[np.ndarray]] = []
    for batch in _and_end(batches):
        new = [] if batch is None else [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]]
        if new and held and all(held[-1][i][-1] == new[0][i][0] == new[0][i][-1] for i in range(4)):
            held += new  # the whole batch is of the run that is open
            continue
        if not (held := held + new):
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        new_run = np.zeros(len(columns[0]), bool)
        new_run[0] = True
        for c in columns[:4]:
            new_run[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new_run)
        ends = np.r_[starts[1:], len(new_run)]
        held = []
        if batch is not None:  # the last run may go on
            held = [[c[starts[-1] :] for c in columns]]
            starts, ends = starts[:-1], ends[:-1]
        for table in np.unique(columns[0][starts]) if len(starts) else ():
            of = columns[0][starts] == table
            yield int(table), [tuple(c[a:b] for c in columns[4:]) for a, b in zip(starts[of], ends[of], strict=True)]


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def document_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, its edited text's, and likenesses (1 - differing bits / 64).

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next document's.
    Documents follow each other by descending id, null ids last, equal ids by a hash of the text; the first follows the last,
    and a document that is alone follows itself. ``near_docs`` counts the other rows with a fingerprint within the radius,
    equal ones included. A null text counts as empty and has fingerprint zero. Ids may be of any ordered type; rows that repeat
    both id and text are rows of their own. Only the id and the text are read, texts whole, however long.
    """
    rows = materialise(with_next(docs, text_col, id_col), "document-fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")), "counted-fingerprints")
    near = neighbour_counts(distinct, radius)
    around = distinct.join(near.withColumnRenamed("fp", "near_fp"), F.col("fp") == F.col("near_fp"), "left").select(
        "fp", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("near_docs")
    )
    hex_ = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return join_hot(rows, materialise(around, "neighbours"), "fp", "copies").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hex_("fp").alias("fingerprint"),
        hex_("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "near_docs",
    )
