"""Lexical and hybrid retrieval over batches of queries: one index, score matrices by blocks, rank fusion, reranking, gates.

An index has a row for each document with its terms and how often they come, written once. A batch of queries is a small table
(query, term, weight); blocks of it of a fixed size go to all tasks, which score their documents in numpy and give back the best of
each batch only, so what is shuffled doesn't grow with documents times queries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.similarity import token_set_ratio
from ..functions.text import word_list, words
from ..functions.vectors import dot
from ..sources.scratch import written
from . import ranking
from .joins import skewed

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, POOL, HEAD, HEAD_CHARS = 60, 50, 20, 500
#: Cells (terms by queries, or components by queries) of a matrix: 32 MB.
CELLS = 1 << 22


@dataclass
class Index:
    """``rows`` (id, dl, terms: array of (term, tf)), how many there are and how long they are on average."""

    rows: DataFrame
    n: int
    avgdl: float

    def postings(self) -> DataFrame:
        return self.rows.select("id", "dl", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "dl")

    def frequencies(self) -> DataFrame:
        """(term, df)"""
        return self.rows.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def of(self, ids: DataFrame) -> Index:
        """The documents of ``ids`` (id), with the statistics of the whole collection."""
        return Index(self.rows.join(ids, "id", "left_semi"), self.n, self.avgdl)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than these; such a table is small, and a few files hold it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build_index(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of all documents, those without words too. Counting happens within a row, so only a table of few partitions is shuffled."""
    held = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    term = pa.struct([("term", pa.string()), ("tf", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counted = [Counter(word_list(t)) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, counted)])
                flat = pa.StructArray.from_arrays(
                    [pa.array([w for c in counted for w in c], pa.string()), pa.array([n for c in counted for n in c.values()], pa.int64())], fields=list(term)
                )
                terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.total() for c in counted], pa.int64()), terms], ["id", "dl", "terms"])

    kind = held.schema["id"].dataType.simpleString()
    rows = written(held.mapInArrow(count, f"id {kind}, dl long, terms array<struct<term: string, tf: long>>"), "index")
    n, avgdl = rows.agg(F.count(F.lit(1)), F.avg("dl")).first()
    return Index(rows, n, avgdl or 0.0)


def idf_of(df: Column, n: int, kind: str = "smooth") -> Column:
    """Inverse frequency by one of the three formulas in use: smooth, tfidf (which are equal but for a constant) and plain."""
    return {"smooth": F.log((n + 1) / (df + 1)) + 1, "tfidf": F.log((1 + n) / (1 + df)), "plain": F.log(1 + n / (1 + df))}[kind]


def idf_table(index: Index, kind: str = "smooth") -> DataFrame:
    """(term, df, idf)"""
    return index.frequencies().withColumn("idf", idf_of(F.col("df"), index.n, kind))


# ---- scoring by blocks


def _blocks(weights: DataFrame) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, terms, and of each weight its query, its term and itself) for blocks of the queries of ``weights`` (query_id, term, w) that have a bounded size.

    Queries are dealt to blocks by a hash; each block is gathered by itself, so memory is bounded by a block of about CELLS // 4 weights. Only weights
    are sent, not a matrix of all terms by all queries, so blocks, and passes over the index, are few.
    """
    weights = written(weights, "asked")
    n = max(1, math.ceil(weights.count() / (CELLS // 4)))
    for block in range(n):
        own = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).toArrow()
        if not len(own):
            continue
        q, t = own.column("query_id").combine_chunks().dictionary_encode(), own.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(q.indices.to_numpy(), kind="stable")
        yield q.dictionary, t.dictionary, q.indices.to_numpy()[order], t.indices.to_numpy()[order], own.column("w").to_numpy()[order]


def _matrices(queries: int, query: np.ndarray, term: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, terms in order, matrix of these terms by queries) for runs of a block's queries, of CELLS cells at most where a run has several."""
    ends, at = np.searchsorted(query, np.arange(queries), side="right"), 0
    while at < queries:
        begin = ends[at - 1] if at else 0
        # no more terms than weights
        cells = (ends[at:] - begin) * np.arange(1, queries - at + 1)
        many = max(1, int(np.searchsorted(cells, CELLS, side="right")))
        part = slice(begin, ends[at + many - 1])
        terms, place = np.unique(term[part], return_inverse=True)
        matrix = np.zeros((len(terms), many))
        np.add.at(matrix, (place, query[part] - at), w[part])
        yield at, terms, matrix
        at += many


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Which cells are among the k largest of their column; of equal ones those of the first rows."""
    if len(scores) <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    above, equal = scores > least, scores == least
    return above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0)))


def score_terms(
    index: Index, weights: DataFrame, k: int | None, part: str = "bm25", zeros: bool = False, scale: DataFrame | None = None
) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` documents of each query of ``weights`` (query_id, term, w), or all (without rank).

    A term of a document counts w times its part: ``bm25`` saturates tf by length, ``log`` is 1 + ln tf, ``one`` is 1; the sum is
    multiplied by ``scale`` (id, scale), and documents without one are left out. Scores are rounded to six digits; equal ones go by
    id. Documents without a term of the query come in only with ``zeros``.
    """
    id_type, mean = index.rows.schema["id"].dataType.simpleString(), index.avgdl or 1.0
    query_type = weights.schema["query_id"].dataType.simpleString()
    rows = index.rows.withColumn("scale", F.lit(1.0)) if scale is None else index.rows.join(scale, "id")
    found = []
    for block in _blocks(weights):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries, vocabulary, *weights = shared.value
            for batch in batches:
                batch = batch.take(pc.sort_indices(batch.column(0)))
                ids, dl, lists, scales = batch.column(0), batch.column(1).to_numpy().astype(float), batch.column(2), batch.column(3).to_numpy()
                counts = pc.list_value_length(lists).to_numpy()
                flat, number = lists.flatten(), len(lists)
                place = pc.fill_null(pc.index_in(flat.field(0), vocabulary), -1).to_numpy()
                known = place >= 0
                term_of, owner_of, tf = place[known], np.repeat(np.arange(number, dtype=np.int32), counts)[known], flat.field(1).to_numpy()[known].astype(float)
                del batch, lists, flat, place, known  # a batch of long documents has millions of terms
                if part == "bm25":
                    weight_of = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[owner_of] / mean))
                else:
                    weight_of = 1 + np.log(tf) if part == "log" else np.ones(len(tf))
                del tf
                for first, terms, matrix in _matrices(len(queries), *weights):
                    row_of = np.full(len(vocabulary), -1, np.int32)
                    row_of[terms] = np.arange(len(terms))
                    term = row_of[term_of]
                    own = term >= 0
                    term, owner, weight = term[own], owner_of[own], weight_of[own]
                    bounds, step = np.searchsorted(owner, np.arange(number + 1)), max(1, (CELLS // 4) // matrix.shape[1])
                    for at in range(0, number, step):
                        here = min(step, number - at)
                        scores = np.zeros((here, matrix.shape[1]))
                        for i in range(here):
                            a, b = bounds[at + i], bounds[at + i + 1]
                            if a < b:
                                scores[i] = weight[a:b] @ matrix[term[a:b]]
                        scores = np.round(scores * scales[at : at + here, None], 6) + 0.0
                        kept = _best(scores, k) if k else np.ones(scores.shape, bool)
                        row, column = np.nonzero(kept if zeros else kept & (scores != 0))
                        yield pa.RecordBatch.from_arrays([queries.take(pa.array(column + first)), ids.take(pa.array(row + at)), pa.array(scores[row, column])], ["query_id", "id", "score"])

        found.append(rows.select("id", "dl", "terms", "scale").mapInArrow(run, f"query_id {query_type}, id {id_type}, score double"))
    out = rows.sparkSession.createDataFrame([], f"query_id {query_type}, id {id_type}, score double") if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return ranking.top_k(out, ["query_id"], "score", "id", k) if k else out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, vector, ...) in the order of their ids, in pieces of CELLS // 4 numbers at most."""
    for batch in batches:
        if batch.num_rows:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            step = max(1, (CELLS // 4) * batch.num_rows // max(1, len(batch.column(1).flatten())))
            yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def _first(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, cell, score) of the ``k`` largest cells of each row by their rounded scores, of equal ones the first, that are not under its ``floor``.

    Cells of -inf are never among them. Only what is near a place is rounded.
    """
    n = scores.shape[1]
    under = lambda x: x - 1.1e-6 - 1e-15 * np.abs(x)  # noqa: E731 what may be equal to x when it is rounded
    bar = np.where(floor > -np.inf, under(np.where(floor > -np.inf, floor, 0.0)), np.finfo(float).min)
    near = scores >= bar[:, None]
    many = np.flatnonzero(near.sum(axis=1) > k)
    if n > k and len(many):
        near[many] = scores[many] >= np.maximum(bar[many], under(np.partition(scores[many], n - k, axis=1)[:, n - k]))[:, None]
    row, cell = np.nonzero(near)
    rounded = np.round(scores[row, cell], 6) + 0.0
    order = np.lexsort((cell, -rounded, row))
    row, cell, rounded = row[order], cell[order], rounded[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = (place < k) & (rounded >= floor[row])
    return row[best], place[best], cell[best], rounded[best]


def _search(
    batches: Iterator[pa.RecordBatch], names: pa.Array, matrix: np.ndarray, asked: list, k: int, per_group: bool = False, other_groups: bool = False, own_group: bool = False
) -> Iterator[pa.RecordBatch]:
    """(query_id, id, group, score): what ``batches`` (id, vector, group) have for the queries ``names`` of the rows of ``matrix``, of the groups ``asked``."""
    places: dict = {}
    for i, name in enumerate(names.to_pylist()):
        places.setdefault(name, []).append(i)
    best = np.full((len(names), k), -np.inf)  # scores of this task's best so far
    for batch in _pieces(batches):
        ids, lists, groups = (batch.column(i) for i in range(3))
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
        itself = np.array([(c, row) for row, name in enumerate(ids.to_pylist()) for c in places.get(name, ())], int).reshape(-1, 2)
        codes: dict = {}
        theirs = np.array([codes.setdefault(g, len(codes)) for g in groups.to_pylist()])
        wanted = np.array([codes.get(g, -1) for g in asked])
        step = max(1, (CELLS // 4) // len(lists))
        for at in range(0, len(names), step):
            scores = matrix[at : at + step] @ values.T
            here = itself[(itself[:, 0] >= at) & (itself[:, 0] < at + step)]
            scores[here[:, 0] - at, here[:, 1]] = -np.inf
            if other_groups:
                scores[wanted[at : at + step, None] == theirs] = -np.inf
            if own_group:
                scores[wanted[at : at + step, None] != theirs] = -np.inf
            for members in [np.flatnonzero(theirs == g) for g in range(len(codes))] if per_group else [None]:
                part, floor = (scores, best[at : at + step].min(axis=1)) if members is None else (scores[:, members], np.full(len(scores), -np.inf))
                column, place, row, score = _first(part, k, floor)
                if not len(row):
                    continue
                if members is None:
                    new, own = np.unique(column, return_inverse=True)
                    more = np.full((len(new), k), -np.inf)
                    more[own, place] = score
                    best[at + new] = np.partition(np.hstack([best[at + new], more]), k, axis=1)[:, k:]
                taken = pa.array(row if members is None else members[row])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(column + at)), ids.take(taken), groups.take(taken), pa.array(score)], ["query_id", "id", "group", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, per_group: bool = False, other_groups: bool = False, own_group: bool = False) -> DataFrame:
    """(query_id, id, group, score, rank): the ``k`` largest dot products of ``vectors`` (id, vector, group) with each of ``queries``
    (query_id, vector, group), itself excluded; with ``per_group`` of each group, with ``other_groups`` of other groups than its own, with
    ``own_group`` of that only.

    Queries go to all tasks by blocks of a fixed size; tasks multiply matrices, CELLS // 4 scores at once however many queries there are, and give
    back what is among the best of their rows so far. Scores are rounded to six digits, equal ones go by id.
    """
    types = [queries.schema["query_id"], vectors.schema["id"], vectors.schema["group"]]
    out_type = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(("query_id", "id", "group"), types, strict=True)) + ", score double"
    queries = written(queries.select("query_id", "vector", "group"), "queries")
    count, size = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks, found = max(1, -(-count * max(1, size or 1) // CELLS)), []
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not len(own):
            continue
        names, asked = own.column(0).combine_chunks(), own.column(2).to_pylist()
        matrix = own.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
        shared = vectors.sparkSession.sparkContext.broadcast((names, matrix, asked))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _search(batches, *shared.value, k, per_group, other_groups, own_group)

        found.append(vectors.select("id", "vector", "group").mapInArrow(run, out_type))
    out = vectors.sparkSession.createDataFrame([], out_type) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return ranking.top_k(out, ["query_id", "group"] if per_group else ["query_id"], "score", "id", k)


def nearest_centres(vectors: DataFrame, centres: DataFrame, k: int = 2) -> DataFrame:
    """(id, centre, score, rank): of every vector (id, vector) the ``k`` centres (centre, vector) with the largest cosine, rounded to nine digits.

    Centres are few: they go to all tasks as a matrix (at most CELLS numbers, else an error), and each batch of vectors is multiplied by it. Equal
    scores go by centre; no pair is shuffled.
    """
    held = centres.orderBy("centre").select("centre", "vector").collect()
    matrix = np.array([r.vector for r in held], float).reshape(len(held), -1)
    if matrix.size > CELLS:
        raise ValueError(f"{len(held)} centres are too many for a matrix of {CELLS} numbers")
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300) if len(held) else matrix
    names, shared = [r.centre for r in held], vectors.sparkSession.sparkContext.broadcast(matrix)
    types = [vectors.schema["id"].dataType.simpleString(), centres.schema["centre"].dataType.simpleString()]
    kind = to_arrow_type(centres.schema["centre"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            if not len(names) or not len(ids):
                continue
            scores = np.round(lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) @ shared.value.T, 9) + 0.0
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(ids)), order.shape[1])
            columns = [ids.take(pa.array(at)), pa.array([names[j] for j in order.ravel()], kind), pa.array(np.take_along_axis(scores, order, axis=1).ravel()), pa.array(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(ids)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "centre", "score", "rank"])

    return vectors.select("id", "vector").mapInArrow(run, f"id {types[0]}, centre {types[1]}, score double, rank int")


def nearest_of_several(vectors: DataFrame, queries: DataFrame, k: int, extra: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the largest product of an item with any of a question's vectors (query_id, part, vector); the best ``k``, and the
    ``extra`` items (query_id, id) that are to be scored too.

    The best of an item is among the best ``k`` of the vector that gives it, so each vector's best are enough.
    """
    none = F.lit(0).alias("group")
    parts = queries.select(F.struct("query_id", "part").alias("query_id"), "vector", none)
    found = nearest(vectors.select("id", "vector", none), parts.withColumn("query_id", F.to_json("query_id")), k)
    key = F.from_json("query_id", f"struct<query_id: {queries.schema['query_id'].dataType.simpleString()}>")["query_id"]
    best = found.select(key.alias("query_id"), "id", "score")
    out = ranking.top_k(best.groupBy("query_id", "id").agg(F.max("score").alias("score")), ["query_id"], "score", "id", k)
    if extra is None:
        return out
    more = extra.join(out.select("query_id", "id"), ["query_id", "id"], "left_anti").join(vectors.select("id", F.col("vector").alias("v")), "id").join(queries, "query_id")
    scored = more.groupBy("query_id", "id").agg(F.round(F.max(dot(F.col("v"), F.col("vector"))), 6).alias("score"))
    return out.unionByName(scored.withColumn("rank", F.lit(None).cast("int")))


# ---- lexical scores


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, times)"""
    return queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(queries: DataFrame, index: Index, k: int | None = POOL, zeros: bool = True, where: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): BM25 (k1 1.5, b 0.75) for each query (query_id, text).

    Inverse frequencies below zero become a quarter of the mean one over the whole vocabulary. ``where`` (id) limits the documents after
    the statistics are taken. With ``zeros``, places of the pool that no document with a common word takes go to the others, by id.
    """
    raw = F.log(index.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = written(index.frequencies().select("term", raw.alias("raw")), "frequencies")
    mean = terms.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))
    weights = terms.join(_asked(queries), "term").select("query_id", "term", (F.col("times") * idf).alias("w"))
    return score_terms(index if where is None else index.of(where), weights, k, "bm25", zeros)


def tfidf_neighbours(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the nearest other documents by cosine of (1 + ln tf) idf, for the ids in ``queries`` (query_id)."""
    idf = written(idf_table(index, "tfidf").filter("idf <> 0"), "idf")
    w = (1 + F.log("tf")) * F.col("idf")
    weighted = skewed(index.postings(), idf, "term", "df").select("id", (w * w).alias("square"))
    scales = written(weighted.groupBy("id").agg((1 / F.sqrt(F.sum("square"))).alias("scale")), "scales")
    own = index.of(queries.select(F.col("query_id").alias("id"))).postings().join(idf, "term").join(scales, "id")
    weights = own.select(F.col("id").alias("query_id"), "term", (w * F.col("idf") * F.col("scale")).alias("w"))
    scored = score_terms(index, weights, k + 1, "log", scale=scales).filter("id <> query_id").drop("rank")
    return ranking.top_k(scored, ["query_id"], "score", "id", k)


def recall_mass(queries: DataFrame, index: Index, k: int | None = None, kind: str = "smooth") -> DataFrame:
    """(query_id, id, mass, recall, rank): idf mass of the query's distinct words that a document has, and its share of all."""
    asked = _asked(queries).select("query_id", "term").join(idf_table(index, kind).select("term", F.col("idf").alias("w")), "term")
    asked = written(asked, "masses")
    total = asked.groupBy("query_id").agg(F.sum("w").alias("total"))
    met = score_terms(index, asked, k, "one").withColumnRenamed("score", "mass").join(total, "query_id")
    return met.select("query_id", "id", "mass", F.round(F.col("mass") / F.col("total"), 6).alias("recall"), *(["rank"] if k else []))


# ---- fusion, reranking, gates


def fuse_ranks(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion of lists (query_id, id, rank from 1); ties by id."""
    both = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("query_id", "id", "rank"))
    return both.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def rerank(hits: DataFrame, scorer: Column, head: int = HEAD) -> DataFrame:
    """``hits`` (query_id, id, rank, ...) in their new order: the head by ``scorer``, then the tail in the order it had.

    Tail scores go down by one from the head's least. ``scorer`` is any column, a pandas UDF of a model too; it is only
    computed for the head.
    """
    w = Window.partitionBy("query_id")
    scored = hits.withColumn("_new", F.when(F.col("rank") <= head, scorer))
    least = F.min("_new").over(w)
    score = F.when(F.col("rank") <= head, F.col("_new")).otherwise(least - 1 - (F.col("rank") - head - 1))
    out = scored.withColumn("new_score", score).drop("_new")
    return out.withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("new_score"), "rank")))


def refuse(hits: DataFrame, score: str, least: float) -> DataFrame:
    """Only the hits of queries whose best score reaches ``least``."""
    w = Window.partitionBy("query_id")
    return hits.withColumn("_best", F.max(score).over(w)).filter(F.col("_best") >= least).drop("_best")


def relax(strict: DataFrame, relaxed: DataFrame) -> DataFrame:
    """Per query the strict hits, or the relaxed ones where there are none; ``tier`` tells which."""
    without = relaxed.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    return strict.withColumn("tier", F.lit("strict")).unionByName(without.withColumn("tier", F.lit("relaxed")))


def matched(color: Column | None = None, grapes: Column | None = None, **equal: Column) -> Column:
    """The hard filter: AND of equalities where the wish isn't null, and any overlap of arrays; null actuals don't pass."""
    out = F.lit(True)
    for name, wish in equal.items():
        out = out & (wish.isNull() | F.coalesce(F.col(name) == wish, F.lit(False)))
    if color is not None:
        out = out & (color.isNull() | F.coalesce(F.col("color") == color, F.lit(False)))
    if grapes is not None:
        out = out & (grapes.isNull() | (F.size(grapes) == 0) | F.coalesce(F.arrays_overlap("grapes", grapes), F.lit(False)))
    return out


def fuse_scores(
    visual: DataFrame, text: DataFrame, weight: float = 0.2, pad: float = 0.03, penalty: Column | None = None, makers: DataFrame | None = None, unconfirmed: float = 1.0, least_recall: float = 0.5
) -> DataFrame:
    """(query_id, id, cv, relative, final): visual plus weighted relative text score over the union of both candidate sets.

    A candidate without a visual score gets the best one less ``pad``; relative is the mass over the query's largest. With ``makers`` (query_id, id, recall)
    the relative score of a candidate whose maker the text confirms by less than ``least_recall`` is multiplied by ``unconfirmed``, after that.
    """
    best = visual.groupBy("query_id").agg(F.max("score").alias("_top"))
    both = visual.select("query_id", "id", F.col("score").alias("cv")).join(text.select("query_id", "id", "mass"), ["query_id", "id"], "full")
    both = both.join(best, "query_id")
    w = Window.partitionBy("query_id")
    relative = F.coalesce(F.try_divide(F.coalesce("mass", F.lit(0.0)), F.max("mass").over(w)), F.lit(0.0))
    both = both.withColumn("relative", relative).withColumn("cv", F.coalesce("cv", F.col("_top") - pad))
    if makers is not None:
        both = both.join(makers.select("query_id", "id", F.col("recall").alias("_recall")), ["query_id", "id"], "left")
        both = both.withColumn("relative", F.col("relative") * F.when(F.coalesce("_recall", F.lit(0.0)) < least_recall, unconfirmed).otherwise(1.0))
    final = F.col("cv") + weight * F.col("relative")
    return both.withColumn("final", final if penalty is None else final - penalty).select("query_id", "id", "cv", "relative", "final")


def confident(fused: DataFrame, families: DataFrame, cv_floor: float = 0.80, gap_floor: float = 0.03) -> DataFrame:
    """(query_id, id, cv, final, gap, confident) of each query's best: ``gap`` is its lead over the best of another family (id, family).

    Ids without a family are families of their own. The gap is null where no other family is among the candidates; then the visual
    floor alone decides.
    """
    held = fused.join(families.select("id", "family"), "id", "left")
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), "id")
    placed = held.withColumn("_n", F.row_number().over(w)).withColumn("_best", F.first("family", ignorenulls=False).over(w))
    other = (F.col("_n") > 1) & ~F.coalesce(F.col("family") == F.col("_best"), F.lit(False))
    first = lambda c: F.max(F.when(F.col("_n") == 1, F.col(c))).alias(c)
    best = placed.groupBy("query_id").agg(first("id"), first("cv"), first("final"), F.max(F.when(other, F.col("final"))).alias("_next"))
    gap = F.col("final") - F.col("_next")
    return best.select("query_id", "id", "cv", "final", gap.alias("gap"), ((F.col("cv") >= cv_floor) & (gap.isNull() | (gap >= gap_floor))).alias("confident"))


#: Weight of the token set ratio beside the shared idf mass.
FUZZY_WEIGHT = 0.35


def distinctive_idf(idf: DataFrame) -> float:
    """The upper median of a vocabulary's idf (word, idf): words from it on tell something."""
    from .metrics import at_places

    found = at_places(idf, [], "idf", {"m": F.floor(F.col("total") / 2)}).first()
    return float(found.m) if found and found.m is not None else 0.0


def rerank_by_text(hits: DataFrame, queries: DataFrame, cards: DataFrame, idf: DataFrame, k: int = 10, weight: float = 1.0, least_idf: float | None = None) -> DataFrame:
    """(query_id, id, score, final, rank): ``hits`` (query_id, id, score, rank) of which the first ``k`` are ordered anew by text.

    To the score of these comes ``weight`` times the share of the card's idf mass (word, idf; unknown words count 1) that the query's tokens have, plus 0.35
    times the token set ratio. Queries (query_id, text) and cards (id, text) are normalised texts. A query without a word of
    ``least_idf``, a blank one and unknown cards add nothing. Later hits keep score and place; equal ones keep their order.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " +"), lambda x: x != ""))
    q = queries.select("query_id", F.trim("text").alias("q"), tokens(F.col("text")).alias("qs")).filter("q <> ''")
    if least_idf is not None:
        asked = q.select("query_id", F.explode("qs").alias("word"))
        q = q.join(asked.join(idf.filter(F.col("idf") >= least_idf), "word", "left_semi").select("query_id").distinct(), "query_id", "left_semi")
    head = hits.filter(F.col("rank") <= k)
    c = cards.select("id", F.trim("text").alias("c"), tokens(F.col("text")).alias("cs")).filter("c <> ''").join(head.select("id").distinct(), "id", "left_semi")
    met = head.select("query_id", "id").join(q, "query_id").join(c, "id")
    each = met.select("query_id", "id", F.explode("cs").alias("word"), "qs").join(idf.select("word", "idf"), "word", "left")
    value = F.coalesce("idf", F.lit(1.0))
    mass = each.groupBy("query_id", "id").agg(F.try_divide(F.sum(F.when(F.array_contains("qs", F.col("word")), value).otherwise(0.0)), F.sum(value)).alias("_share"))
    added = met.select("query_id", "id", (token_set_ratio("q", "c") / 100).alias("_ratio")).join(mass, ["query_id", "id"])
    out = hits.join(added.select("query_id", "id", (F.coalesce("_share", F.lit(0.0)) + FUZZY_WEIGHT * F.col("_ratio")).alias("_text")), ["query_id", "id"], "left")
    out = out.withColumn("final", F.when(F.col("rank") <= k, F.col("score") + weight * F.coalesce("_text", F.lit(0.0))).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy((F.col("rank") > k).cast("int"), F.when(F.col("rank") <= k, -F.round("final", 9)), "rank")
    return out.withColumn("_new", F.row_number().over(order)).select("query_id", "id", "score", "final", F.col("_new").alias("rank"))
