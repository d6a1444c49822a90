"""Style matching and analogs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import written
from .joins import skewed
from .retrieval import spread

# Least score of a style, least number of shared axes, bonus of a typical grape.
THRESHOLD, MIN_SHARED, BONUS = 0.80, 3, 0.10


def style_score(item: Column, style: Column, axes: list[str], bonus: Column) -> Column:
    """1 less half the mean and half the largest difference over shared axes, plus the bonus, 1 at most; null under three axes."""
    diffs = F.filter(F.array(*[F.abs(item[a] - style[a]) for a in axes]), lambda d: d.isNotNull())
    mean = F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d) / F.size(diffs)
    score = 1 - (0.5 * mean + 0.5 * F.array_max(diffs)) + F.when(bonus, BONUS).otherwise(0.0)
    return F.when(F.size(diffs) >= MIN_SHARED, F.least(F.lit(1.0), score))


def match_styles(pairs: DataFrame, item: str, style: str, score: str = "score", n: int = 3, least: float = THRESHOLD) -> DataFrame:
    """The first ``n`` styles of each item by score, then style descending, of those that reach ``least``."""
    w = Window.partitionBy(item).orderBy(F.desc_nulls_last(score), F.desc(style))
    return pairs.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= n) & (F.col(score) >= least))


def one_per_maker(scored: DataFrame, item: str, maker: str, other: str, score: str, n: int) -> DataFrame:
    """Per item the best of each maker, then the first ``n``."""
    best = Window.partitionBy(item, maker).orderBy(F.desc(score), other)
    first = scored.withColumn("_of_maker", F.row_number().over(best)).filter("_of_maker = 1").drop("_of_maker")
    w = Window.partitionBy(item).orderBy(F.desc(score), other)
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Cards that go to the tasks at once; cells (asked cards by cards, or by words) that a task holds of them.
BLOCK, CELLS = 16384, 1 << 20
# Weights of grapes, region and description; from which likeness on a description is a reason; names of grapes that say nothing.
GRAPES, REGION, DESCRIPTION, ALIKE = 3.0, 1.0, 2.0, 0.25
GENERIC_GRAPES = ("белые сорта винограда", "красные сорта винограда", "розовые сорта винограда", "купаж", "белые сорта", "красные сорта")


def description_vectors(cards: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, vector): of cards (id, words) a map of (1 + ln tf) ln((1 + N) / (1 + df)) by word, of length one; cards without words have an empty one."""
    n = cards.count()
    tf = cards.select("id", F.explode("words").alias("word")).filter(~F.coalesce(F.col("word").isin(*stop), F.lit(False))).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = written(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("rows", F.col("df")), "words")
    w = skewed(tf, df, "word", "rows").select("id", "word", ((1 + F.log("tf")) * F.log((1 + F.lit(n)) / (1 + F.col("df")))).alias("w"))
    by = w.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "w")))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = F.transform_values("m", lambda _, v: v / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    none = F.create_map().cast("map<string, double>")
    held = cards.select("id").join(by.select("id", scaled.alias("vector")).hint("merge"), "id", "left").select("id", F.coalesce("vector", none).alias("vector"))
    return held.hint("merge")  # maps are not to be broadcast, however small they seem


def analogs(cards: DataFrame, asked: DataFrame, n: int = 6, block: int = BLOCK) -> DataFrame:
    """(item, other, maker, score, rank, reasons): for the ``asked`` cards (id) the ``n`` most like them, of one category and sparkle, of other makers, one of each.

    Cards: id, maker, category, sparkling, grapes (array), sweetness (a step), region and vector (of ``description_vectors``). 1, and 3 times the Jaccard
    index of the grapes that say something, 2 for equal and 0.7 for neighbouring sweetness, 1 for the region, twice the cosine of the
    descriptions. Reasons: ``color``, ``grapes``, ``sweetness``, ``sparkling``, ``region``, ``description``. Equal scores go by id.

    Asked cards go to the tasks in blocks of about ``block`` rows, against all cards; tasks score CELLS pairs at once and send on what may be among
    the best of each asked card only, the best card of each maker.
    """
    plain = F.filter(F.array_distinct(F.transform(F.coalesce("grapes", F.array().cast("array<string>")), F.lower)), lambda g: ~g.isin(*GENERIC_GRAPES))
    rows = spread(cards).select("id", "maker", "category", F.coalesce("sparkling", F.lit(False)).alias("sparkling"), plain.alias("grapes"), F.col("sweetness").cast("double"), "region", F.map_entries(F.col("vector").cast("map<string, double>")).alias("words"))
    held = written(rows, "cards")
    own = written(held.join(asked.select("id").distinct(), "id", "left_semi"), "asked-cards")
    types = held.schema["id"].dataType, held.schema["maker"].dataType
    kinds, blocks, found = [t.simpleString() for t in types], max(1, -(-own.count() // block)), None
    for b in range(blocks):
        shared = held.sparkSession.sparkContext.broadcast(own.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _compared(batches, shared.value, n, to_arrow_type(types[0]), to_arrow_type(types[1]))

        part = held.mapInArrow(run, f"item {kinds[0]}, other {kinds[0]}, maker {kinds[1]}, score double, why int")
        found = part if found is None else found.unionByName(part)
    top = found.groupBy("item", "maker").agg(F.min(F.struct((-F.col("score")).alias("low"), "other", "why")).alias("b")).select("item", "maker", "b.*")
    w = Window.partitionBy("item").orderBy("low", "other")
    reasons = F.array_compact(F.array(*[F.when(F.col("why").bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(("color", "grapes", "sweetness", "sparkling", "region", "description"))]))
    return top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("item", "other", "maker", (-F.col("low")).alias("score"), "rank", reasons.alias("reasons"))


def _codes(column: pa.Array, known: pa.Array, unknown: int) -> np.ndarray:
    """The places of values in ``known``; ``unknown`` for others and nulls."""
    return pc.fill_null(pc.index_in(column, known), unknown).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of lists one after the other, and how many each has."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _products(matrix: np.ndarray, place: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(asked cards, cards): for each card the sum of the rows ``place`` of ``matrix`` (terms, asked cards) times their weights; places under 0 count nothing."""
    out = np.zeros((len(sizes), matrix.shape[1]))
    owner, known = np.repeat(np.arange(len(sizes)), sizes), place >= 0
    owner, place, weight = owner[known], place[known], weight[known]
    step = max(1, CELLS // max(1, matrix.shape[1]))
    for at in range(0, len(owner), step):
        own = owner[at : at + step]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[starts]] += np.add.reduceat(matrix[place[at : at + step]] * weight[at : at + step, None], starts, axis=0)
    return out.T


def _compared(batches: Iterator[pa.RecordBatch], asked: pa.Table, n: int, id_type: pa.DataType, maker_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(item, other, maker, score, why): of each asked card what may be among its ``n`` best cards of different makers; ``why`` has a bit for each reason."""
    if not len(asked):
        return
    column = lambda name: asked.column(name).combine_chunks()
    whole = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    distinct = lambda name: whole(pc.unique(asked.column(name)).drop_null())
    kinds, regions, makers, items = distinct("category"), distinct("region"), distinct("maker"), column("id")
    kind = np.where((k := _codes(column("category"), kinds, -1)) < 0, -1, 2 * k + column("sparkling").to_numpy(zero_copy_only=False))
    region, maker, sweetness = _codes(column("region"), regions, -1), _codes(column("maker"), makers, -1), column("sweetness").to_numpy(zero_copy_only=False)
    grapes, g_sizes = _lists(column("grapes"))
    words, w_sizes = _lists(column("words"))
    floor = np.full(len(asked), np.iinfo(np.int64).min)  # millionths that a card needs here
    for batch in (b.slice(at, 1 << 16) for b in batches for at in range(0, b.num_rows, 1 << 16)):
        batch = batch.take(pc.sort_indices(batch.column(0)))
        of = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        its_kind = np.where((k := _codes(of["category"], kinds, -1)) < 0, -1, 2 * k + of["sparkling"].to_numpy(zero_copy_only=False))
        own_maker = of["maker"].dictionary_encode(null_encoding="encode").indices.to_numpy()
        for each in np.intersect1d(its_kind[its_kind >= 0], kind):
            rows = np.flatnonzero(its_kind == each)
            rows = rows[np.argsort(own_maker[rows], kind="stable")]  # by maker, then id
            part = batch.take(pa.array(rows))
            of = {f: part.column(i) for i, f in enumerate(part.schema.names)}
            (g, g_n), (w, w_n) = _lists(of["grapes"]), _lists(of["words"])
            same_maker, same_region, step_of = _codes(of["maker"], makers, -2), _codes(of["region"], regions, -2), of["sweetness"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(own_maker[rows], prepend=-1))
            mine = np.flatnonzero(kind == each)
            size = max(1, CELLS // max(len(rows), 256))
            for at in range(0, len(mine), size):
                here = mine[at : at + size]
                terms = lambda values, sizes, here=here: (np.repeat(np.arange(len(here)), sizes[here]), values.take(pa.array(np.concatenate([np.arange(e - m, e) for e, m in zip(np.cumsum(sizes)[here], sizes[here], strict=True)]).astype(np.int64))))
                owner, said = terms(grapes, g_sizes)
                vocabulary = said.unique()
                matrix = np.zeros((len(vocabulary), len(here)))
                matrix[_codes(said, vocabulary, -1), owner] = 1
                both = _products(matrix, _codes(g, vocabulary, -1), np.ones(len(g)), g_n)
                union = g_sizes[here][:, None] + g_n[None, :] - both
                share = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
                owner, said = terms(words, w_sizes)
                vocabulary = said.field(0).unique()
                matrix = np.zeros((len(vocabulary), len(here)))
                matrix[_codes(said.field(0), vocabulary, -1), owner] = said.field(1).to_numpy(zero_copy_only=False)
                alike = np.round(_products(matrix, _codes(w.field(0), vocabulary, -1), w.field(1).to_numpy(zero_copy_only=False), w_n), 9)
                apart = np.abs(sweetness[here][:, None] - step_of[None, :])
                near = np.where(apart == 0, 2.0, np.where(apart == 1, 0.7, 0.0))
                there = region[here][:, None] == same_region[None, :]
                millionths = np.rint((1 + GRAPES * share + near + REGION * there + DESCRIPTION * alike) * 1e6).astype(np.int64)
                # a number of the score and, for equal ones, of the place by id: the largest of a maker is its best card
                key = ((millionths + (1 << 41)) << 20) + ((1 << 20) - 1 - rows[None, :])
                itself = _codes(of["id"], items.take(pa.array(here)), -1)
                key[maker[here][:, None] == same_maker[None, :]] = -1
                key[itself[itself >= 0], np.flatnonzero(itself >= 0)] = -1
                best = np.maximum.reduceat(key, starts, axis=1)
                if best.shape[1] > n:
                    best = np.partition(best, best.shape[1] - n, axis=1)[:, -n:]
                if best.shape[1] == n:
                    least = best.min(axis=1)
                    floor[here] = np.maximum(floor[here], np.where(least < 0, np.iinfo(np.int64).min, (least >> 20) - (1 << 41)))
                a, place = np.nonzero((best >= 0) & ((best >> 20) - (1 << 41) >= floor[here][:, None]))
                found = best[a, place]
                row = (1 << 20) - 1 - (found & ((1 << 20) - 1))
                back = np.empty(len(batch), np.int64)
                back[rows] = np.arange(len(rows))
                r = back[row]
                why = 1 + 2 * (share[a, r] > 0) + 4 * (near[a, r] == 2) + 8 * int(each % 2) + 16 * there[a, r] + 32 * (alike[a, r] >= ALIKE)
                yield pa.RecordBatch.from_arrays([
                    items.take(pa.array(here[a])).cast(id_type), of["id"].take(pa.array(r)).cast(id_type), of["maker"].take(pa.array(r)).cast(maker_type), pa.array(((found >> 20) - (1 << 41)) / 1e6), pa.array(why.astype(np.int32)),
                ], ["item", "other", "maker", "score", "why"])


def sensory(sugar: Column, text: Column, color: Column, profile: Column, abv: Column) -> Column:
    """The seven axes from a catalog card by fixed rules, with the share of axes that were really derived.

    ``profile`` is a struct of the mean grape profile (acidity, tannin, body, aromatic_intensity), any of them null.
    """
    sugar, text, color = F.lower(F.coalesce(sugar, F.lit(""))), F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(color, F.lit("")))
    # Sweetness by sugar category, caps and defaults by color, words that tell bubbles and oak.
    sweet = F.create_map(*[F.lit(x) for kv in (("экстра брют", 0.02), ("брют", 0.08), ("сухое", 0.05), ("полусухое", 0.30), ("полусладкое", 0.55), ("сладкое", 0.85)) for x in kv])[sugar]
    by_color = lambda values, default: F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[color], F.lit(default))
    bubbles = F.contains(sugar, F.lit("брют")) | text.rlike("пет нат|пет-нат|pet nat|petnat")
    oak = text.rlike("баррель|бочк|дуб|выдержк|barrique")
    tannin = F.least(F.coalesce(F.round(profile["tannin"], 3), by_color({"красное": 0.55, "оранжевое": 0.5}, 0.05)), by_color({"белое": 0.10, "розовое": 0.20, "оранжевое": 0.60}, 1.0))
    body = F.least(F.coalesce(F.round(profile["body"], 3), by_color({"красное": 0.65, "оранжевое": 0.6, "розовое": 0.4}, 0.45)), by_color({"белое": 0.80, "розовое": 0.65}, 1.0))
    body = F.when(abv.isNotNull() & (abv != 0), F.round(F.least(F.lit(1.0), body + (abv - 12.0) * 0.03), 3)).otherwise(body)
    derived = [sweet.isNotNull(), bubbles, oak, *(profile[a].isNotNull() for a in ("acidity", "tannin", "body", "aromatic_intensity"))]
    known = sum((d.cast("int") for d in derived), F.lit(0))
    return F.struct(
        sweet.alias("sweetness"), F.round(profile["acidity"], 3).alias("acidity"), tannin.alias("tannin"), body.alias("body"),
        F.when(oak, 0.6).otherwise(0.1).alias("oak"), F.round(profile["aromatic_intensity"], 3).alias("aromatic_intensity"),
        F.when(bubbles, 0.6).otherwise(0.0).alias("bubbles"), F.bround(F.least(F.lit(1.0), known / 6), 2).alias("confidence"),
    )
