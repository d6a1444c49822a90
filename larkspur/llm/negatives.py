"""Hard negatives by product quantisation with rigorous bounds, then exact integer scores.

A vector is cut into SPACES parts, and each part is coded as one of CODES integer codewords, learned from a bounded sample. Every row
is indexed: its codes, and the norm of its residual (what the codewords leave over). For an anchor a, a table of the products of its
parts with all codewords gives a row's score up to the residual's part, which is within norm(a) * norm(residual) of zero. So the score
lies between two known numbers, and only rows whose range reaches what is asked for are scored exactly, in integers: no
row of the result can be missed, however well or badly the codewords fit.

Anchors go to the tasks in blocks of a bounded size, against all rows. For each block two passes are made: the first finds the
anchor's best rows of its own label (positives), the second, for each positive, the best rows of other labels within the window of scores that
the positive sets. A task keeps, for each anchor and window, the few best rows that it has met, whose last one is the bound that
later rows must reach; only these few are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, materialise, shared_dir
from .vectors import integers, products

#: Most rows that the codewords are learned from, in how many rounds; codewords of a part.
SAMPLE, ROUNDS, CODES = 8192, 6, 256
#: Components of a part.
PART = 4
#: Anchors of a block, about: 8 MB at 64 components.
BLOCK = 16_384
#: Rows that an anchor is compared with at once.
ROWS = 4096
#: Most components that are gathered at once for exact scores.
GATHERED = 1 << 21


# ---- index


def codebooks(sample: np.ndarray) -> np.ndarray:
    """(part, code, component) integers: codewords of each part, by k-means over the rows of ``sample``."""
    n, dim = sample.shape
    books = np.zeros((dim // PART, CODES, PART), np.int64)
    for p in range(dim // PART):
        x = sample[:, p * PART : (p + 1) * PART]
        book = x[np.linspace(0, n - 1, CODES).astype(np.int64)].copy() if n else books[p]
        for _ in range(ROUNDS if n else 0):
            code = _nearest(x, book)
            order = np.argsort(code, kind="stable")
            met, starts, counts = np.unique(code[order], return_index=True, return_counts=True)
            book[met] = np.rint(np.add.reduceat(x[order], starts, axis=0) / counts[:, None]).astype(np.int64)
        books[p] = book
    return books


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    code, squares = np.empty(len(x), np.int64), (book * book).sum(axis=1)
    for at in range(0, len(x), ROWS):
        code[at : at + ROWS] = (squares - 2 * products(x[at : at + ROWS], book)).argmin(axis=1)
    return code


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes (row, part) of the rows of ``x``, and upper bounds of the norms of their residuals."""
    codes = np.stack([_nearest(x[:, p * PART : (p + 1) * PART], book) for p, book in enumerate(books)], axis=1)
    left = x - np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)
    return codes, np.sqrt((left * left).sum(axis=1).astype(np.float64)) * (1 + 1e-12)


def index(rows: DataFrame, id_col: str, label_col: str, vector_col: str, dim: int) -> tuple[DataFrame, np.ndarray]:
    """(id, label, x, codes, residual) of every row that takes part, written, and the codebooks."""
    if dim % PART:
        raise ValueError(f"dim must be divisible by {PART}")
    taken = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("x"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(2), dim)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), _lists(x)], ["id", "label", "x"])

    whole = taken.dropna(subset=["id", "label"]).mapInArrow(usable, "id long, label long, x array<long>")
    drawn = whole.orderBy(F.xxhash64("id", "x"), "id", "x").select("x").limit(SAMPLE).toPandas()  # SAMPLE rows at most
    books = codebooks(np.array(drawn["x"].tolist(), np.int64).reshape(-1, dim))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            codes, residual = encode(x, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(codes.astype(np.int16)), pa.array(residual)], ["id", "label", "x", "codes", "residual"])

    return materialise(whole.mapInArrow(coded, "id long, label long, x array<long>, codes array<short>, residual double"), "quantised"), books


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(flat.type))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


# ---- search


class Best:
    """The few best (score, id) of a window: higher scores first, ties by smaller id."""

    def __init__(self, keep: int):
        self.keep, self.score, self.id = keep, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int | None:
        """The score that a row must reach to get in; None while there is room."""
        return int(self.score[-1]) if len(self.score) == self.keep else None

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.keep:
            top = score >= np.partition(score, len(score) - self.keep)[len(score) - self.keep]
            score, ids = score[top], ids[top]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.keep]
        self.score, self.id = score[order], ids[order]


@dataclass
class Anchor:
    """An anchor's vector and label, and the windows of scores (least, most) that are asked for; none: all scores."""

    x: np.ndarray
    label: int
    id: int
    windows: list[tuple[int, int]] | None


class Search:
    """For one anchor after another, the rows of a batch that may get into its windows, and their exact scores."""

    def __init__(self, books: np.ndarray, keep: int):
        self.books, self.keep = books, keep
        self.best: dict[tuple[int, int], Best] = {}
        self.reranked = self.compared = 0

    def meet(self, number: int, anchor: Anchor, batch: tuple[np.ndarray, ...]) -> None:
        """Offers the rows of ``batch`` (id, label, x, places of the codes by part, residual) to the anchor's windows."""
        ids, labels, x, places, residual = batch
        same = anchor.windows is None
        asked = [(None, None)] if same else anchor.windows
        held = [self.best.setdefault((number, w), Best(self.keep)) for w in range(len(asked))]
        least = [max((v for v in (low, b.least()) if v is not None), default=None) for (low, _), b in zip(asked, held, strict=True)]
        may = (labels == anchor.label) & (ids != anchor.id) if same else labels != anchor.label
        table = np.einsum("pcd,pd->pc", self.books, anchor.x.reshape(len(self.books), -1)).ravel()
        score = table[places].sum(axis=0)
        slack = np.ceil(residual * (np.sqrt(float(anchor.x @ anchor.x)) * (1 + 1e-12))).astype(np.int64) + 1
        if all(v is not None for v in least):
            may &= score + slack >= min(least)
        if not same:
            may &= score - slack <= max(most for _, most in asked)
        left = np.flatnonzero(may)
        self.compared, self.reranked = self.compared + len(ids), self.reranked + len(left)
        step = max(1, GATHERED // x.shape[1])
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            exact = products(x[rows], anchor.x[None])[:, 0]
            for (low, most), best in zip(asked, held, strict=True):
                fits = np.ones(len(rows), bool) if same else (exact >= low) & (exact <= most)
                if (last := best.least()) is not None:
                    fits &= exact >= last
                best.add(exact[fits], ids[rows[fits]])

    def found(self) -> pd.DataFrame:
        kept = [(a, w, b) for (a, w), b in self.best.items() if len(b.id)]
        lengths = np.array([len(b.id) for _, _, b in kept], np.int64)
        columns = {
            "anchor": np.repeat(np.array([a for a, _, _ in kept], np.int32), lengths),
            "window": np.repeat(np.array([w for _, w, _ in kept], np.int32), lengths),
            "id": np.concatenate([b.id for _, _, b in kept] or [np.empty(0, np.int64)]),
            "score": np.concatenate([b.score for _, _, b in kept] or [np.empty(0, np.int64)]),
        }
        return pd.DataFrame(columns)


def search(indexed: DataFrame, books: np.ndarray, anchors: list[Anchor], keep: int) -> DataFrame:
    """(anchor, window, id, score, rank): the best ``keep`` rows of each window of each anchor; anchors by their place in the list."""
    dim = books.shape[0] * PART
    shared = indexed.sparkSession.sparkContext.broadcast((books, anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, anchors = shared.value
        hunt, first = Search(books, keep), np.arange(len(books))[:, None] * CODES
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                places = _matrix(part.column(3), len(books)).T.astype(np.int64) + first
                rows = (part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dim), places, part.column(4).to_numpy())
                for number, anchor in enumerate(anchors):
                    hunt.meet(number, anchor, rows)
        yield pa.RecordBatch.from_pandas(hunt.found(), preserve_index=False)

    found = indexed.select("id", "label", "x", "codes", "residual").mapInArrow(run, "anchor int, window int, id long, score long")
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", dim: int = 64, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, the rows whose id is divisible by ``every``.

    Scores are inner products of the integers floor(256 * x). A negative's score, times 100, lies from ``least_percent`` to
    ``most_percent`` times the positive's. Rows with a null id, label or vector, another length than ``dim``, or a null, NaN or infinite
    component take no part. Rows that share an id are rows of their own, each with its place in the order, but not "other" rows to an anchor of that
    id; anchors that are equal in id, label and vector count once. Other columns play no part; an empty table gives no rows.
    """
    spark = rows.sparkSession
    indexed, books = index(rows, id_col, label_col, vector_col, dim)
    asked = materialise(indexed.filter(F.col("id") % every == 0).select("id", "label", "x").distinct(), "anchors")
    blocks = max(1, -(-asked.count() // block))
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for b in range(blocks):
        here = asked.filter(F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)) == b).orderBy("id", "label", "x").collect()  # about ``block`` rows
        anchors = [Anchor(np.array(r.x, np.int64), r.label, r.id, None) for r in here]
        pairs = search(indexed, books, anchors, positives).select("anchor", "id", "score", "rank").orderBy("anchor", "rank").collect()
        windows: dict[int, list] = {}
        for p in pairs:
            windows.setdefault(p.anchor, []).append((p.id, p.score))
        for number, anchor in enumerate(anchors):
            anchor.windows = [(-(-least_percent * s // 100), most_percent * s // 100) for _, s in windows.get(number, [])]
        found = search(indexed, books, [a for a in anchors if a.windows], negatives)
        numbers = [n for n, a in enumerate(anchors) if a.windows]
        known = [(k, w, anchors[n].id, *windows[n][w]) for k, n in enumerate(numbers) for w in range(len(windows[n]))]
        named = spark.createDataFrame(known, "anchor int, window int, anchor_id long, positive_id long, positive_score long")  # a block's
        made = found.join(F.broadcast(named), ["anchor", "window"])
        made = made.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made.write.parquet(f"{path}/{b}")
    discard(asked)
    discard(indexed)
    return spark.read.schema(made.schema).option("recursiveFileLookup", True).parquet(path)
