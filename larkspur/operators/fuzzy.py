"""Names most like a query, by the token set ratio, complete from a least score on.

The ratio of two names is the best of three: of their whole texts, and of the tokens that they share with either text. The last two follow
from token lengths alone. The first is at most twice the letters that both have, counted with repeats, over both lengths; so a batch of
names is bounded for a query by a few vector operations, and the exact count is made in the order of these bounds, until
one falls short of what the query's last place needs. No name is left out for its spelling.

Queries go to the tasks in blocks of a bounded size, against all names; a task gives back the best of each query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import common_subsequence
from ..sources.scratch import discard, written
from .retrieval import spread

#: Queries of a block; names that are bounded at once.
BLOCK, NAMES = 8192, 4096
#: Counters of letters: letters that share one only loosen the bound.
COUNTERS = 32


class Text:
    """A name's distinct tokens, its text made of them in order, and its letters counted."""

    __slots__ = ("letters", "text", "tokens")

    def __init__(self, name: str):
        self.tokens = frozenset(name.split())
        self.text = " ".join(sorted(self.tokens))
        self.letters = np.bincount(np.frombuffer(self.text.encode("utf-32-le"), np.uint32) % COUNTERS, minlength=COUNTERS)


def _whole(a: Text, b: Text, both: frozenset) -> float:
    """The ratio of the whole texts, each with the shared tokens first."""
    first = sorted(both)
    left, right = (" ".join([*first, *sorted(x.tokens - both)]) for x in (a, b))
    return 2 * common_subsequence(left, right) / (len(left) + len(right))


def _shared(a: Text, b: Text, both: frozenset) -> float:
    """The best ratio of the shared tokens alone to either text; 1 if they are all that one has."""
    if not both:
        return 0.0
    if len(both) in (len(a.tokens), len(b.tokens)):
        return 1.0
    n = sum(map(len, both)) + len(both) - 1
    return 2 * n / (n + min(len(a.text), len(b.text)))


def percent(share: float | np.ndarray):
    """A share as 0 to 100, to four places, halves up."""
    return np.floor(share * 1e6 + 0.5) / 1e4


class _Best:
    """The best ``k`` ids of a query: (score, id, name), higher scores first, then ids, then names."""

    def __init__(self, k: int, least: float):
        self.k, self.least, self.rows = k, least, []

    def need(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.k else self.least

    def offer(self, score: float, id_, name: str) -> None:
        if score < self.need():
            return
        same = [r for r in self.rows if r[1] == id_]
        if same and (-same[0][0], same[0][2]) <= (-score, name):
            return
        self.rows = sorted([*(r for r in self.rows if r[1] != id_), (score, id_, name)], key=lambda r: (-r[0], r[1], r[2]))[: self.k]


class Names:
    """A batch of names (id, name, text) that queries are compared with."""

    def __init__(self, rows: list[tuple]):
        self.rows = [(i, name, Text(text)) for i, name, text in rows]
        self.letters = np.array([t.letters for _, _, t in self.rows]).reshape(-1, COUNTERS)
        self.lengths = np.array([len(t.text) for _, _, t in self.rows])
        self.of: dict[str, list[int]] = {}
        for at, (_, _, t) in enumerate(self.rows):
            for token in t.tokens:
                self.of.setdefault(token, []).append(at)
        self.counted = 0

    def search(self, query: Text, best: _Best) -> None:
        bound = 2 * np.minimum(self.letters, query.letters).sum(axis=1) / (self.lengths + len(query.text))
        for at in {at for token in query.tokens for at in self.of.get(token, ())}:
            id_, name, text = self.rows[at]
            share = _shared(query, text, query.tokens & text.tokens)
            best.offer(float(percent(share)), id_, name)
            if share >= bound[at]:
                bound[at] = -1  # the whole texts can't do better
        for at in np.argsort(-bound, kind="stable"):
            if bound[at] < 0 or percent(bound[at]) < best.need():
                break
            id_, name, text = self.rows[at]
            self.counted += 1
            best.offer(float(percent(_whole(query, text, query.tokens & text.tokens))), id_, name)


def most_alike(queries: DataFrame, names: DataFrame, least: float, k: int) -> DataFrame:
    """(query_id, id, name, score): of every query (query_id, q) the ``k`` ids with the names (id, name, n) most like it, from ``least`` on.

    Texts are lower case, their tokens parted by blanks; an id with several names counts by its best. Queries and names without
    tokens, and names without an id, find nothing. A task's best of each query; the best of all are left to the caller.

    Distinct texts are compared, however many ids have them, and stand for the ``k`` smallest of these. An id can be the first of as many
    texts as it has names, so ``k`` times the most names of an id are found.
    """
    spark, parts = names.sparkSession, []
    asked = written(queries.select("query_id", "q").filter("q <> ''").distinct(), "queries")
    texts = written(asked.select("q").distinct(), "texts")
    blocks = max(1, -(-texts.count() // BLOCK))
    once = written(names.filter("n <> '' AND id IS NOT NULL").groupBy("n", "id").agg(F.min("name").alias("name")), "names")
    most = k * (once.groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    held = written(once.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy("id"))).filter(F.col("_r") <= k), "firsts")
    scanned = spread(held.filter("_r = 1").select("id", "n"))
    for b in range(blocks):
        own = [r.q for r in texts.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()]  # about BLOCK rows
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            texts = [Text(q) for q in shared.value]
            best = [_Best(most, least) for _ in texts]
            for batch in batches:
                for at in range(0, batch.num_rows, NAMES):
                    ids, said = (c.to_pylist() for c in batch.slice(at, NAMES).columns)
                    part = Names([((i, n), n, n) for i, n in zip(ids, said, strict=True)])
                    for text, found in zip(texts, best, strict=True):
                        part.search(text, found)
            rows = [(q, n, score) for q, found in zip(shared.value, best, strict=True) for score, _, n in found.rows]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["q", "n", "score"])

        parts.append(scanned.mapInArrow(run, "q string, n string, score double"))
    discard(once)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(held.select("n", "id", "name").hint("merge"), "n").join(asked.hint("merge"), "q").select("query_id", "id", "name", "score")
