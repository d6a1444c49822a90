"""The query interface: batches of questions to ranked candidates, over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..operators import intents, ranking, retrieval


class Retriever:
    """Hybrid search over ``items`` (id, kind, text, any filter columns) and ``vectors`` (id, embedding).

    All questions of a batch go through one plan; there is no loop over them. The index is built once, when it is first asked.
    """

    def __init__(self, items: DataFrame, vectors: DataFrame | None = None, pool: int = retrieval.POOL):
        self.items, self.vectors, self.pool, self.index = items, vectors, pool, None

    def lexical(self, queries: DataFrame, where: Column | None = None) -> DataFrame:
        """BM25 over the whole collection; the filter comes after, so it doesn't change the statistics."""
        self.index = self.index or retrieval.build_index(self.items, "id", "text")
        allowed = None if where is None else self.items.filter(where).select("id")
        return retrieval.bm25(queries, self.index, self.pool, where=allowed)

    def dense(self, queries: DataFrame, where: Column | None = None, k: int | None = None) -> DataFrame:
        """Nearest by dot product of unit vectors for queries (query_id, vector), themselves excluded; the filter comes before."""
        own = self.vectors if where is None else self.vectors.join(self.items.filter(where).select("id"), "id", "left_semi")
        none = F.lit(0).alias("group")
        asked = queries.select("query_id", doubles("vector").alias("vector"), none)
        return retrieval.nearest(own.select("id", doubles("embedding").alias("vector"), none), asked, k or self.pool).drop("group")

    def search(self, queries: DataFrame, k: int = 8, where: Column | None = None, scorer: Column | None = None, refuse_below: float | None = None) -> DataFrame:
        """(query_id, id, rank, score, tier) for queries (query_id, text and, with vectors, vector).

        Both branches are fused by rank, the head is reranked if there is a scorer (over query text ``q`` and item ``text``), and
        questions whose best score is too low are refused. Where a filter leaves nothing, the hits without it are given, as
        ``relaxed``.
        """
        strict = self._ranked(queries, where, scorer, refuse_below)
        if where is None:
            found = strict.withColumn("tier", F.lit("strict"))
        else:
            found = retrieval.relax(strict, self._ranked(queries, None, scorer, refuse_below))
        return found.filter(F.col("rank") <= k)

    def _ranked(self, queries: DataFrame, where: Column | None, scorer: Column | None, refuse_below: float | None) -> DataFrame:
        lists = [self.lexical(queries.select("query_id", "text"), where)]
        if self.vectors is not None and "vector" in queries.columns:
            lists.append(self.dense(queries, where))
        hits = ranking.top_k(retrieval.fuse_ranks(*lists), ["query_id"], "score", "id", self.pool)
        if scorer is None:
            return hits.select("query_id", "id", "rank", "score")
        texts = self.items.select("id", F.substring("text", 1, retrieval.HEAD_CHARS).alias("text"))
        met = hits.join(texts, "id", "left").join(queries.select("query_id", F.col("text").alias("q")), "query_id")
        new = retrieval.rerank(met, scorer).select("query_id", "id", F.col("new_rank").alias("rank"), F.col("new_score").alias("score"))
        return new if refuse_below is None else retrieval.refuse(new, "score", refuse_below)

    def ask(self, queries: DataFrame, k: int = 8, where: Column | None = None, active: Column | None = None, **options) -> DataFrame:
        """(query_id, id, rank, score, tier, intent): ``search`` in the collections (column ``kind`` of the items) that each question's intent asks for.

        ``active`` says of a question whether it sets filters. A question about pairing searches wines, and wines and knowledge if these are
        fewer than ``k``. ``where`` filters wines only.
        """
        asked = queries.withColumn("intent", intents.intent(F.col("text"), active))
        found = []
        for name, kinds in intents.COLLECTIONS.items():
            own = asked.filter(F.col("intent") == name).drop("intent")
            hits = self.search(own, k, self._among(kinds, where), **options)
            if name == "pairing":
                hits = intents.first_or_wider(hits, self.search(own, k, self._among(intents.COLLECTIONS["default"], where), **options), k)
            found.append(hits.withColumn("intent", F.lit(name)))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    @staticmethod
    def _among(kinds: list[str], where: Column | None) -> Column:
        full = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        return F.col("kind").isin(*kinds) & intents.passes(F.col("kind"), full, F.lit(True))

    def similar(self, ids: DataFrame, k: int = 8) -> DataFrame:
        """More like the items of ``ids`` (id), by their stored vectors, themselves excluded."""
        q = self.vectors.join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
        return self.dense(q, k=k)

    def get(self, ids: DataFrame) -> DataFrame:
        """The items of ``ids`` (id, and any further columns such as a rank, which are kept to order by); unknown ids are left out."""
        return ids.join(self.items, "id")

    def popular(self, column: str, n: int) -> DataFrame:
        from ..operators.aggregates import popular

        return popular(self.items, column, n)
