"""Near duplicates: SimHash fingerprints linked at a Hamming distance, found with vantage-point trees.

The 64 bits are cut into disjoint windows. Two fingerprints within R bits of each other are within floor(R / w) bits in
one of w windows at least, so there is one vantage-point tree per window and it is searched at that smaller radius;
Hamming distance over a window is a metric, so the triangle bound of a vantage point holds in it. (Over all 64 bits
the distances of unrelated fingerprints crowd around 32, and a radius of 4 would send two thirds of them to both sides
of each split; over a third of the bits at radius 1 it is one third.)

The top of each tree splits the fingerprints into shards by their distance to vantage points, which follow from a node's
number. A fingerprint lives in one shard and also goes, as a query, to each later shard that a value of its ball lives in: where
the triangle bound cannot rule a side out, the values that go there are told apart. So there are at most as many
queries as values in a ball (22 for a third of the bits), half of them on average, however many shards. Within a shard the tree goes
on down to small leaves, where whole 64-bit distances decide, so the links found are exact. A shard returns a spanning star
for each group that it has linked, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .components import connected_components
from .tables import HOT, join_hot, materialise, width

#: Fingerprints of a shard, about. A shard's tree goes on within its task.
SHARD = 65_536
#: Most fingerprints that thresholds are fitted on, and how many levels are; those below split at half a window's bits.
#: Thresholds only balance the shards; any give all links.
SAMPLE, FITTED = 16_384, 10
LEAF = 192
BLOCK = 1 << 21


# ---- fingerprints


def simhash(text: str | None, size: int = 4) -> int:
    """The signed 64-bit majority of the XXH64 (seed 42) of a text's word shingles; 0 for a text without words.

    A-Z are lower-cased, words are what ASCII white space divides, a text of fewer words than ``size`` is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        digests = xxh64_digest(flat, 42)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: -(size - 1)].tolist()
        digests = b"".join([xxh64_digest(flat[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 4) -> DataFrame:
    """(id, fp) for each row of ``docs``; fp is a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([simhash(t.as_py(), size) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


# ---- trees


def windows(radius: int) -> list[tuple[int, int, int]]:
    """(shift, mask, radius) of the windows: 64 bits in radius // 2 + 1 near-equal parts."""
    parts = radius // 2 + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1, radius // parts) for a, b in pairwise(cuts)]


def _distance(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(vantage))


def vantage_points(nodes: np.ndarray, mask: int, seed: int) -> np.ndarray:
    """The vantage point of each node of a window's tree: bits drawn from the node's number, so no table is sent around."""
    x = (nodes.astype(np.uint64) + np.uint64(seed << 48)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(mask)


def plant(sample: np.ndarray, radius: int, levels: int) -> list[np.ndarray]:
    """For each window the thresholds of the nodes of its upper levels, node 1 at the top: medians of the sample."""
    levels, trees = min(levels, FITTED), []
    for seed, (shift, mask, _) in enumerate(windows(radius)):
        values = (sample >> np.uint64(shift)) & np.uint64(mask)
        cut = np.full(1 << levels, mask.bit_length() // 2, np.int64)
        at = np.ones(len(values), np.int64)
        points = vantage_points(np.arange(1 << levels), mask, seed)
        for node in range(1, 1 << levels):
            if len(here := np.flatnonzero(at == node)):
                d = _distance(values[here], int(points[node]))
                cut[node] = int(np.median(d))
                at[here] = 2 * node + (d > cut[node])
        trees.append(cut)
    return trees


def route(fps: np.ndarray, trees: list, radius: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): where each fingerprint lives, and the later shards where a value of its ball lives.

    A window's radius is 1 at most, so a ball is a value and its flips of one bit. An entry is a row at a node with the set of
    the flips that live below it, one bit for each.
    """
    rows, shards, homes = [], [], []
    for w, ((shift, mask, r), cuts) in enumerate(zip(windows(radius), trees, strict=True)):
        values = (fps >> np.uint64(shift)) & np.uint64(mask)
        n, row, node = len(fps), np.arange(len(fps)), np.ones(len(fps), np.int64)
        flips = np.full(n, mask if r else 0, np.uint64)
        nothing = np.uint64(0)
        for _ in range(levels):
            apart = values[row] ^ vantage_points(node, mask, w)
            d = np.bitwise_count(apart).astype(np.int64)
            cut = np.where(node < len(cuts), cuts[np.minimum(node, len(cuts) - 1)], mask.bit_length() // 2)
            # the triangle bound: a flip is one bit nearer (those set in ``apart``) or farther, so only a threshold next to d parts them
            within = np.where(d < cut, flips, np.where(d <= cut + 1, flips & apart, nothing))
            beyond = flips & ~within
            inner = d <= cut
            own, other = np.where(inner, within, beyond), np.where(inner, beyond, within)
            away, stay = np.flatnonzero(other[:n]), np.flatnonzero(within[n:]) + n
            out = np.flatnonzero(beyond[n:]) + n
            row = np.concatenate([row[:n], row[away], row[stay], row[out]])
            flips = np.concatenate([own[:n], other[away], within[stay], beyond[out]])
            node = np.concatenate([2 * node[:n] + ~inner[:n], 2 * node[away] + inner[away], 2 * node[stay], 2 * node[out] + 1])
        home = np.arange(len(row)) < n
        kept = home | (node > node[:n][row])  # each two shards ask one another once
        rows.append(row[kept])
        shards.append((w << levels) + node[kept] - (1 << levels))
        homes.append(home[kept])
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


class _Links:
    """Linked pairs of positions, reduced to stars whenever they have become many."""

    def __init__(self, n: int):
        self.root, self.pending, self.held = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.pending.append((a, b))
            self.held += len(a)
            if self.held > BLOCK:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.pending:
            a, b = (np.concatenate(x) for x in zip(*self.pending, strict=True))
            self.pending, self.held, root = [], 0, self.root
            while True:
                ra, rb = root[a], root[b]
                if not (apart := ra != rb).any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while not np.array_equal(root, up := root[root]):
                    root[:] = up
        return self.root


def _compare(fps: np.ndarray, own: np.ndarray, other: np.ndarray, radius: int, links: _Links) -> None:
    """Link each of ``own`` to each of ``other`` (positions in ``fps``) within the radius, block by block."""
    step = max(1, BLOCK // max(1, len(other)))
    for at in range(0, len(own), step):
        near = np.bitwise_count(fps[own[at : at + step], None] ^ fps[other][None, :]) <= radius
        i, j = np.nonzero(near)
        links.add(own[at + i], other[j])


def _leaf(fps: np.ndarray, own: np.ndarray, guests: np.ndarray, radius: int, links: _Links) -> None:
    while len(own) > 1024:
        # a crowd: all within the radius of one fingerprint are linked through it and need no comparing among themselves
        ones = np.unpackbits(fps[own].byteswap().view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0) > 0.5
        middle = np.frombuffer(np.packbits(ones).tobytes(), ">u8")[0].astype(np.uint64)
        pivot = own[np.argmin(np.bitwise_count(fps[own] ^ middle))]
        ball = np.bitwise_count(fps[own] ^ fps[pivot]) <= radius
        if ball.sum() < max(64, len(own) // 64):
            break
        crowd, own = own[ball], own[~ball]
        links.add(crowd, np.full(len(crowd), pivot))
        _compare(fps, crowd, own, radius, links)
        _compare(fps, crowd, guests, radius, links)
    _compare(fps, own, own, radius, links)
    _compare(fps, own, guests, radius, links)


def search(fps: np.ndarray, home: np.ndarray, window: int, radius: int) -> np.ndarray:
    """The root position of each fingerprint after linking, within the radius, residents to all.

    Where many share a window's value, so that its tree cannot part them, the trees of the other windows go on: of what is
    within the radius, at least one of them holds no more than its share.
    """
    parts, links = windows(radius), _Links(len(fps))
    values = [(fps >> np.uint64(shift)) & np.uint64(mask) for shift, mask, _ in parts]
    wider = radius // (len(parts) - 1) if len(parts) > 1 else radius
    todo = [(np.flatnonzero(home), np.flatnonzero(~home), 0, window, parts[window][2], True)]
    while todo:
        own, guests, level, w, r, first = todo.pop()
        if not len(own):
            continue
        if len(own) > LEAF:
            d_own = _distance(values[w][own], v := int(values[w][own[(level * 7919) % len(own)]]))
            cut = int(np.median(d_own))
            cut -= cut == d_own.max()
            inner = d_own <= cut
            if 0 < inner.sum() < len(own):
                d = _distance(values[w][guests], v).astype(np.int64)
                todo.append((own[inner], guests[d - r <= cut], level + 1, w, r, first))
                met = np.concatenate([guests[d + r > cut], own[inner & (d_own.astype(np.int64) + r > cut)]])
                todo.append((own[~inner], met, level + 1, w, r, first))
                continue
            if first and len(parts) > 1:
                todo += [(own, guests, level, other, wider, False) for other in range(len(parts)) if other != window]
                continue
        _leaf(fps, own, guests, radius, links)
    return links.settle()


def links_within(distinct: DataFrame, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """(u, v): edges that connect exactly what fingerprints (column fp, distinct) within ``radius`` bits connect.

    The number of shards grows with the table; a shard is larger than ``shard`` where many distinct fingerprints share
    the value of a window, and is read by one task.
    """
    n = distinct.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n) / shard))))
    sample = np.empty(0, np.uint64)
    if levels:
        rows = distinct.sample(min(0.25, SAMPLE / n), seed=11).limit(2 * SAMPLE).collect()
        sample = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    trees = plant(sample, radius, levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                row, where, home = route(part, trees, radius, levels)
                yield pa.RecordBatch.from_pydict({"shard": where, "fp": part[row].view(np.int64), "home": home})

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().view(np.uint64)
        root = search(fps, rows["home"].to_numpy(), int(key[0]) >> levels, radius)
        far = root != np.arange(len(fps))
        return pd.DataFrame({"u": fps[far].view(np.int64), "v": fps[root[far]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    parts = max(width(distinct), len(trees) << levels >> 3)
    return dealt.repartition(parts, "shard").groupBy("shard").applyInPandas(link, "u long, v long")


def near_groups(fps: DataFrame, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """(fp, component_id, copies): for each distinct fingerprint of ``fps`` (id, fp), the smallest id of its component."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "fingerprints")
    roots = connected_components(links_within(distinct, radius, shard))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    rooted = materialise(rooted.select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "components")
    return join_hot(rooted.select("fp", "copies", "root"), least, "root", "members").select("fp", "component_id", "copies")


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 4, radius: int = 4
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and wordless texts have fingerprint zero and are linked like any other. Null ids are kept as rows; they never
    name a component unless it has no other id. Repeated rows give repeated rows; an empty table gives none. Only the id
    and the text are read, so other columns may have any names; texts are read whole, however long.
    """
    fps = materialise(fingerprints(docs, text_col, id_col, size), "simhash")
    groups = materialise(near_groups(fps, radius), "groups")
    return join_hot(fps, groups, "fp", "copies").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 4, radius: int = 4) -> DataFrame:
    """The documents that name their component, with all columns of ``docs``; rows without an id stay.

    Ids name documents: of rows that repeat an id, all stay if one of them names its component, and else all go. Ids of more
    than one in HOT rows are settled by a broadcast.
    """
    groups = near_duplicates(docs, text_col, id_col, size, radius).filter(F.col(id_col).isNotNull())
    named = F.col(id_col) == F.col("component_id")
    ids = groups.groupBy(F.col(id_col).alias("gone_id")).agg(F.bool_or(named).alias("stays"), F.count(F.lit(1)).alias("copies"))
    gone = materialise(ids.filter("NOT stays OR copies > 1"), "gone")
    hot = F.col("copies") * HOT > docs.count()
    few = F.broadcast(gone.filter(hot).select(F.col("gone_id").alias("hot_id"), "stays"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", F.col(f"row.`{id_col}`"))
    tagged = held.join(few, F.col("key") == F.col("hot_id"), "left")
    rest = tagged.filter("hot_id IS NULL").join(gone.filter(~hot & ~F.col("stays")), F.col("key") == F.col("gone_id"), "left_anti")
    return tagged.filter("stays").select("row.*").unionByName(rest.select("row.*"))
