from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import annulus, negatives, sharding, vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


@pytest.fixture(scope="module")
def table(spark):
    """Vectors of 64 components around eight centres, of which a third are one vector, with any that don't count among them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64)) / 8
    rows = [(i, (centres[rng.integers(8)] * rng.uniform(0.3, 3) + rng.normal(size=64) / 30).tolist(), int(rng.integers(4))) for i in range(400)]
    rows += [(i, [0.25] * 64, i % 3) for i in range(400, 600)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.1] * 63, 1), (603, [0.1] * 63 + [None], 1), (604, [0.1] * 63 + [float("nan")], 1), (605, [float("inf")] * 64, 2)]
    rows += [(606, [-0.25] * 64, None), (700, [0.1] * 32 + [-0.1] * 32, 2)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("id", "x", "cluster", "distance", "score", "anchor", "codes"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def whole(rows, label=False):
    """The rows that take part, with their integers."""
    kept = []
    for r in rows:
        v = r.embedding
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and not (label and r.label is None):
            kept.append((r, [int(np.floor(256 * x)) for x in v]))
    return kept


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 2**20, 2**26):
        a, b = rng.integers(-most, most, (7, 64)), rng.integers(-most, most, (5, 64))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        assert vectors.products(a, b).tolist() == want


def test_nearest_is_that_of_a_full_search():
    rng = np.random.default_rng(2)
    for k in (1, 3, 40, 300):
        centroids = rng.integers(-3, 4, (k, 6)) * rng.integers(1, 30, (k, 1))  # small integers: many ties, many equal norms
        x = rng.integers(-3, 4, (1500, 6)) * rng.integers(1, 30, (1500, 1))
        d = ((x[:, None] - centroids) ** 2).sum(axis=2)
        cluster, distance = annulus.Annuli(centroids).nearest(x)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_annulus_leaves_out_most_of_differing_norms():
    rng = np.random.default_rng(3)
    centroids = np.arange(1, 201)[:, None] * 100 * np.array([[1, 0, 0]]) + rng.integers(-5, 6, (200, 3))
    search = annulus.Annuli(centroids)
    x = centroids[50:60] + 7
    start, end = search.annulus(np.sqrt((x * x).sum(axis=1)), np.full(10, 150.0))
    assert (end - start).max() <= 4


def brute_clusters(rows, k=40, rounds=5):
    kept = whole(rows)
    x = np.array([v for _, v in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"2:{kept[i][0].vec_id}".encode()).hexdigest(), kept[i][1]))
    centroids = x[order[:k]].copy()
    for _ in range(rounds + 1):
        d = ((x[:, None] - centroids) ** 2).sum(axis=2)
        cluster, final = d.argmin(axis=1), centroids.copy()
        for c in set(cluster.tolist()):
            mine = x[cluster == c]
            centroids[c] = mine.sum(axis=0) // len(mine)
    distance = d.min(axis=1)
    return {r.vec_id: (int(c), int(s), int(distance[cluster == c].sum()), int(distance.sum()), final[c].tolist()) for (r, _), c, s in zip(kept, cluster, distance, strict=True)}


def test_clusters_against_brute_force(table):
    got = {r.vec_id: tuple(r)[1:] for r in annulus.cluster(table).collect()}
    assert got == brute_clusters(table.collect())


def test_clusters_of_odd_tables(spark, table):
    assert annulus.cluster(table.limit(0)).count() == 0
    few = spark.createDataFrame([(None, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [-0.5, 0.1], 1)], SCHEMA)
    got = sorted((r.vec_id or 0, r.cluster, r.distance, r.inertia) for r in annulus.cluster(few, k=40, dim=2).collect())
    ids = sorted((1, 1, 2), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    assert got == [(0, ids.index(1), 0, 0), (1, ids.index(1), 0, 0), (1, ids.index(1), 0, 0), (2, ids.index(2), 0, 0)]
    with pytest.raises(Exception, match="too large"):
        annulus.cluster(spark.createDataFrame([(1, [1e30, 0.0], 1)], SCHEMA), dim=2).count()


def brute_negatives(rows, every=100):
    kept = [(r.vec_id, r.label, v) for r, v in whole(rows, label=True)]
    x = np.array([v for _, _, v in kept], np.int64)
    out = []
    for a, own, v in {(i, lab, tuple(v)) for i, lab, v in kept if i % every == 0}:
        scores = (x @ np.array(v)).tolist()
        ranked = sorted((-s, i, lab) for s, (i, lab, _) in zip(scores, kept, strict=True) if i != a)
        for s, p, _ in [r for r in ranked if r[2] == own][:5]:
            fits = [r for r in ranked if r[2] != own and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 2])
def test_negatives_against_brute_force(table, block):
    got = sorted(tuple(r) for r in negatives.hard_negatives(table, every=20, block=block).collect())
    assert len(got) > 50 and got == brute_negatives(table.collect(), 20)


def test_negatives_of_odd_tables(spark, table):
    assert negatives.hard_negatives(table.limit(0)).count() == 0
    v = [0.5] * 4
    rows = [(0, v, 1), (0, v, 1), (None, v, 2), (1, v, 1), (1, v, 1), (2, v, 2), (2, v, 2), (3, [-0.5] * 4, 2), (100, v, 9)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), dim=4).collect())
    s = 4 * 128 * 128  # two rows each of 1 and 2; an anchor that is repeated counts once; 100 has no positive
    one = [(0, 1, 1, 2, s, s), (0, 1, 2, 2, s, s), (0, 1, 3, 100, s, s)]
    assert got == sorted(one * 2)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(5000, 64)) * 40).astype(np.int64)
    books = negatives.codebooks(x[:2000])
    codes, residual = negatives.encode(x, books)
    a = x[17]
    table = np.einsum("pcd,pd->pc", books, a.reshape(16, 4))
    score = table[np.arange(16), codes].sum(axis=1)
    slack = residual * np.sqrt(float(a @ a))
    assert (np.abs(score - x @ a) <= slack + 1).all()
    hunt = negatives.Search(books, 5)
    places = codes.T + np.arange(16)[:, None] * negatives.CODES
    for at in range(0, 5000, 500):
        part = slice(at, at + 500)
        hunt.meet(0, negatives.Anchor(a, 1, -1, None), (np.arange(5000)[part], np.ones(500, int), x[part], places[:, part], residual[part]))
    assert hunt.reranked < hunt.compared / 2
    assert hunt.found()["score"].tolist() == sorted((x @ a).tolist(), reverse=True)[:5]


# ---- sharding


def brute_shard(key, weights):
    """XXH64 (seed 42) of the key's text, XXH64 of that, and with it as seed XXH64 of the shard's number."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
    seed = xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), 42)
    best = max(range(len(weights)), key=lambda i: (weights[i] / -np.log(((xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) >> 11) + 0.5) / 2**53) if weights[i] else -1, -i))
    return best


def test_rendezvous_against_brute_force(spark):
    keys = [None, "", *range(500)]
    weights = [1.0, 2.5, 0.0, 1.0, 4.0]
    df = spark.createDataFrame([(None if k is None else str(k),) for k in keys], "k string")
    got = [r[0] for r in df.select(sharding.rendezvous(F.col("k"), weights)).collect()]
    assert got == [brute_shard(k, weights) for k in keys]
    with pytest.raises(ValueError, match="weight"):
        sharding.rendezvous(F.col("k"), [0.0, 0.0])


def test_few_records_move(spark):
    key, n = F.col("id"), 20_000
    more, heavy = [1.0] * 11, [1.0] * 9 + [3.0]
    rows = spark.range(n).select(sharding.rendezvous(key, [1.0] * 10).alias("a"), sharding.rendezvous(key, more).alias("b"), sharding.rendezvous(key, heavy).alias("c"), sharding.rendezvous(key, [1.0] * 9 + [0.0]).alias("d")).collect()
    assert all(r.b in (r.a, 10) and r.c in (r.a, 9) and (r.d == r.a or r.a == 9) for r in rows)
    counts = np.bincount([r.a for r in rows], minlength=10)
    assert abs(counts - n / 10).max() < n / 100
    assert abs(sum(r.b == 10 for r in rows) - n / 11) < n / 100 and abs(sum(r.c == 9 for r in rows) - n / 4) < n / 60


@pytest.mark.parametrize("most", [sharding.MOST_BROADCAST, 0])
def test_slots_are_gapless(spark, make, odd, monkeypatch, tmp_path, most):
    monkeypatch.setattr(sharding, "MOST_BROADCAST", most)
    docs = make([(7 if i % 3 == 0 else i, f"text {i}", "en", "s") for i in range(900)]).repartition(6)
    placed = sharding.place(docs, [1.0] * 5)
    assert placed.columns == [*docs.columns, "shard", "slot"]
    rows = placed.collect()
    assert sorted(r.text for r in rows) == sorted(r.text for r in docs.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.shard == brute_shard(r.doc_id, [1.0] * 5)
    assert len(slots) == 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sharding.write_shards(placed, str(tmp_path / "shards"), rows=100)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.shard, r.slot, r.text) for r in back.collect()) == sorted((r.shard, r.slot, r.text) for r in rows)
    assert sharding.place(docs.limit(0), [1.0]).count() == 0
    strange = sharding.place(odd.withColumn("Slot", F.lit("old")), [1.0, 1.0])
    assert strange.columns == [*[c for c in odd.columns if c != "shard"], "shard", "slot"]
    kept = strange.collect()
    assert len(kept) == odd.count() and sorted(r.text or "" for r in kept) == sorted(r.text or "" for r in odd.collect())


def test_sharding_query(spark):
    from larkspur.llm.queries import op12_rendezvous_sharding

    rows = op12_rendezvous_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 24) and r.shard == brute_shard(r.doc_id, [1.0] * 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
