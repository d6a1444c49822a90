from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup as E
from larkspur.llm import neardup as N


def test_exact_groups_against_brute_force(spark, make):
    rng = random.Random(1)
    texts = [rng.choice(["a b", "a  b", "c", None, "", "d\ne", f"u{i}"]) for i in range(400)]
    got = {r.doc_id: r for r in E.exact_groups(make(texts), k=3).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (ids[0], len(ids), i == ids[0])
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(r.doc_id for r in E.drop_exact_copies(make(texts), k=3).collect()) == sorted(ids[0] for ids in groups.values())


def test_misra_gries_finds_every_frequent_value(spark):
    values = ["hot"] * 500 + ["warm"] * 200 + [f"v{i}" for i in range(300)]
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    found = {r.v: r.estimate for r in E.misra_gries(df, "v", 9).collect()}
    assert len(found) <= 9 and found["hot"] <= 500 and found["warm"] <= 200


def test_odd_rows(odd):
    got = E.exact_groups(odd).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r.doc_id in (4, 5)]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in same) == [(4, 4, 3, True), (5, 4, 3, False), (5, 4, 3, False)]
    kept = E.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert E.exact_groups(odd.limit(0)).count() == 0 and E.drop_exact_copies(odd.limit(0)).count() == 0
    groups = N.near_duplicates(odd).collect()
    assert len(groups) == odd.count() and {r.component_id for r in groups if r.doc_id in (1, 2, 3)} == {1}
    assert N.drop_near_copies(odd).columns == odd.columns
    assert N.near_duplicates(odd.limit(0)).count() == 0


def brute_simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_that_of_spark_and_brute_force(spark):
    for t in (None, "", " \n", "One", "A b c d", "A b c d e f g É ÉA", "x " * 50):
        assert N.simhash(t) & (2**64 - 1) == brute_simhash(t)
    text = "one two three four"
    by_spark = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h
    assert N.simhash(text) == by_spark


def near(n=3000, crowd=1500, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    some = base[: n // 5].copy()
    for i in range(len(some)):
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            some[i] ^= np.uint64(1) << np.uint64(b)
    many = np.repeat(base[-1], crowd)
    for i in range(crowd):
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            many[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(np.concatenate([base, some, many]))


def brute_components(fps, radius=4):
    links = N._Links(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= radius) + i + 1
        links.add(np.full(len(j), i), j)
    return links.settle()


def test_trees_lose_no_link(spark):
    fps = near()
    want = brute_components(fps)
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(signed)], "id long, fp long")
    got = {r.fp: r.component_id for r in N.near_groups(df, shard=256).collect()}
    assert [got[int(f)] for f in signed] == want.tolist()


def test_windows_cover_the_radius():
    for radius in range(1, 9):
        parts = N.windows(radius)
        assert sum(mask << shift for shift, mask, _ in parts) == 2**64 - 1
        assert all((r + 1) * len(parts) > radius for _, _, r in parts)
