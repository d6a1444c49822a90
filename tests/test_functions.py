from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.functions import similarity as sim
from larkspur.functions import text as T
from larkspur.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("scheme", "slug"), [("page", "shhyoj-czar"), ("maker", "shchey-tsar"), ("upload", "shyoj-czar"), ("census", "shchyoj-czar"), ("label", "shchey-tsar")])
def test_transliterations_stay_apart(spark, scheme, slug):
    assert one(spark, T.slug(F.col("t"), scheme), t=" Щёй  ЦАР!") == slug


def test_upload_names(spark):
    got = one(spark, T.upload_parts(F.col("n")), n="Бел.сух_0123456789.JPG")
    assert (got.base, got.file_hash, got.ext, got.key) == ("Бел.сух", "0123456789", "jpg", "belsuh")
    assert one(spark, T.without_hashes(F.col("n")), n="a_704fdf2136_4e49dedcd5") == "a"


def test_attributes(spark):
    got = one(spark, T.attributes(F.col("n"), F.col("s")), n="Игристое экстра брют 2019, 0,75 л", s="x-y")
    assert (got.year, got.sweetness, got.sparkling, got.volume_l) == (2019, "extra_brut", True, 0.75)
    got = one(spark, T.attributes(F.col("n"), F.col("s")), n="Каберне полусухое", s="kaberne-2011")
    assert (got.year, got.sweetness, got.sparkling, got.volume_l) == (2011, "semi_dry", False, None)


def test_skeletons_and_similarity(spark):
    assert one(spark, T.skeleton(F.col("t")), t="chardonnay") == one(spark, T.skeleton(F.col("t")), t="shardone")
    df = spark.createDataFrame([("2019", "2018"), ("noir", "nuar"), ("rozovyj", "rossii"), ("abc", "abc")], "a string, b string")
    got = [r.x for r in df.select(sim.token_similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == 0 and got[1] >= 0.85 and got[2] < 0.85 and got[3] == 1
    assert sim.token_set("old oak wine", "wine oak") == 100 and sim.indel("abcd", "abed") == 0.75


def test_citations(spark):
    assert one(spark, T.citations(F.col("t"), F.lit(3)), t="see [2] and [9], [2], [1]") == [2, 1]
    assert one(spark, T.citations(F.col("t"), F.lit(3)), t="none") == [1, 2, 3]


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == pytest.approx(1)
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0
    assert one(spark, V.hamming_hex(F.col("a"), F.col("b")), a="ffffffffffffffff", b="0000000000000000") == 64
    assert one(spark, V.quantise(F.array(F.lit(1.0), F.lit(-0.5)))) == [127, -64]
    box = lambda *c: F.named_struct(*[x for k, v in zip(("x0", "y0", "x1", "y1"), c, strict=True) for x in (F.lit(k), F.lit(float(v)))])
    assert one(spark, V.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    axes = lambda a, b: F.named_struct(F.lit("a"), F.lit(a).cast("double"), F.lit("b"), F.lit(b).cast("double"))
    assert one(spark, V.masked_distance(axes(0.2, None), axes(0.5, 1), ["a", "b"])) == pytest.approx(0.3)
    assert one(spark, V.masked_distance(axes(None, None), axes(0.5, 1), ["a", "b"])) == 1


def test_scalars(spark):
    day = lambda y, m, d: F.lit(dt.date(y, m, d))
    assert one(spark, S.age(day(2004, 2, 29), day(2022, 2, 28))) == 17 and one(spark, S.age(day(2004, 2, 29), day(2022, 3, 1))) == 18
    assert one(spark, S.client_ip(F.col("f"), F.col("h")), f=" 1.2.3.4, 5.6.7.8", h="x") == "1.2.3.4"
    assert [one(spark, S.seconds_of(F.lit(x).cast("string"))) for x in ("5m", "1m30s", "90", "0s", "5x", "")] == [300, 90, 90, None, None, None]
    assert tuple(one(spark, S.size_of(F.lit("1200X1600")))) == (1200, 1600) and one(spark, S.size_of(F.lit("12"))) is None
    assert one(spark, S.salted_hash(F.lit("1.2.3.4"), day(2024, 1, 2))) == hashlib.sha256(b"1.2.3.4:2024-01-02").hexdigest()
    assert [one(spark, S.plural(F.lit(n), "a", "b", "c")) for n in (1, 3, 11, 25)] == ["a", "b", "c", "c"]


def test_near_hashes_see_the_last_component(spark):
    from larkspur.operators import joins

    ones = [1.0] * 64
    flipped = lambda *at: [-1.0 if i in at else 1.0 for i in range(64)]
    rows = [(0, ones), (1, flipped(63)), (2, flipped(*range(12))), (3, flipped(63, *range(12))), (4, ones)]
    h = spark.createDataFrame(rows, "id long, v array<double>").select("id", V.sign_bits(F.col("v")).alias("bits"))
    got = {(r.a, r.b): (r.distance, r.a_copies, r.b_copies) for r in joins.near_hashes(h, h, "id", "bits", 12).filter("a < b").collect()}
    assert got == {(0, 1): (1, 2, 1), (0, 2): (12, 2, 1), (1, 3): (12, 1, 1), (2, 3): (1, 1, 1)}


def test_near_hashes_against_brute_force(spark):
    import numpy as np

    from larkspur.operators import joins

    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    near = base.copy()
    for i in range(60):
        for b in rng.integers(0, 63, rng.integers(0, 9)):
            near[i] ^= 1 << int(b)
    frame = lambda x: spark.createDataFrame([(i, int(v), "g") for i, v in enumerate(x)], "id long, bits long, g string")
    want = {(i, j) for i in range(60) for j in range(60) if int(base[i] ^ near[j]).bit_count() <= 6}
    assert {(r.a, r.b) for r in joins.near_hashes(frame(base), frame(near), "id", "bits", 6).collect()} == want and len(want) > 20
    both = np.unique(np.concatenate([base, near]))
    pairs = {(i, j) for i in range(len(both)) for j in range(i + 1, len(both)) if int(both[i] ^ both[j]).bit_count() <= 6}
    assert {(r.a, r.b) for r in joins.near_hashes_within(frame(both), "g", "id", "bits", 6).collect()} == pairs


def test_hashes_near_each_other_are_linked_not_paired(spark):
    import numpy as np

    from larkspur.operators import families, joins, matching

    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    crowd = np.unique([int(base[0]) ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(20) for j in range(20, 30) for k in range(30, 34)])  # 6 bits apart at most
    chain = [int(base[1])]
    for i in range(8):
        chain.append(chain[-1] ^ (0b111111 << 7 * i))
    bits = [*map(int, crowd), *chain, *map(int, base[2:])]
    df = spark.createDataFrame([(i, b, "gh"[i % 7 == 0]) for i, b in enumerate(bits)], "id long, bits long, g string")
    links = joins.near_hash_links(df, "g", "id", "bits", 6)
    assert links.count() < 10 * len(bits)  # of 318,000 pairs
    pairs = df.crossJoin(df.toDF("id2", "bits2", "g2")).filter("g = g2 AND id < id2 AND bit_count(bits ^ bits2) <= 6").select("id", "id2")
    whole = lambda edges: sorted(map(tuple, families.components(edges).collect()))
    assert whole(links) == whole(pairs)
    files = df.selectExpr("g AS group", "id AS file", "string(id) AS digest", "bits", "double(id) AS score", "0 AS area", "0 AS mtime")
    best = {(r.group, r.root) for r in matching.content_groups(files, "group").filter(f"file < {len(crowd)}").collect()}
    assert len(best) == 2


def test_stems():
    pairs = {"вино": "вин", "вина": "вин", "красное": "красн", "красного": "красн", "полусухое": "полусух", "важность": "важност", "длинный": "длин", "ёлка": "елк", "wine": "wine", "был": "был"}
    assert {w: T.stem_word(w) for w in pairs} == pairs
    assert T.word_list("Été, ВИНО_x 2019") == ["été", "вин", "x", "2019"] and T.word_list(None) == []
