"""Rules of names, wishes, labels and candidates, case by case."""

from __future__ import annotations

from math import comb, log

import pytest
from pyspark.sql import functions as F

from larkspur.functions import similarity as S
from larkspur.functions import text as T
from larkspur.operators import aggregates, joins, labels, matching, metrics, profiles, retrieval, sampling


def values(spark, xs, column, kind="string"):
    return [r.v for r in spark.createDataFrame([(x,) for x in xs], f"x {kind}").select(column(F.col("x")).alias("v")).collect()]


def test_noise_classes(spark):
    cases = {
        "logo.SVG": "svg_logo", "a.geojson": "geojson_map", "b.xml": "xml_sitemap", "c.pdf": "pdf_doc", "d.tif": "tif_scan", "d.tiff": "tif_scan", "e.heic": "heic_photo", "f.jfif": "jfif_photo",
        "clip.mp4": "other_ext_mp4", "noext": "other_ext_none", ".png": "other_ext_none", "DSC_0012.jpg": "camera_original", "img123.webp": "camera_original", "PXL-2.png": "camera_original", "mgx.png": "other_photo",
        "Ab3dEfGhIjKlMnOpQr.png": "random_s3_name", "abcdefghijklmnopqr.png": "other_photo", "Ab3d_fGhIjKlMnOpQr.png": "other_photo", "Ab3dEfGhIjKlMnO.png": "other_photo",
        "DSC_1_0123456789_abcdef0123.jpeg": "camera_original", "Ab3dEfGhIjKlMnOpQr_0123456789.png": "random_s3_name",
    }
    assert dict(zip(cases, values(spark, list(cases), T.noise_class), strict=True)) == cases


def test_close_tokens(spark):
    cases = [("abc", "abc", 1.0), ("2019", "2018", 0.0), ("abc", "abd", 0.0), ("kaberxyzw", "kaberqqqq", 0.0), ("skalis", "skalistyj", 0.8), ("rubin", "rubinovoe", 0.85), ("rubi", "rubinovoe", 0.0), ("krasnostop", "krasnostob", 0.9), (None, "a", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r.v for r in df.select(S.close_token(F.col("a"), F.col("b")).alias("v")).collect()]
    assert [g if g is None else round(g, 6) for g in got[:-1]] == [w for *_, w in cases[:-1]]
    for a, b, want in cases[:-1]:
        assert round(S.likeness(a, b), 6) == want == round(S.likeness(b, a), 6)


def test_sweetness_sparkle_and_profiles(spark):
    text = ["Полусладкое", "сладкое", "Десертное", "Ликёрное", "ликерное", "полусухое", "Брют", "brut", "сухое", "dry", "вино", None]
    assert values(spark, text, profiles.keyword_sweetness) == [0.55, 0.85, 0.85, 0.85, 0.85, 0.35, 0.05, 0.05, 0.10, 0.10, None, None]
    assert values(spark, ["Prosecco", "Asti", "Cava", "Креман", "пет-нат", "тихое", None], profiles.keyword_sparkling) == [True] * 5 + [False] * 2
    df = spark.createDataFrame([(" Белое ", "Prosecco", "полусухое", None), ("красное", "x", None, 14.0), ("синее", "x", None, 1.0), (None, "x", None, 1.0)], "c string, n string, d string, a double")
    got = [r.p for r in df.select(profiles.heuristic_profile(F.col("c"), F.col("n"), F.col("d"), F.col("a")).alias("p")).collect()]
    assert got[2:] == [None, None]
    assert (got[0].sweetness, got[0].bubbles, got[0].abv_percent) == (0.35, 0.73, 12.5) and (got[1].sweetness, got[1].tannin, got[1].abv_percent) == (0.15, 0.62, 14.0)


def test_wishes_exclude_by_filters(spark):
    rows = [("красное, не сладкое", "красное", "сухое", True), ("красное, не сладкое", "красное", "Сладкое", False), ("без белого", "Белое", None, False), ("без белого", "розовое", None, True), ("не хочу полусладкое", "x", "полусладкое", False), ("сухое", None, None, False), ("не без затей", None, None, True), (None, "красное", None, True)]
    df = spark.createDataFrame([r[:3] for r in rows], "w string, c string, s string")
    got = [r.v for r in df.select(profiles.chosen_by(F.col("w"), F.col("c"), F.col("s"), F.lit(None).cast("string"), {}).alias("v")).collect()]
    assert got == [r[3] for r in rows]


def test_cascade_of_matches(spark):
    n = spark.createDataFrame([(x,) for x in ("exact_one", "chateau_blanc", "petit_vino_x", "lonely_zzzz", "ambig_name", "bad_match", "extra_ones", "gone_list")], "name string")
    k = spark.createDataFrame([(x,) for x in ("exact_one", "chateau_blanc_2019", "some_petit_thing", "ambig_name_a", "ambig_name_b", "bad_match", "right_key", "f1", "f2")], "key string")
    said = spark.createDataFrame([("exact_one", "right_key"), ("lonely_zzzz", "right_key"), ("petit_vino_x", "no_such_key"), ("stranger", "f1")], "name string, key string")
    looked = spark.createDataFrame([("bad_match", ["gone", "right_key"]), ("extra_ones", ["f2", "gone", "f1"]), ("gone_list", ["gone"]), ("chateau_blanc", [])], "name string, keys array<string>")
    plain = {r.name: (r.key, r.status) for r in matching.cascade(n, k).collect()}
    assert plain == {
        "exact_one": ("exact_one", "exact"), "chateau_blanc": ("chateau_blanc_2019", "substring"), "petit_vino_x": (None, "weak_overlap"), "lonely_zzzz": (None, "no_ref"),
        "ambig_name": (None, "ambiguous"), "bad_match": ("bad_match", "exact"), "extra_ones": (None, "no_ref"), "gone_list": (None, "no_ref"),
    }
    found = matching.cascade(n, k, said, looked)
    got = {r.name: (r.key, r.status, r.extra) for r in found.collect()}
    assert got == {
        "exact_one": ("exact_one", "exact", []), "chateau_blanc": (None, "rejected", []), "petit_vino_x": (None, "weak_overlap", []), "lonely_zzzz": ("right_key", "override", []),
        "ambig_name": (None, "ambiguous", []), "bad_match": ("right_key", "reviewed", []), "extra_ones": ("f2", "reviewed", ["f1"]), "gone_list": (None, "rejected", []),
    }
    assert [(r.key, r.names) for r in matching.shared_keys(found).collect()] == [("right_key", ["bad_match", "lonely_zzzz"])]
    words = joins.sharing_words(spark.createDataFrame([("abcde_x",), ("zzzz",), ("cdef",)], "name string"), spark.createDataFrame([("xabcdefy",)], "key string"))
    assert sorted(r.name for r in words.collect()) == ["abcde_x", "cdef"]


def test_names_conflict_by_likeness(spark):
    arrays = "struct<name: array<string>, winery: array<string>, grapes: array<string>>"
    card = (["rubin", "rezerv"], ["orlova", "winery"], ["merlo"])
    cases = [
        ((["sapfir"], ["orlov"], []), ["sapfira"], True),  # another name that was heard, of a maker read about alike
        ((["sapfir"], ["orlov"], []), ["rubinn"], False),  # the card's was heard
        ((["rubinov"], ["orlov"], []), ["rubinov"], False),  # begins with the card's
        ((["reserve"], ["orlov"], []), ["reserve"], False),  # generic
        ((["sapfir"], ["petrov"], []), ["sapfir"], False),
        ((["sapfir"], ["winery"], []), ["sapfir"], False),
        ((["sapfir", "2019"], ["orlova"], ["sapfir"]), ["sapfir"], False),  # a grape
        ((["sapfir"], None, None), ["sapfir"], False),
        ((["sapfir"], ["orlova"], []), None, False),
    ]
    df = spark.createDataFrame([(card, read, ocr) for read, ocr, _ in cases], f"card {arrays}, read {arrays}, ocr array<string>")
    side = lambda x: {f: F.col(f"{x}.{f}") for f in ("name", "winery", "grapes")}
    assert [r.v for r in df.select(labels.name_conflicts(side("read"), side("card"), F.col("ocr")).alias("v")).collect()] == [want for *_, want in cases]


def test_fusion_with_makers_and_families(spark):
    visual = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.85), (1, "c", 0.7)], "query_id int, id string, score double")
    text = spark.createDataFrame([(1, "b", 4.0), (1, "d", 2.0)], "query_id int, id string, mass double")
    makers = spark.createDataFrame([(1, "b", 0.4), (1, "d", 0.5)], "query_id int, id string, recall double")
    plain = {r.id: (round(r.cv, 6), round(r.relative, 6), round(r.final, 6)) for r in retrieval.fuse_scores(visual, text).collect()}
    assert plain == {"a": (0.9, 0.0, 0.9), "b": (0.85, 1.0, 1.05), "c": (0.7, 0.0, 0.7), "d": (0.87, 0.5, 0.97)}
    fused = retrieval.fuse_scores(visual, text, makers=makers, unconfirmed=0.5)
    assert {r.id: round(r.relative, 6) for r in fused.collect()} == {"a": 0.0, "b": 0.5, "c": 0.0, "d": 0.5}  # the scale stays
    gate = lambda fam, **kw: [tuple(r) for r in retrieval.confident(fused.withColumn("final", F.round("final", 6)), spark.createDataFrame(fam, "id string, family string"), **kw).select("id", F.round("gap", 6), "confident").collect()]
    assert gate([("x", "y")]) == [("d", 0.02, False)]
    assert gate([("d", "f"), ("b", "f")]) == [("d", 0.07, True)] and gate([("d", "f"), ("b", "f"), ("a", "f"), ("c", "f")]) == [("d", None, True)]
    assert gate([("d", "f"), ("b", "f")], cv_floor=0.88) == [("d", 0.07, False)]


def test_text_reranks_the_first_k(spark):
    cards = {"a": "shato rubin merlo", "b": "shato sapfir merlo", "c": "shato opal"}
    df = spark.createDataFrame(list(cards.items()), "id string, text string")
    counts = {"shato": 3, "merlo": 2, "rubin": 1, "sapfir": 1, "opal": 1}
    idf = {w: log(4 / (n + 1)) + 1 for w, n in counts.items()}
    words = spark.createDataFrame(list(idf.items()), "word string, idf double")
    assert retrieval.distinctive_idf(words) == pytest.approx(sorted(idf.values())[2])
    hits = spark.createDataFrame([(q, i, s, r) for q in (1, 2, 3, 4) for i, s, r in (("a", 0.9, 1), ("b", 0.85, 2), ("x", 0.8, 3), ("c", 0.7, 4))], "query_id int, id string, score double, rank int")
    queries = spark.createDataFrame([(1, "sapfir merlo"), (2, "shato"), (3, " "), (4, "opal")], "query_id int, text string")
    got = {}
    for r in retrieval.rerank_by_text(hits, queries, df, words, k=3, weight=1.0, least_idf=1.5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.final)
    order = lambda q: [got[q][i][0] for i in (1, 2, 3, 4)]
    assert order(1) == ["b", "a", "x", "c"] and order(2) == order(3) == ["a", "b", "x", "c"] and order(4)[3] == "c"
    share = (idf["sapfir"] + idf["merlo"]) / sum(idf[w] for w in cards["b"].split())
    assert got[1][1][1] == pytest.approx(0.85 + share + 0.35 * S.token_set("sapfir merlo", cards["b"]) / 100)
    assert got[2][1][1] == 0.9 and got[1][4] == ("c", 0.7)


def test_sign_test_of_any_size(spark):
    for n in (1, 2, 7, 40, 101):
        for k in range(n + 1):
            assert metrics.half_tail(k, n) == pytest.approx(sum(comb(n, i) for i in range(k + 1)) / 2**n, abs=1e-12)
    assert metrics.half_tail(499_000, 1_000_000) == pytest.approx(0.0228, abs=1e-4)
    df = spark.createDataFrame([(True, False)] * 9 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    r = metrics.sign_test(df, F.col("a"), F.col("b")).first()
    assert (r.fixed, r.broken) == (9, 2) and r.p == pytest.approx(2 * (1 + 11 + 55) / 2**11)
    assert metrics.sign_test(df.limit(0), F.col("a"), F.col("b")).first().p == 1.0


def test_reports(spark):
    rows = spark.createDataFrame([("ok", "a", 1, 1.0), ("ok", "a", None, 3.0), ("no", None, 2, 99.0), (None, "b", None, None)], "s string, i string, y int, v double")
    got = {(r.section, r.name): (r.value, r.share) for r in aggregates.report(rows, "s", "i", ["y"], ["v"]).collect()}
    assert got[("status", "ok")] == (2.0, 0.5) and got[("status", "none")] == (1.0, 0.25) and got[("filled", "y")] == (2.0, 0.5)
    assert got[("images", "with")] == (3.0, 0.75) and got[("images", "different")] == (2.0, None)
    assert [got[("v", p)][0] for p in ("p0", "p5", "p50", "p100")] == pytest.approx([1.0, 1.1, 2.0, 3.0])
    flags = spark.createDataFrame([("a", True), ("a", False), ("a", False), ("a", None), ("b", None)], "g string, f boolean")
    assert sorted(map(tuple, aggregates.flag_rate(flags, ["g"], "f").collect())) == [("a", 3, 1, 0.3333, 1), ("b", 0, 0, 0.0, 1)]
    ids = spark.range(1000).withColumnRenamed("id", "i")
    both = {r.i for r in sampling.unseen(ids, "i", [("a", F.lit(True)), ("b", F.col("i") < 500)]).collect()}
    one = {r.i for r in sampling.unseen(ids, "i", [("a", F.lit(True))]).collect()}
    assert both < one and 400 < len(one) < 600 and {i for i in one if i >= 500} == {i for i in both if i >= 500}


def test_files_of_one_hash_are_one_content(spark):
    rows = [("g", "a", "x", 7, 1.0), ("g", "b", "y", 7, 3.0), ("g", "c", "z", 7 | 1 << 40, 2.0), ("g", "d", "w", None, 9.0), ("h", "e", "v", 7, 1.0), ("g", "f", None, 0x7FFF << 20, 5.0)]
    df = spark.createDataFrame(rows, "group string, file string, digest string, bits long, score double").withColumn("area", F.lit(0)).withColumn("mtime", F.lit(0))
    assert {r.file: r.root for r in matching.content_groups(df, "group").collect()} == {"a": "b", "b": "b", "c": "b", "d": "d", "e": "e", "f": "f"}
