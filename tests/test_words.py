"""Words of labels, names and questions, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.functions import text as T
from larkspur.operators import intents as I
from larkspur.operators import labels, matching, profiles, recommend


def each(spark, xs, column, kind="string"):
    return [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").coalesce(1).orderBy("i").select(column(F.col("x")).alias("v")).collect()]


def test_label_tokens(spark):
    cases = {"CAMAPA, 2019": "2019 camapa samara", "semi-dry 750": "polusuhoe", "ОЛΕΓ": "oleg", "PO3E": "po3e roze", "a 12 (b)": "", "Extra Brut": "bryut ekstra", "«Chateau»": "chateau"}
    assert [" ".join(sorted(v)) for v in each(spark, list(cases), labels.query_tokens)] == list(cases.values())


def test_label_categories(spark):
    rows = [
        ("vino-polusuhoe-2019", "a.jpg", "Белое", "polusuhoe", "white"), ("vino-suhoe", "сладкое.jpg", "Красное", "suhoe", "red"), ("vino", "Брют белое красное.jpg", "Белое и красное", "bryut", None),
        ("vino", "a.jpg", "Вино", "", None), ("vino", "Розе сл.", "rosé", "sladkoe", "rose"), ("ekstra-bryut-x", "b.jpg", "Вино", "ekstra bryut", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "s string, p string, n string")
    got = df.select(labels.sweetness_of(F.col("s"), F.array("p"), F.col("n")).alias("a"), labels.text_color(F.col("n")).alias("b")).collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]


def test_stems_and_scalars(spark):
    cases = {"Красное вино Дагестана": "красн вин дагеста", "крымское вино": "крымск вин", "полусухой рислинг": "полусух рислинг", "красивейшая": "красив", "Oak 2019, été": "oak 2019 été", "": ""}
    assert [" ".join(T.word_list(x)) for x in cases] == list(cases.values())
    assert each(spark, ["1m30s", "30", "5 m", "5x", "1h30m", "0s"], S.seconds_of) == [90.0, 30.0, 300.0, None, 5400.0, None]
    assert [v and (v.width, v.height) for v in each(spark, ["1200x1600", "12", "64X32", "ax1", "x"], S.size_of)] == [(1200, 1600), None, (64, 32), None, None]
    assert each(spark, [" a   b", "x ", " ", "q\n w"], T.squeeze) == ["a b", "x", "", "q w"]
    assert each(spark, ["see [2]", "none", "[3] [9]", "[7]", "[1][1]"], lambda c: T.citations(c, F.lit(3))) == [[2], [1, 2, 3], [3], [1, 2, 3], [1]]
    assert each(spark, [1, 2, 11, 25, 33, 112], lambda c: S.plural(c, "год", "года", "лет"), "int") == ["год", "года", "лет", "лет", "года", "лет"]


def test_names_and_lists(spark):
    rows = [("Игристое экстра брют 2019, 0,75 л", "x-y", 2019, "extra_brut", True, 0.75), ("Каберне полусухое", "kaberne-2011", 2011, "semi_dry", False, None), ("Prosecco", "prosecco", None, None, True, None), ("Мускат сладкий 1998 1,5 л", "muskat", 1998, "sweet", False, 1.5)]
    df = spark.createDataFrame([r[:2] for r in rows], "n string, s string")
    assert [tuple(r) for r in df.select(T.attributes(F.col("n"), F.col("s")).alias("a")).select("a.*").collect()] == [r[2:] for r in rows]
    lists = [["Мерло", "Красные сорта"], ["Пино нуар (клон)", "мерло "], ["Неизвестный сорт"], ["Пино чёрный (Пино нуар) и Мерло"], ["Каберне и тайна", " "]]
    words = spark.createDataFrame([("Мерло", "merlo"), ("Пино нуар", "pino"), ("Пино чёрный", "pino"), ("Каберне", "kaberne")], "word string, card string")
    made = matching.expand_names(spark.createDataFrame(list(enumerate(lists)), "i int, names array<string>"), "i", "names", words, spark.createDataFrame([("красные сорта",)], "word string"))
    assert {r.id: r.names for r in made.collect()} == {0: ["Мерло"], 1: ["Пино нуар", "мерло"], 2: ["Неизвестный сорт"], 3: ["Пино чёрный", "Мерло"], 4: ["Каберне и тайна"]}


def test_phrases(spark):
    texts = spark.createDataFrame([(0, "a glass of Pinot Noir, merlot"), (1, "old MERLOT 2019"), (2, "some merlott here"), (3, "nothing at all")], "id int, text string")
    known = spark.createDataFrame([("Pinot Noir", "pinot-noir"), ("Merlot", "merlot")], "phrase string, slug string")
    assert sorted(map(tuple, profiles.phrases_found(texts, known).collect())) == [(0, "pinot-noir", 0), (1, "merlot", 1), (2, "merlot", 2)]


def test_phrases_in_very_many_texts(spark):
    said = ["a glass of Pinot Noir, merlot", "merlott merlot", "some merlott here", "the pinnt noirr", "merlox Noir", ""]
    texts = spark.range(6000).select("id", F.element_at(F.array(*map(F.lit, said)), (F.col("id") % 6 + 1).cast("int")).alias("text"))
    known = spark.createDataFrame([("Pinot Noir", "pinot-noir"), ("Merlot", "merlot"), ("MERLON", "b"), ("merlod", "a"), ("noir", "n")], "phrase string, slug string")
    found = profiles.phrases_found(texts, known)
    got = found.groupBy((F.col("id") % 6).alias("r"), "slug", "step").count().orderBy("r").collect()
    assert list(map(tuple, got)) == [(0, "pinot-noir", 0, 1000), (1, "merlot", 1, 1000), (2, "merlot", 2, 1000), (4, "n", 1, 1000)]
    assert "levenshtein" not in found._jdf.queryExecution().executedPlan().toString()  # looked up for distinct words, not for each text's


def test_questions(spark):
    asked = {
        "Расскажи про Янтарь от хозяйства Север": ("pairing", None, None, None), "Какие винодельни стоит посетить?": ("travel", None, None, None), "Почему вино бывает мутным": ("fact", None, None, None),
        "Красное полусухое с Дона": ("pairing", "красное", "полусухое", "don"), "Экстра-брют": ("pairing", None, "экстра брют", None), "Сыр под орехи": ("pairing", None, None, None),
        "Просто поговорим о погоде и о том, к чему это всё": ("default", None, None, None), "": ("default", None, None, None), None: ("default", None, None, None),
    }
    regions, fields = {"krym": "Крым", "don": "Долина Дона"}, ["color", "sugar", "region"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").withColumn("f", I.extracted_filters(F.col("q"), regions))
    got = df.orderBy("i").select(I.intent(F.col("q"), I.filters_active(F.col("f"), fields)).alias("intent"), "f.*").collect()
    assert [tuple(r) for r in got] == list(asked.values())


def test_analogs_have_reasons_and_other_makers(spark):
    card = "id string, maker string, category string, sparkling boolean, grapes array<string>, sweetness int, region string, words array<string>"
    rows = [
        ("base", "A", "red", False, ["Merlot", "Купаж"], 1, "x", ["plum", "oak"]), ("close", "B", "red", False, ["merlot"], 1, "x", ["plum", "oak"]), ("twin", "B", "red", False, ["merlot"], 1, "x", ["leaf"]),
        ("other", "C", "red", None, ["Malbec", "merlot"], 2, "y", []), ("own", "A", "red", False, ["merlot"], 1, "x", ["plum"]), ("white", "D", "white", False, ["merlot"], 1, "x", ["plum"]), ("fizz", "E", "red", True, ["merlot"], 1, "x", ["plum"]),
        ("bare", None, "red", False, None, None, None, ["leaf", "leaf"]),
    ]
    cards = spark.createDataFrame(rows, card)
    held = cards.join(recommend.description_vectors(cards.select("id", "words")), "id")
    for block in (2048, 1):
        got = recommend.analogs(held, cards.filter("id IN ('base', 'fizz')"), 6, block).orderBy("item", "rank").collect()
        assert [(r.item, r.other) for r in got] == [("base", "close"), ("base", "other"), ("base", "bare")]
        assert got[0].score == pytest.approx(1 + 3 + 2 + 1 + 2) and got[0].reasons == ["color", "grapes", "sweetness", "region", "description"]
        assert got[1].score == pytest.approx(1 + 1.5 + 0.7) and got[1].reasons == ["color", "grapes"] and got[2].score == 1.0
    assert recommend.analogs(held.limit(0), cards).count() == 0


def test_analogs_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(8)
    some = lambda xs, k: rng.sample(xs, rng.randint(0, k))
    cards = [(i, rng.choice([*"ABCDEFGHI", None]), rng.choice(["red", "white", None]), rng.random() < 0.3, some(["x", "y", "z", "v"], 3), rng.choice([0, 1, 2, None]), rng.choice(["n", "s", None]), {w: rng.choice([0.25, 0.5]) for w in some(["p", "q", "r"], 3)}) for i in range(400)]
    df = spark.createDataFrame(cards, "id long, maker string, category string, sparkling boolean, grapes array<string>, sweetness int, region string, vector map<string, double>")
    want = []
    for q in cards[:40]:
        best: dict = {}
        for c in cards:
            if c[0] == q[0] or None in (c[2], q[2]) or c[2:4] != q[2:4] or c[1] is not None and c[1] == q[1]:
                continue
            share = len({*c[4]} & {*q[4]}) / max(1, len({*c[4]} | {*q[4]}))
            near = 0.0 if None in (c[5], q[5]) else {0: 2.0, 1: 0.7}.get(abs(c[5] - q[5]), 0.0)
            here, alike = c[6] is not None and c[6] == q[6], sum(v * q[7].get(w, 0) for w, v in c[7].items())
            why = ["color"] + [n for n, x in (("grapes", share > 0), ("sweetness", near == 2), ("sparkling", q[3]), ("region", here), ("description", alike >= 0.25)) if x]
            best[c[1]] = min(best.get(c[1], (9, 0)), (-round(1 + 3 * share + near + here + 2 * alike, 6), c[0], why))
        want += [(q[0], other, -low, rank, why) for rank, (low, other, why) in enumerate(sorted(best.values())[:4], 1)]
    monkeypatch.setattr(recommend, "CELLS", 600)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")  # many batches a task
    try:
        found = recommend.analogs(df, df.filter("id < 40"), 4)
        assert sorted((r.item, r.other, r.score, r["rank"], r.reasons) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # pairs are made in matrices, not by a join
