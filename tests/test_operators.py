from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import decisions, extraction, families, joins, labels, matching, metrics, ranking, recommend, retrieval, rules, sampling
from larkspur.plans.retriever import Retriever
from larkspur.sources import readers, sinks
from larkspur.streaming import state


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_family_gap_treats_null_as_own_family(spark):
    df = spark.createDataFrame([(1, "a", 0.9, "f"), (1, "b", 0.8, "f"), (1, "c", 0.7, None), (1, "d", 0.6, None)], "q int, id string, s double, fam string")
    got = {r.id: r.gap for r in ranking.gap_to_next_family(df, ["q"], "s", "id", "fam").collect()}
    assert got["a"] == pytest.approx(0.2) and got["b"] == pytest.approx(0.1) and got["c"] == pytest.approx(0.1) and got["d"] is None


def test_names_within_two_edits(spark):
    import itertools
    import random

    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(names)], "g string, id int, name string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if edits(a, b) <= min(2, max(1, min(len(a), len(b)) // 3))}
    got = {(r.a, r.b) for r in joins.similar_names(df, "g", "id", "name").collect()}
    assert got == want


def test_names_that_many_have_are_compared_once(spark):
    df = spark.range(300).selectExpr("'g' AS g", "id", "CASE WHEN id < 200 THEN 'merlot' WHEN id < 290 THEN 'merlo' ELSE 'syrah' || id END AS name")
    links = joins.similar_name_links(df, "g", "id", "name")
    assert links.count() < 400  # of 41,950 pairs
    c = families.components(links)
    assert rows(families.families(df, links, "id")) == [(0, 290), (290, 10)] and c.count() == 300
    found = joins.similar_names(df, "g", "id", "name")
    assert found.groupBy("edits").count().orderBy("edits").collect() == [(0, 199 * 100 + 89 * 45), (1, 200 * 90 + 45)] and found.filter("a >= b").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString() + links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4  # what rows are multiplied in is not broadcast, however small it seems


def test_proposals_against_exploded_lists(spark):
    from larkspur.operators import diagnostics

    p = spark.createDataFrame([(1, 0, 5, "x"), (1, 0, 9, " "), (2, 7, 3, "x")], "query_id long, slot long, id long, evidence string")
    asked = spark.range(1, 3).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("slot"))
    listed = spark.range(1, 3).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("id"))
    found = diagnostics.proposal_report(p, asked, listed)
    assert rows(found) == [("duplicate", 2), ("missing", 3), ("no_evidence", 1), ("out_of_shortlist", 1), ("unknown", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # a list is many times the rows that its size tells


def test_nearest_in_time(spark):
    h = lambda x: datetime(2024, 1, 1) + timedelta(hours=x)
    left = spark.createDataFrame([("w", 1, h(10)), ("w", 2, h(50))], "k string, l_id int, l_ts timestamp")
    right = spark.createDataFrame([("w", "far", h(100)), ("w", "near", h(11)), ("w", "nearer", h(10.2))], "k string, r_id string, r_ts timestamp")
    got = joins.near_in_time(left, right, "k", 6 * 3600, 12).orderBy("place").collect()
    assert [(r.l_id, r.r_id) for r in got] == [(1, "nearer"), (1, "near")]


def test_contained_only_if_unique(spark):
    names = spark.createDataFrame([("chateaublanc",), ("vinogradx",), ("short",)], "name string")
    keys = spark.createDataFrame([("chateaublanc2019",), ("vinograd",), ("vinogradxy",)], "key string")
    assert rows(joins.contained(names, keys)) == [("chateaublanc", "chateaublanc2019")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a int, b int")
    got = {r.node: r.root for r in families.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.8), (True, 0.7), (False, 0.2)], "ok boolean, c double")
    best = metrics.abstention_sweep(df, "ok", "c").orderBy(F.desc("f1")).first()
    assert (best.threshold, best.precision, best.recall) == (0.7, 1, 0.75) and best.f1 == pytest.approx(1.5 / 1.75)
    hits = spark.createDataFrame([(["a"], ["b", "a"]), ([], []), (["c"], [])], "e array<string>, g array<string>")
    assert [r.h for r in hits.select(metrics.hit(F.col("e"), F.col("g")).alias("h")).collect()] == [True, True, False]
    pairs = spark.createDataFrame([(True, False)] * 8 + [(False, True), (True, True)], "a boolean, b boolean")
    got = metrics.sign_test(pairs, F.col("a"), F.col("b")).first()
    assert (got.fixed, got.broken) == (8, 1) and got.p == pytest.approx(20 / 512)
    assert metrics.sign_test(pairs.limit(0), F.col("a"), F.col("b")).first().p == 1


def test_rules(spark):
    spec = [{"id": "r", "when": {"dish.fat": ">=0.6"}, "require": {"wine.acid": ">=0.6"}, "penalize": {"wine.tan": ">=0.9"}, "weight": 1.0, "explain": "e"}]
    df = spark.sql("SELECT named_struct('fat', 0.7D) AS dish, named_struct('acid', a, 'tan', t) AS wine FROM VALUES (0.7D, 0.1D), (0.7D, 0.95D), (CAST(NULL AS DOUBLE), 0.1D) AS v(a, t)")
    assert [r.score for r in rules.scored(df, spec).collect()] == [1, 0, 0]


def test_style_ties_go_to_the_later_slug(spark):
    df = spark.createDataFrame([("i", "a", 0.9), ("i", "b", 0.9), ("i", "c", 0.7)], "item string, style string, score double")
    assert [(r.style, r["rank"]) for r in recommend.match_styles(df, "item", "style").orderBy("rank").collect()] == [("b", 1), ("a", 2)]


def test_evidence_and_choices(spark):
    df = spark.createDataFrame([(1, "a", 30, 0.5, 0.1), (1, "b", 21, 0.5, 0.1), (2, "a", 30, 0.5, 0.1), (2, "b", 25, 0.5, 0.1)], "g int, id string, inliers int, ratio double, coverage double")
    assert [(r.g, r.id) for r in decisions.evidence_gate(df, "g", "id").collect()] == [(1, "a")]
    x = spark.range(1).select(decisions.decide(F.lit(0.9), F.lit(0.9), F.lit(None).cast("double"), (0.8, 0.8, 0.1)).alias("a"), decisions.bucket(F.lit(0.9), F.lit(0.01), 0.8).alias("b")).first()
    assert (x.a, x.b) == ("found", "unsure")


def test_boxes(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.8, 0.0, 0.0, 1.0, 0.9), (1, 3, 0.7, 2.0, 2.0, 3.0, 3.0)], "img int, box_id int, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in ranking.suppress(df, "img").collect()) == [1, 3]
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.7), (1, 2, 2, 0.4)], "img int, left_id int, right_id int, overlap double")
    assert rows(ranking.match_one_to_one(pairs, "img")) == [(1, 1, 1, 0.9)]


def test_deck_shows_new_values_first(spark):
    df = spark.createDataFrame([("g", i, "red" if i < 5 else "white", "n") for i in range(6)], "g string, id int, color string, region string")
    deck = ranking.diversity_deck(df, "g", ["color", "region"], "id", "2024-01-01", 2).orderBy("place").collect()
    assert {r.color for r in deck} == {"red", "white"}


def test_blocks_and_values(spark):
    html = "<h1> A  b </h1><p>Temp:</p><p>10-12</p><script>x</script><p>c<br>d</p><p> </p>"
    assert extraction.parse_blocks(html) == [("h1", "A b", True), ("p", "Temp:", True), ("p", "10-12", True), ("p", "c d", True)]
    assert [b[:2] for b in extraction.parse_blocks("<div>A</div><p>B</p><div>C</div>")] == [("div", "A"), ("p", "B"), ("div", "C")]
    nested = extraction.parse_blocks("<div>a <p>b<span>c</span></p> d</div><ul><li>e<li>f</ul>")
    assert nested == [("div", "a bc d", False), ("p", "bc", False), ("span", "c", True), ("li", "e", True), ("li", "f", True)]
    tries = spark.createDataFrame([(["Temp", "Temp:", "x", "Temp"],), (["Temp", "Temp:", "Temp", "Temp", "Temp", "q", "Temp", "7"],), (["Temp", "y" * 401],)], "t array<string>")
    assert [r.v for r in tries.select(extraction.value_after(F.col("t"), ["Temp"]).alias("v")).collect()] == ["x", "q", None]
    df = spark.createDataFrame([(["x", "Temp:", "10-12", "y"],)], "t array<string>")
    got = df.select(extraction.value_after(F.col("t"), ["Temp"]).alias("v")).select("v", extraction.range_of(F.col("v")).alias("r")).first()
    assert got.v == "10-12" and got.r == [10, 12]
    long = spark.createDataFrame([(1, "a" * 30 + "\n" + "b" * 5 + "\n" + "c" * 5), (2, None)], "id int, t string")
    assert [r.text for r in extraction.chunk_paragraphs(long, "id", "t", 20).orderBy("chunk").collect()] == ["a" * 30, "b" * 5 + "\n\n" + "c" * 5]


def test_json_ld(spark):
    df = spark.createDataFrame([('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"Product","name":"x"}</script>',)], "h string")
    got = df.select(F.try_variant_get(extraction.json_ld(F.col("h"), ["Product"]), "$.name", "string").alias("n")).first()
    assert got.n == "x"


def test_sampling(spark):
    df = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 9)], "g string, id int")
    got = sampling.deranged(df, "g", "id", "s").collect()
    assert all(r.donor != r.id for r in got if r.donor is not None) and len({r.donor for r in got if r.g == "g"}) == 5
    assert [r.donor for r in got if r.g == "h"] == [None]
    assert spark.range(1).select(sampling.hash_share("42", F.lit("q1")).alias("x")).first().x == pytest.approx(0.08707178898320342)


def test_retriever_relaxes_once(spark):
    items = spark.createDataFrame([("a", "wine", "dry red oak", "red"), ("b", "wine", "sweet white", "white"), ("c", "wine", "plain", "white")], "id string, kind string, text string, color string")
    q = spark.createDataFrame([(1, "red oak"), (2, "sweet")], "query_id int, text string")
    found = Retriever(items)
    # a document without a common word fills the pool, so a filter that leaves one gives it
    got = {(r.query_id, r.id, r.tier) for r in found.search(q, 1, F.col("color") == "red").collect()}
    assert got == {(1, "a", "strict"), (2, "a", "strict")}
    got = {(r.query_id, r.id, r.tier) for r in found.search(q, 1, F.col("color") == "blue").collect()}
    assert got == {(1, "a", "relaxed"), (2, "b", "relaxed")}
    assert rows(retrieval.refuse(spark.createDataFrame([(1, 0.2), (2, 0.9)], "query_id int, s double"), "s", 0.5)) == [(2, 0.9)]


def test_russian_questions_find_their_items(spark):
    items = spark.createDataFrame([("a", "красное сухое вино Крым"), ("b", "белое полусладкое Кубань"), ("c", "oak wine")], "id string, text string")
    q = spark.createDataFrame([(1, "крымские вина"), (2, "полусладкого белого"), (3, "OAK")], "query_id int, text string")
    best = {r.query_id: (r.id, r.score > 0) for r in retrieval.bm25(q, retrieval.build_index(items, "id", "text"), 1).collect()}
    assert {k: v[0] for k, v in best.items()} == {1: "a", 2: "b", 3: "c"}


def test_pools_are_filled_by_id(spark):
    items = spark.createDataFrame([(i, "oak" if i == 7 else "else" if i else None) for i in range(9)], "id int, text string")
    q = spark.createDataFrame([(1, "oak")], "query_id int, text string")
    index = retrieval.build_index(items, "id", "text")
    assert [r.id for r in retrieval.bm25(q, index, 4).orderBy("rank").collect()] == [7, 0, 1, 2]
    assert [r.id for r in retrieval.bm25(q, index, 4, zeros=False).collect()] == [7]
    assert index.n == 9 and retrieval.bm25(q, index, 4, where=items.filter("id > 5").select("id")).count() == 3


def test_query_blocks_lose_nothing(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist(), i % 3) for i in range(60)], "id int, vector array<double>, group int")
    asked = vectors.filter("id < 20").withColumnRenamed("id", "query_id")
    words = ["a", "b", "c", "d", "e"]
    index = retrieval.build_index(spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(40)], "id int, text string"), "id", "text")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(9)], "query_id int, text string")
    whole = [rows(retrieval.nearest(vectors, asked, 4, other_groups=True)), rows(retrieval.bm25(q, index, 5))]
    monkeypatch.setattr(retrieval, "CELLS", 40)
    assert [rows(retrieval.nearest(vectors, asked, 4, other_groups=True)), rows(retrieval.bm25(q, index, 5))] == whole
    assert len(whole[0]) == 80 and len(whole[1]) == 45


def test_dense_search_holds_few_scores_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    v, group = rng.integers(-3, 4, (300, 4)).astype(float), rng.integers(0, 3, 300).tolist()  # many equal scores
    held, sizes, first = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 60)), "vector": v[a : a + 60].tolist(), "group": group[a : a + 60]}) for a in range(0, 300, 60)], [], retrieval._first
    monkeypatch.setattr(retrieval, "CELLS", 4000)
    monkeypatch.setattr(retrieval, "_first", lambda scores, *rest: sizes.append(scores.size) or first(scores, *rest))
    cases = {(): lambda q, i: True, ("other_groups",): lambda q, i: group[q] != group[i], ("own_group",): lambda q, i: group[q] == group[i]}
    for flags, fits in cases.items():
        found: dict = {}
        for b in retrieval._search(iter(held), pa.array(range(200)), v[:200], group[:200], 3, **dict.fromkeys(flags, True)):
            for q, i, _, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.setdefault(q, []).append((-s, i))
        for q in range(200):
            assert sorted(found[q])[:3] == sorted((-float(v[q] @ v[i]), i) for i in range(300) if i != q and fits(q, i))[:3]
    assert max(sizes) <= 1000


def test_questions_take_few_passes(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "CELLS", 4000)
    weights = spark.range(2000).selectExpr("id % 40 AS query_id", "'t' || (id div 20) AS term", "double(id) AS w")
    blocks, seen = list(retrieval._blocks(weights)), []
    assert len(blocks) == 2  # a pass over the index each
    for queries, vocabulary, query, term, w in blocks:
        for first, terms, matrix in retrieval._matrices(len(queries), query, term, w):
            assert matrix.size <= 4000 and matrix.shape[1] > 1
            seen += [(queries[first + int(c)].as_py(), vocabulary[int(terms[r])].as_py(), matrix[r, c]) for r, c in zip(*np.nonzero(matrix), strict=True)]
    assert sorted(seen) == rows(weights.filter("w <> 0"))


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(2999, 3000), (5000, 5001)], "a int, b int")
    got = {r.node: r.root for r in families.components(edges).collect()}
    assert all(got[i] == 0 for i in range(3001)) and got[5001] == 5000


def test_running_sums_by_ranges(spark):
    import random

    rng = random.Random(5)
    values = [(g, v, rng.randint(1, 5)) for g in "ab" for v in rng.sample(range(1000), 200)]
    got = metrics.running(spark.createDataFrame(values, "g string, v int, n long"), ["g"], "v", ["n"]).collect()
    for g in "ab":
        own = sorted((v, n) for h, v, n in values if h == g)
        upto, want = 0, {}
        for k, (v, n) in enumerate(own):
            upto += n
            want[v] = (upto, own[k + 1][0] if k + 1 < len(own) else None)
        assert {r.v: (r.n_upto, r.following) for r in got if r.g == g} == want


def test_choices_between_two_results(spark):
    side = "struct<id: string, score: double, visual: double, confident: boolean>"
    df = spark.createDataFrame([(("a", 0.9, 0.9, True), ("b", 0.5, 0.5, True)), (("a", 0.9, 0.9, True), ("b", 0.5, 0.5, False)), (("a", 0.9, 0.9, True), ("a", 0.5, 0.5, True)), ((None, None, None, None), ("b", 0.5, 0.5, False)), (("a", 0.1, 0.1, False), (None, None, None, None))], f"l {side}, m {side}")
    picked = {r: [x.s for x in df.select(decisions.choose(r, F.col("l"), F.col("m"))["score"].alias("s")).collect()] for r in ("merge", "max_score", "confident_else_cv", "agree_else_cv", "agree_else_llm")}
    assert picked == {"merge": [0.5, 0.5, 0.5, 0.5, None], "max_score": [0.9, 0.9, 0.9, 0.5, 0.1], "confident_else_cv": [0.5, 0.9, 0.5, 0.5, 0.1], "agree_else_cv": [0.9, 0.9, 0.5, 0.5, 0.1], "agree_else_llm": [0.5, 0.5, 0.5, 0.5, 0.1]}


def test_identity_veto_and_coverage(spark):
    arrays = "name array<string>, winery array<string>, grapes array<string>"
    card = f"card struct<{arrays.replace(' array', ': array')}>, read struct<{arrays.replace(' array', ': array')}>, ocr array<string>"
    c = (["rubin"], ["orlov", "estate"], ["merlo"])
    df = spark.createDataFrame([(c, (["sapfir", "merlo"], ["orlov"], []), ["sapfir"]), (c, (["sapfir"], ["orlov"], []), ["rubin", "sapfir"]), (c, (["sapfir"], ["other"], []), ["sapfir"]), (c, (["rubin"], ["orlov"], []), ["x"]), (c, ([], ["orlov"], []), ["x"])], card)
    side = lambda x: {f: F.col(f"{x}.{f}") for f in ("name", "winery", "grapes")}
    assert [r.v for r in df.select(labels.name_conflicts(side("read"), side("card"), F.col("ocr")).alias("v")).collect()] == [True, False, False, False, False]
    cards = spark.createDataFrame([(1, "a", ["chardonnay", "reserve"]), (1, "b", ["merlot"])], "query_id int, id string, tokens array<string>")
    label = spark.createDataFrame([(1, "shardone"), (1, "merlo")], "query_id int, token string")
    found = {r.id: r.found for r in labels.covered(cards, "tokens", label).collect()}
    assert found == {"a": ["chardonnay"], "b": ["merlot"]}
    field = {"name": F.array(F.lit("chardonnay"), F.lit("vino")), "winery": F.array(F.lit("x")), "grapes": F.array().cast("array<string>"), "year": F.lit(2019), "sweetness": F.lit("dry")}
    score = labels.card_score(field, F.array(F.lit("chardonnay")), {"year": F.lit(2018), "sweetness": F.lit("dry")}, ["vino"])
    assert spark.range(1).select(score.alias("s")).first().s == pytest.approx(1.0 - 0.3 + 0.2)


def test_fuzzy_words_of_labels(spark):
    q = spark.createDataFrame([(1, "krasnostop"), (1, "krasnostob"), (1, "2019"), (2, "skalis"), (2, "abc")], "query_id int, token string")
    idf = spark.createDataFrame([("krasnostop", 2.0), ("skalistyj", 1.0), ("2018", 5.0), ("abd", 3.0)], "word string, idf double")
    got = {(r.query_id, r.token, r.word): round(r.likeness, 2) for r in labels.vocabulary_matches(q, idf.select("word")).collect()}
    assert got == {(1, "krasnostop", "krasnostop"): 1.0, (1, "krasnostob", "krasnostop"): 0.9, (2, "skalis", "skalistyj"): 0.8}
    cards = spark.createDataFrame([("a", "krasnostop"), ("b", "skalistyj")], "id string, word string")
    assert {(r.query_id, r.id): round(r.mass, 2) for r in labels.fuzzy_mass(q, cards, idf).collect()} == {(1, "a"): 2.0, (2, "b"): 0.8}


def test_groups_of_equal_and_near_content(spark):
    rows_ = [("g", "a", "x", 0, 1.0), ("g", "b", "x", 1, 3.0), ("g", "c", "y", 0b111, 2.0), ("g", "d", "z", (1 << 40) - 1, 9.0), ("h", "e", "x", 0, 1.0)]
    df = spark.createDataFrame(rows_, "group string, file string, digest string, bits long, score double").withColumn("area", F.lit(0)).withColumn("mtime", F.lit(0))
    assert {r.file: r.root for r in matching.content_groups(df, "group").collect()} == {"a": "b", "b": "b", "c": "b", "d": "d", "e": "e"}


def test_one_to_one_merge_and_orphans(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "c")], "k int, y string")
    assert rows(matching.merged_one_to_one(left, right, "k")) == [(1, "a", "c"), (2, "b", None)]
    with pytest.raises(Exception, match="repeated on the right"):
        matching.merged_one_to_one(left, right.union(right), "k").collect()
    files = spark.createDataFrame([("a.jpg", "jpg"), ("small_a.jpg", "jpg"), ("b.mp4", "mp4"), ("c.png", "png")], "file string, ext string")
    used = spark.createDataFrame([("c.png",)], "file string")
    assert [r.file for r in matching.orphans(files, used, F.col("file").startswith("small_"), F.col("ext"), ("jpg", "png")).collect()] == ["a.jpg"]


def test_box_ranker_learns(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)], "id int, a double, b double, right int")
    model = labels.train_box_ranker(df, ["a", "b"], "right")
    got = model.transform(df).select("right", "prediction").collect()
    assert all(r.right == r.prediction for r in got)


def test_vectors_of_colors(spark):
    from larkspur.operators import profiles

    table = {("red", True): {"body": 0.7, "acid": 0.4}, ("white", True): {"body": 0.3}}
    df = spark.createDataFrame([("red", True, None), ("red", True, 0.9), ("white", True, None), ("blue", True, None)], "c string, s boolean, b double")
    got = df.select(profiles.vector_of(F.col("c"), F.col("s"), table, {"body": F.col("b")}).alias("v")).collect()
    assert [(r.v.acid, r.v.body) for r in got] == [(0.4, 0.7), (0.4, 0.9), (None, 0.3), (None, None)]
    assert [r.x for r in df.limit(1).select(profiles.excluded([F.lit("Красное сладкое")], F.array(F.lit("сладкого"))).alias("x")).collect()] == [True]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿slug,name\n a ,x\na,x\na,y\nb,\n")
    df = readers.csv_text(spark, str(tmp_path / "t.csv"), ["slug", "name"])
    first, conflicts = readers.one_per_key(df, "slug")
    assert rows(first.select("slug"))[0] == ("a",) and rows(conflicts) == [("a", 2)]
    with pytest.raises(ValueError, match="no column"):
        readers.csv_text(spark, str(tmp_path / "t.csv"), ["other"])
    assert readers.json_lines(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0
    (tmp_path / "m.json").write_text('{"mapping": {"k": "v"}}')
    assert rows(readers.mapping(spark, str(tmp_path / "m.json"))) == [("k", "v")]
    new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    for _ in range(2):
        sinks.append_new(new, str(tmp_path / "out"), "k")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    at = sinks.upsert(spark.createDataFrame([("a", 2)], "k string, v int"), str(tmp_path / "out"), "v2", "k", "v")
    assert rows(spark.read.parquet(at)) == [("a", 2), ("b", 1)]
    bad = readers.violations(spark.createDataFrame([("a", "z"), ("a", None)], "k string, s string"), ["s"], "k", {}, {"s": ["sure"]})
    assert rows(bad) == [("a", "k: repeated"), ("a", "k: repeated"), ("a", "s: missing"), ("a", "s: unknown value")]


def test_rejected_hits_do_not_count(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    hits = [("u", i, t0 + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 59, 61, 65, 71))]
    spark.createDataFrame(hits, "key string, id int, ts timestamp").write.parquet(str(tmp_path / "log"))
    out = state.drain(state.rate_limited(state.read_log(spark, str(tmp_path / "log")), "key", "id", "ts", 2, 60))
    assert [r.allowed for r in out.orderBy("id").collect()] == [True, True, False, False, True, False, True]


def test_late_windows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    spark.createDataFrame([("a", t0), ("a", t0 + timedelta(minutes=1)), ("a", t0 + timedelta(hours=2))], "k string, ts timestamp").write.parquet(str(tmp_path / "log"))
    out = state.drain(state.tumbling(state.read_log(spark, str(tmp_path / "log")), "ts", "10 minutes", "5 minutes", ["k"]))
    assert [r.n for r in out.collect()] == [2]


PAGE = """<html><head><meta property="og:title" content="Orlov — Wines"><script type="application/ld+json">{"@type": "Article", "headline": "News", "author": {"name": " Ann "}, "datePublished": "2024-05-06T10:00"}</script></head>
<body><h1>Orlov</h1><div><span>Region</span><span>Coast</span></div><p>Area:</p><p>1 250,5 га</p><h2>One</h2><p>LONG founded in 1998</p><h2>Tail</h2><h3>Other</h3><p>LONG founded in 1998</p>
<a href="/wineries/orlov">x</a><a href="/wineries/pavlov">y</a><a href="/wines/rubin">z</a></body></html>""".replace("LONG", "w" * 150)


def test_pages_become_documents(spark):
    from larkspur.operators import documents

    pages = spark.createDataFrame([("orlov", PAGE)], "slug string, html string")
    labels_ = {"region": ["Region"], "locality": ["Place"], "climate": ["Climate"], "area": ["Area"]}
    m = documents.makers(pages, "slug", "html", labels_).first()
    assert (m.name, m.name_from, m.region_name, m.locality, m.area, m.founded, m.neighbours) == ("Orlov — Wines", "meta", "Coast", None, 1250.5, 1998, ["pavlov"])
    assert m.about == "w" * 150 + " founded in 1998"
    a = documents.articles(pages, "slug", "html", ["Tail"]).first()
    assert (a.title, a.title_from, a.body_from, a.author, a.date, a.year, a.headings) == ("News", "jsonld", "dom", "Ann", "2024-05-06", 2024, ["One"])
    i = documents.items(pages, "slug", "html", r"\s+— Wines$", {"region": ["Region"]}).first()
    assert (i.name, i.fields.region, i.similar) == ("Orlov", "Coast", ["rubin"])


def test_broken_answers_are_salvaged(spark):
    from larkspur.operators import documents

    raw = ['talk {"winery": "Orlov", "name": "null", "year": 2019, "sparkling": true, "grapes": ["a", "b"], "text": "x y"} end', '{"name": "Rubin", "year": "1900", "grapes": ["a", "b', " no object "]
    got = [r.s for r in spark.createDataFrame([(x,) for x in raw], "r string").select(documents.salvaged(F.col("r")).alias("s")).collect()]
    assert (got[0].winery, got[0].name, got[0].year, got[0].sparkling, got[0].grapes, got[0].text) == ("Orlov", None, 2019, True, ["a", "b"], "x y")
    assert (got[1].name, got[1].year, got[1].grapes, got[1].sparkling) == ("Rubin", None, ["a"], None) and got[2].text == "no object"
    shown = spark.createDataFrame([("wine", "s", "d", "t"), ("chunk", "s", "d", "t"), ("x", "s", "d", "t")], "kind string, source string, derived string, title string")
    shown = shown.select(documents.public(F.col("kind"), {c: F.col(c) for c in ("source", "derived", "title")}).alias("p"))
    assert [tuple(r.p) for r in shown.collect()] == [("s", "d", None), (None, None, "t"), ("s", "d", "t")]


def test_intervals(spark):
    from larkspur.operators import intervals

    df = spark.createDataFrame([("g", 0.0, 5.0), ("g", 4.0, 6.0), ("g", 6.5, 7.0), ("g", 20.0, 22.0)], "g string, a double, b double")
    assert rows(intervals.runs(df, "g", "a", "b", 1.0)) == [("g", 0, 0.0, 7.0, 3), ("g", 1, 20.0, 22.0, 1)]
    c = spark.createDataFrame([("g", 10.0), ("g", 40.0), ("g", 62.0), ("h", 5.0)], "g string, c double")
    assert rows(intervals.borders(c, "g", "c", 0, 100)) == [("g", 10.0, 0.0, 25.0), ("g", 40.0, 25.0, 51.0), ("g", 62.0, 51.0, 100.0), ("h", 5.0, 0.0, 100.0)]
    assert rows(intervals.near_middle(c, "g", "c", 100, 0.03)) == [("g", 40.0), ("g", 62.0), ("h", 5.0)]
    assert rows(intervals.near_middle(c, "g", "c", 100, 0.01)) == [("g", 40.0), ("h", 5.0)]
    model = intervals.clusters(spark.createDataFrame([([0.0, i / 100],) for i in range(20)] + [([9.0, i / 100],) for i in range(20)], "v array<double>"), "v", 2)
    assert sorted(round(x[0]) for x in model.clusterCenters()) == [0, 9]


def test_questions_of_several_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.6]), (4, [-1.0, -1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 0.9])], "query_id int, part int, vector array<double>")
    got = retrieval.nearest_of_several(v, q, 2, spark.createDataFrame([(7, 4), (7, 1)], "query_id int, id int"))
    assert {(r.id, r.score, r["rank"]) for r in got.collect()} == {(1, 1.0, 1), (2, 0.9, 2), (4, -0.9, None)}


def test_evidence_that_stands_by_itself(spark):
    df = spark.createDataFrame([(1, 20.0, 40.0, 0.1, 20), (2, 30.0, 60.0, 0.1, 16), (3, 20.0, 10.0, 0.1, 0), (4, float("nan"), 10.0, 0.1, 0)], "query_id int, inliers double, matches double, coverage double, label_inliers int")
    cols = {c: F.col(c) for c in ("inliers", "matches", "coverage")}
    assert [r.x for r in df.orderBy("query_id").select(decisions.independent(cols).alias("x")).collect()] == [True, True, False, False]
    assert [r.query_id for r in decisions.strongly_supported(df).collect()] == [2]
    assert [r.query_id for r in decisions.rescue_queue(df, 2).collect()] == [1, 2]
    both = spark.range(1).select(decisions.rescue_candidates(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "bxyz"))).alias("x"))
    assert both.first().x == ["a", "b", "c", "x", "y"]


def test_references_and_outputs(spark, tmp_path):
    listed = spark.createDataFrame([("a", "1.jpg", True), ("a", "2.jpg", None), ("b", "3.jpg", False), ("b", "4.jpg", True)], "slug string, file string, usable boolean")
    found, missing = readers.usable_references(listed, spark.createDataFrame([("1.jpg",), ("4.jpg",)], "file string"))
    assert rows(found.select("slug", "file")) == [("a", "1.jpg"), ("b", "4.jpg")] and rows(missing) == [("a", 1)]
    extra = spark.createDataFrame([("k", 2, "red", "p2"), ("k", 1, " ", "p1"), ("k", 3, "white", None)], "k string, n int, c string, p string")
    assert rows(readers.extra_fields(extra, "k", "c", "p", "n")) == [("k", "red", ["p1", "p2"])]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string")
    sinks.documents(df, str(tmp_path / "docs"), "kind")
    sinks.catalog(df, str(tmp_path / "out"), {"audit": df})
    assert spark.read.json(str(tmp_path / "docs")).count() == 2 and spark.read.parquet(str(tmp_path / "out/catalog.parquet")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "out/audit.csv")).columns == ["id", "kind"]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "dim.yaml").write_text(yaml.safe_dump({"styles": [{"slug": "a", "n": 1}, {"slug": "b"}]}))
    assert rows(readers.dimension(spark, str(tmp_path / "dim.yaml"), "slug string, n int", "styles")) == [("a", 1), ("b", None)]


def test_questions_go_where_they_belong(spark):
    items = spark.createDataFrame(
        [("w1", "wines", "красное вино к мясу", "red"), ("w2", "wines", "белое вино", "white"), ("y1", "wineries", "винодельня Орлова", None), ("k1", "knowledge", "танины вина", None), ("k2", "knowledge", "почва", None)],
        "id string, kind string, text string, color string",
    )
    q = spark.createDataFrame([(1, "красное вино к мясу"), (2, "Что такое танины"), (3, "винодельня Орлова")], "query_id int, text string")
    r = Retriever(items)
    got = {(x.query_id, x.intent): x.id for x in r.ask(q, 1).collect()}
    assert got == {(1, "pairing"): "w1", (2, "fact"): "k1", (3, "travel"): "y1"}
    wide = [x.id for x in r.ask(q.filter("query_id = 1"), 3).orderBy("rank").collect()]
    assert len(wide) == 3 and wide[0] == "w1" and set(wide) & {"k1", "k2"}
    assert [x.id for x in r.ask(q.filter("query_id = 1"), 1, F.col("color") == "white").collect()] == ["w2"]
    ranked = spark.createDataFrame([("k1", 2), ("w1", 1), ("none", 3)], "id string, rank int")
    assert [x.id for x in r.get(ranked).orderBy("rank").collect()] == ["w1", "k1"]


def test_lookups_and_leftovers(spark):
    from larkspur.functions import text as T
    from larkspur.operators import aggregates

    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "a"), (3, "q", "z"), (4, None, None)], "id int, k string, other string")
    dim = spark.createDataFrame([("a", 10), ("b", 20)], "key string, v int")
    assert {r.id: r.v for r in joins.by_key_or(df, dim, [F.col("k"), F.col("other")], "key", ["v"]).collect()} == {1: 10, 2: 20, 3: None, 4: None}
    assert rows(joins.unknown(df, dim.withColumnRenamed("key", "k"), "k")) == [("q", 1)]
    files = spark.createDataFrame([("a.jpg",), ("small_a.jpg",), ("large_b.jpg",)], "name string")
    assert rows(joins.thumbnails(files, "name", T.original_of(F.col("name")))) == [("small_a.jpg",)]
    tags = spark.createDataFrame([(["a", "b"], 1.0), (["b"], 0.0)], "tags array<string>, score double")
    assert rows(aggregates.unused(tags, "tags", spark.createDataFrame([("a",), ("c",)], "tag string"))) == [("c",)]
    scores = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.2), ("b", 0.4), ("c", 0.0)], "g string, s double")
    assert [(r.g, r.n) for r in aggregates.worst(scores, "g", "s", 2, 1).collect()] == [("b", 2)]
