"""The most alike names against a comparison with all of them."""

from __future__ import annotations

import random

import pytest

from larkspur.functions import similarity as S
from larkspur.operators import fuzzy, intents


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert S.common_subsequence(a, b) == plain_subsequence(a, b)


def names(rng, n):
    words = ["rouge", "petit", "blanc", "reserve", "old", "oak", "cuvee", "chateau", "grand", "noir", "terre", "2019"]
    return [" ".join("".join(c for c in rng.choice(words) if rng.random() > 0.15) or "x" for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.mark.parametrize(("least", "k", "block"), [(52, 5, 8192), (0, 3, 8192), (80, 1, 7)])
def test_most_alike_is_complete(spark, monkeypatch, least, k, block):
    monkeypatch.setattr(fuzzy, "BLOCK", block)
    monkeypatch.setattr(fuzzy, "NAMES", 16)
    rng = random.Random(2)
    known = list(enumerate(names(rng, 120))) + [(i, "old oak") for i in range(120, 140)] + [(3, "another name"), (None, "old oak"), (141, ""), (142, None)]
    asked = list(enumerate([*names(rng, 25), "old oak", "uge tit", "", None]))
    n = spark.createDataFrame(known, "id int, name string").repartition(4)
    got = {}
    for r in intents.resolved(spark.createDataFrame(asked, "query_id int, text string"), n, least, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.name, r.score))
    for query_id, text in asked:
        best = {}
        for i, name in known:
            if i is not None and (name or "").strip() and (text or "").strip():
                score = float(fuzzy.percent(S.token_set(text, name) / 100))
                if score >= least and (i not in best or (-score, name) < best[i]):
                    best[i] = (-score, name)
        want = [(rank, i, name, -s) for rank, (s, i, name) in enumerate(sorted((s, i, name) for i, (s, name) in best.items())[:k], 1)]
        assert sorted(got.get(query_id, [])) == want, text


def test_a_text_of_many_ids_is_compared_once(spark, monkeypatch):
    seen, spread = [], fuzzy.spread
    monkeypatch.setattr(fuzzy, "spread", lambda df: seen.append(df) or spread(df))
    texts = ["old oak", "oak old", "oak, old", "old oaks", "zzz"]  # three are alike in full
    n = spark.createDataFrame([(900 - i, texts[i % 5]) for i in range(900)] + [(3, "old oak"), (1, "old oak"), (1, "Oak Old"), (2, "oak old")], "id int, name string")
    q = spark.createDataFrame([(1, "old oak"), (2, "old oak"), (3, "zz")], "query_id int, text string")
    got = sorted((r.query_id, r["rank"], r.id, r.name, r.score) for r in intents.resolved(q, n, 60, 4).collect())
    near = [(rank, i, "zzz", 80.0) for rank, i in enumerate((1, 6, 11, 16), 1)]
    assert [r for r in got if r[0] == 3] == [(3, *r) for r in near]
    best: dict = {}
    for r in n.filter("name <> 'zzz' AND name <> 'old oaks'").collect():
        best[r.id] = min(best.get(r.id, "~"), r.name)
    first = [(rank, i, best[i], 100.0) for rank, i in enumerate(sorted(best)[:4], 1)]
    assert [r for r in got if r[0] < 3] == [(x, *r) for x in (1, 2) for r in first]
    assert seen[0].count() == len({t.replace(",", " ") for t in texts}) <= 5


def test_lost_first_letters_are_found(spark):
    q = spark.createDataFrame([(1, "ouge petit"), (2, "PETIT, rouge!")], "query_id int, text string")
    n = spark.createDataFrame([("a", "Rouge betit"), ("b", "Petit Rouge"), ("c", "zzz")], "id string, name string")
    found = {(r.query_id, r.id): r.score for r in intents.resolved(q, n, 35, 5).collect()}
    assert set(found) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")} and found[2, "b"] == 100


def test_bounds_spare_most_counts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    part = fuzzy.Names([(i, None, "".join(rng.choice(letters) for _ in range(10))) for i in range(2000)])
    best = fuzzy._Best(5, 52)
    part.search(fuzzy.Text(part.rows[7][2].text[1:]), best)
    assert best.rows[0][1] == 7 and part.counted < 200


def test_no_names_no_queries(spark):
    q, n = spark.createDataFrame([(1, "a")], "query_id int, text string"), spark.createDataFrame([("a", "a")], "id string, name string")
    assert intents.resolved(q.limit(0), n, 50, 1).count() == 0 and intents.resolved(q, n.limit(0), 50, 1).count() == 0
