"""Stages, open sets, densities, regions, scenes and pushed data."""

from __future__ import annotations

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larkspur.operators import extraction, intervals, labels, metrics, sampling, stages


def test_costly_scores_are_for_finalists_only(spark):
    rng = random.Random(1)
    rows = [(q, i, rng.random(), float(rng.randint(0, 30)), rng.random()) for q in range(6) for i in range(60)]
    facts = spark.createDataFrame(rows, "query_id int, id int, score double, c double, x double")
    calls = {"coarse": spark.sparkContext.accumulator(0), "costly": spark.sparkContext.accumulator(0)}

    def counted(name, column):
        @F.udf(DoubleType())
        def f(v):
            calls[name].add(1)
            return v

        return lambda df: df.join(facts.select("query_id", "id", F.col(column).alias("_v")), ["query_id", "id"]).withColumn(name, f("_v")).drop("_v")

    known = spark.createDataFrame([(0, 59), (0, 58), (0, 0), (99, 1)], "query_id int, id int")
    judged = stages.staged(facts, counted("coarse", "c"), counted("costly", "x"), known).collect()
    assert calls["costly"].value == len(judged) <= 6 * 5 and calls["coarse"].value <= 6 * 24 + 2
    by = {(q, i): r for q, i, *r in rows}
    for q in range(6):
        ids = sorted(range(60), key=lambda i: (-by[q, i][0], i))[:24]
        seen = ids + ([i for i in (0, 58, 59) if i not in ids] if q == 0 else [])
        coarse = sorted(seen, key=lambda i: (-by[q, i][1], ids.index(i) if i in ids else 99, i))
        finalists = list(dict.fromkeys(coarse[:3] + ids[:2]))
        want = sorted(finalists, key=lambda i: -by[q, i][2])
        assert [r.id for r in sorted(judged, key=lambda r: r.final) if r.query_id == q] == want


def test_a_query_without_a_coarse_match_has_no_result(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 11.0), (2, 1, 0.9, 12.0), (2, 2, 0.8, 3.0)], "query_id int, id int, score double, c double")
    score = lambda name: lambda df: df.join(rows.select("query_id", "id", F.col("c").alias(name)), ["query_id", "id"])
    judged = stages.staged(rows, score("coarse"), score("costly"))
    assert sorted((r.query_id, r.id, r.final) for r in judged.collect()) == [(2, 1, 1), (2, 2, 2)]
    assert [tuple(r) for r in stages.accepted(judged, 10, 2.0).collect()] == [(2, 1)] and stages.accepted(judged, 10, 5.0).count() == 0


def test_negatives_have_gaps_of_their_own(spark):
    rows = [(1, 0.9, True, False), (1, 0.7, False, False), (1, 0.6, False, False), (2, 0.8, False, False), (2, 0.5, False, False), (3, 0.9, True, True), (3, 0.4, False, True), (4, 0.9, True, False)]
    c = spark.createDataFrame(rows, "q int, visual double, truth boolean, shared boolean")
    got = sorted((r.kind, r.correct, round(r.confidence, 6)) for r in metrics.open_set_confidences(c, "q", "visual", "truth", "shared", lambda v, gap: v + gap).collect())
    # 1 without its own is 0.7 with no gap, not 0.7 - 0.2; 2 has none of its own, 3 shares its picture, 4 has no other
    assert got == [("negative", False, 0.7), ("positive", False, 0.8), ("positive", True, 0.9), ("positive", True, 0.9), ("positive", True, 0.9)]


def test_open_set_sweep(spark):
    rng = random.Random(2)
    rows = [("positive", rng.random() < 0.8, round(rng.random(), 2)) for _ in range(60)] + [("negative", False, round(rng.random() * 0.8, 2)) for _ in range(40)]
    sweep = metrics.open_set_sweep(spark.createDataFrame(rows, "kind string, correct boolean, confidence double")).collect()
    assert sorted(r.threshold for r in sweep) == sorted({c for _, _, c in rows})
    for r in sweep:
        right = sum(k == "positive" and ok and c >= r.threshold for k, ok, c in rows)
        refused = sum(k == "negative" and c < r.threshold for k, _, c in rows)
        out = sum(k == "positive" and c < r.threshold for k, _, c in rows)
        assert (r.accuracy, r.answered_right, r.rejected, r.rejected_outside) == pytest.approx(((right + refused) / 100, right / 60, out / 60, refused / 40))


def test_density_runs_and_bands(spark):
    rng, size = random.Random(3), 1000.0
    rows = [(g, lo := rng.uniform(-20, 980), lo + rng.uniform(-1, 60)) for g in range(4) for _ in range(25)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    for bins, frac in ((600, 0.02), (40, 0.0)):
        cover = intervals.density(df, "g", "a", "b", size, bins)
        got = cover.select("g", "cover", intervals.covered(F.col("cover"), F.col("size"), frac, bins).alias("runs"), intervals.middle_band(F.col("cover"), F.col("size"), bins=bins).alias("band")).collect()
        for r in got:
            want, width = np.zeros(bins, int), size / bins
            for g, a, b in rows:
                if g == r.g:
                    want[max(0, int(a / width)) : max(0, min(bins, int(np.ceil(b / width))))] += 1
            assert r.cover == want.tolist()
            runs: list = []
            for i in np.flatnonzero(want).tolist():
                if runs and i - runs[-1][1] <= max(1, int(frac * bins)):
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1])
            assert [(round(x.low, 6), round(x.high, 6)) for x in r.runs] == [(round(a * width, 6), round(b * width, 6)) for a, b in runs]
            k, middle = max(3, int(0.045 * bins)), bins // 2
            smooth = np.convolve(want, np.ones(k, int), mode="same")
            win = int(0.4 * bins)
            low = middle - win + int(np.argmin(smooth[middle - win : middle]))
            high = middle + int(np.argmin(smooth[middle : middle + win]))
            assert (round(r.band.low, 6), round(r.band.high, 6)) == (round(low * width, 6), round(high * width, 6))


def test_regions_grow_until_nothing_is_near(spark):
    line = lambda y, x=300.0, h=10.0, s=0.9: (1, x, y, x + 100, y + h, s)
    boxes = [line(400.0, h=12.0), line(460.0), line(520.0), line(580.0), line(800.0), line(520.0, x=10.0), line(300.0, s=0.3), (2, 0.0, 0.0, 10.0, 10.0, 0.9)]
    df = spark.createDataFrame(boxes, "image int, x0 double, y0 double, x1 double, y1 double, score double")
    [r] = labels.grown_regions(df, "image", F.lit(700.0), F.lit(1000.0)).collect()
    # four lines hang together; the far, the side and the unsure one don't count, nor does an image without any
    mx, my = 0.18 * 100 + 14, 0.15 * 190 + 20
    x0, x1, y0, y1 = 300 - mx, 400 + mx, 400 - my, 590 + my
    middle, more = (x0 + x1) / 2, 320 - (y1 - y0)
    assert (r.image, r.x0, r.x1, r.y0, r.y1) == pytest.approx((1, middle - 157.5, middle + 157.5, y0 - 0.3 * more, y1 + 0.7 * more))


def test_scenes(spark):
    rows = [(i, None if i % 7 == 0 else "lone" if i == 1 else f"m{i % 3}", None if i == 5 else f"f{i}") for i in range(60)]
    items = spark.createDataFrame(rows, "id int, maker string, file string")
    back = spark.createDataFrame([(f"b{i}",) for i in range(5)], "file string")
    plan = sampling.scenes(items, back, "seed", 20).collect()
    assert len(plan) == 59 * 20 and len({r.scene for r in plan}) == 59 * 20
    maker = {f: m for _, m, f in rows}
    for r in plan:
        assert len(set(r.neighbours)) == len(r.neighbours) <= 4 and r.file not in r.neighbours and r.background in {f"b{i}" for i in range(5)}
    sizes, two = Counter(len(r.neighbours) for r in plan), [r for r in plan if len(r.neighbours) > 1 and maker[r.file] not in (None, "lone")]
    assert min(sizes[n] for n in range(5)) > 150
    assert 0.4 < np.mean([len({maker[n] for n in r.neighbours} | {maker[r.file]}) == 1 for r in two]) < 0.75
    assert all(len({maker[n] for n in r.neighbours}) > 0 for r in plan if maker[r.file] == "lone" and r.neighbours)
    again = sampling.scenes(items.repartition(7), back, "seed", 20).collect()
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, again), key=str)
    assert plan != sampling.scenes(items, back, "other", 20).collect()
    assert {r.background for r in sampling.scenes(items, back.limit(0), "seed", 1).collect()} == {None}


def pushed(*objects, parts=1):
    text = json.dumps('1:["$", ' + ", ".join(json.dumps(o) for o in objects) + "]")[1:-1]
    cut = [text[i * len(text) // parts : (i + 1) * len(text) // parts] for i in range(parts)]
    cut = [text] if any(c.endswith("\\") for c in cut) else cut
    return "<p>x</p>" + "".join(f'<script>self.__next_f.push([1,"{c}"])</script>' for c in cut)


@pytest.mark.parametrize("parts", [1, 3])
def test_pushed_objects(spark, parts):
    inner = {"name": 'a } "quoted" {', "year": 2001, "grapeSorts": [{"name": "Merlot"}, "Malbec", {"x": 1}], "gastronomy": ["fish"]}
    html = pushed({"k": "}{"}, {"attributes": inner, "n": {}}, {"other": {"attributes": 5}, "note": '"wine"'}, parts=parts)
    found = [json.loads(x) for x in extraction.pushed_objects(html)]
    assert found == [inner, {"attributes": inner, "n": {}}, {"attributes": 5}]
    assert extraction.pushed_objects(None) == extraction.pushed_objects("<p>") == extraction.pushed_objects('self.__next_f.push([1,"{\\"wine\\": ')== []
    [r] = spark.createDataFrame([(html,)], "h string").select(extraction.pushed_fields(extraction.push_payloads("h")).alias("f")).select("f.*").collect()
    assert (r.name, r.vintage, r.grapes, r.food, r.abv) == (inner["name"], "2001", ["Merlot", "Malbec"], ["fish"], None)
