"""Small functions, readers and sinks."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import scalars as S
from larkspur.functions import similarity
from larkspur.functions import text as X
from larkspur.operators import decisions, events, families, labels, ranking
from larkspur.sources import readers, scratch, sinks


def each(spark, xs, column, kind="string"):
    return [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").coalesce(1).orderBy("i").select(column(F.col("x")).alias("v")).collect()]


def test_text_functions(spark):
    assert each(spark, ["Вино A", "abc", "", None], X.has_cyrillic) == [True, False, False, None]
    assert each(spark, ["Вино №1.JPG", "A b-c.webp", "x"], X.photo_key) == ["vino1", "abc", "x"]
    assert each(spark, ["Вино, белое", "A--b"], X.separator_key) == ["vino_beloe", "a_b"]
    assert each(spark, ["Щука & Ко", "!!"], lambda c: X.slug_or_null(c, "maker")) == ["shchuka-ko", None]
    assert each(spark, ["Щи_0123456789", " "], X.census_key) == ["shchi_0123456789", ""]
    assert each(spark, ["a_0123456789_abcdef0123", "a_01234"], X.without_hashes) == ["a", "a_01234"]
    assert each(spark, ['say {"a": {"b": 1}} end', "none", None], X.json_object) == ['{"a": {"b": 1}}', None, None]
    assert each(spark, ["a", "", None], X.is_filled) == [True, False, False]
    assert each(spark, [[1], [], None], lambda c: X.is_filled(c, "array<int>"), "array<int>") == [True, False, False]
    assert each(spark, [1.5, float("nan"), None], S.clean_number, "double") == [1.5, None, None]
    assert each(spark, ["kitten", "abc", "", None], lambda c: similarity.indel_ratio(c, F.lit("sitting"))) == [pytest.approx(8 / 13), 0.0, 0.0, None]
    assert each(spark, ["chateau", "schulz", "phoenix", "book"], X.skeleton) == ["sht", "shls", "fnks", "bk"]


def test_choices(spark):
    choice = lambda n, score, lead, conflict: spark.range(1).select(decisions.label_choice(F.array(*[F.lit(str(i)) for i in range(n)]), F.lit(score), F.lit(lead), F.lit(conflict).cast("boolean")).alias("v")).first().v
    assert choice(2, 5.0, 2.0, None) and choice(3, 9.0, 2.5, False)
    assert not any((choice(1, 5.0, 2.0, None), choice(2, 4.9, 2.0, None), choice(2, 5.0, 1.9, None), choice(2, 5.0, 2.0, True)))
    df = spark.createDataFrame([(1, "a", "v2", 0.5), (1, "a", "v1", 0.5), (1, "a", "v3", 0.1), (1, "b", "v1", 0.2)], "q int, id string, view string, s double")
    assert sorted(tuple(r) for r in ranking.best_view(df, ["q", "id"], "s", "view").collect()) == [(1, "a", 0.5, "v1"), (1, "b", 0.2, "v1")]
    page = ranking.page_and_total(spark.createDataFrame([(3, "b"), (2, "B"), (1, "a"), (4, "c")], "id int, name string"), "name", "id", 1, 2).collect()
    assert [(r.id, r.total) for r in page] == [(2, 4), (3, 4)]
    props = spark.createDataFrame([({"a": "1"},), ({"_v": "9"},)], "p map<string, string>")
    assert [r.v for r in props.select(events.stamped(F.col("p")).alias("v")).collect()] == [{"a": "1", "_v": "0.1"}, {"_v": "9"}]
    a = spark.range(1).select(labels.fused(F.lit(0.5), F.lit(None).cast("double"), F.lit(2.0), 0.3, 0.1).alias("v")).first().v
    assert a == pytest.approx(0.7)
    model = decisions.train_fusion(spark.createDataFrame([(float(i), float(i % 3), int(i >= 20)) for i in range(40)], "a double, b double, y int"), ["a", "b"], "y")
    told = model.transform(spark.createDataFrame([(1.0, 0.0, 0), (39.0, 0.0, 1)], "a double, b double, y int").withColumn("_w", F.lit(1.0)))
    assert [r.prediction for r in told.collect()] == [0.0, 1.0]


def test_components_leave_one_table_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "folder", lambda _: str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    got = {r.node: r.root for r in families.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100} and len(list(tmp_path.iterdir())) == 1


def test_readers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name in ("one", "two"):
        (tmp_path / "docs" / f"{name}.json").write_text(json.dumps({"n": len(name), "t": name}, indent=1))
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("t", T.StringType())])
    assert sorted((r.slug, r.n) for r in readers.json_folder(spark, str(tmp_path / "docs"), schema).collect()) == [("one", 3), ("two", 3)]
    (tmp_path / "log.jsonl").write_text('{"k": "a", "i": 1, "e": null}\n{"k": "a", "i": 3}\n{"k": "b", "i": 2, "e": "bad"}\n{"k": "c", "i"\n\n{"k": "a", "i": 2}\n')
    log = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("e", T.StringType())])
    assert [(r.k, r.i) for r in readers.log_lines(spark, str(tmp_path / "log.jsonl"), log, "k", "i", "e").collect()] == [("a", 3)]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "Vino_0123456789.JPG").write_bytes(b"abc")
    [f] = readers.file_table(spark, str(tmp_path / "up")).collect()
    assert (f.filename, f.length, f.parts.base, f.parts.file_hash, f.ext) == ("Vino_0123456789.JPG", 3, "Vino", "0123456789", "jpg")
    [d] = readers.file_digests(spark, str(tmp_path / "up")).collect()
    assert d.sha256 == hashlib.sha256(b"abc").hexdigest()
    assert readers.json_lines(spark, str(tmp_path / "none"), "a int", True).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 2), 1, "x"), ("b", datetime(2024, 1, 3), 2, None)], "kind string, ts timestamp, n int, t string")
    sinks.archive(rows, str(tmp_path / "arc"), "kind", "ts")
    sinks.archive(rows, str(tmp_path / "arc"), "kind", "ts")
    assert spark.read.parquet(str(tmp_path / "arc")).filter("kind = 'a' AND day = '2024-01-02'").count() == 2
    sinks.search_index(rows, str(tmp_path / "idx"), ["t", "n"], ["kind"])
    assert sorted((r.kind, r.text) for r in spark.read.json(str(tmp_path / "idx")).collect()) == [("a", "x · 1"), ("b", "2")]
    sinks.manifest(rows, str(tmp_path / "man"), "v1", dim=64)
    [m] = spark.read.json(str(tmp_path / "man")).collect()
    assert (m.version, m.rows, m.dim) == ("v1", 2, 64)
    assert sinks.markdown(rows.orderBy("kind").select("kind", "t")) == "| kind | t |\n|---|---|\n| a | x |\n| b |  |"
