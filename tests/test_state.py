"""Streams with state of their own, and tables that grow by segments."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import events
from larkspur.sources import segments
from larkspur.streaming import state, tracking

FRAME = "camera int, ts timestamp, boxes array<struct<x0: double, y0: double, x1: double, y1: double, id: string, small: boolean>>"


def follow(spark, tmp_path, *batches, required=3):
    """(ms, n, track, seen, confirmed) of frames (ms, boxes), a batch after another."""
    start = datetime(2024, 1, 1)
    for frames in batches:
        rows = [(c, start + timedelta(milliseconds=ms), [(x, 0.0, x + 10.0, 10.0, i, s) for x, i, s in boxes]) for c, ms, boxes in frames]
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames"))
    got = state.drain(tracking.tracked(stream, "camera", "ts", "boxes", required=required), rocksdb=True).collect()
    zero = int(start.timestamp() * 1_000_000) if start.tzinfo else None
    first = min((r.at for r in got), default=0) if zero is None else zero
    return sorted((r.camera, (r.at - first) // 1000, r.n, r.track, r.seen, r.confirmed) for r in got)


def test_confirmed_after_three_frames(spark, tmp_path):
    got = follow(spark, tmp_path, [(1, 0, [(0.0, "a", False)]), (1, 500, [(1.0, "a", False)])], [(1, 1000, [(2.0, "a", False)]), (1, 1500, [(2.0, "b", False)])])
    assert got == [(1, 0, 0, 1, 1, False), (1, 500, 0, 1, 2, False), (1, 1000, 0, 1, 3, True), (1, 1500, 0, 1, 1, False)]


def test_gaps_unknowns_and_empty_frames_end_what_was_seen(spark, tmp_path):
    frames = [(1, 0, [(0.0, "a", False)]), (1, 1800, [(0.0, "a", False)]), (1, 2000, [(0.0, None, False)]), (1, 2200, []), (1, 2400, [(0.0, "a", True)])]
    got = follow(spark, tmp_path, frames, required=1)
    assert got == [(1, 0, 0, 1, 1, True), (1, 1800, 0, 2, 1, True), (1, 2000, 0, 2, 0, False), (1, 2400, 0, 3, 1, False)]


def test_each_box_is_claimed_once(spark, tmp_path):
    two = [(0.0, "a", False), (4.0, "b", False)]
    got = follow(spark, tmp_path, [(1, 0, two), (2, 0, two[:1])], [(1, 100, [(3.5, "b", False), (4.0, "b", False), (90.0, "c", False)]), (2, 50, two[1:])])
    assert [(c, ms, n, track, seen) for c, ms, n, track, seen, _ in got if ms] == [(1, 100, 0, 2, 2), (1, 100, 1, 1, 1) if tracking.overlap((0, 0, 10, 10), (4, 0, 14, 10)) >= 0.4 else (1, 100, 1, 3, 1), (1, 100, 2, 3 if tracking.overlap((0, 0, 10, 10), (4, 0, 14, 10)) >= 0.4 else 4, 1), (2, 50, 0, 1 if tracking.overlap((0, 0, 10, 10), (4, 0, 14, 10)) >= 0.4 else 2, 1)]


def test_a_late_or_repeated_frame_changes_nothing(spark, tmp_path):
    a = [(0.0, "a", False)]
    assert follow(spark, tmp_path, [(1, 0, a), (1, 500, a)], [(1, 500, a), (1, 200, a)], [(1, 900, a)]) == [(1, 0, 0, 1, 1, False), (1, 500, 0, 1, 2, False), (1, 900, 0, 1, 3, True)]


def test_a_profile_is_kept_up_and_a_repeated_batch_is_harmless(spark, tmp_path):
    items = spark.createDataFrame([(1, "s", 0.5), (2, "t", None), (3, "s", 0.1)], "item_id int, style string, axis double")
    said = [[("u", 1, "like"), ("u", 2, "like"), ("v", 1, "pass"), ("w", 9, "like")], [("u", 3, "like"), ("v", 3, "like"), ("u", 9, "like")]]
    at, schema = str(tmp_path), "user_id string, item_id int, verdict string"
    for batch in said:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{at}/log")
        sums = events.taste(spark.readStream.schema(schema).parquet(f"{at}/log"), items, ["axis"], "style")
        state.follow(sums, f"{at}/kept")
    kept = lambda: sorted(map(tuple, events.profile_of(state.followed(spark, f"{at}/kept", sums.schema, ["user_id", "style"]), ["axis"]).collect()))
    want = sorted(map(tuple, events.profile(spark.createDataFrame(said[0] + said[1], schema), items, ["axis"], "style").collect()))
    assert kept() == want == [("u", 3, 4, 0.2, "s,t"), ("v", 1, 2, 0.1, "s"), ("w", 0, 1, 0.5, "")]
    last = sorted((tmp_path / "kept" / "out").glob("batch=*"))[-1]
    again = spark.read.parquet(str(last))
    again.write.mode("overwrite").parquet(f"{at}/copy")
    spark.read.parquet(f"{at}/copy").write.mode("overwrite").parquet(str(last))
    assert kept() == want


def test_points_are_uuids(spark):
    ids = ["", "a", "вино::1", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in [*ids, None]], "i string").select(segments.point_id(F.col("i"))).collect()]
    assert got[:-1] == [str(uuid.uuid5(segments.SPACE, i)) for i in ids] and got[-1] is None


def test_segments_are_as_a_rebuild(spark, tmp_path):
    rows = lambda *ids, v=1.0: spark.createDataFrame([(i, [v, float(i)], f"n{i}") for i in ids], "id int, vector array<double>, name string")
    table = segments.Segments(spark, str(tmp_path / "t"), 2)
    table.create(rows(1, 2, 3))
    now = lambda t: sorted((r.id, r.vector[0], r.name) for r in t.read().collect())
    assert now(table) == [(1, 1.0, "n1"), (2, 1.0, "n2"), (3, 1.0, "n3")]
    table.upsert(rows(3, 4, v=2.0), 1)
    table.remove(rows(1, 9).select("id"), 2)
    table.upsert(rows(3, 4, v=2.0), 1)
    assert now(table) == [(2, 1.0, "n2"), (3, 2.0, "n3"), (4, 2.0, "n4")]
    table.upsert(rows(1, v=3.0), 3)
    table.remove(rows(4).select("id"), 4)
    assert now(table) == now(table.compacted(str(tmp_path / "c"))) == [(1, 3.0, "n1"), (2, 1.0, "n2"), (3, 2.0, "n3")]
    with pytest.raises(Exception, match="not of 2 dimensions"):
        table.upsert(spark.createDataFrame([(7, [1.0], "n")], "id int, vector array<double>, name string"), 5)
    assert segments.ensured(spark, str(tmp_path / "t"), 2, rows(1)).path.endswith("t")
    other = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "n")], "id int, vector array<double>, name string")
    assert segments.ensured(spark, str(tmp_path / "t"), 3, other).path.endswith("t-3")
    assert segments.ensured(spark, str(tmp_path / "t"), 3, other).read().count() == 1


def test_frames_in_very_many_files_are_not_late(spark, tmp_path):
    import duckdb

    from larkspur.plans import stream_queries

    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT s * 100 + d AS l_orderkey, d AS l_partkey, s AS l_suppkey, 1 AS l_linenumber, 1.0::DOUBLE AS l_quantity, 0.1::DOUBLE AS l_discount, 0.05::DOUBLE AS l_tax, 'A' AS l_returnflag,
      TIMESTAMP '2000-12-20' + to_days(d::INT * 3) AS l_shipdate FROM range(80) s(s), range(8) d(d)""")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, stream_queries.QUERIES["box_tracks"](spark, str(tmp_path)).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(con.execute(stream_queries.ORACLES["box_tracks"]).fetchall()) and len(got) == 640
