"""Queries that run a stream over the event log to its present end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from ..sources.scratch import folder
from ..streaming import state, tracking
from .catalog_table_queries import swipes_and_items
from .registry import ORACLES, QUERIES


def latest_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = state.read_log(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value")
    return state.drain(state.current(log, ["user_id"], ["ts", "event_id"]), "complete").select("user_id", "event_id", "event_type", "value")


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events of a user in six hours are allowed."""
    log = state.read_log(spark, f"{sf_dir}/events.parquet")
    return state.drain(state.rate_limited(log, "user_id", "event_id", "ts", 3, 6 * 3600))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = state.sessions(log, "user_id", "ts", "30 minutes", 2)
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def box_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes: a supplier is a camera, a day a frame, five days end a track; frames come in parts of a year, a batch each."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    left, top = F.col("l_linenumber") * 100 + F.col("l_quantity"), F.col("l_discount") * 200
    size = 60 + F.col("l_partkey") % 40
    box = F.struct(
        "l_orderkey", "l_linenumber", left.cast("double").alias("x0"), top.alias("y0"), (left + size).cast("double").alias("x1"), (top + 100).alias("y1"),
        F.when(F.col("l_tax") >= 0.02, F.col("l_returnflag")).alias("id"), (size < 65).alias("small"),
    )
    frames = li.groupBy(F.col("l_suppkey").alias("camera"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    at = f"{folder(spark)}/frames-{uuid.uuid4().hex}"
    years = frames.withColumn("part", F.year("ts"))
    tracks = spark.createDataFrame([], "camera long, at long, n int, track long, seen long, confirmed boolean")
    for part in [r.part for r in years.select("part").distinct().orderBy("part").collect()]:
        years.filter(F.col("part") == part).drop("part").repartition("camera").write.mode("append").parquet(f"{at}/in")
        # all files of a part are one batch: the watermark moves to a batch's last frame, and earlier ones of other files would be late after that
        stream = spark.readStream.schema(frames.schema).parquet(f"{at}/in")
        tracks = state.drain(tracking.tracked(stream, "camera", "ts", "boxes", gap_ms=5 * 86_400_000), rocksdb=True, at=f"{at}/tracks")
    return tracks


def taste_profile_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taste of each user, kept up by a stream of verdicts that is run twice: over the first half of the events, then over the rest."""
    log, at = spark.read.parquet(f"{sf_dir}/events.parquet"), f"{folder(spark)}/profile-{uuid.uuid4().hex}"
    middle = log.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= middle
    for part in (~late, late):
        log.filter(part).write.mode("append").parquet(f"{at}/log")
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/log")
        sums = events.taste(*swipes_and_items(stream, spark.read.parquet(f"{sf_dir}/part.parquet")), ["size_axis", "price_axis"], "style")
        state.follow(sums, f"{at}/kept")
    return events.profile_of(state.followed(spark, f"{at}/kept", sums.schema, ["user_id", "style"]), ["size_axis", "price_axis"])


QUERIES |= {"box_tracks": box_tracks, "taste_profile_stream": taste_profile_stream}
ORACLES["taste_profile_stream"] = ORACLES["taste_profile"]
ORACLES["box_tracks"] = """WITH RECURSIVE o AS (
  SELECT l_suppkey AS camera, epoch_us(date_trunc('day', l_shipdate)) AS "at",
    (row_number() OVER (PARTITION BY l_suppkey, date_trunc('day', l_shipdate) ORDER BY l_orderkey, l_linenumber, x0, y0, x1, y1) - 1)::INT AS n,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY date_trunc('day', l_shipdate), l_orderkey, l_linenumber, x0, y0, x1, y1) AS k, x0, y0, x1, y1, id, small
  FROM (SELECT *, (l_linenumber * 100 + l_quantity)::DOUBLE AS x0, l_discount * 200 AS y0, x0 + 60 + l_partkey % 40 AS x1, l_discount * 200 + 100 AS y1,
    CASE WHEN l_tax >= 0.02 THEN l_returnflag END AS id, 60 + l_partkey % 40 < 65 AS small FROM lineitem)),
r AS (
  SELECT DISTINCT camera, 0::BIGINT AS k, NULL::BIGINT AS "at", NULL::INT AS n, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, id VARCHAR, track BIGINT, seen BIGINT)[] AS free,
    []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, id VARCHAR, track BIGINT, seen BIGINT)[] AS held, 1::BIGINT AS next, 0::BIGINT AS track, 0::BIGINT AS seen, FALSE AS confirmed FROM o
  UNION ALL
  SELECT camera, k, "at", n, list_filter(free, lambda t: t.track <> coalesce(old.track, -1)) AS free,
    list_append(held, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'id': id, 'track': coalesce(old.track, next), 'seen': seen}) AS held,
    CASE WHEN old IS NULL THEN next + 1 ELSE next END AS next, coalesce(old.track, next) AS track, seen, seen >= 3 AND NOT small AS confirmed
  FROM (SELECT *, CASE WHEN id IS NULL THEN 0 WHEN old.id = id THEN old.seen + 1 ELSE 1 END AS seen
    FROM (SELECT *, list_filter(free, lambda t: t.track = best.track AND best.share >= 0.4)[1] AS old
      FROM (SELECT *, list_sort(list_transform(free, lambda t, i: {'share': -area(t), 'i': i, 'track': t.track}))[1] AS found, {'share': -found['share'], 'track': found['track']} AS best
        FROM (SELECT o.*, r.next, CASE WHEN o."at" IS DISTINCT FROM r."at" THEN list_filter(r.held, lambda t: o."at" - r."at" < 432000000000) ELSE r.free END AS free,
          CASE WHEN o."at" IS DISTINCT FROM r."at" THEN list_filter(r.held, lambda t: FALSE) ELSE r.held END AS held FROM r JOIN o ON o.camera = r.camera AND o.k = r.k + 1)))))
SELECT camera, "at", n, track, seen, confirmed FROM r WHERE k > 0""".replace(
    "area(t)",
    "greatest(0, least(t.x1, x1) - greatest(t.x0, x0)) * greatest(0, least(t.y1, y1) - greatest(t.y0, y0))"
    " / ((t.x1 - t.x0) * (t.y1 - t.y0) + (x1 - x0) * (y1 - y0) - greatest(0, least(t.x1, x1) - greatest(t.x0, x0)) * greatest(0, least(t.y1, y1) - greatest(t.y0, y0)))",
)
QUERIES |= {"latest_state_stream": latest_state_stream, "rate_limit_stream": rate_limit_stream, "sessions": sessions}
ORACLES |= {
    "rate_limit_stream": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, n, id, allowed, t1, t2, t3) AS (SELECT user_id, n, event_id, TRUE, us, NULL::BIGINT, NULL::BIGINT FROM e WHERE n = 1 UNION ALL
  SELECT user_id, n, id, ok, CASE WHEN ok THEN us ELSE t1 END, CASE WHEN ok THEN t1 ELSE t2 END, CASE WHEN ok THEN t2 ELSE t3 END
  FROM (SELECT e.user_id, e.n, e.event_id AS id, e.us, t1, t2, t3, coalesce(t3 <= e.us - 21600000000, TRUE) AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS key, id, allowed FROM r""",
    "latest_state_stream": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "sessions": """WITH g AS (SELECT user_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING count(*) >= 2""",
}
