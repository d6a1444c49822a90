"""Queries of boxes and pictures: densities along a line, regions that grow, scenes that are planned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, labels, sampling
from .registry import query

# Fixed for the queries: a frame of 43,200 (minutes of a month), 120 bins.
_FRAME, _BINS = 43200.0, 120
_LINE = "SELECT user_id, (epoch_us(ts) // 60000000 % 43200)::DOUBLE AS low, (epoch_us(ts) // 60000000 % 43200) + value * 10 AS high FROM events"
_COVER = f"""l AS ({_LINE}), i AS (SELECT user_id, greatest(0, (low / 360)::DOUBLE) AS a, low, high FROM l),
b AS (SELECT user_id, unnest(range(greatest(0, floor(low / 360.0)::INT), least({_BINS}, ceil(high / 360.0)::INT))) AS bin FROM i),
u AS (SELECT DISTINCT user_id FROM b), g AS (SELECT user_id, r.bin::INT AS bin FROM u, range({_BINS}) r(bin)),
c AS (SELECT g.user_id, g.bin, count(b.bin) AS n FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.bin = g.bin GROUP BY 1, 2)"""


def _cover(t):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) % 43200
    rows = t("events").select("user_id", at.cast("double").alias("low"), (at + F.col("value") * 10).alias("high"))
    return intervals.density(rows, "user_id", "low", "high", _FRAME, _BINS)


@query(f"""WITH {_COVER}, m AS (SELECT user_id, bin, coalesce((bin - lag(bin) OVER (PARTITION BY user_id ORDER BY bin) - 1 > 2)::INT, 1) AS new FROM c WHERE n > 0),
r AS (SELECT user_id, bin, sum(new) OVER (PARTITION BY user_id ORDER BY bin) AS run FROM m)
SELECT user_id, (min(bin) * 360)::DOUBLE AS low, ((max(bin) + 1) * 360)::DOUBLE AS high, (min(bin) + max(bin) + 1) / 2.0::DOUBLE * 360 AS center FROM r GROUP BY user_id, run""")
def covered_runs(t):
    """Parts of a month that a user's events cover, gaps of two bins closed."""
    runs = intervals.covered(F.col("cover"), F.col("size"), 0.02, _BINS)
    return _cover(t).select("user_id", F.explode(runs).alias("r")).select("user_id", "r.*")


@query(f"""WITH {_COVER}, s AS (SELECT user_id, bin, sum(n) OVER (PARTITION BY user_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM c)
SELECT user_id, (arg_min(bin, (n, bin)) FILTER (WHERE bin BETWEEN 12 AND 59) * 360)::DOUBLE AS low, (arg_min(bin, (n, bin)) FILTER (WHERE bin BETWEEN 60 AND 107) * 360)::DOUBLE AS high FROM s GROUP BY user_id""")
def middle_bands(t):
    """The band around the middle of a user's month, between the places that fewest events cover."""
    return _cover(t).select("user_id", intervals.middle_band(F.col("cover"), F.col("size"), 0.4, 0.045, _BINS).alias("b")).select("user_id", "b.*")


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS image, (l_partkey * 7 % 500)::DOUBLE AS x0, (l_suppkey * 13 % 300)::DOUBLE AS y0, (l_partkey * 7 % 500 + 20 + l_quantity * 3)::DOUBLE AS x1, (l_suppkey * 13 % 300 + 1 + l_linenumber * 2)::DOUBLE AS y1, 0.4 + l_tax * 6 AS score FROM lineitem),
k AS (SELECT image, x0, y0, x1, y1 FROM b WHERE score >= 0.5 AND (x0 + x1) / 2 BETWEEN 0.18 * 640 AND 0.82 * 640 AND y1 - y0 >= 0.008 * 400),
m AS (SELECT image, max((x1 - x0) * (y1 - y0)) AS most, median(y1 - y0) AS line FROM k GROUP BY image),
f AS (SELECT k.*, line, (x1 - x0) * (y1 - y0) / most - 1.5::DOUBLE * sqrt((((x0 + x1) / 2 - 320) / 640)**2 + (((y0 + y1) / 2 - 0.58 * 400) / 400)**2) AS fit FROM k JOIN m USING (image)),
r AS (SELECT image, line, x0, y0, x1, y1 FROM f QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(fit, 9) DESC, x0, y0, x1, y1) = 1
  UNION SELECT r.image, r.line, min(least(r.x0, k.x0)), min(least(r.y0, k.y0)), max(greatest(r.x1, k.x1)), max(greatest(r.y1, k.y1)) FROM r JOIN k ON k.image = r.image
    AND greatest(k.y0 - r.y1, r.y0 - k.y1, 0) <= 6 * r.line AND least(k.x1, r.x1 + 64) > greatest(k.x0, r.x0 - 64) GROUP BY r.image, r.line, r.x0, r.y0, r.x1, r.y1),
g AS (SELECT image, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r GROUP BY image),
p AS (SELECT image, x0 - (0.18::DOUBLE * (x1 - x0) + 12.8) AS x0, y0 - (0.15::DOUBLE * (y1 - y0) + 8) AS y0, x1 + (0.18::DOUBLE * (x1 - x0) + 12.8) AS x1, y1 + (0.15::DOUBLE * (y1 - y0) + 8) AS y1 FROM g),
w AS (SELECT image, CASE WHEN x1 - x0 < 288 THEN (x0 + x1) / 2 - 144 ELSE x0 END AS x0, CASE WHEN x1 - x0 < 288 THEN (x0 + x1) / 2 + 144 ELSE x1 END AS x1,
  y0 - 0.3::DOUBLE * greatest(0, 128 - (y1 - y0)) AS y0, y1 + 0.7::DOUBLE * greatest(0, 128 - (y1 - y0)) AS y1 FROM p)
SELECT image, round(greatest(0, x0), 6) AS x0, round(greatest(0, y0), 6) AS y0, round(least(640, x1), 6) AS x1, round(least(400, y1), 6) AS y1 FROM w""")
def grown_regions(t):
    """Regions of labels, grown from line items as boxes of an order's picture."""
    x0, y0 = F.col("l_partkey") * 7 % 500, F.col("l_suppkey") * 13 % 300
    boxes = t("lineitem").select(
        F.col("l_orderkey").alias("image"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_quantity") * 3).alias("x1"), (y0 + 1 + F.col("l_linenumber") * 2).alias("y1"), (0.4 + F.col("l_tax") * 6).alias("score")
    )
    found = labels.grown_regions(boxes, "image", F.lit(640.0), F.lit(400.0))
    return found.select("image", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _share(what: str) -> str:
    return f"('0x' || sha256('s:{what}:' || scene)[1:8])::BIGINT / 4294967295.0::DOUBLE"


@query(f"""WITH i AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS maker, (p_partkey // 2)::VARCHAR AS file FROM part WHERE p_size <> 7),
m AS (SELECT maker, file, row_number() OVER (PARTITION BY maker ORDER BY sha256('s:maker:' || file)) - 1 AS place, count(*) OVER (PARTITION BY maker) AS total FROM (SELECT DISTINCT maker, file FROM i WHERE maker IS NOT NULL)),
a AS (SELECT file, row_number() OVER (ORDER BY sha256('s:all:' || file)) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT file FROM i)),
b AS (SELECT s_name AS background, row_number() OVER (ORDER BY sha256('s:back:' || s_name)) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT s_name FROM supplier)),
s AS (SELECT i.*, id || '-' || n AS scene, m.place AS mp, m.total AS mt, a.place AS ap, a.total AS at_ FROM i CROSS JOIN range(1, 3) r(n) JOIN a USING (file) LEFT JOIN m ON m.maker = i.maker AND m.file = i.file),
t AS (SELECT *, {_share("pool")} < 0.5 AND coalesce(mt, 0) > 1 AS narrow FROM s),
u AS (SELECT *, CASE WHEN narrow THEN mp ELSE ap END AS own, CASE WHEN narrow THEN mt ELSE at_ END - 1 AS others FROM t),
v AS (SELECT *, least(floor({_share("count")} * 5)::INT, 4, others) AS k, floor({_share("start")} * others)::BIGINT AS start FROM u),
d AS (SELECT *, j, (start + j) % others AS p FROM (SELECT *, unnest(range(k)) AS j FROM v)),
e AS (SELECT d.scene, list(coalesce(m.file, a.file) ORDER BY j) AS neighbours FROM d LEFT JOIN m ON narrow AND m.maker = d.maker AND m.place = p + (p >= own)::INT LEFT JOIN a ON NOT narrow AND a.place = p + (p >= own)::INT GROUP BY d.scene)
SELECT scene, id, v.file, coalesce(array_to_string(neighbours, ','), '') AS neighbours, background, floor({_share("seed").replace("scene)", "v.scene)")} * 2147483647)::BIGINT AS seed
FROM v LEFT JOIN e USING (scene) LEFT JOIN b ON b.place = least(floor({_share("back").replace("scene)", "v.scene)")} * b.total)::BIGINT, b.total - 1)""")
def scene_plan(t):
    """Two scenes of each part, with neighbours of its brand or of all, before a supplier; some parts have no brand, some no picture of their own."""
    maker, file = F.when(F.col("p_size") % 10 != 0, F.col("p_brand")), F.when(F.col("p_size") != 7, F.floor(F.col("p_partkey") / 2).cast("string"))
    items = t("part").select(F.col("p_partkey").alias("id"), maker.alias("maker"), file.alias("file"))
    plan = sampling.scenes(items, t("supplier").select(F.col("s_name").alias("file")), "s", 2)
    return plan.withColumn("neighbours", F.array_join("neighbours", ","))
