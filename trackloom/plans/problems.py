"""Queries of the general track operators that have no counterpart elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.nearby import near_and_inside
from ..operators.slices import rows_that_count, with_fps
from ..operators.spikes import implausible_rows
from ..operators.stops import stops_and_trips
from ..session import cut_lineage, sized
from ..sources.tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    stops = p3_trips(spark, sf).where("kind = 'stop'")
    return stops.select("track_id", F.floor((F.col("start_s") + F.col("end_s")) / 2 / 60).cast("long").alias("stop_minute")).distinct()


def p3_trips(spark: SparkSession, sf: str) -> DataFrame:
    return stops_and_trips(table(spark, sf, "points"), table(spark, sf, "clips"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_and_inside(*[table(spark, sf, t) for t in ("points", "clips", "calibrations", "zones")])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_flags(spark, sf).select("track_id", "frame")


def p5_flags(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_rows(*[table(spark, sf, t) for t in ("points", "clips", "calibrations")])


def p3_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Stops that break what a stop is: shorter than 20 s, overlapping the one before, or most of whose rows are farther than 2 m from its spot."""
    s = p3_trips(spark, sf).where("kind = 'stop'").select("track_id", "start_s", "end_s", "cx", "cy")
    s = cut_lineage(s.withColumn("before", F.lag("end_s").over(Window.partitionBy("track_id").orderBy("start_s"))))
    rows = rows_that_count(with_fps(table(spark, sf, "points"), table(spark, sf, "clips")), ["fps"], {"x": F.col("x"), "y": F.col("y")})
    j = rows.where("x is not null and y is not null").join(sized(s), "track_id").where((F.col("frame") / F.col("fps")).between(F.col("start_s") - 1e-9, F.col("end_s") + 1e-9))
    near = F.avg((F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) <= 2.0).cast("double"))
    per = j.groupBy("track_id", "start_s", "end_s", "before").agg(near.alias("near"))
    bad = (F.col("end_s") - F.col("start_s") < 20 - 1e-6) | (F.col("start_s") < F.col("before")) | (F.col("near") < 0.5)
    return per.where(bad).select("track_id", "start_s", "end_s")


def p5_runs_and_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The tests apart from the decomposition, exactly."""
    return p5_flags(spark, sf).where("stuck or range").select("track_id", "frame", "stuck", "range")


QUERIES = {f.__name__: f for f in (p3_found, p3_trips, p3_checked, p4_found, p5_found, p5_flags, p5_runs_and_ranges)}

_COUNTS = """
WITH d AS (
  SELECT p.track_id, p.clip, p.site, p.frame, c.fps, p.x, p.y
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY arrived_at) AS rn FROM points) p
  JOIN clips c ON c.clip = p.clip
  JOIN calibrations k ON k.site = p.site
  WHERE p.rn = 1 AND p.x IS NOT NULL AND p.y IS NOT NULL AND NOT isnan(p.x) AND NOT isnan(p.y)
    AND sqrt((p.x - k.origin_e) * (p.x - k.origin_e) + (p.y - k.origin_n) * (p.y - k.origin_n)) <= 1000),
n AS (
  SELECT track_id, lower(trim("group")) AS g, count(*) AS n FROM points
  WHERE lower(trim("group")) IN ('people', 'cycles', 'vehicles', 'trains') GROUP BY ALL),
m AS (
  SELECT track_id, CASE WHEN cl = 'person' THEN 'people' WHEN cl = 'bicycle' THEN 'cycles' WHEN cl = 'train' THEN 'trains' ELSE 'vehicles' END AS g, n
  FROM (SELECT track_id, lower(trim(class)) AS cl, count(*) AS n FROM points
        WHERE lower(trim(class)) IN ('person', 'bicycle', 'car', 'truck', 'bus', 'motorcycle', 'train') GROUP BY ALL)),
v AS (
  SELECT coalesce(a.track_id, b.track_id) AS track_id, coalesce(a.g, b.g) AS g
  FROM (SELECT track_id, arg_max(g, n) AS g FROM n GROUP BY track_id) a
  FULL JOIN (SELECT track_id, arg_max(g, n) AS g FROM m GROUP BY track_id) b ON a.track_id = b.track_id),
q AS (SELECT d.*, v.g FROM d JOIN v ON v.track_id = d.track_id),
e AS (
  SELECT zone_id, site, ring_x, ring_y, unnest(range(1, len(ring_x) + 1)) AS i FROM zones),
s AS (
  SELECT zone_id, site, ring_x[i] AS ax, ring_y[i] AS ay, ring_x[i % len(ring_x) + 1] AS bx, ring_y[i % len(ring_x) + 1] AS by FROM e)
"""

_FLAGS = """
WITH d AS (
  SELECT p.track_id, p.frame, p.x, p.y, CASE WHEN isnan(p.speed) THEN NULL ELSE p.speed END AS speed, k.origin_e, k.origin_n
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY arrived_at) AS rn FROM points) p
  JOIN clips c ON c.clip = p.clip LEFT JOIN calibrations k ON k.site = p.site
  WHERE p.rn = 1 AND p.track_id IS NOT NULL AND p.frame IS NOT NULL),
v AS (SELECT track_id, frame, speed AS a, lag(speed) OVER w AS pa FROM d WHERE speed IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
vr AS (SELECT *, sum(CASE WHEN a = pa THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY frame) AS k FROM v),
q AS (SELECT track_id, frame, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)
  WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
qr AS (SELECT *, sum(CASE WHEN x = px AND y <> py THEN 0 ELSE 1 END) OVER w AS kx, sum(CASE WHEN y = py AND x <> px THEN 0 ELSE 1 END) OVER w AS ky
  FROM q WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
s AS (
  SELECT track_id, frame FROM (SELECT *, count(*) OVER (PARTITION BY track_id, k) AS n FROM vr) WHERE n >= 6 AND a <> 0
  UNION SELECT track_id, frame FROM (SELECT *, count(*) OVER (PARTITION BY track_id, kx) AS n FROM qr) WHERE n >= 6
  UNION SELECT track_id, frame FROM (SELECT *, count(*) OVER (PARTITION BY track_id, ky) AS n FROM qr) WHERE n >= 6),
g AS (
  SELECT track_id, frame FROM d WHERE speed < 0 OR speed > 200 OR (NOT isnan(x) AND NOT isnan(y) AND (x <= 0 OR x > 700000 OR y <= 0 OR y > 1300000
    OR coalesce(sqrt((x - origin_e) * (x - origin_e) + (y - origin_n) * (y - origin_n)) > 10000, false))))
SELECT track_id, frame, s.track_id IS NOT NULL AS stuck, g.track_id IS NOT NULL AS "range" FROM s FULL JOIN g USING (track_id, frame)
"""

ORACLES = {
    "p3_checked": "SELECT CAST(0 AS BIGINT) AS track_id, 0.0 AS start_s, 0.0 AS end_s WHERE false",
    "p5_runs_and_ranges": _FLAGS,
    "p4_found": _COUNTS
    + """
SELECT DISTINCT 'near' AS kind, a.track_id AS id_a, b.track_id AS id_b
FROM q a JOIN q b ON a.clip = b.clip AND a.track_id < b.track_id AND a.g <> b.g AND abs(a.frame - b.frame) <= a.fps
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25 + 1e-9
UNION ALL
SELECT DISTINCT 'zone', zone_id, track_id FROM (
  SELECT s.zone_id, d.track_id, d.frame
  FROM d JOIN s ON s.site = d.site AND (s.ay > d.y) <> (s.by > d.y) AND d.x < (s.bx - s.ax) * (d.y - s.ay) / nullif(s.by - s.ay, 0) + s.ax
  GROUP BY ALL HAVING count(*) % 2 = 1)
""",
}
