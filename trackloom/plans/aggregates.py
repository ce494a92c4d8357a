"""Queries of aggregates, statistics and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import aggregate as A
from ..session import sized
from ..sources.tables import table
from .base import BOXES, POINTS, boxes, points, r, sql
from .registry import query


def rnd(df: DataFrame, places: int = 4) -> DataFrame:
    """df with every double rounded alike in all engines."""
    return df.select(*[rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SUMMARY = f"""s AS (
  SELECT *, end_s - start_s AS duration_s, sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y)) AS straight_dist_m,
    CASE WHEN path_length_m > 0 THEN sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y)) / path_length_m END AS straightness
  FROM (SELECT clip, track_id, cls, grp, min(t) AS start_s, max(t) AS end_s, count(*) AS n_points,
      CAST(sum(CASE WHEN source = 'predicted' THEN 1 ELSE 0 END) AS BIGINT) AS n_predicted, CAST(sum(CASE WHEN source = 'stitched' THEN 1 ELSE 0 END) AS BIGINT) AS n_stitched,
      CAST(sum(CASE WHEN source = 'interpolated' THEN 1 ELSE 0 END) AS BIGINT) AS n_interpolated, coalesce(sum(step), 0.0) AS path_length_m,
      avg(speed) AS mean_speed, quantile_cont(speed, 0.5) AS median_speed, max(speed) AS max_speed,
      arg_min(x, frame) AS start_x, arg_min(y, frame) AS start_y, arg_max(x, frame) AS end_x, arg_max(y, frame) AS end_y
    FROM (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM p WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))
    GROUP BY ALL))"""

HEAD = "(degrees(atan2({0}, {1})) + 360.0) - 360.0 * floor((degrees(atan2({0}, {1})) + 360.0) / 360.0)"


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.summary(points(spark, sf))


_GRID = """g AS (SELECT clip, floor(x / 2.0) AS i, floor(y / 2.0) AS j, avg(vx) AS mean_vx, avg(vy) AS mean_vy, avg(speed) AS mean_speed, count(*) AS n, count(DISTINCT track_id) AS n_tracks
  FROM p WHERE NOT pred AND vx IS NOT NULL AND vy IS NOT NULL GROUP BY ALL)"""


@query(sql(POINTS, _GRID, then=f"""SELECT clip, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('(i + 0.5) * 2.0')} AS cell_x, {r('(j + 0.5) * 2.0')} AS cell_y, {r('mean_vx')} AS mean_vx, {r('mean_vy')} AS mean_vy,
  {r('mean_speed')} AS mean_speed, {r('sqrt(mean_vx * mean_vx + mean_vy * mean_vy)')} AS flow_speed, {r(HEAD.format('mean_vx', 'mean_vy'), 2)} AS heading,
  {r('CASE WHEN mean_speed > 0 THEN sqrt(mean_vx * mean_vx + mean_vy * mean_vy) / mean_speed ELSE 0 END')} AS coherence, n AS count, n_tracks FROM g"""))
def agg01_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = A.grid(points(spark, sf), 2.0)
    return rnd(g.withColumn("_h", rounded(F.col("heading"), 2))).withColumn("heading", F.col("_h")).drop("_h")


@query(sql(POINTS, SUMMARY, then="SELECT clip, track_id, cls, grp, n_points, n_predicted, n_stitched, n_interpolated, " + ", ".join(f"{r(c, 3)} AS {c}" for c in ("start_s", "end_s", "path_length_m", "mean_speed", "median_speed", "max_speed", "start_x", "start_y", "end_x", "end_y", "duration_s", "straight_dist_m", "straightness")) + " FROM s"))
def cln22_track_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(summary(spark, sf), 3)


_BLOCK = "count(*) AS n, count(*) / 10.0 AS n_per_min, avg(mean_speed) AS mean_speed, quantile_cont(mean_speed, 0.5) AS median_speed, quantile_cont(mean_speed, 0.85) AS p85_speed, avg(straightness) AS mean_straightness, avg(duration_s) AS mean_duration_s, avg(path_length_m) AS mean_path_m"
_BLOCKS = f"""k AS (
  SELECT a.*, b.mean_sample_speed FROM (
    SELECT 'class' AS scope, cls AS name, {_BLOCK} FROM s GROUP BY cls UNION ALL SELECT 'group', grp, {_BLOCK} FROM s GROUP BY grp) a
  LEFT JOIN (SELECT 'class' AS scope, cls AS name, avg(speed) AS mean_sample_speed FROM p WHERE NOT pred GROUP BY cls UNION ALL SELECT 'group', grp, avg(speed) FROM p WHERE NOT pred GROUP BY grp) b
    ON a.scope = b.scope AND a.name = b.name)"""
METRICS = ["n_per_min", "mean_speed", "median_speed", "p85_speed", "mean_straightness", "mean_duration_s", "mean_path_m", "mean_sample_speed"]


@query(sql(POINTS, SUMMARY, _BLOCKS, then="SELECT scope, name, n, " + ", ".join(f"{r(c)} AS {c}" for c in METRICS) + " FROM k"))
def agg02_stat_blocks(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return rnd(A.stat_blocks(A.summary(p), p, 10.0))


@query(sql(POINTS, SUMMARY, then="""SELECT g.grp, CAST(m.m AS INTEGER) AS minute, count(s.track_id) AS n FROM (SELECT DISTINCT grp FROM s) g CROSS JOIN range(0, 8) m(m)
  LEFT JOIN s ON s.grp = g.grp AND least(greatest(floor(s.start_s / 60.0), 0), 7) = m.m GROUP BY ALL"""))
def agg03_flow_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    return A.flow_per_minute(summary(spark, sf), 0.0, 8)


@query(sql(POINTS, SUMMARY, then=f"""SELECT grp, CAST(b AS INTEGER) AS bin, {r('0.0 + b * 1.25')} AS bin_lo, {r('0.0 + (b + 1) * 1.25')} AS bin_hi, count(*) AS n FROM (
  SELECT grp, least(floor(least(greatest(mean_speed, 0.0), 15.0) / 1.25), 11) AS b FROM s WHERE mean_speed IS NOT NULL) GROUP BY grp, b"""))
def agg04_speed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.histogram(summary(spark, sf), "mean_speed", 0.0, 15.0, 12))


def count_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line per site, west to east, 30 m north of its origin."""
    return table(spark, sf, "calibrations").select(F.concat(F.lit("gate "), "site").alias("line"), "site", F.lit(-60.0).alias("ax"), F.lit(30.0).alias("ay"), F.lit(60.0).alias("bx"), F.lit(30.5).alias("by"))


_CROSS = """w AS (SELECT clip, site, track_id, cls, grp, frame, t, x, y, lead(t) OVER q AS t2, lead(x) OVER q AS x2, lead(y) OVER q AS y2 FROM p WINDOW q AS (PARTITION BY clip, track_id ORDER BY frame)),
z AS (SELECT *, sign(120.0 * (y - 30.0) - 0.5 * (x + 60.0)) AS s1, sign(120.0 * (y2 - 30.0) - 0.5 * (x2 + 60.0)) AS s2, (x2 - x) * 0.5 - (y2 - y) * 120.0 AS den FROM w WHERE t2 IS NOT NULL),
c AS (SELECT * FROM (SELECT *, ((-60.0 - x) * 0.5 - (30.0 - y) * 120.0) / den AS s, ((-60.0 - x) * (y2 - y) - (30.0 - y) * (x2 - x)) / den AS u FROM z WHERE s1 * s2 < 0 AND abs(den) >= 1e-12)
  WHERE s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


@query(sql(POINTS, _CROSS, then=f"SELECT 'gate ' || site AS line, clip, track_id, cls, grp, {r('t + s * (t2 - t)')} AS time_s, CAST(s1 AS INTEGER) AS direction FROM c"))
def agg05_crossings(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.crossings(points(spark, sf), count_lines(spark, sf)))


@query(sql(POINTS, _CROSS, then="SELECT 'gate ' || site AS line, cls, CAST(sum(CASE WHEN s1 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS left_to_right, CAST(sum(CASE WHEN s1 = -1 THEN 1 ELSE 0 END) AS BIGINT) AS right_to_left, " + r("count(*) / 10.0") + " AS per_min FROM c GROUP BY site, cls"))
def agg06_crossing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.crossing_summary(A.crossings(points(spark, sf), count_lines(spark, sf)), 10.0))


@query(sql(POINTS, then=f"SELECT clip, count(*) AS n, {r('avg(CASE WHEN pred THEN 1.0 ELSE 0.0 END)')} AS predicted_share, {r('min(t)')} AS start_s, {r('max(t)')} AS end_s, {r('max(t) - min(t)')} AS duration_s FROM p GROUP BY clip"))
def agg07_predicted_share(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.predicted_share(points(spark, sf)))


@query(sql(POINTS, SUMMARY, _BLOCKS, then=" UNION ALL ".join(f"SELECT scope, name, '{m}' AS metric, {r(m)} AS value FROM k WHERE {m} IS NOT NULL" for m in METRICS)))
def agg08_stats_long(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return rnd(A.unpivot_stats(A.stat_blocks(A.summary(p), p, 10.0), METRICS))


_FIGURES = {"tracks": "CAST(count(*) AS DOUBLE)", "median_speed": "quantile_cont(mean_speed, 0.5)", "path_total_m": "sum(path_length_m)", "straightness": "avg(straightness)"}


@query(sql(POINTS, SUMMARY, then=" UNION ALL ".join([f"SELECT '{n}' AS figure, {r(e, 2)} AS value FROM s" for n, e in _FIGURES.items()] + [f"SELECT '{n}_' || grp, {r(e, 2)} FROM s GROUP BY grp" for n, e in _FIGURES.items()])))
def agg09_key_figures(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return rnd(A.key_figures(A.summary(p), p), 2)


def recorded(spark: SparkSession, sf: str) -> DataFrame:
    """track_summary without its repeats and with normal group names."""
    return table(spark, sf, "track_summary").distinct().withColumn("grp", F.lower(F.trim("group")))


@query(f"SELECT grp, {r('sum(feet_hidden_share * n_points) / sum(n_points)')} AS share, sum(feet_hidden_share * n_points) / sum(n_points) > 0.1 AS warn FROM (SELECT DISTINCT *, lower(trim(\"group\")) AS grp FROM track_summary) WHERE feet_hidden_share IS NOT NULL AND NOT isnan(feet_hidden_share) GROUP BY grp")
def agg12_hidden_feet_share(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.weighted_share(recorded(spark, sf), "feet_hidden_share", "n_points", ["grp"], 0.1))


def zone_edges(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Edges of the zones of a kind in local metres."""
    z = table(spark, sf, "zones").where(F.col("kind") == kind).join(sized(table(spark, sf, "calibrations").select("site", "origin_e", "origin_n")), "site")
    e = z.select("site", "zone_id", "ring_x", "ring_y", "origin_e", "origin_n", F.explode(F.sequence(F.lit(0), F.size("ring_x") - 1)).alias("k"))
    nxt = (F.col("k") + 1) % F.size("ring_x")
    return e.select("site", "zone_id", *[(F.get(f"ring_{c}", k) - F.col(o)).alias(n) for n, c, k, o in (("ax", "x", F.col("k"), "origin_e"), ("ay", "y", F.col("k"), "origin_n"), ("bx", "x", nxt, "origin_e"), ("by", "y", nxt, "origin_n"))])


EDGES = """e AS (SELECT site, zone_id, kind, ring_x[i] - origin_e AS ax, ring_y[i] - origin_n AS ay, ring_x[i % len(ring_x) + 1] - origin_e AS ex, ring_y[i % len(ring_x) + 1] - origin_n AS ey
  FROM (SELECT z.site, zone_id, kind, ring_x, ring_y, origin_e, origin_n, unnest(range(1, len(ring_x) + 1)) AS i FROM zones z JOIN calibrations k ON k.site = z.site))"""
SEG = "sqrt(({x} - ax - u * (ex - ax)) * ({x} - ax - u * (ex - ax)) + ({y} - ay - u * (ey - ay)) * ({y} - ay - u * (ey - ay)))"
SEGU = "CASE WHEN (ex - ax) * (ex - ax) + (ey - ay) * (ey - ay) > 0 THEN least(greatest((({x} - ax) * (ex - ax) + ({y} - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0.0), 1.0) ELSE 0.0 END"


@query(sql(POINTS, EDGES, f"d AS (SELECT site, clip, track_id, frame, min({SEG.format(x='x', y='y')}) AS d FROM (SELECT p.*, e.*, {SEGU.format(x='x', y='y')} AS u FROM p JOIN e ON e.site = p.site AND e.kind = 'roadway' WHERE p.grp = 'vehicles') q(clip, site, track_id, cls, grp, frame, t, x, y, vx, vy, speed, heading, pred, source, dt, fps, site2, zone_id, kind, ax, ay, ex, ey, u) GROUP BY ALL)", then=f"SELECT site, count(*) AS n, {r('avg(CASE WHEN d <= 6.0 THEN 1.0 ELSE 0.0 END)')} AS share, {r('quantile_cont(d, 0.5)')} AS median_m FROM d GROUP BY site"))
def agg13_near_roads_share(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.near_lines_share(points(spark, sf).where("grp = 'vehicles'"), zone_edges(spark, sf, "roadway")))


@query(sql(POINTS, then=f"""SELECT clip, track_id, frame, {r('x')} AS x, {r('y')} AS y, {r('speed')} AS speed FROM (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY abs(t - 120.0), frame) AS n, min(t) OVER (PARTITION BY clip, track_id) AS a, max(t) OVER (PARTITION BY clip, track_id) AS b FROM p) WHERE n = 1 AND a <= 120.0 AND b >= 120.0"""))
def agg14_state_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.state_nearest(points(spark, sf), 120.0))


@query(sql(POINTS, then=f"""SELECT clip, track_id, frame, {r('x')} AS x, {r('y')} AS y, {r('speed')} AS speed FROM (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY frame) AS n FROM (SELECT *, min(t) OVER (PARTITION BY clip, track_id) AS a FROM p) WHERE t >= 120.0 AND a <= 120.0) WHERE n = 1"""))
def agg15_state_next(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.state_next(points(spark, sf), 120.0))


@query(sql(POINTS, then="SELECT clip, track_id, count(*) AS n, list(frame ORDER BY frame) AS frames FROM p WHERE t <= 120.0 AND t >= 110.0 GROUP BY clip, track_id HAVING count(*) >= 2"))
def agg16_trails(spark: SparkSession, sf: str) -> DataFrame:
    return A.trails(points(spark, sf), 120.0, 10.0)


@query(sql(POINTS, then=" UNION ALL ".join(f"SELECT clip, track_id, grp, '{k}' AS kind, {f}(frame, frame) AS frame, {r(f'{f}(x, frame)')} AS x, {r(f'{f}(y, frame)')} AS y FROM p WHERE NOT pred GROUP BY clip, track_id, grp" for k, f in (("source", "arg_min"), ("sink", "arg_max")))))
def agg17_sources_and_sinks(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.sources_and_sinks(points(spark, sf)))


@query(sql(POINTS, "c AS (SELECT clip, floor(x / 2.0) AS i, floor(y / 2.0) AS j, avg(speed) AS v FROM p WHERE grp = 'people' AND speed IS NOT NULL GROUP BY ALL)", "q AS (SELECT DISTINCT clip, floor(x / 2.0) AS i, floor(y / 2.0) AS j FROM p WHERE grp <> 'people')", then=f"SELECT clip, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('v')} AS v FROM (SELECT q.*, c.v, row_number() OVER (PARTITION BY q.clip, q.i, q.j ORDER BY CASE WHEN c.i IS NULL THEN 1 ELSE 0 END, (c.i - q.i) * (c.i - q.i) + (c.j - q.j) * (c.j - q.j), c.i, c.j) AS n FROM q LEFT JOIN c ON c.clip = q.clip AND c.i BETWEEN q.i - 3 AND q.i + 3 AND c.j BETWEEN q.j - 3 AND q.j + 3) WHERE n = 1"))
def agg18_nearest_cell_fill(spark: SparkSession, sf: str) -> DataFrame:
    """As its SQL has it: within three cells on each side only; agg18_nearest_cell_whole has no bound."""
    return rnd(A.cell_means_filled(*speed_cells(spark, sf), "v", ["clip"], 3))


def speed_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Mean speed of people per 2 m cell, and the cells of all others."""
    p = points(spark, sf).withColumn("i", F.floor(F.col("x") / 2.0)).withColumn("j", F.floor(F.col("y") / 2.0))
    cells = p.where("grp = 'people' and speed is not null").groupBy("clip", "i", "j").agg(F.avg("speed").alias("v"))
    return cells, p.where("grp <> 'people'").select("clip", "i", "j").distinct()


@query(sql(POINTS, "c AS (SELECT clip, floor(x / 2.0) AS i, floor(y / 2.0) AS j, avg(speed) AS v FROM p WHERE grp = 'people' AND speed IS NOT NULL GROUP BY ALL)", "q AS (SELECT DISTINCT clip, floor(x / 2.0) AS i, floor(y / 2.0) AS j FROM p WHERE grp <> 'people')", then=f"SELECT clip, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('v')} AS v FROM (SELECT q.*, c.v, row_number() OVER (PARTITION BY q.clip, q.i, q.j ORDER BY CASE WHEN c.i IS NULL THEN 1 ELSE 0 END, (c.i - q.i) * (c.i - q.i) + (c.j - q.j) * (c.j - q.j), c.i, c.j) AS n FROM q LEFT JOIN c ON c.clip = q.clip) WHERE n = 1"))
def agg18_nearest_cell_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell takes the nearest one's value, however far; null only where the clip has no people at all."""
    return rnd(A.cell_means_filled(*speed_cells(spark, sf), "v", ["clip"]))


@query(sql(POINTS, "a AS (SELECT *, lead(frame) OVER w AS nxt FROM (SELECT *, least(floor(least(greatest(speed, 0.0), 15.0) / 1.25), 11) AS k FROM p WHERE speed IS NOT NULL) WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))", "l AS (SELECT *, lag(k) OVER (PARTITION BY clip, track_id ORDER BY frame) AS pk FROM a)", "u AS (SELECT *, sum(CASE WHEN k = pk THEN 0 ELSE 1 END) OVER (PARTITION BY clip, track_id ORDER BY frame) AS run FROM l)", then="SELECT clip, track_id, CAST(run AS BIGINT) AS run, CAST(k AS INTEGER) AS k, min(frame) AS start_frame, coalesce(max(nxt), max(frame)) AS end_frame, count(*) AS n FROM u GROUP BY clip, track_id, run, k"))
def agg19_speed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return A.speed_runs(points(spark, sf), 0.0, 15.0)


@query(sql(POINTS, "n AS (SELECT greatest(1, CAST(ceil(count(*) / 20000.0) AS BIGINT)) AS step FROM p)", then="SELECT clip, track_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY frame) AS k FROM p) q, n WHERE (k - 1) % step = 0"))
def agg20_thinned(spark: SparkSession, sf: str) -> DataFrame:
    return A.thinned(points(spark, sf), 20_000).select("clip", "track_id", "frame")


@query(sql(BOXES, "l AS (SELECT clip, track_id FROM b GROUP BY ALL HAVING (max(frame) - min(frame)) / 25.0 >= 1.0)", "d AS (SELECT b.* FROM b JOIN l ON l.clip = b.clip AND l.track_id = b.track_id WHERE NOT predicted)", "m AS (SELECT clip, (min(frame) + max(frame)) / 2 AS mid FROM d GROUP BY clip)", then="SELECT clip, frame, n FROM (SELECT d.clip, frame, n, row_number() OVER (PARTITION BY d.clip ORDER BY n DESC, abs(frame - mid), frame) AS k FROM (SELECT clip, frame, count(DISTINCT track_id) AS n FROM d GROUP BY ALL) d JOIN m ON m.clip = d.clip) WHERE k = 1"))
def agg21_busiest_frame(spark: SparkSession, sf: str) -> DataFrame:
    return A.busiest_frame(boxes(spark, sf), 25.0)


@query(sql(POINTS, "q AS (SELECT site, count(*) AS n, " + ", ".join(f"CASE WHEN count(*) >= 2000 THEN quantile_cont({c}, 0.002) ELSE min({c}) END AS l{c}, CASE WHEN count(*) >= 2000 THEN quantile_cont({c}, 0.998) ELSE max({c}) END AS h{c}" for c in "xy") + " FROM p GROUP BY site)", then=f"SELECT site, n, {r('lx - (hx - lx) * 0.05')} AS x0, {r('ly - (hy - ly) * 0.05')} AS y0, {r('hx + (hx - lx) * 0.05')} AS x1, {r('hy + (hy - ly) * 0.05')} AS y1 FROM q"))
def agg22_robust_extent(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.robust_extent(points(spark, sf), ["site"]))


@query(sql(POINTS, then="SELECT grp, tracks, CAST(row_number() OVER (ORDER BY tracks DESC, grp) AS INTEGER) AS place FROM (SELECT grp, count(DISTINCT track_id) AS tracks FROM p GROUP BY grp)"))
def agg23_groups_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return A.groups_by_size(points(spark, sf))


_STRAIGHT = """q AS (SELECT p.clip, p.track_id, s.straight_dist_m AS chord, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM p JOIN s ON s.clip = p.clip AND s.track_id = p.track_id
  WHERE s.grp = 'vehicles' AND n_points >= 10 AND straight_dist_m >= 25.0 AND straightness >= 0.9 GROUP BY ALL),
o AS (SELECT clip, track_id, chord, degrees(0.5 * atan2(2 * c, a - b)) AS axis_deg, sqrt(greatest((a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + c * c), 0.0)) AS scatter_m FROM q)"""


@query(sql(POINTS, SUMMARY, _STRAIGHT, then=f"SELECT clip, track_id, {r('chord')} AS chord, {r('axis_deg')} AS axis_deg, {r('scatter_m')} AS scatter_m FROM o"))
def agg24_straight_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.straight_tracks(points(spark, sf), min_ratio=0.9))


_AX = "degrees(atan2(avg(sin(radians(2 * axis_deg))), avg(cos(radians(2 * axis_deg))))) / 2 + 180.0"


@query(sql(POINTS, SUMMARY, _STRAIGHT, then=f"SELECT clip, count(*) AS n, {r(f'({_AX}) - 180.0 * floor(({_AX}) / 180.0)')} AS mean_axis_deg, {r('quantile_cont(scatter_m, 0.5)')} AS median_scatter_m FROM o GROUP BY clip HAVING count(*) >= 1"))
def agg24_axis_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.axis_mean(A.straight_tracks(points(spark, sf), min_ratio=0.9), ["clip"], 1))


@query(sql(BOXES, "t AS (SELECT clip, track_id, count(*) AS rows, greatest(max((x1 + x2) / 2) - min((x1 + x2) / 2), max(y2) - min(y2)) AS span FROM b GROUP BY ALL HAVING count(*) >= 8)", "o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY md5(CAST(track_id AS VARCHAR)), track_id) AS o FROM t WHERE span > 40.0)", "k AS (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY frame) - 1 AS k FROM b)", then=f"SELECT k.clip, k.track_id, frame, {r('(x1 + x2) / 2')} AS u, {r('y2')} AS v FROM k JOIN (SELECT DISTINCT clip, track_id, CAST(floor(i * (rows - 1) / 4.0) AS BIGINT) AS k FROM o, range(0, 5) r(i) WHERE o <= 300) w ON w.clip = k.clip AND w.track_id = k.track_id AND w.k = k.k"))
def agg25_spaced_samples(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.spaced_samples(boxes(spark, sf)))


@query(sql(POINTS, then="SELECT clip, count(*) AS samples, count(DISTINCT track_id) AS tracks, count(DISTINCT (floor(x), floor(y))) AS cells FROM p GROUP BY clip"))
def agg26_sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.sample_counts(points(spark, sf))


@query(sql(POINTS, SUMMARY, then=f"SELECT grp, count(mean_speed) AS n, {r('avg(mean_speed)')} AS mean, {r('stddev_samp(mean_speed)')} AS sd FROM s GROUP BY grp"))
def agg27_normal_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(A.normal_fit(summary(spark, sf), ["grp"]))
