"""Queries of calibration, with their SQL where a fit isn't iterative."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import calibrate as C
from ..operators import ground as G
from ..operators.field import kernel
from ..sources.tables import table
from .aggregates import EDGES, SEG, SEGU, rnd, zone_edges
from .base import POINTS, points, r, sql
from .registry import query


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve click pairs per site: pixels on a lattice, their ground by the site's matrix with small errors."""
    k = table(spark, sf, "calibrations").select("site", "h", "image_w", "image_h")
    c = k.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    u, v = F.col("image_w") * (0.1 + 0.26 * (F.col("k") % 4)), F.col("image_h") * (0.55 + 0.2 * F.floor(F.col("k") / 4))
    h = G.cells("h")
    c = c.withColumn("u", u).withColumn("v", v)
    x, y = G.to_ground(h, F.col("u"), F.col("v"), G.sign_of_view(h, F.col("image_w"), F.col("image_h")))
    return c.select("site", "k", "u", "v", (x + 0.05 * ((F.col("k") * 7) % 5 - 2)).alias("x"), (y + 0.05 * ((F.col("k") * 11) % 5 - 2)).alias("y")).where("x is not null and y is not null")


_H = [f"h[{k}]" for k in range(1, 10)]
CLICKS = f"""ck0 AS (SELECT site, h, image_w, image_h, k, image_w * (0.1 + 0.26 * (k % 4)) AS u, image_h * (0.55 + 0.2 * floor(k / 4)) AS v FROM calibrations, range(0, 12) t(k)),
ck1 AS (SELECT *, {', '.join(f'{_H[3 * q]} * u + {_H[3 * q + 1]} * v + {_H[3 * q + 2]} AS m{q}' for q in range(3))}, sign({_H[6]} * (image_w / 2) + {_H[7]} * image_h + {_H[8]}) AS s FROM ck0),
ck AS (SELECT site, k, u, v, m0 / m2 + 0.05 * ((k * 7) % 5 - 2) AS x, m1 / m2 + 0.05 * ((k * 11) % 5 - 2) AS y FROM ck1 WHERE sign(m2) = s AND abs(m2) > 1e-12)"""


@query(sql(CLICKS, then=f"SELECT site, CAST(k AS INTEGER) AS k, {r('u', 3)} AS u, {r('v', 3)} AS v, {r('x', 3)} AS x, {r('y', 3)} AS y FROM ck"))
def src08_click_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(clicks(spark, sf), 3)


def exact_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """The sites' clicks without errors but for one of twelve, which is 25 m off."""
    c = clicks(spark, sf)
    x = F.col("x") - 0.05 * ((F.col("k") * 7) % 5 - 2)
    y = F.col("y") - 0.05 * ((F.col("k") * 11) % 5 - 2)
    return c.withColumn("x", F.when(F.col("k") == 5, x + 25.0).otherwise(x)).withColumn("y", y)


@query("SELECT site, CAST(12 AS BIGINT) AS n, CAST(11 AS BIGINT) AS inliers, 0.0 AS rmse_m, 0.0 AS max_m, true AS same FROM calibrations")
def cal01_homography(spark: SparkSession, sf: str) -> DataFrame:
    """The site's own matrix, from clicks one of which is wrong."""
    f = C.fits(exact_clicks(spark, sf), ["site"]).join(table(spark, sf, "calibrations").select("site", F.col("h").alias("own")), "site")
    scaled = lambda c: F.transform(c, lambda v: v / F.get(c, F.lit(8)))
    off = F.aggregate(F.zip_with(scaled(F.col("h")), scaled(F.col("own")), lambda a, b: F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-3))), F.lit(0.0), lambda a, v: F.greatest(a, v))
    return rnd(f.select("site", "n", "inliers", "rmse_m", "max_m", (off < 1e-4).alias("same")), 4)


@query(sql(CLICKS, then=f"SELECT site, {r('u', 3)} AS u, {r('v', 3)} AS v, 0.0 AS error_m FROM ck WHERE k <> 5"))
def cal01_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks without errors: what the others say of each is where it is."""
    return rnd(C.held_out(exact_clicks(spark, sf).where("k <> 5"), ["site"]).select("site", "u", "v", "error_m"), 3)


_EIG = "(a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + c * c)"


@query(sql(CLICKS, "g AS (SELECT site, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM ck GROUP BY site)", then=f"SELECT site, {r(f'sqrt(greatest({_EIG}, 0.0) / (a + b - ({_EIG})))')} AS spread FROM g"))
def cal02_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(C.spread(clicks(spark, sf), ["site"]))


_NEAR = [EDGES, f"nd AS (SELECT site, clip, track_id, frame, speed, heading, round({SEG.format(x='x', y='y')}, 9) AS d, round((degrees(atan2(ex - ax, ey - ay)) + 360.0) - 180.0 * floor((degrees(atan2(ex - ax, ey - ay)) + 360.0) / 180.0), 6) AS axis FROM (SELECT p.site, clip, track_id, frame, speed, heading, x, y, ax, ay, ex, ey, {SEGU.format(x='x', y='y')} AS u FROM p JOIN e ON e.site = p.site AND e.kind = 'roadway' WHERE grp = 'vehicles'))",
         "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, clip, track_id, frame ORDER BY d, axis) AS n FROM nd) WHERE n = 1)"]


def near_roads(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).where("grp = 'vehicles'").select("site", "clip", "track_id", "frame", "x", "y", "speed", "heading")
    d = C.nearest_lines(p, zone_edges(spark, sf, "roadway"), ["site"], ["clip", "track_id", "frame"])
    return p.join(d, ["site", "clip", "track_id", "frame"])


@query(sql(POINTS, *_NEAR, then=f"SELECT site, clip, track_id, frame, {r('d', 3)} AS distance_m FROM nn"))
def cal09_road_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(near_roads(spark, sf).select("site", "clip", "track_id", "frame", "distance_m"), 3)


_RES = "rs AS (SELECT site, avg(d) AS road_m, avg(CASE WHEN speed > 1.0 THEN ln(speed) END) - ln(11.0) AS log_speed, avg(CASE WHEN speed > 1.0 THEN abs((heading - axis + 90.0) - 180.0 * floor((heading - axis + 90.0) / 180.0) - 90.0) END) AS direction_deg FROM nn GROUP BY site)"


@query(sql(POINTS, *_NEAR, _RES, then=f"SELECT site, {r('road_m', 3)} AS road_m, {r('log_speed', 3)} AS log_speed, {r('direction_deg', 1)} AS direction_deg FROM rs"))
def cal10_road_residuals(spark: SparkSession, sf: str) -> DataFrame:
    c = C.road_residuals(near_roads(spark, sf), ["site"])
    return c.select("site", rounded(F.col("road_m"), 3).alias("road_m"), rounded(F.col("log_speed"), 3).alias("log_speed"), rounded(F.col("direction_deg"), 1).alias("direction_deg"))


_GRID = ["cd AS (SELECT site, track_id, frame, tt::DOUBLE AS turn, ss::DOUBLE AS scale, ss * (x * cos(radians(tt)) - y * sin(radians(tt))) AS x, ss * (x * sin(radians(tt)) + y * cos(radians(tt))) AS y FROM p, (VALUES (-4.0), (0.0), (4.0)) a(tt), (VALUES (0.95), (1.0), (1.05)) b(ss) WHERE grp = 'vehicles')",
         f"dd AS (SELECT site, track_id, frame, turn, scale, min({SEG.format(x='x', y='y')}) AS d FROM (SELECT cd.*, e.ax, e.ay, e.ex, e.ey, {SEGU.format(x='x', y='y')} AS u FROM cd JOIN e ON e.site = cd.site AND e.kind = 'roadway') GROUP BY ALL)",
         "cm AS (SELECT site, turn, scale, round(avg(d), 6) AS cost FROM dd GROUP BY ALL)"]


@query(sql(POINTS, EDGES, *_GRID, then=f"SELECT site, turn, scale, {r('cost')} AS cost_m FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cost, abs(turn), abs(scale - 1), turn, scale) AS n FROM cm) WHERE n = 1"))
def cal11_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(C.grid_search(points(spark, sf).where("grp = 'vehicles'").select("site", "x", "y"), zone_edges(spark, sf, "roadway"), ["site"], [-4.0, 0.0, 4.0], [0.95, 1.0, 1.05]), 4)


@query(sql(POINTS, *_NEAR, _RES, then="SELECT site, CASE WHEN road_m <= 6 AND direction_deg <= 10 AND abs(log_speed) <= 0.3 THEN 'good' WHEN road_m > 12 OR direction_deg > 20 OR abs(log_speed) > 0.7 THEN 'poor' ELSE 'fair' END AS verdict FROM rs"))
def cal13_quality(spark: SparkSession, sf: str) -> DataFrame:
    return C.quality(C.road_residuals(near_roads(spark, sf), ["site"])).select("site", "verdict")


@query("SELECT clip, f AS frame, " + r("greatest(sqrt((0.02 * (f % 10)) ** 2 + (0.01 * (f % 7)) ** 2), 0.0)", 6) + " AS drift_px FROM clips, range(0, 50) t(f)")
def cal20_drift(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "clips").select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("frame"))
    m = f.withColumn("m", F.array(F.lit(1.0), F.lit(0.0), 0.02 * (F.col("frame") % 10), F.lit(0.0), F.lit(1.0), 0.01 * (F.col("frame") % 7), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return rnd(C.drift(m, F.lit(1920.0), F.lit(1080.0)), 6)


_TAPS = " + ".join(f"coalesce({'lead' if k > 0 else 'lag'}(v, {abs(k)}) OVER w, 0.0) * {g!r}" if k else f"v * {g!r}" for k, g in kernel(1.5) if abs(k) <= 3)
_MASS = " + ".join(f"CASE WHEN {'lead' if k > 0 else 'lag'}(v, {abs(k)}) OVER w IS NOT NULL THEN {g!r} ELSE 0.0 END" if k else f"{g!r}" for k, g in kernel(1.5) if abs(k) <= 3)


@query(sql("a AS (SELECT clip, f AS frame, CASE WHEN f <= 45 THEN sin(5 * floor(f / 5) / 10.0) + (f % 5) / 5.0 * (CASE WHEN f < 45 THEN sin(5 * (floor(f / 5) + 1) / 10.0) ELSE sin(4.5) END - sin(5 * floor(f / 5) / 10.0)) ELSE sin(4.5) END AS v FROM clips, range(0, 50) t(f))", then=f"SELECT clip, frame, {r(f'({_TAPS}) / ({_MASS})', 6)} AS dx FROM a WINDOW w AS (PARTITION BY clip ORDER BY frame)"))
def cal18_smoothed_registration(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "clips").select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("frame"))
    return rnd(C.smoothed_registration(f.withColumn("dx", F.when(F.col("frame") % 5 == 0, F.sin(F.col("frame") / 10.0))), "dx"), 6)


@query("SELECT site, '11 of 12 clicks, rmse 0.000 m, largest 0.000 m' AS report, '1 clicks left out' AS warnings FROM calibrations")
def cal03_reports(spark: SparkSession, sf: str) -> DataFrame:
    return C.reports(C.fits(exact_clicks(spark, sf), ["site"])).select("site", "report", "warnings")


_HGT = "hh AS (SELECT grp AS clip, CASE WHEN t < 60 THEN 0 WHEN t < 120 THEN 1 ELSE 2 END AS band, 1.5::DOUBLE + 0.01::DOUBLE * (frame % 30) AS height FROM p)"


@query(sql(POINTS, _HGT, "bb AS (SELECT clip, band, quantile_cont(height, 0.5) AS m FROM hh GROUP BY ALL HAVING count(*) >= 30)", "cc AS (SELECT clip, s::DOUBLE AS scale, round(avg(abs(m * s - 1.70)), 9) AS cost, count(*) AS bands FROM bb, (VALUES (0.9), (1.0), (1.1), (1.2)) t(s) GROUP BY ALL)", then=f"SELECT clip AS grp, scale, bands, {r('cost', 6)} AS cost_m FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY cost, abs(scale - 1), scale) AS n FROM cc) WHERE n = 1"))
def cal12_people_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up heights, by stretches of time in place of distance."""
    h = points(spark, sf).select("grp", F.when(F.col("t") < 60, 0).when(F.col("t") < 120, 1).otherwise(2).alias("band"), (1.5 + 0.01 * (F.col("frame") % 30)).alias("height"))
    return rnd(C.people_fit(h, ["grp"], [0.9, 1.0, 1.1, 1.2]), 6)


@query(sql(POINTS, "n AS (SELECT site, count(DISTINCT CASE WHEN grp = 'vehicles' THEN track_id END) AS v, count(DISTINCT CASE WHEN grp = 'people' THEN track_id END) AS q FROM p GROUP BY site)", then="SELECT site, CASE WHEN hash_k = 0 THEN 'transfer' WHEN hash_k > 3 THEN 'held-out choice' WHEN v >= 5 THEN 'roads' WHEN q >= 5 AND hash_k >= 2 THEN 'people and clicks' ELSE 'none' END AS way FROM (SELECT n.*, length(site) % 5 AS hash_k FROM n)"))
def cal15_ladder(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    n = p.groupBy("site").agg(F.count_distinct(F.when(F.col("grp") == "vehicles", F.col("track_id"))).alias("vehicle_tracks"), F.count_distinct(F.when(F.col("grp") == "people", F.col("track_id"))).alias("people_tracks"))
    k = F.length("site") % 5
    return C.ladder(n.withColumn("clicks", k).withColumn("same_spot", k == 0)).select("site", "way")


@query(sql(POINTS, "z AS (SELECT site, 5.0 + 0.01 * (x + 199.5) + 0.02 * (199.5 - y) AS z FROM p WHERE floor(x + 199.5) >= 0 AND floor(x + 199.5) < 399 AND floor(199.5 - y) >= 0 AND floor(199.5 - y) < 399)", then=f"SELECT site, {r('quantile_cont(z, 0.5)', 3)} AS datum_m, count(*) AS n FROM z GROUP BY site"))
def cal16_terrain_datum(spark: SparkSession, sf: str) -> DataFrame:
    from .ground_queries import terrain

    return rnd(C.terrain_datum(points(spark, sf).select("site", "x", "y"), terrain(spark), -200.0, 200.0, 1.0, ["site"]), 3)
