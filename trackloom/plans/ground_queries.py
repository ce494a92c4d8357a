"""Queries of projection, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import ground as G
from ..session import sized
from ..sources.tables import table
from .aggregates import EDGES, SEG, SEGU, rnd, zone_edges
from .base import BOXES, POINTS, points, r, sql
from .box_queries import FEET, feet, sized_boxes
from .registry import query

KEY = "clip, track_id, frame"


def cameras(spark: SparkSession, sf: str) -> DataFrame:
    """Per clip: matrix, picture size, focal length and height of its site's camera."""
    k = table(spark, sf, "calibrations").select("site", "h", "f_px", "height_m", "image_w", "image_h")
    return table(spark, sf, "clips").select("clip", "site").join(sized(k), "site")


def _map(prefix: str, u: str, v: str, m: list[str]) -> str:
    return ", ".join(f"{m[3 * k]} * {u} + {m[3 * k + 1]} * {v} + {m[3 * k + 2]} AS {prefix}{n}" for k, n in enumerate("xyw"))


H = [f"h[{k}]" for k in range(1, 10)]
GROUND = f"""c0 AS (SELECT clip, k.* FROM clips c JOIN calibrations k ON k.site = c.site),
g0 AS (SELECT ft.*, h, image_w, image_h, f_px, height_m, {_map('m', 'u', 'v', H)}, sign({H[6]} * (image_w / 2) + {H[7]} * image_h + {H[8]}) AS ws FROM ft JOIN c0 ON c0.clip = ft.clip),
gr AS (SELECT *, mx / mw AS gx, my / mw AS gy FROM g0 WHERE sign(mw) = ws AND abs(mw) > 1e-12)"""


def projected(spark: SparkSession, sf: str) -> DataFrame:
    b = feet(spark, sf).join(sized(cameras(spark, sf)), "clip")
    h = G.cells("h")
    gx, gy = G.to_ground(h, F.col("u"), F.col("v"), G.sign_of_view(h, F.col("image_w"), F.col("image_h")))
    return b.withColumn("gx", gx).withColumn("gy", gy).where("gx is not null and gy is not null")


@query(sql(BOXES, "q AS (SELECT DISTINCT clip, frame FROM b WHERE frame % 7 <> 0)", then=f"SELECT b.clip, track_id, b.frame, {r('((x1 + x2) / 2 + 0.01 * (b.frame % 10)) / (1.0 + 0.000001 * y2)')} AS u, {r('(y2 - 0.02 * (b.frame % 10)) / (1.0 + 0.000001 * y2)')} AS v FROM b JOIN q ON q.clip = b.clip AND q.frame = b.frame"))
def prj03_registered(spark: SparkSession, sf: str) -> DataFrame:
    from .base import boxes
    from ..operators.boxes import with_feet

    b = boxes(spark, sf)
    d = F.col("frame") % 10
    m = b.where("frame % 7 <> 0").select("clip", "frame").distinct().withColumn("m", F.array(F.lit(1.0), F.lit(0.0), 0.01 * d, F.lit(0.0), F.lit(1.0), -0.02 * d, F.lit(0.0), F.lit(0.000001), F.lit(1.0)))
    return rnd(G.registered(with_feet(b), m).select("clip", "track_id", "frame", "u", "v"))


LENS = {"fx": 1400.0, "fy": 1400.0, "cx": 960.0, "cy": 540.0, "k1": -0.12, "k2": 0.03, "p1": 0.0005, "p2": -0.0003}


def _lens_sql() -> list[str]:
    out = ["l0 AS (SELECT clip, track_id, frame, ((x1 + x2) / 2 - 960.0) / 1400.0 AS x0, (y2 - 540.0) / 1400.0 AS y0, ((x1 + x2) / 2 - 960.0) / 1400.0 AS x, (y2 - 540.0) / 1400.0 AS y FROM b)"]
    for k in range(1, 9):
        out.append(f"l{k} AS (SELECT clip, track_id, frame, x0, y0, (x0 - (2 * 0.0005 * x * y + -0.0003 * (x * x + y * y + 2 * x * x))) / (1 + -0.12 * (x * x + y * y) + 0.03 * (x * x + y * y) * (x * x + y * y)) AS x, (y0 - (0.0005 * (x * x + y * y + 2 * y * y) + 2 * -0.0003 * x * y)) / (1 + -0.12 * (x * x + y * y) + 0.03 * (x * x + y * y) * (x * x + y * y)) AS y FROM l{k - 1})")
    return out


@query(sql(BOXES, *_lens_sql(), then=f"SELECT {KEY}, {r('x * 1400.0 + 960.0', 3)} AS u, {r('y * 1400.0 + 540.0', 3)} AS v FROM l8"))
def prj04_undistorted(spark: SparkSession, sf: str) -> DataFrame:
    from .base import boxes

    u, v = G.undistorted((F.col("x1") + F.col("x2")) / 2, F.col("y2"), LENS)
    return rnd(boxes(spark, sf).select("clip", "track_id", "frame", u.alias("u"), v.alias("v")), 3)


@query(sql(BOXES, FEET, GROUND, then=f"SELECT {KEY}, {r('gx', 3)} AS gx, {r('gy', 3)} AS gy FROM gr"))
def prj05_to_ground(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(projected(spark, sf).select("clip", "track_id", "frame", "gx", "gy"), 3)


@query(sql(BOXES, FEET, GROUND, then=f"SELECT {KEY}, {r('u', 2)} AS u, {r('v', 2)} AS v FROM gr"))
def prj06_to_pixel(spark: SparkSession, sf: str) -> DataFrame:
    """There and back: the pixel of each projected foot point is the foot point."""
    u, v = G.to_pixel(G.cells("h"), F.col("gx"), F.col("gy"))
    return rnd(projected(spark, sf).select("clip", "track_id", "frame", u.alias("u"), v.alias("v")), 2)


@query(sql(BOXES, FEET, GROUND, then="SELECT ft.clip, count(*) AS rows, CAST(count(*) - count(gr.frame) AS BIGINT) AS above_horizon FROM ft LEFT JOIN gr ON gr.clip = ft.clip AND gr.track_id = ft.track_id AND gr.frame = ft.frame GROUP BY ft.clip"))
def prj07_dropped_rows(spark: SparkSession, sf: str) -> DataFrame:
    b = feet(spark, sf).join(sized(cameras(spark, sf)), "clip")
    h = G.cells("h")
    gx, _ = G.to_ground(h, F.col("u"), F.col("v"), G.sign_of_view(h, F.col("image_w"), F.col("image_h")))
    return b.groupBy("clip").agg(F.count("*").alias("rows"), F.sum(gx.isNull().cast("long")).alias("above_horizon"))


def scene() -> np.ndarray:
    """A raster of 1 m cells: a slope with a terrace."""
    j, i = np.mgrid[0:400, 0:400]
    return 5.0 + 0.01 * i + np.where(j < 150, 3.0, 0.0)


@query()
def prj08_ray_cast(spark: SparkSession, sf: str) -> DataFrame:
    """A ray to each row of points, whether the ground there is on the raster or the datum beyond it."""
    p = points(spark, sf).select("clip", "track_id", "frame", F.lit(0.0).alias("ox"), F.lit(-190.0).alias("oy"), F.lit(40.0).alias("oz"), F.col("x").alias("dx"), (F.col("y") + 190.0).alias("dy"), F.lit(-35.0).alias("dz"))
    return rnd(G.ray_cast(p, scene(), -200.0, 200.0, 1.0, 5.0).select("clip", "track_id", "frame", "gx", "gy", "gz"), 3)


@query(sql(POINTS, then="SELECT clip, track_id, frame, true AS near FROM p"))
def prj08_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Rays to every row of points over one inclined plane of 10 m cells, against where they meet it by arithmetic."""
    row, column = np.mgrid[0:240, 0:240]
    # heights at the cells' centres, in x and y of the site
    grid = 2.0 + 0.01 * (-1200.0 + 10.0 * (column + 0.5)) - 0.005 * (1200.0 - 10.0 * (row + 0.5))
    p = points(spark, sf).select("clip", "track_id", "frame", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(60.0).alias("oz"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.lit(-60.0).alias("dz"))
    got = G.ray_cast(p, grid, -1200.0, 1200.0, 10.0, 0.0)
    s = (F.col("oz") - 2.0) / (0.01 * F.col("dx") - 0.005 * F.col("dy") - F.col("dz"))
    off = F.sqrt((F.col("gx") - s * F.col("dx")) ** 2 + (F.col("gy") - s * F.col("dy")) ** 2)
    return got.select("clip", "track_id", "frame", F.coalesce(off < 0.01, F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) < 1e-9).alias("near"))


def terrain(spark: SparkSession) -> DataFrame:
    return spark.range(160_000).select((F.col("id") / 400).cast("long").alias("row"), (F.col("id") % 400).alias("col")).withColumn("z", 5.0 + 0.01 * F.col("col") + 0.02 * F.col("row"))


_Z = "CASE WHEN floor(x + 199.5) >= 0 AND floor(x + 199.5) < 399 AND floor(199.5 - y) >= 0 AND floor(199.5 - y) < 399 THEN 5.0 + 0.01 * (x + 199.5) + 0.02 * (199.5 - y) END"


@query(sql(POINTS, then=f"SELECT {KEY}, {r(_Z, 3)} AS z FROM p"))
def prj09_elevation(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(G.with_elevation(points(spark, sf).select("clip", "track_id", "frame", "x", "y"), terrain(spark), -200.0, 200.0, 1.0).select("clip", "track_id", "frame", "z"), 3)


@query(sql(POINTS, then=f"SELECT clip, track_id, {r(f'avg({_Z})', 2)} AS z FROM p GROUP BY ALL"))
def prj10_mean_elevation(spark: SparkSession, sf: str) -> DataFrame:
    z = G.with_elevation(points(spark, sf).select("clip", "track_id", "frame", "x", "y"), terrain(spark), -200.0, 200.0, 1.0)
    return rnd(z.groupBy("clip", "track_id").agg(F.avg("z").alias("z")), 2)


@query("SELECT r AS \"row\", c AS col, CASE WHEN c % 50 = 7 THEN 5.0 + 0.01 * (c - 1) + 0.02 * r ELSE 5.0 + 0.01 * c + 0.02 * r END AS z FROM range(0, 60) a(r), range(0, 400) b(c)")
def src11_filled_terrain(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps in every fiftieth column take the cell before them."""
    t = terrain(spark).where("row < 60").withColumn("z", F.when(F.col("col") % 50 == 7, F.lit(-9999.0)).otherwise(F.col("z")))
    return G.filled_terrain(t)


@query("SELECT r AS \"row\", c AS col, CASE WHEN c % 50 = 7 THEN 5.0 + 0.01 * (c - 1) + 0.02 * r WHEN c BETWEEN 210 AND 249 THEN 5.0 + 0.01 * (CASE WHEN c <= 229 THEN 209 ELSE 250 END) + 0.02 * r ELSE 5.0 + 0.01 * c + 0.02 * r END AS z FROM range(0, 400) a(r), range(0, 400) b(c)")
def src11_filled_raster(spark: SparkSession, sf: str) -> DataFrame:
    """All 400 rows; besides every fiftieth column a strip of forty is missing."""
    t = terrain(spark).withColumn("z", F.when((F.col("col") % 50 == 7) | F.col("col").between(210, 249), F.lit(-9999.0)).otherwise(F.col("z")))
    return G.filled_terrain(t)


@query(sql(POINTS, EDGES, "q0 AS (SELECT p.site, p.track_id, p.frame, p.x * (1 - z / 40.0) AS x, p.y * (1 - z / 40.0) AS y, z FROM p, (VALUES (0.0), (2.5), (5.0), (7.5)) t(z) WHERE grp = 'trains')",
           f"q1 AS (SELECT site, track_id, frame, z, min({SEG.format(x='x', y='y')}) AS d FROM (SELECT q0.*, e.ax, e.ay, e.ex, e.ey, {SEGU.format(x='x', y='y')} AS u FROM q0 JOIN e ON e.site = q0.site AND e.kind = 'platform') GROUP BY ALL)",
           "q2 AS (SELECT site, z, quantile_cont(d, 0.5) AS m FROM q1 GROUP BY ALL HAVING count(*) >= 20)", then=f"SELECT site, CAST(z AS DOUBLE) AS z, {r('m')} AS median_m FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY m, z) AS n FROM q2) WHERE n = 1"))
def prj11_plane_height(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).where("grp = 'trains'").select("site", "x", "y", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(40.0).alias("height"))
    return rnd(G.fitted_plane(p, zone_edges(spark, sf, "platform").drop("zone_id"), ["site"], [0.0, 2.5, 5.0, 7.5]))


#: Metres of depth a pixel may stand for, by group.
DEPTH = {"people": 0.25, "cycles": 0.4, "vehicles": 1.0, "trains": 0.5}
_LIM = "CASE grp WHEN 'people' THEN 0.25 WHEN 'cycles' THEN 0.4 WHEN 'vehicles' THEN 1.0 ELSE 0.5 END"
_RANGE = f"sqrt(greatest({_LIM} * f_px * height_m - height_m * height_m, height_m * height_m))"


def depth_limit() -> Column:
    out = F.lit(0.5)
    for g, v in DEPTH.items():
        out = F.when(F.col("grp") == g, v).otherwise(out)
    return out


@query(f"SELECT site, grp, {r(_RANGE, 3)} AS range_m FROM calibrations, (SELECT DISTINCT \"group\" AS grp FROM group_params)")
def prj12_precise_range(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "group_params").select(F.col("group").alias("grp")).distinct()
    k = table(spark, sf, "calibrations").crossJoin(sized(g))
    return k.select("site", "grp", rounded(G.precise_range(depth_limit(), F.col("f_px"), F.col("height_m")), 3).alias("range_m"))


@query(sql(POINTS, f"w AS (SELECT p.*, sqrt(x * x + y * y) AS d, {_RANGE} / 4.0 AS rng FROM p JOIN calibrations k ON k.site = p.site)", then=f"SELECT {KEY}, d > rng AS beyond_limit FROM w WHERE d <= 2.2 * rng"))
def prj13_within_range(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "calibrations").select("site", "f_px", "height_m")
    p = points(spark, sf).join(sized(k), "site")
    return G.within_range(p, G.precise_range(depth_limit(), F.col("f_px"), F.col("height_m")) / 4.0).select("clip", "track_id", "frame", "beyond_limit")


@query(sql(POINTS, then=f"SELECT {KEY}, {r('x / sqrt(x * x + (y + 20.0) * (y + 20.0))')} AS ax, {r('(y + 20.0) / sqrt(x * x + (y + 20.0) * (y + 20.0))')} AS ay FROM p"))
def prj14_away(spark: SparkSession, sf: str) -> DataFrame:
    ax, ay = G.away(F.col("x"), F.col("y"), F.lit(0.0), F.lit(-20.0))
    return rnd(points(spark, sf).select("clip", "track_id", "frame", ax.alias("ax"), ay.alias("ay")))


_HALF = "CASE WHEN grp = 'vehicles' THEN 2.2 ELSE 0.0 END"


@query(sql(POINTS, then=f"SELECT {KEY}, {r(f'x - CASE WHEN heading IS NULL THEN 0.0 ELSE {_HALF} * sin(radians(heading)) END', 3)} AS x, {r(f'y - CASE WHEN heading IS NULL THEN 0.0 ELSE {_HALF} * cos(radians(heading)) END', 3)} AS y FROM p"))
def prj15_centred_travel(spark: SparkSession, sf: str) -> DataFrame:
    half = F.when(F.col("grp") == "vehicles", 2.2).otherwise(0.0)
    return rnd(G.centred(points(spark, sf), half).select("clip", "track_id", "frame", "x", "y"), 3)


@query(sql(POINTS, "a AS (SELECT *, x / sqrt(x * x + (y + 20.0) * (y + 20.0)) AS ax, (y + 20.0) / sqrt(x * x + (y + 20.0) * (y + 20.0)) AS ay FROM p WHERE grp = 'vehicles')", "m AS (SELECT *, CASE WHEN heading IS NULL THEN 1.55 ELSE 2.2 * abs(ax * sin(radians(heading)) + ay * cos(radians(heading))) + 0.9 * sqrt(greatest(1 - (ax * sin(radians(heading)) + ay * cos(radians(heading))) * (ax * sin(radians(heading)) + ay * cos(radians(heading))), 0.0)) END AS m FROM a)", then=f"SELECT {KEY}, {r('x + m * ax', 3)} AS x, {r('y + m * ay', 3)} AS y FROM m"))
def prj15_centred_view(spark: SparkSession, sf: str) -> DataFrame:
    ax, ay = G.away(F.col("x"), F.col("y"), F.lit(0.0), F.lit(-20.0))
    p = points(spark, sf).where("grp = 'vehicles'").withColumn("ax", ax).withColumn("ay", ay)
    return rnd(G.centred(p, F.lit(2.2), "view", 0.9, F.col("ax"), F.col("ay")).select("clip", "track_id", "frame", "x", "y"), 3)


@query(sql(BOXES, FEET, GROUND, "i AS (SELECT *, sqrt(gx * gx + gy * gy + height_m * height_m) AS distance, (y2 - y1) * sqrt(gx * gx + gy * gy + height_m * height_m) / f_px AS hh FROM gr WHERE NOT predicted AND class = 'person' AND y2 - y1 >= 25.0)", then=f"SELECT CASE WHEN distance < 15 THEN 0 WHEN distance < 30 THEN 1 WHEN distance < 60 THEN 2 WHEN distance < 120 THEN 3 ELSE 4 END AS band, count(*) AS n, {r('quantile_cont(hh, 0.5)')} AS median_m, {r('quantile_cont(hh, 0.75) - quantile_cont(hh, 0.25)')} AS iqr_m FROM i WHERE hh BETWEEN 0.3 AND 5 GROUP BY band HAVING count(*) >= 30"))
def agg11_implied_heights(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.aggregate import implied_heights

    ground = projected(spark, sf).select("clip", "track_id", "frame", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("height_m") ** 2).alias("distance"), "f_px")
    return rnd(implied_heights(feet(spark, sf), ground))
