"""Queries of physical cameras, with SQL that knows the truth: the sites' own cameras, made-up turns, synthetic scenes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators import camera as K
from ..operators import ground as G
from ..session import sized
from ..sources.readers import synthetic_walks
from ..sources.tables import table
from .aggregates import rnd
from .base import POINTS, points, r, sql
from .calibration_queries import exact_clicks
from .registry import query


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "calibrations").select("site", "h", "image_w", "image_h", "f_px", "height_m", "pitch_deg")


@query("SELECT site, round(f_px, 1) AS f_px, 0.0 AS cam_x, -20.0 AS cam_y, round(height_m, 2) AS height_m FROM calibrations")
def prj16_cameras(spark: SparkSession, sf: str) -> DataFrame:
    """The camera behind each site's matrix; it stands 20 m south of the origin, and the table says its focal length and height."""

    def run(frames):
        for f in frames:
            rows = []
            for s, h, w, t in zip(f["site"], f["h"], f["image_w"], f["image_h"]):
                focal, (x, y, z) = C.estimate_camera(np.asarray(h, float).reshape(3, 3), (w, t))
                rows.append((s, round(focal, 1), round(x, 3) + 0.0, round(y, 3), round(z, 2)))
            yield pd.DataFrame(rows, columns=["site", "f_px", "cam_x", "cam_y", "height_m"])

    return sites(spark, sf).mapInPandas(run, "site string, f_px double, cam_x double, cam_y double, height_m double")


@query("SELECT site, CAST(k AS INTEGER) AS k, round(image_w * (0.1 + 0.26 * (k % 4)), 2) AS u, round(image_h * (0.55 + 0.2 * floor(k / 4)), 2) AS v FROM calibrations, range(0, 12) t(k)")
def prj17_projected(spark: SparkSession, sf: str) -> DataFrame:
    """A lattice of pixels to the ground by the matrix, and back by the 3x4 matrix of the camera that was recovered from it."""
    c = sites(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    c = c.withColumn("u", F.col("image_w") * (0.1 + 0.26 * (F.col("k") % 4))).withColumn("v", F.col("image_h") * (0.55 + 0.2 * F.floor(F.col("k") / 4)))
    h = G.cells("h")
    x, y = G.to_ground(h, F.col("u"), F.col("v"), G.sign_of_view(h, F.col("image_w"), F.col("image_h")))

    def run(frames):
        for f in frames:
            rows = []
            for q in f.to_dict("records"):
                size = (q["image_w"], q["image_h"])
                m = np.asarray(q["h"], float).reshape(3, 3)
                focal, where = C.estimate_camera(m, size)
                ahead = m @ [size[0] / 2, size[1], 1.0]
                yaw = math.atan2(ahead[0] / ahead[2] - where[0], ahead[1] / ahead[2] - where[1])
                p = C.camera_matrix(focal, np.array([*where, yaw, math.radians(q["pitch_deg"]), 0.0]), size) @ [q["x"], q["y"], 0.0, 1.0]
                rows.append((q["site"], q["k"], round(p[0] / p[2], 2), round(p[1] / p[2], 2)))
            yield pd.DataFrame(rows, columns=["site", "k", "u", "v"])

    return c.withColumn("x", x).withColumn("y", y).drop("u", "v").mapInPandas(run, "site string, k int, u double, v double")


def priors(spark: SparkSession, sf: str) -> DataFrame:
    """What one would say of the sites' cameras from memory: all of it off."""
    k = table(spark, sf, "calibrations")
    return k.select("site", "image_w", "image_h", F.lit(8.0).alias("yaw"), (F.col("pitch_deg") + 4).alias("tilt"), (F.col("f_px") * 0.75).alias("focal"), F.lit(3.0).alias("x"), F.lit(-24.0).alias("y"), (F.col("height_m") + 2).alias("height"), F.lit(15.0).alias("position_tol"), F.lit(6.0).alias("height_tol"))


@query("SELECT site, true AS focal, true AS height, true AS tilt, true AS place FROM calibrations")
def cal04_cameras(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras fitted to clicks that are right, against the sites' own: within 3 %, 1 m, half a degree and 1.5 m."""
    got = K.camera_fits(exact_clicks(spark, sf).where("k <> 5"), priors(spark, sf))
    j = got.withColumnRenamed("height_m", "_height").join(sites(spark, sf), "site")
    near = lambda a, b, tol: F.abs(a - b) <= tol
    return j.select("site", near(F.col("focal_px"), F.col("f_px"), 0.03 * F.col("f_px")).alias("focal"), near(F.col("_height"), F.col("height_m"), 1.0).alias("height"), near(F.col("tilt_deg"), F.col("pitch_deg"), 0.5).alias("tilt"), (F.sqrt(F.col("cam_x") ** 2 + (F.col("cam_y") + 20.0) ** 2) <= 1.5).alias("place"))


@query("SELECT site, CAST(12 AS BIGINT) AS n, true AS without_it FROM calibrations")
def cal07_without_outlier(spark: SparkSession, sf: str) -> DataFrame:
    """One click of twelve is 25 m off: it doesn't count in the second fit, and at most one other beside it doesn't."""
    return K.camera_fits(exact_clicks(spark, sf), priors(spark, sf)).select("site", "n", F.col("counted").between(10, 11).alias("without_it"))


@query("SELECT site, CAST(11 AS BIGINT) AS agreeing FROM calibrations")
def cal06_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return K.consensus_clicks(exact_clicks(spark, sf), priors(spark, sf)).groupBy("site").agg(F.sum(F.col("agrees").cast("long")).alias("agreeing"))


@query("SELECT site, true AS among_the_clicks, true AS better_than_plane FROM calibrations")
def cal14_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Which method predicts held-out clicks best, one of them being wrong: a camera does at least as well as the plain plane at every site."""
    e = K.method_errors(exact_clicks(spark, sf), priors(spark, sf))
    best = C.best_method(e, ["site"])
    plane = e.where("method = 'plane'").groupBy("site").agg(F.percentile("error_m", 0.5).alias("plane_m"))
    return best.join(plane, "site").select("site", (F.col("median_m") < 3.0).alias("among_the_clicks"), (F.col("median_m") <= F.col("plane_m")).alias("better_than_plane"))


def turning(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of every clip over frames in which the camera turns by 0.3 degrees a frame, by 6 in every tenth; each seventh match is wrong."""
    c = table(spark, sf, "clips").select("clip", "site").join(sites(spark, sf), "site").select("clip", "f_px", "image_w", "image_h")
    m = c.withColumn("frame", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long")))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(83))))
    m = m.withColumn("u", F.col("image_w") * (0.1 + 0.8 * (F.col("k") % 7) / 6)).withColumn("v", F.col("image_h") * (0.1 + 0.8 * F.floor(F.col("k") / 7) / 11))
    turn = F.radians(F.when(F.col("frame") % 10 == 0, 6.0).otherwise(0.3))
    a, b = (F.col("u") - F.col("image_w") / 2) / F.col("f_px"), (F.col("v") - F.col("image_h") / 2) / F.col("f_px")
    x, z = F.cos(turn) * a + F.sin(turn), F.cos(turn) - F.sin(turn) * a
    wrong = F.when(F.col("k") % 7 == 3, 40.0).otherwise(0.0)
    return m.withColumn("u0", F.col("image_w") / 2 + F.col("f_px") * x / z + wrong).withColumn("v0", F.col("image_h") / 2 + F.col("f_px") * b / z)


@query("SELECT clip, CAST(f AS BIGINT) AS frame, CASE WHEN f % 10 <> 0 THEN 0.3 END AS angle_deg, CAST(CASE WHEN f % 10 <> 0 THEN 72 ELSE 0 END AS BIGINT) AS agreeing FROM clips, range(1, 13) t(f)")
def cal19_turns(spark: SparkSession, sf: str) -> DataFrame:
    m = turning(spark, sf)
    got = K.frame_turns(m, m.select("clip", "f_px", "image_w", "image_h").distinct())
    return got.select("clip", "frame", F.round("angle_deg", 4).alias("angle_deg"), "agreeing")


@query("SELECT site, turn, turn <> 'moved' AND turn <> 'skyline' AS same_spot FROM calibrations, (VALUES ('turned'), ('zoomed'), ('moved'), ('skyline')) t(turn)")
def cal08_same_spot(spark: SparkSession, sf: str) -> DataFrame:
    """Four made-up second views of each site: turned, turned and zoomed, from 6 m aside (by its ground), turned but matched along a skyline alone."""

    def run(frames):
        for f in frames:
            rows = []
            for s, h, w, t, focal in zip(f["site"], f["h"], f["image_w"], f["image_h"], f["f_px"]):
                ground = np.asarray(h, float).reshape(3, 3)
                k = np.array([[focal, 0, w / 2], [0, focal, t / 2], [0, 0, 1.0]])
                zoom = np.array([[1.4 * focal, 0, w / 2], [0, 1.4 * focal, t / 2], [0, 0, 1.0]])
                a = math.radians(7.0)
                turn = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
                aside = np.array([[1, 0, 6.0], [0, 1, 9.0], [0, 0, 1.0]])
                views = {"turned": k @ turn @ np.linalg.inv(k), "zoomed": zoom @ turn @ np.linalg.inv(k), "moved": np.linalg.inv(ground) @ aside @ ground}
                for name, m in (views | {"skyline": views["turned"]}).items():
                    v = np.linspace(0.30, 0.34, 50) * t if name == "skyline" else np.linspace(0.2, 0.9, 50) * t
                    rows.append((s, name, (m / m[2, 2]).ravel().tolist(), v.tolist(), w, t))
            yield pd.DataFrame(rows, columns=["clip", "other", "h", "matched_v", "image_w", "image_h"])

    pairs = sites(spark, sf).repartition(8).mapInPandas(run, "clip string, other string, h array<double>, matched_v array<double>, image_w int, image_h int")
    return K.same_spot(pairs).select(F.col("clip").alias("site"), F.col("other").alias("turn"), "same_spot")


@query(sql(POINTS, "s AS (SELECT site, track_id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) / greatest(t - lag(t) OVER w, 1e-3) AS v FROM p WHERE grp = 'vehicles' WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))",
           "g AS (SELECT site, track_id, exp(avg(ln(greatest(v, 1e-3)))) AS speed FROM s WHERE v IS NOT NULL GROUP BY ALL)",
           then=f"SELECT site, track_id, {r('speed')} AS speed, {r('greatest(ln(speed / 40.0), 0.0) + greatest(ln(0.2 / speed), 0.0)')} AS speed_fault FROM g"))
def cal10_speed_faults(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("clip", "track_id").orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    s = points(spark, sf).where("grp = 'vehicles'").withColumn("step_speed", F.sqrt(dx * dx + dy * dy) / F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-3)))
    return rnd(K.track_speed_faults(s.where("step_speed is not null"), ["site"]), 4)


_SIZE = "ln(greatest(m, 1e-3) / greatest(l * abs(sin(radians(heading) - atan2(x, y))) + b * abs(cos(radians(heading) - atan2(x, y))), 1e-3))"


@query(sql(POINTS, "q AS (SELECT *, 1.5 + (frame % 5) AS m, CASE cls WHEN 'bus' THEN 11.0 WHEN 'truck' THEN 8.0 WHEN 'motorcycle' THEN 2.1 ELSE 4.5 END AS l, CASE cls WHEN 'bus' THEN 2.55 WHEN 'truck' THEN 2.5 WHEN 'motorcycle' THEN 0.8 ELSE 1.8 END AS b FROM p WHERE grp = 'vehicles')",
           f"g AS (SELECT site, track_id, coalesce(avg({_SIZE}), 0.0) AS v FROM q GROUP BY ALL)", then=f"SELECT site, track_id, {r('v')} AS log_ratio, {r('greatest(abs(v) - 0.15, 0.0)')} AS size_fault FROM g"))
def cal10_size_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Lower edges of boxes laid about the positions of points, 1.5 to 5.5 m wide."""
    p = points(spark, sf).where("grp = 'vehicles'")
    half = (1.5 + F.col("frame") % 5) / 2
    b = p.select("site", "track_id", "cls", (F.col("x") - half).alias("left_x"), F.col("y").alias("left_y"), (F.col("x") + half).alias("right_x"), F.col("y").alias("right_y"), "x", "y", "heading")
    return rnd(K.track_size_faults(b, ["site"]), 4)


_DEPTH = [
    "zo AS (SELECT z.zone_id, z.site, unnest(range(1, len(ring_x) + 1)) AS i, ring_x, ring_y, origin_e, origin_n FROM zones z JOIN calibrations k ON k.site = z.site)",
    "ze AS (SELECT zone_id, site, ring_x[i] - origin_e AS ax, ring_y[i] - origin_n AS ay, ring_x[i % len(ring_x) + 1] - origin_e AS ex, ring_y[i % len(ring_x) + 1] - origin_n AS ey FROM zo)",
    "pe AS (SELECT p.site, p.track_id, p.frame, zone_id, p.x, p.y, ax, ay, ex, ey, CASE WHEN ax = ex AND ay = ey THEN 0.0 ELSE least(greatest(((p.x - ax) * (ex - ax) + (p.y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0.0), 1.0) END AS u FROM p JOIN ze ON ze.site = p.site WHERE grp = 'people')",
    "pz AS (SELECT site, track_id, frame, zone_id, min(sqrt((x - ax - u * (ex - ax)) * (x - ax - u * (ex - ax)) + (y - ay - u * (ey - ay)) * (y - ay - u * (ey - ay)))) AS d, sum(CASE WHEN (ay > y) <> (ey > y) AND x < (ex - ax) * (y - ay) / nullif(ey - ay, 0) + ax THEN 1 ELSE 0 END) % 2 AS odd FROM pe GROUP BY ALL)",
    "pd AS (SELECT p.site, p.track_id, p.frame, coalesce(d, 0.0) AS d FROM (SELECT site, track_id, frame FROM p WHERE grp = 'people') p LEFT JOIN (SELECT track_id, frame, max(d) AS d FROM pz WHERE odd = 1 GROUP BY ALL) z ON z.track_id = p.track_id AND z.frame = p.frame)",
]


@query(sql(POINTS, *_DEPTH, then=f"SELECT site, track_id, frame, {r('d', 3)} AS depth_m FROM pd"))
def cal12_obstacle_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of every kind taken for obstacles."""
    return rnd(depths(spark, sf), 3)


def depths(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).where("grp = 'people'").select("site", "track_id", "frame", "x", "y")
    o = table(spark, sf, "calibrations").select("site", "origin_e", "origin_n")
    z = table(spark, sf, "zones").join(sized(o), "site")
    z = z.select("zone_id", "site", F.transform("ring_x", lambda v: v - F.col("origin_e")).alias("ring_x"), F.transform("ring_y", lambda v: v - F.col("origin_n")).alias("ring_y"))
    return K.obstacle_depth(p, z, ["site", "track_id", "frame"])


@query(sql(POINTS, *_DEPTH, "sp AS (SELECT site, track_id, avg(speed) AS speed FROM p WHERE grp = 'people' GROUP BY ALL)", "fs AS (SELECT site, avg(CASE WHEN speed > 2.5 THEN 1.0 ELSE 0.0 END) AS fast_share FROM sp WHERE speed IS NOT NULL GROUP BY site)",
           then=f"SELECT pd.site, {r('avg(d)')} AS inside_m, {r('avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)')} AS inside_share, {r('any_value(fast_share)')} AS fast_share FROM pd LEFT JOIN fs ON fs.site = pd.site GROUP BY pd.site"))
def cal12_people_cost(spark: SparkSession, sf: str) -> DataFrame:
    s = points(spark, sf).where("grp = 'people'").groupBy("site", "track_id").agg(F.avg("speed").alias("speed"))
    return rnd(K.people_cost(depths(spark, sf), s, ["site"]), 4)


SCENE = {"yaw": 20.0, "tilt": 25.0, "focal": 1500.0, "x": -6.0, "y": -30.0, "height": 12.0}


@query("SELECT CAST(k + 1 AS BIGINT) AS track_id, CAST(f AS BIGINT) AS frame, " + r("1.4 * f / 25.0 * sin(radians(k * 30.0)) + k", 3) + " AS x, " + r("1.4 * f / 25.0 * cos(radians(k * 30.0)) + 2.0 * k", 3) + " AS y FROM range(0, 5) a(k), range(0, 500) b(f) WHERE (1.4 * f / 25.0 * sin(radians(k * 30.0)) + k + 6.0) * sin(radians(20.0)) + (1.4 * f / 25.0 * cos(radians(k * 30.0)) + 2.0 * k + 30.0) * cos(radians(20.0)) > 0")
def src21_boxes_to_ground(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the synthetic walkers, brought back to the ground through the camera's matrix: where they truly are."""
    b = K.synthetic_boxes(synthetic_walks(spark), SCENE)
    g = np.linalg.inv(C._camera_from(SCENE["focal"], np.array([SCENE["x"], SCENE["y"], SCENE["height"], math.radians(SCENE["yaw"]), math.radians(SCENE["tilt"]), 0.0]), (1920, 1080)))
    h = [F.lit(float(v)) for v in g.ravel()]
    x, y = G.to_ground(h, (F.col("x1") + F.col("x2")) / 2, F.col("y2"), G.sign_of_view(h, F.lit(1920), F.lit(1080)))
    return rnd(b.select("track_id", "frame", x.alias("x"), y.alias("y")), 3)
