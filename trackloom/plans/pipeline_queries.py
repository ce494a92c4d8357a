"""The whole way from boxes to points on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pipeline as P
from ..session import sized
from ..sources.tables import table
from .base import boxes
from .ground_queries import depth_limit
from .registry import query


def dimensions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, sf, "calibrations").select("site", "h", "image_w", "image_h", "f_px", "height_m")
    cameras = table(spark, sf, "clips").select("clip", "site", F.col("fps").cast("double").alias("fps"), F.col("vid_stride").cast("long").alias("stride")).join(sized(k), "site").drop("site")
    g = table(spark, sf, "group_params").select("class", F.col("group").alias("grp"), "max_speed", F.col("jump_tol_m").alias("jump_tol"))
    by = lambda d: F.coalesce(F.create_map(*[F.lit(v) for kv in d.items() for v in kv])[F.col("grp")], F.lit(0.0))
    g = g.withColumns({"stitch_radius": by({"people": 1.5, "cycles": 2.5, "trains": 8.0, "vehicles": 4.0}), "smooth_s": by({"people": 1.0, "cycles": 0.8, "trains": 1.0, "vehicles": 0.6}), "min_displacement": by({"trains": 10.0, "vehicles": 5.0}), "offset_m": by({"vehicles": 2.2}), "depth_limit": depth_limit()})
    return cameras, g


def processed(spark: SparkSession, sf: str) -> P.Processed:
    return P.process(boxes(spark, sf), *dimensions(spark, sf), P.Settings(stitch_max_gap_s=8.0, end_fit_s=1.6))


@query()
def cln23_points(spark: SparkSession, sf: str) -> DataFrame:
    return processed(spark, sf).points


@query()
def cln23_summary(spark: SparkSession, sf: str) -> DataFrame:
    return processed(spark, sf).summary


@query()
def cln23_counters(spark: SparkSession, sf: str) -> DataFrame:
    return P.counters(boxes(spark, sf), processed(spark, sf))


@query("SELECT DISTINCT clip, true AS same_tracks, true AS same_points, true AS same_sources, true AS on_lattice, true AS in_time FROM raw_boxes WHERE clip IN (SELECT clip FROM clips) AND false")
def cln23_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Clips whose points and summary disagree, in tracks, rows, sources, frames off the lattice or times; there are none."""
    done = processed(spark, sf)
    rates = table(spark, sf, "clips").select("clip", F.col("fps").cast("double").alias("fps"), F.col("vid_stride").alias("stride"))
    w = Window.partitionBy("clip", "track_id").orderBy("frame")
    p = done.points.join(sized(rates), "clip").withColumn("_step", F.col("frame") - F.lag("frame").over(w))
    a = p.groupBy("clip").agg(
        F.count_distinct("track_id").alias("tracks"), F.count("*").alias("n"), F.sum((F.col("source") == "interpolated").cast("long")).alias("i"),
        F.min(F.coalesce(F.col("_step") == F.col("stride"), F.lit(True))).alias("on_lattice"), F.min(F.abs(F.col("time_s") - F.col("frame") / F.col("fps")) < 1e-3).alias("in_time"),
    )
    b = done.summary.groupBy("clip").agg(F.count("*").alias("_tracks"), F.sum("n_points").alias("_n"), F.sum("n_interpolated").alias("_i"))
    j = a.join(b, "clip", "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    j = j.select("clip", same("tracks", "_tracks").alias("same_tracks"), same("n", "_n").alias("same_points"), same("i", "_i").alias("same_sources"), F.coalesce("on_lattice", F.lit(False)).alias("on_lattice"), F.coalesce("in_time", F.lit(False)).alias("in_time"))
    return j.where("not (same_tracks and same_points and same_sources and on_lattice and in_time)")
