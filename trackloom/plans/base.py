"""The facts that most queries start from, and the same as SQL.

boxes: one row per (clip, track, frame) of raw_boxes, with lenient flags and NaN as null.
points: the rows of points that count, in local metres, with the class and group of their track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lenient_bool, nan_to_null
from ..operators.slices import clip_rates, rows_that_count
from ..session import cut_lineage, sized
from ..sources.tables import table

#: Names of the sources of a sample, by code.
SOURCES = ["detected", "predicted", "stitched", "interpolated"]


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_boxes").withColumn("predicted", lenient_bool(F.col("predicted"))).withColumn("confidence", nan_to_null(F.col("confidence")))
    w = Window.partitionBy("clip", "track_id", "frame").orderBy("class", "x1", "y1", "x2", "y2", F.coalesce("confidence", F.lit(-1.0)))
    one = raw.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and class is not null")
    return one.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


BOXES = """b AS (
  SELECT clip, track_id, class, class_id, frame, time_s, x1, y1, x2, y2, confidence, predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY clip, track_id, frame ORDER BY class, x1, y1, x2, y2, coalesce(confidence, -1.0)) AS n FROM (
      SELECT clip, track_id, class, class_id, frame, time_s, x1, y1, x2, y2, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence,
        coalesce(lower(trim(predicted)) IN ('true', '1', 'yes', 't', '1.0'), false) AS predicted
      FROM raw_boxes WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND class IS NOT NULL))
  WHERE n = 1)"""


def track_classes(points: DataFrame) -> DataFrame:
    """track_id, cls: the class that most rows name, the first by name on ties."""
    named = points.where("track_id is not null and class is not null").groupBy("track_id", F.lower(F.trim("class")).alias("cls")).agg(F.count("*").alias("_n"))
    return named.groupBy("track_id").agg(F.min(F.struct(-F.col("_n"), "cls")).alias("_b")).select("track_id", F.col("_b.cls").alias("cls"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "points")
    code = F.lit(None).cast("int")
    for k, s in enumerate(SOURCES):
        code = F.when(F.col("source") == s, k).otherwise(code)
    values = {"x": F.col("x"), "y": F.col("y"), "vx": F.col("vx"), "vy": F.col("vy"), "speed": nan_to_null(F.col("speed")), "heading": nan_to_null(F.col("heading")), "predicted": F.col("predicted"), "source": code}
    rows = rows_that_count(raw, ["clip", "site"], values)
    origin = table(spark, sf, "calibrations").select("site", F.col("origin_e"), F.col("origin_n"))
    strides = table(spark, sf, "clips").groupBy("clip").agg(F.max("vid_stride").cast("double").alias("_stride"))
    groups = table(spark, sf, "group_params").select(F.col("class").alias("cls"), F.col("group").alias("grp"))
    rows = rows.join(sized(origin), "site").join(sized(clip_rates(table(spark, sf, "clips"))), "clip").join(sized(strides), "clip")
    rows = rows.withColumn("x", F.col("x") - F.col("origin_e")).withColumn("y", F.col("y") - F.col("origin_n")).where("x * x + y * y <= 1000000.0")
    rows = rows.join(sized(cut_lineage(track_classes(raw))), "track_id").join(sized(groups), "cls")
    source = F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return rows.select("clip", "site", "track_id", "cls", "grp", "frame", (F.col("frame") / F.col("fps")).alias("t"), "x", "y", "vx", "vy", "speed", "heading", F.coalesce("predicted", F.lit(False)).alias("pred"), source.alias("source"), (F.col("_stride") / F.col("fps")).alias("dt"), "fps")


POINTS = """p AS (
  SELECT d.clip, d.site, d.track_id, v.cls, g."group" AS grp, d.frame, d.frame / CAST(c.fps AS DOUBLE) AS t,
    d.x - k.origin_e AS x, d.y - k.origin_n AS y, d.vx, d.vy, CASE WHEN isnan(d.speed) THEN NULL ELSE d.speed END AS speed,
    CASE WHEN isnan(d.heading) THEN NULL ELSE d.heading END AS heading, coalesce(d.predicted, false) AS pred, d.source,
    c.vid_stride / CAST(c.fps AS DOUBLE) AS dt, CAST(c.fps AS DOUBLE) AS fps
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY arrived_at) AS rn FROM points) d
  JOIN clips c ON c.clip = d.clip
  JOIN calibrations k ON k.site = d.site
  JOIN (SELECT track_id, cls FROM (
      SELECT track_id, cls, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, cls) AS rn FROM (
        SELECT track_id, lower(trim(class)) AS cls, count(*) AS n FROM points WHERE class IS NOT NULL GROUP BY ALL)) WHERE rn = 1) v ON v.track_id = d.track_id
  JOIN group_params g ON g.class = v.cls
  WHERE d.rn = 1 AND (d.x - k.origin_e) * (d.x - k.origin_e) + (d.y - k.origin_n) * (d.y - k.origin_n) <= 1000000.0)"""


def sql(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + then


def r(expression: str, places: int = 4) -> str:
    """SQL of functions.rounded."""
    scale = f"1e{places}"
    return f"floor(({expression}) * {scale} + 0.500001) / {scale}"
