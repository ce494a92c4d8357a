"""Queries of what sinks write, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..sources import sinks as K
from ..sources.readers import synthetic_walks
from .aggregates import rnd
from .base import BOXES, POINTS, boxes, points, r, sql
from .registry import ORACLES, query


@query(sql(BOXES, then="SELECT clip, count(*) AS rows, count(DISTINCT track_id) AS tracks, CAST(sum(CASE WHEN predicted THEN 1 ELSE 0 END) AS BIGINT) AS predicted, min(frame) AS start_frame, max(frame) AS end_frame FROM b GROUP BY clip"))
def snk04_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return K.run_summary(boxes(spark, sf))


@query(sql(POINTS, f"v AS (SELECT clip, track_id, frame, {r('x', 3)} AS x, {r('y', 3)} AS y FROM p)", "d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))", then="SELECT clip, track_id, CAST(count(*) AS INTEGER) AS vertices FROM d WHERE NOT coalesce(x = px AND y = py, false) GROUP BY clip, track_id HAVING count(*) >= 2"))
def snk07_track_lines(spark: SparkSession, sf: str) -> DataFrame:
    return K.track_features(points(spark, sf)).select("clip", "track_id", "vertices")


@query(sql(POINTS, f"v AS (SELECT clip, track_id, frame, {r('x', 3)} AS x, {r('y', 3)} AS y FROM p)", "d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))",
           then="SELECT clip, track_id, 'LineString' AS kind, CAST(count(*) AS INTEGER) AS vertices, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0, arg_max(x, frame) AS x1, arg_max(y, frame) AS y1, track_id AS named FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND NOT coalesce(x = px AND y = py, false) GROUP BY clip, track_id HAVING count(*) >= 2"))
def snk07_track_features(spark: SparkSession, sf: str) -> DataFrame:
    """What the features say when they are read as JSON."""
    p = points(spark, sf)
    read = F.from_json("feature", "type string, geometry struct<type: string, coordinates: array<array<double>>>, properties struct<track_id: long>").alias("f")
    f = K.track_features(p, rnd(A.summary(p), 3)).select("clip", "track_id", read)
    at = lambda k, c: F.col("f.geometry.coordinates")[k][c]
    last = F.size("f.geometry.coordinates") - 1
    return f.where("f.type = 'Feature'").select("clip", "track_id", F.col("f.geometry.type").alias("kind"), F.size("f.geometry.coordinates").alias("vertices"), at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(last, 0).alias("x1"), at(last, 1).alias("y1"), F.col("f.properties.track_id").alias("named"))


@query(sql(POINTS, "a AS (SELECT *, lag(frame) OVER w AS pf, lead(frame) OVER w AS qf, sum(CASE WHEN pred THEN 0 ELSE 1 END) OVER w AS g FROM p WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))",
           "k AS (SELECT clip, track_id, g, source, count(*) AS n, min(coalesce(pf, frame)) AS p, max(coalesce(qf, frame)) AS q FROM a WHERE pred GROUP BY ALL)",
           "o AS (SELECT *, row_number() OVER (PARTITION BY clip, track_id, g ORDER BY n DESC, coalesce(source, 'predicted')) AS k FROM k)",
           then="SELECT clip, track_id, max(CASE WHEN k = 1 THEN coalesce(source, 'predicted') END) AS kind, CAST(sum(n) AS BIGINT) AS n, min(p) AS start_frame, max(q) AS end_frame FROM o GROUP BY clip, track_id, g"))
def snk08_predicted_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return K.predicted_gaps(points(spark, sf))


@query(ORACLES["agg02_stat_blocks"])
def snk11_stats_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks as the documents hold them."""
    p = points(spark, sf)
    blocks = rnd(A.stat_blocks(A.summary(p), p, 10.0))
    inner = ", ".join(f"{n}: {t}" for n, t in blocks.dtypes if n != "scope")
    return K.stats_document(blocks).select("scope", F.inline(F.from_json("document", f"array<struct<{inner}>>"))).select(*blocks.columns)


@query("SELECT CAST(k + 1 AS BIGINT) AS track_id, CAST(f AS BIGINT) AS frame, " + r("1.4 * f / 25.0 * sin(radians(k * 30.0)) + k", 3) + " AS x, " + r("1.4 * f / 25.0 * cos(radians(k * 30.0)) + 2.0 * k", 3) + " AS y FROM range(0, 5) a(k), range(0, 500) b(f)")
def src21_synthetic_walks(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(synthetic_walks(spark).select("track_id", "frame", "x", "y"), 3)
