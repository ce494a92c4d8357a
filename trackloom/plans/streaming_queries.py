"""The windowed operators of the streaming package on finished tables, with their SQL.

Streams themselves are compared with these in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import timed_table
from ..streaming import field_slices, starts_per_minute, trail_windows, track_sessions
from .registry import query


def live(spark: SparkSession, sf: str) -> DataFrame:
    e = timed_table(spark, sf, "events")
    return e.select(F.col("ts").alias("at"), F.col("user_id").alias("track"), F.col("event_type").alias("kind"), (F.col("user_id") % 20).cast("double").alias("x"), (F.col("user_id") % 7).cast("double").alias("y"), (F.col("value") * 0.01).alias("vx"), (F.col("value") * -0.01).alias("vy"))


@query("SELECT event_type AS kind, time_bucket(INTERVAL 1 MINUTE, ts) AS start_at, count(*) AS n FROM events GROUP BY ALL")
def str_starts_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    return starts_per_minute(live(spark, sf)).withColumn("start_at", F.col("start_at").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t_start, CAST(floor((user_id % 20) / 4.0) AS BIGINT) AS i, CAST(floor((user_id % 7) / 4.0) AS BIGINT) AS j, count(*) AS n, floor(sum(value * 0.01) * 1e4 + 0.500001) / 1e4 AS bx, floor(sum(value * -0.01) * 1e4 + 0.500001) / 1e4 AS b_y FROM events GROUP BY ALL")
def str_field_slices(spark: SparkSession, sf: str) -> DataFrame:
    from .aggregates import rnd

    return rnd(field_slices(live(spark, sf), 4.0)).withColumn("t_start", F.col("t_start").cast("timestamp_ntz"))


@query("SELECT user_id AS track, time_bucket(INTERVAL 10 MINUTE, ts) - o * INTERVAL 10 MINUTE AS start_at, count(*) AS n, max(ts) AS last_at FROM events, range(0, 3) t(o) GROUP BY ALL")
def str_trail_windows(spark: SparkSession, sf: str) -> DataFrame:
    return trail_windows(live(spark, sf)).withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query("SELECT user_id AS track, min(ts) AS start_at, max(ts) + INTERVAL 6 HOUR AS end_at, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s")
def str_track_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return track_sessions(live(spark, sf)).withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).withColumn("end_at", F.col("end_at").cast("timestamp_ntz"))
