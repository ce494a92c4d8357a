"""Windowed aggregates over a stream of samples with an event time.

events: at (timestamp), track (any key) and what each function names. Late rows count up to the
watermark; windows still open at the end of an append query are not out yet. The same functions
take finished tables, where the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starts_per_minute(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """AGG-03: kind, start_at, n: samples per tumbling window."""
    g = events.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count("*").alias("n"))
    return g.select("kind", F.col("window.start").alias("start_at"), "n")


def field_slices(events: DataFrame, cell: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """FLD-06: sums of samples and velocity per tumbling window and cell, from which a field is smoothed."""
    g = events.withWatermark("at", late).groupBy(F.window("at", window), F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"))
    return g.agg(F.count("*").alias("n"), F.sum("vx").alias("bx"), F.sum("vy").alias("b_y")).select(F.col("window.start").alias("t_start"), "i", "j", "n", "bx", "b_y")


def trail_windows(events: DataFrame, length: str = "30 minutes", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """AGG-16: samples of each track within the last stretch, at every slide."""
    g = events.withWatermark("at", late).groupBy(F.window("at", length, slide), "track").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return g.select("track", F.col("window.start").alias("start_at"), "n", "last_at")


def track_sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """CLN-08: a track's stretches without a longer gap."""
    g = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "track").agg(F.count("*").alias("n"))
    return g.select("track", F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "n")
