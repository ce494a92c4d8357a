"""CLN-23: the whole way from boxes to points and a summary per track, for all clips at once.

The plan is lazy but for one barrier: the segmented samples are written once, as matching segments
goes in rounds and their rows are needed again afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rounded
from ..session import cut_lineage, sized
from . import boxes as B
from . import clean as C
from . import ground as G
from .aggregate import with_steps


@dataclass(frozen=True)
class Settings:
    """What a configuration may change."""

    max_gap_s: float = 2.0
    stitch: bool = True
    stitch_max_gap_s: float = 3.0
    min_track_s: float = 1.0
    min_moving_speed: float = 0.2
    drop_passengers: bool = True
    bridge_hidden_feet: bool = False
    recover_feet: bool = True
    feet_rows: int = 60
    squish_ratio: float = 0.8
    end_fit_s: float = 0.6
    radial_smoothing: bool = True

    @classmethod
    def of(cls, cleaning: dict) -> Settings:
        """From a configuration's cleaning section. feet_window_s and smooth_polyorder have no counterpart here."""
        own = {k: cleaning[k] for k in ("max_gap_s", "stitch", "stitch_max_gap_s", "min_track_s", "min_moving_speed", "drop_passengers", "squish_ratio", "radial_smoothing") if k in cleaning}
        return cls(**own, bridge_hidden_feet=cleaning.get("hidden_feet", "keep") == "bridge", recover_feet=cleaning.get("recover_occluded_feet", True))


@dataclass(frozen=True)
class Processed:
    points: DataFrame
    summary: DataFrame
    samples: DataFrame
    segments: DataFrame


def ground_samples(boxes: DataFrame, cameras: DataFrame, groups: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Boxes voted, filtered, with whole feet and on the ground, within 2.2 times the precise range.

    cameras: clip, h, image_w, image_h, f_px, height_m, fps, stride. groups: class, grp, max_speed, jump_tol,
    stitch_radius, smooth_s, min_displacement, offset_m, depth_limit (metres per pixel).
    """
    b = B.voted(boxes)
    if settings.drop_passengers:
        b = b.join(B.passengers(b), ["clip", "track_id"], "left_anti")
    b = B.with_hidden_feet(b)
    if settings.bridge_hidden_feet:
        b = b.where(~F.col("feet_hidden"))
    b = b.join(sized(groups), "class").join(sized(cameras), "clip")
    b = B.with_recovered_feet(b, settings.feet_rows, settings.squish_ratio) if settings.recover_feet else B.with_feet(b)
    h = G.cells("h")
    x, y = G.to_ground(h, F.col("u"), F.col("v"), G.sign_of_view(h, F.col("image_w"), F.col("image_h")))
    b = b.withColumn("x", x).withColumn("y", y).where("x is not null and y is not null")
    b = b.withColumn("range_m", G.precise_range(F.col("depth_limit"), F.col("f_px"), F.col("height_m")))
    b = G.within_range(b, F.col("range_m"))
    return b.select("clip", "track_id", F.col("class").alias("cls"), "grp", "frame", (F.col("frame") / F.col("fps")).alias("t"), "x", "y", F.col("predicted").alias("pred"), "feet_hidden", "fps", "stride", "max_speed", "jump_tol", F.col("stitch_radius").alias("radius"), "smooth_s", "min_displacement", "offset_m", "range_m", "height_m")


def process(boxes: DataFrame, cameras: DataFrame, groups: DataFrame, settings: Settings = Settings()) -> Processed:
    """points: clip, track_id, class, frame, time_s, x, y, vx, vy, speed, heading, predicted, source, group, beyond_limit;
    summary: one row per track with tracker_ids, counts, lengths and speeds. Empty boxes give empty tables."""
    clean = C.without_spikes(ground_samples(boxes, cameras, groups, settings))
    samples = cut_lineage(C.with_segments(clean, settings.max_gap_s))
    ends = cut_lineage(C.end_states(samples, settings.end_fit_s))
    ids = C.segment_ids(ends.select("clip", "track_id", "seg", "n")).select("clip", F.struct("track_id", "seg").alias("root"), "new_id")
    every = ends.select("clip", F.struct("track_id", "seg").alias("k"))
    links = C.greedy_matching(C.stitch_candidates(ends, settings.stitch_max_gap_s)) if settings.stitch else every.limit(0).select("clip", F.col("k").alias("i"), F.col("k").alias("j"))
    places = C.chains(every, links)
    labels = C.chain_labels(ends, places).select("clip", "root", "tracker_ids", F.col("cls").alias("_cls"), F.col("grp").alias("_grp"), "parts")
    where = cut_lineage(places.join(ids, ["clip", "root"]).join(labels, ["clip", "root"]).select("clip", F.col("k.track_id").alias("track_id"), F.col("k.seg").alias("seg"), F.col("new_id").cast("long").alias("out_id"), "place", "tracker_ids", "_cls", "_grp", "parts"))
    last = ends.select("clip", "track_id", "seg", "f1")
    s = samples.join(sized(where.join(last, ["clip", "track_id", "seg"])), ["clip", "track_id", "seg"])
    s = s.withColumn("open_gap", (F.col("frame") == F.col("f1")) & (F.col("place") < F.col("parts") - 1)).withColumn("cls", F.col("_cls")).withColumn("grp", F.col("_grp"))
    key = ["clip", "out_id"]
    s = C.lasting(C.moving(s, F.col("min_displacement"), key), settings.min_track_s, key)
    # dense rows of each width of window; groups and rates make few of them
    fixed = s.groupBy(*key, "cls", "grp", "tracker_ids", "stride", "fps", "smooth_s", "offset_m", "range_m", "height_m").agg(F.avg(F.col("feet_hidden").cast("double")).alias("feet_hidden_share"))
    dense = C.densified(s, F.col("stride").cast("long"), key).join(fixed, key)
    known = F.coalesce(F.col("height_m") != 0, F.lit(False)) & F.lit(settings.radial_smoothing)
    # halves round to even, as savgol_width does
    w = F.greatest(F.bround(F.col("smooth_s") / (F.col("stride") / F.col("fps"))), F.lit(4.0)).cast("int")
    dense = dense.withColumn("_w", w + F.when(w % 2 == 0, 1).otherwise(0))
    # as in the reference, about the camera wherever its height is known; it stands over (0, 0)
    dt = F.col("stride") / F.col("fps")
    smooth = C.smoothed_radially(dense.where(known), F.col("_w"), dt, (0.0, 0.0, F.col("height_m")), key, span=F.col("smooth_s") / dt)
    smooth = smooth.unionByName(C.smoothed(dense.where(~known), F.col("_w"), dt, key).select(*smooth.columns))
    p = C.with_headings(smooth, settings.min_moving_speed, key)
    p = G.centred(p, F.col("offset_m")).withColumn("speed", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2))
    p = p.withColumn("beyond_limit", F.coalesce(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) > F.col("range_m"), F.lit(False)))
    points = p.select(
        "clip", F.col("out_id").alias("track_id"), F.col("cls").alias("class"), "frame", rounded(F.col("t"), 4).alias("time_s"), *[rounded(F.col(c), 3).alias(c) for c in ("x", "y", "vx", "vy", "speed")],
        rounded(F.col("heading"), 1).alias("heading"), F.col("pred").alias("predicted"), "source", F.col("grp").alias("group"), "beyond_limit",
    )
    g = with_steps(p, key).groupBy("clip", "out_id", "tracker_ids", "cls", "grp").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("n_points"), *[F.sum((F.col("source") == k).cast("long")).alias(f"n_{k}") for k in ("predicted", "stitched", "interpolated")],
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.avg("speed").alias("mean"), F.percentile("speed", 0.5).alias("median"), F.max("speed").alias("top"), F.max("feet_hidden_share").alias("hidden"),
        *[f(c, "frame").alias(f"{n}_{c}") for n, f in (("start", F.min_by), ("end", F.max_by)) for c in ("x", "y")],
    )
    straight = F.sqrt((F.col("end_x") - F.col("start_x")) ** 2 + (F.col("end_y") - F.col("start_y")) ** 2)
    summary = g.select(
        "clip", F.col("out_id").alias("track_id"), "tracker_ids", F.col("cls").alias("class"), F.col("grp").alias("group"), rounded(F.col("start_s"), 3).alias("start_s"), rounded(F.col("end_s"), 3).alias("end_s"),
        rounded(F.col("end_s") - F.col("start_s"), 3).alias("duration_s"), "n_points", "n_predicted", "n_stitched", "n_interpolated", rounded(F.col("path"), 3).alias("path_length_m"), rounded(straight, 3).alias("straight_dist_m"),
        rounded(F.when(F.col("path") > 0, straight / F.col("path")), 4).alias("straightness"), rounded(F.col("mean"), 3).alias("mean_speed"), rounded(F.col("median"), 3).alias("median_speed"), rounded(F.col("top"), 3).alias("max_speed"),
        rounded(F.col("hidden"), 3).alias("feet_hidden_share"), *[rounded(F.col(c), 3).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")],
    )
    return Processed(points, summary, samples, ends)


def counters(boxes: DataFrame, done: Processed) -> DataFrame:
    """CLN-23: what happened on the way, per clip: boxes, clean samples, segments, tracks, points not detected."""
    a = boxes.groupBy("clip").agg(F.count("*").alias("boxes"))
    b = done.segments.groupBy("clip").agg(F.sum("n").alias("samples"), F.count("*").alias("segments"))
    c = done.points.groupBy("clip").agg(F.count_distinct("track_id").alias("tracks"), F.sum(F.col("predicted").cast("long")).alias("not_detected"))
    return a.join(b, "clip", "left").join(c, "clip", "left").na.fill(0)
