"""Relational operators on image boxes: filters, votes, occlusion and privacy.

boxes: clip, track_id, class, frame, x1, y1, x2, y2, confidence, predicted. Joins between boxes are
equalities on (clip, frame) with a residual condition, so what meets is one frame's boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TRACK = ["clip", "track_id"]
#: Classes that people ride on, that carry people and that bear plates.
RIDEABLE = ["bicycle", "motorcycle"]
CARRIERS = ["car", "truck", "bus", "train"]
PLATED = ["car", "truck", "bus", "motorcycle"]


def wanted(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """DET-02, CLN-05: boxes of the classes."""
    return boxes.where(F.col("class").isin(classes))


def _other(boxes: DataFrame, prefix: str = "o_") -> DataFrame:
    return boxes.select("clip", "frame", *[F.col(c).alias(prefix + c) for c in ("track_id", "class", "x1", "y1", "x2", "y2")])


def _area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def _overlap(axis: str, p: str = "o_") -> Column:
    return F.greatest(F.least(f"{axis}2", f"{p}{axis}2") - F.greatest(f"{axis}1", f"{p}{axis}1"), F.lit(0.0))


def without_riders(boxes: DataFrame, share: float = 0.3) -> DataFrame:
    """DET-03: no persons whose box lies by more than share on a bicycle's or motorcycle's of the same
    frame with the feet within its height."""
    bikes = _other(wanted(boxes, RIDEABLE)).alias("o")
    b = boxes.alias("b")
    h = F.col("o_y2") - F.col("o_y1")
    inter = F.greatest(F.least("b.x2", "o_x2") - F.greatest("b.x1", "o_x1"), F.lit(0.0)) * F.greatest(F.least("b.y2", "o_y2") - F.greatest("b.y1", "o_y1"), F.lit(0.0))
    area = F.greatest((F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1")), F.lit(1e-6))
    on = (F.col("b.clip") == F.col("o.clip")) & (F.col("b.frame") == F.col("o.frame")) & (F.col("b.class") == "person") & (inter / area > share) & (F.col("b.y2") >= F.col("o_y1")) & (F.col("b.y2") <= F.col("o_y2") + 0.1 * h)
    return b.join(bikes, on, "left_anti")


def above_edge(boxes: DataFrame, height: Column, margin: float) -> DataFrame:
    """DET-04: boxes that end above the picture's bottom edge by more than margin pixels."""
    return boxes.where(F.col("y2") < height - margin)


def foot_in(boxes: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """DET-05: boxes whose foot point is in the polygon, by the even-odd rule; fewer than three corners keep all."""
    if len(polygon) < 3:
        return boxes
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:
            odd = odd != (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return boxes.where(odd)


def bridged(boxes: DataFrame, buffer_frames: Column) -> DataFrame:
    """DET-07 on finished data: predicted boxes stay if the track is detected again within buffer_frames of
    its last detection; trailing ones and those of forgotten tracks go."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    seen = F.when(~F.col("predicted"), F.col("frame"))
    b = boxes.withColumn("_next", F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("_last", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return b.where(~F.col("predicted") | (F.col("_next").isNotNull() & F.col("_last").isNotNull() & (F.col("_next") - F.col("_last") <= buffer_frames))).drop("_next", "_last")


def for_privacy(boxes: DataFrame) -> DataFrame:
    """DET-08: every person's and vehicle's box before any filter, rounded to a tenth of a pixel."""
    from ..functions import rounded

    return boxes.where(F.col("class").isin("person", *PLATED)).select("clip", "frame", "class", *[rounded(F.col(c), 1).alias(c) for c in ("x1", "y1", "x2", "y2")])


def voted(boxes: DataFrame) -> DataFrame:
    """CLN-01: each track's class is the one with most confidence over its detected rows, the first by name on
    ties. Tracks without a detected row vanish; a detected row without confidence counts nothing."""
    sums = boxes.where(~F.col("predicted")).groupBy(*TRACK, "class").agg(F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("_s"))
    best = sums.groupBy(*TRACK).agg(F.min(F.struct(-F.col("_s"), "class")).alias("_b")).select(*TRACK, F.col("_b.class").alias("class"))
    return boxes.drop("class").join(best, TRACK)


def passengers(boxes: DataFrame, share: float = 0.6, steady: float = 0.1, moved: float = 0.25) -> DataFrame:
    """CLN-02: clip, track_id of persons that ride in a vehicle.

    For most of its rows the person's centre is in the box of one and the same vehicle (of several
    the smallest, the vehicle most often so, the smaller id on ties), whose bottom it doesn't reach, at
    a steady place, while the vehicle moves.
    """
    people, carriers = boxes.where("class = 'person'"), _other(wanted(boxes, CARRIERS))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    met = people.join(carriers, ["clip", "frame"]).where((F.col("o_x1") <= cx) & (cx <= F.col("o_x2")) & (F.col("o_y1") <= cy) & (cy <= F.col("o_y2")) & (F.col("y2") <= F.col("o_y2") - 0.1 * (F.col("o_y2") - F.col("o_y1"))))
    place = F.struct(F.col("o_track_id").alias("v"), ((cx - F.col("o_x1")) / F.greatest(F.col("o_x2") - F.col("o_x1"), F.lit(1.0))).alias("px"), ((cy - F.col("o_y1")) / F.greatest(F.col("o_y2") - F.col("o_y1"), F.lit(1.0))).alias("py"), ((F.col("o_x1") + F.col("o_x2")) / 2).alias("vx"), ((F.col("o_y1") + F.col("o_y2")) / 2).alias("vy"), F.greatest(F.col("o_x2") - F.col("o_x1"), F.lit(1.0)).alias("vw"))
    held = met.groupBy(*TRACK, "frame").agg(F.min_by(place, F.struct(_area("o_"), "o_track_id")).alias("h")).select(*TRACK, "frame", "h.*")
    per = held.groupBy(*TRACK, "v").agg(F.count("*").alias("n"), F.greatest(F.stddev_pop("px"), F.stddev_pop("py")).alias("sway"), F.sqrt((F.max("vx") - F.min("vx")) ** 2 + (F.max("vy") - F.min("vy")) ** 2).alias("went"), F.percentile("vw", 0.5).alias("width"))
    most = per.groupBy(*TRACK).agg(F.sum("n").alias("all"), F.min(F.struct(-F.col("n"), "v")).alias("_m"))
    total = people.groupBy(*TRACK).agg(F.count("*").alias("rows"))
    one = most.join(total, TRACK).select(*TRACK, "all", "rows", F.col("_m.v").alias("v")).join(per, [*TRACK, "v"])
    return one.where((F.col("all") >= share * F.col("rows")) & (F.col("n") >= share * F.col("rows")) & (F.col("sway") <= steady) & (F.col("went") >= moved * F.col("width"))).select(*TRACK)


def with_hidden_feet(boxes: DataFrame, cover: float = 0.4) -> DataFrame:
    """CLN-03: feet_hidden: a person whose legs another, nearer person's box covers by more than cover of its width."""
    people = boxes.where("class = 'person'")
    o = _other(people)
    h = F.col("y2") - F.col("y1")
    over = (F.least("x2", "o_x2") - F.greatest("x1", "o_x1")) / F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0))
    hidden = people.join(o, ["clip", "frame"]).where((F.col("track_id") != F.col("o_track_id")) & (F.col("o_y2") > F.col("y2") + 0.05 * h) & (F.col("o_y1") < F.col("y2") - 0.35 * h) & (over > cover))
    flags = hidden.select(*TRACK, "frame", F.lit(True).alias("feet_hidden")).distinct()
    return boxes.join(flags, [*TRACK, "frame"], "left").withColumn("feet_hidden", F.coalesce("feet_hidden", F.lit(False)))


def with_feet(boxes: DataFrame) -> DataFrame:
    """PRJ-01: u, v: the middle of the box's bottom edge."""
    return boxes.withColumn("u", (F.col("x1") + F.col("x2")) / 2).withColumn("v", F.col("y2"))


def with_recovered_feet(boxes: DataFrame, rows: int = 60, squish: float = 0.8) -> DataFrame:
    """PRJ-02: u, v, recovered: where a box is cut off from below, v is its top plus the track's usual height.

    Usual height: the 0.8 quantile of the heights of rows detected rows around. A box below squish of
    it is squished; its edges are compared with those interpolated between whole boxes; if the bottom
    moved more than the top, the feet are rebuilt. Tracks of fewer than five detected rows stay.
    """
    rows = max(5, rows)
    w = Window.partitionBy(*TRACK).orderBy("frame")
    whole = Window.partitionBy(*TRACK)
    det = boxes.where(~F.col("predicted")).withColumn("_h", F.col("y2") - F.col("y1"))
    around = w.rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    det = det.withColumn("_c", F.count("*").over(around)).withColumn("_ref", F.percentile("_h", 0.8).over(around)).withColumn("_ref", F.when(F.col("_c") >= 3, F.col("_ref")))
    det = det.withColumn("_sq", F.coalesce(F.col("_h") < squish * F.col("_ref"), F.lit(False))).withColumn("_n", F.count("*").over(whole)).withColumn("_good", F.count(F.when(~F.col("_sq"), 1)).over(whole))
    good = F.when(~F.col("_sq"), F.struct("frame", "y1", "y2"))
    det = det.withColumn("_p", F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_q", F.first(good, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))

    def between(c: str) -> Column:
        p, q = F.col(f"_p.{c}"), F.col(f"_q.{c}")
        share = (F.col("frame") - F.col("_p.frame")) / (F.col("_q.frame") - F.col("_p.frame"))
        return F.when(F.col("_p").isNull(), q).when(F.col("_q").isNull() | (F.col("_q.frame") == F.col("_p.frame")), p).otherwise(p + share * (q - p))

    cut = F.col("_sq") & (F.col("_n") >= 5) & (F.col("_good") > 0) & (F.abs(F.col("y2") - between("y2")) > F.abs(F.col("y1") - between("y1")))
    det = det.withColumn("recovered", F.coalesce(cut, F.lit(False)))
    det = det.withColumn("v", F.when(F.col("recovered"), F.col("y1") + F.col("_ref")).otherwise(F.col("y2")))
    det = det.withColumn("u", (F.col("x1") + F.col("x2")) / 2).select(*boxes.columns, "u", "v", "recovered")
    rest = with_feet(boxes.where(F.col("predicted"))).withColumn("recovered", F.lit(False))
    return det.unionByName(rest)


def blur_boxes(boxes: DataFrame, hold: int = 0, band: float = 0.45, least_px: float = 28.0) -> DataFrame:
    """PRV-01, PRV-02: persons whole, the lower band of vehicles high enough, each for hold frames before and after."""
    v = boxes.where(F.col("class").isin(PLATED) & (F.col("y2") - F.col("y1") >= least_px)).withColumn("y1", F.col("y2") - band * (F.col("y2") - F.col("y1")))
    out = boxes.where("class = 'person'").unionByName(v).select("clip", "frame", "x1", "y1", "x2", "y2")
    if hold:
        out = out.withColumn("frame", F.explode(F.sequence(F.col("frame") - hold, F.col("frame") + hold)))
    return out


def overlap_groups(boxes: DataFrame) -> DataFrame:
    """PRV-03: component: boxes of a frame that overlap, directly or through others, share the least id.

    Rounds of label lowering over the pairs that overlap; they end when no label falls.
    """
    b = cut_lineage(boxes.select("clip", "frame", "track_id", "x1", "y1", "x2", "y2"))
    o = _other(b.withColumn("class", F.lit("")))
    pairs = b.join(o, ["clip", "frame"]).where((F.col("track_id") != F.col("o_track_id")) & (F.least("x2", "o_x2") > F.greatest("x1", "o_x1")) & (F.least("y2", "o_y2") > F.greatest("y1", "o_y1")))
    pairs = cut_lineage(pairs.select("clip", "frame", "track_id", "o_track_id"))
    labels = cut_lineage(b.select("clip", "frame", "track_id", F.col("track_id").alias("component")))
    while True:
        seen = pairs.join(labels.select("clip", "frame", F.col("track_id").alias("o_track_id"), F.col("component").alias("_c")), ["clip", "frame", "o_track_id"]).groupBy("clip", "frame", "track_id").agg(F.min("_c").alias("_c"))
        nxt = cut_lineage(labels.join(seen, ["clip", "frame", "track_id"], "left").select("clip", "frame", "track_id", F.least("component", F.coalesce("_c", "component")).alias("component"), (F.col("_c") < F.col("component")).alias("_fell")))
        labels = nxt.drop("_fell")
        if nxt.where("_fell").isEmpty():
            return labels


def trail_speeds(boxes: DataFrame, points: DataFrame, tracks: DataFrame) -> DataFrame:
    """PRV-04: speed of the output track at each raw box, found through the '+'-joined ids of tracks
    (clip, track_id, tracker_ids); null where cleaning removed the row. Copies of an id: the largest speed."""
    ids = tracks.select("clip", F.col("track_id").alias("_out"), F.explode(F.transform(F.array_distinct(F.split("tracker_ids", "\\+")), lambda i: i.cast("long"))).alias("track_id"))
    speeds = points.select("clip", F.col("track_id").alias("_out"), "frame", "speed").join(ids, ["clip", "_out"]).groupBy("clip", "track_id", "frame").agg(F.max("speed").alias("speed"))
    return boxes.select("clip", "track_id", "frame").join(speeds, ["clip", "track_id", "frame"], "left")


def relative_speeds(boxes: DataFrame, fps: Column) -> DataFrame:
    """PRV-04 before calibration: pixels per second of the foot point; persons by their median box height as metres."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    b = with_feet(boxes).withColumn("_dt", (F.col("frame") - F.lag("frame").over(w)) / fps)
    px = F.sqrt((F.col("u") - F.lag("u").over(w)) ** 2 + (F.col("v") - F.lag("v").over(w)) ** 2) / F.when(F.col("_dt") > 0, F.col("_dt"))
    b = b.withColumn("px_speed", px).withColumn("_h", F.percentile(F.col("y2") - F.col("y1"), 0.5).over(Window.partitionBy(*TRACK)))
    return b.select(*TRACK, "frame", "px_speed", F.when(F.col("class") == "person", F.col("px_speed") / F.greatest(F.col("_h"), F.lit(1.0)) * 1.7).alias("approx_speed"))


def drawn_tracks(boxes: DataFrame, fps: Column, min_s: float, min_rows: int) -> DataFrame:
    """PRV-05: boxes of tracks that last and have enough detected rows."""
    good = boxes.withColumn("_fps", fps).where(~F.col("predicted")).groupBy(*TRACK).agg(((F.max("frame") - F.min("frame")) / F.max("_fps")).alias("_s"), F.count("*").alias("_n")).where((F.col("_s") >= min_s) & (F.col("_n") >= min_rows))
    return boxes.join(good.select(*TRACK), TRACK, "left_semi")


def with_frames_between(raw: DataFrame, untracked: DataFrame) -> DataFrame:
    """SRC-18: tracked and untracked boxes together; columns that one lacks are null."""
    return raw.unionByName(untracked, allowMissingColumns=True)
