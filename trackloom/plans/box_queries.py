"""Queries on image boxes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as B
from ..session import sized
from ..sources.tables import table
from .aggregates import rnd
from .base import BOXES, POINTS, boxes, points, r, sql
from .registry import query

KEY = "clip, track_id, frame"


def key(df: DataFrame) -> DataFrame:
    return df.select("clip", "track_id", "frame")


@query(f"SELECT clip, track_id, frame, coalesce(lower(trim(predicted)) IN ('true', '1', 'yes', 't', '1.0'), false) AS predicted, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence FROM raw_boxes")
def src01_raw_scan(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import lenient_bool, nan_to_null

    return table(spark, sf, "raw_boxes").select("clip", "track_id", "frame", lenient_bool(F.col("predicted")).alias("predicted"), nan_to_null(F.col("confidence")).alias("confidence"))


@query(sql(BOXES, then=f"SELECT {KEY}, class FROM b WHERE class IN ('person', 'bicycle', 'train')"))
def det02_wanted(spark: SparkSession, sf: str) -> DataFrame:
    return B.wanted(boxes(spark, sf), ["person", "bicycle", "train"]).select("clip", "track_id", "frame", "class")


@query(sql(BOXES, then=f"SELECT {KEY} FROM b WHERE NOT (class = 'person' AND EXISTS (SELECT 1 FROM b o WHERE o.clip = b.clip AND o.frame = b.frame AND o.class IN ('bicycle', 'motorcycle') AND greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0.0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0.0) / greatest((b.x2 - b.x1) * (b.y2 - b.y1), 1e-6) > 0.05 AND b.y2 >= o.y1 AND b.y2 <= o.y2 + 0.1 * (o.y2 - o.y1)))"))
def det03_without_riders(spark: SparkSession, sf: str) -> DataFrame:
    return key(B.without_riders(boxes(spark, sf), 0.05))


def sized_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes with the size of their clip's picture and the clip's fps."""
    size = table(spark, sf, "clips").join(sized(table(spark, sf, "calibrations").select("site", "image_w", "image_h")), "site").select("clip", "image_w", "image_h", F.col("fps").cast("double").alias("fps"), F.col("vid_stride").cast("double").alias("stride"))
    return boxes(spark, sf).join(sized(size), "clip")


SIZED = "z AS (SELECT b.*, image_w, image_h, CAST(fps AS DOUBLE) AS fps, CAST(vid_stride AS DOUBLE) AS stride FROM b JOIN clips c ON c.clip = b.clip JOIN calibrations k ON k.site = c.site)"


@query(sql(BOXES, SIZED, then=f"SELECT {KEY} FROM z WHERE y2 < image_h - 200"))
def det04_above_edge(spark: SparkSession, sf: str) -> DataFrame:
    return key(B.above_edge(sized_boxes(spark, sf), F.col("image_h"), 200.0))


_ROI = [(200.0, 100.0), (1700.0, 150.0), (1500.0, 900.0), (900.0, 500.0), (300.0, 950.0)]
_ODD = " + ".join(f"CASE WHEN ({ay} > y2) <> ({by} > y2) AND (x1 + x2) / 2 < ({bx} - {ax}) * (y2 - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_ROI, _ROI[1:] + _ROI[:1]))


@query(sql(BOXES, then=f"SELECT {KEY} FROM b WHERE ({_ODD}) % 2 = 1"))
def det05_foot_in_roi(spark: SparkSession, sf: str) -> DataFrame:
    return key(B.foot_in(boxes(spark, sf), _ROI))


_BRIDGED = """SELECT clip, track_id, frame FROM (SELECT *, min(CASE WHEN NOT predicted THEN frame END) OVER (PARTITION BY clip, track_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx,
  max(CASE WHEN NOT predicted THEN frame END) OVER (PARTITION BY clip, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM z) WHERE NOT predicted OR (nx IS NOT NULL AND la IS NOT NULL AND nx - la <= 3.0 * fps)"""


@query(sql(BOXES, SIZED, then=_BRIDGED))
def det07_bridged(spark: SparkSession, sf: str) -> DataFrame:
    return key(B.bridged(sized_boxes(spark, sf), 3.0 * F.col("fps")))


@query(sql(BOXES, then=f"SELECT clip, frame, class, {r('x1', 1)} AS x1, {r('y1', 1)} AS y1, {r('x2', 1)} AS x2, {r('y2', 1)} AS y2 FROM b WHERE class IN ('person', 'car', 'truck', 'bus', 'motorcycle')"))
def det08_privacy_capture(spark: SparkSession, sf: str) -> DataFrame:
    return B.for_privacy(boxes(spark, sf))


@query(sql(BOXES, then=f"SELECT {KEY}, {r('x1', 2)} AS x1, {r('y1', 2)} AS y1, {r('x2', 2)} AS x2, {r('y2', 2)} AS y2, {r('time_s', 4)} AS time_s FROM b ORDER BY track_id, frame"))
def det09_ordered(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import rounded

    return boxes(spark, sf).select("clip", "track_id", "frame", *[rounded(F.col(c), 2).alias(c) for c in ("x1", "y1", "x2", "y2")], rounded(F.col("time_s"), 4).alias("time_s")).orderBy("track_id", "frame")


VOTED = """v0 AS (SELECT clip, track_id, class AS cls FROM (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY s DESC, class) AS n FROM (SELECT clip, track_id, class, coalesce(sum(confidence), 0.0) AS s FROM b WHERE NOT predicted GROUP BY ALL)) WHERE n = 1),
v AS (SELECT b.clip, b.track_id, v0.cls AS class, b.frame, b.x1, b.y1, b.x2, b.y2, b.confidence, b.predicted FROM b JOIN v0 ON v0.clip = b.clip AND v0.track_id = b.track_id)"""


@query(sql(BOXES, VOTED, then=f"SELECT {KEY}, class FROM v"))
def cln01_voted(spark: SparkSession, sf: str) -> DataFrame:
    return B.voted(boxes(spark, sf)).select("clip", "track_id", "frame", "class")


@query(sql(BOXES, VOTED, """m AS (SELECT * FROM (SELECT p.clip, p.track_id, p.frame, o.track_id AS t, ((p.x1 + p.x2) / 2 - o.x1) / greatest(o.x2 - o.x1, 1.0) AS px, ((p.y1 + p.y2) / 2 - o.y1) / greatest(o.y2 - o.y1, 1.0) AS py, (o.x1 + o.x2) / 2 AS vx, (o.y1 + o.y2) / 2 AS vy, greatest(o.x2 - o.x1, 1.0) AS vw,
  row_number() OVER (PARTITION BY p.clip, p.track_id, p.frame ORDER BY (o.x2 - o.x1) * (o.y2 - o.y1), o.track_id) AS n FROM v p JOIN v o ON o.clip = p.clip AND o.frame = p.frame AND o.class IN ('car', 'truck', 'bus', 'train') AND o.x1 <= (p.x1 + p.x2) / 2 AND (p.x1 + p.x2) / 2 <= o.x2 AND o.y1 <= (p.y1 + p.y2) / 2 AND (p.y1 + p.y2) / 2 <= o.y2 AND p.y2 <= o.y2 - 0.1 * (o.y2 - o.y1) WHERE p.class = 'person') WHERE n = 1)""",
           "q AS (SELECT clip, track_id, t, count(*) AS n, greatest(stddev_pop(px), stddev_pop(py)) AS sway, sqrt((max(vx) - min(vx)) * (max(vx) - min(vx)) + (max(vy) - min(vy)) * (max(vy) - min(vy))) AS went, quantile_cont(vw, 0.5) AS width FROM m GROUP BY ALL)",
           "w AS (SELECT *, sum(n) OVER (PARTITION BY clip, track_id) AS held, row_number() OVER (PARTITION BY clip, track_id ORDER BY n DESC, t) AS k FROM q)",
           "t AS (SELECT clip, track_id, count(*) AS rows FROM v WHERE class = 'person' GROUP BY ALL)",
           then="SELECT w.clip, w.track_id FROM w JOIN t ON t.clip = w.clip AND t.track_id = w.track_id WHERE k = 1 AND held >= 0.02 * rows AND n >= 0.02 * rows AND sway <= 0.5 AND went >= 0.0 * width"))
def cln02_passengers(spark: SparkSession, sf: str) -> DataFrame:
    return B.passengers(B.voted(boxes(spark, sf)), 0.02, 0.5, 0.0)


_HIDDEN = """h AS (SELECT DISTINCT p.clip, p.track_id, p.frame FROM v p JOIN v o ON o.clip = p.clip AND o.frame = p.frame AND o.track_id <> p.track_id AND o.class = 'person' AND p.class = 'person' AND o.y2 > p.y2 + 0.05 * (p.y2 - p.y1) AND o.y1 < p.y2 - 0.35 * (p.y2 - p.y1)
  AND (least(p.x2, o.x2) - greatest(p.x1, o.x1)) / greatest(p.x2 - p.x1, 1.0) > 0.1)"""


@query(sql(BOXES, VOTED, _HIDDEN, then="SELECT v.clip, v.track_id, v.frame, h.clip IS NOT NULL AS feet_hidden FROM v LEFT JOIN h ON h.clip = v.clip AND h.track_id = v.track_id AND h.frame = v.frame"))
def cln03_hidden_feet(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_hidden_feet(B.voted(boxes(spark, sf)), 0.1).select("clip", "track_id", "frame", "feet_hidden")


@query(sql(BOXES, VOTED, _HIDDEN, then="SELECT v.clip, v.track_id, v.frame FROM v ANTI JOIN h ON h.clip = v.clip AND h.track_id = v.track_id AND h.frame = v.frame"))
def cln04_feet_bridged(spark: SparkSession, sf: str) -> DataFrame:
    return key(B.with_hidden_feet(B.voted(boxes(spark, sf)), 0.1).where("not feet_hidden"))


@query(sql(BOXES, VOTED, then=f"SELECT {KEY} FROM v WHERE class IN (SELECT class FROM group_params WHERE \"group\" IN ('people', 'cycles'))"))
def cln05_configured_classes(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "group_params").where(F.col("group").isin("people", "cycles")).select("class")
    return key(B.voted(boxes(spark, sf)).join(sized(wanted), "class", "left_semi"))


@query(sql(BOXES, then=f"SELECT {KEY}, (x1 + x2) / 2 AS u, y2 AS v FROM b"))
def prj01_foot_points(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_feet(boxes(spark, sf)).select("clip", "track_id", "frame", "u", "v")


FEET = """f0 AS (SELECT *, y2 - y1 AS h, count(*) OVER a AS c, quantile_cont(y2 - y1, 0.8) OVER a AS q FROM b WHERE NOT predicted WINDOW a AS (PARTITION BY clip, track_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
f1 AS (SELECT *, CASE WHEN c >= 3 THEN q END AS ref, coalesce(h < 0.9 * CASE WHEN c >= 3 THEN q END, false) AS sq, count(*) OVER w AS n FROM f0 WINDOW w AS (PARTITION BY clip, track_id)),
f2 AS (SELECT *, count(CASE WHEN NOT sq THEN 1 END) OVER (PARTITION BY clip, track_id) AS good, """ + ", ".join(
    f"{f}(CASE WHEN NOT sq THEN {c} END IGNORE NULLS) OVER (PARTITION BY clip, track_id ORDER BY frame ROWS BETWEEN {fr}) AS {p}_{c}"
    for c in ("frame", "y1", "y2")
    for f, p, fr in (("last_value", "p", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("first_value", "q", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
) + """ FROM f1),
f3 AS (SELECT *, """ + ", ".join(f"CASE WHEN p_frame IS NULL THEN q_{c} WHEN q_frame IS NULL OR q_frame = p_frame THEN p_{c} ELSE p_{c} + (frame - p_frame) / (q_frame - p_frame) * (q_{c} - p_{c}) END AS e_{c}" for c in ("y1", "y2")) + """ FROM f2),
f4 AS (SELECT *, coalesce(sq AND n >= 5 AND good > 0 AND abs(y2 - e_y2) > abs(y1 - e_y1), false) AS recovered FROM f3),
ft AS (SELECT clip, track_id, class, frame, predicted, (x1 + x2) / 2 AS u, CASE WHEN recovered THEN y1 + ref ELSE y2 END AS v, recovered, x1, y1, x2, y2 FROM f4 UNION ALL SELECT clip, track_id, class, frame, predicted, (x1 + x2) / 2, y2, false, x1, y1, x2, y2 FROM b WHERE predicted)"""


def feet(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_recovered_feet(boxes(spark, sf), 20, 0.9)


@query(sql(BOXES, FEET, then=f"SELECT {KEY}, {r('u', 3)} AS u, {r('v', 3)} AS v, recovered FROM ft"))
def prj02_recovered_feet(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(feet(spark, sf).select("clip", "track_id", "frame", "u", "v", "recovered"), 3)


_BLUR = "l AS (SELECT clip, frame, x1, y1, x2, y2 FROM b WHERE class = 'person' UNION ALL SELECT clip, frame, x1, y2 - 0.45 * (y2 - y1), x2, y2 FROM b WHERE class IN ('car', 'truck', 'bus', 'motorcycle') AND y2 - y1 >= 28.0)"
_BLURRED = ", ".join(f"{r(c, 3)} AS {c}" for c in ("x1", "y1", "x2", "y2"))


@query(sql(BOXES, _BLUR, then=f"SELECT clip, frame, {_BLURRED} FROM l"))
def prv01_blur_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(B.blur_boxes(boxes(spark, sf)), 3)


@query(sql(BOXES, _BLUR, then=f"SELECT clip, frame + o AS frame, {_BLURRED} FROM l, range(-3, 4) t(o)"))
def prv02_held_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(B.blur_boxes(boxes(spark, sf), 3), 3)


_PAIRS = "pr AS (SELECT a.clip, a.frame, a.track_id AS s, o.track_id AS e FROM b a JOIN b o ON o.clip = a.clip AND o.frame = a.frame AND o.track_id <> a.track_id AND least(a.x2, o.x2) > greatest(a.x1, o.x1) AND least(a.y2, o.y2) > greatest(a.y1, o.y1))"


@query("WITH RECURSIVE " + BOXES + ", " + _PAIRS + ", w AS (SELECT clip, frame, track_id, track_id AS c FROM b UNION SELECT w.clip, w.frame, pr.e, w.c FROM w JOIN pr ON pr.clip = w.clip AND pr.frame = w.frame AND pr.s = w.track_id) SELECT clip, frame, track_id, min(c) AS component FROM w GROUP BY ALL")
def prv03_overlap_groups(spark: SparkSession, sf: str) -> DataFrame:
    return B.overlap_groups(boxes(spark, sf))


@query(sql(BOXES, "i AS (SELECT DISTINCT clip, track_id AS o, CAST(unnest(string_split(tracker_ids, '+')) AS BIGINT) AS track_id FROM (SELECT DISTINCT clip, track_id, '' || track_id || '+' || (track_id + 1) AS tracker_ids FROM track_summary))", POINTS, then=f"SELECT b.clip, b.track_id, b.frame, s.speed FROM b LEFT JOIN (SELECT p.clip, i.track_id, p.frame, {r('max(p.speed)')} AS speed FROM p JOIN i ON i.clip = p.clip AND i.o = p.track_id GROUP BY ALL) s ON s.clip = b.clip AND s.track_id = b.track_id AND s.frame = b.frame"))
def prv04_trail_speeds(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "track_summary").select("clip", "track_id").distinct().withColumn("tracker_ids", F.concat_ws("+", F.col("track_id").cast("string"), (F.col("track_id") + 1).cast("string")))
    return rnd(B.trail_speeds(boxes(spark, sf), points(spark, sf), t))


@query(sql(BOXES, SIZED, "g AS (SELECT *, (x1 + x2) / 2 AS u, lag((x1 + x2) / 2) OVER w AS pu, lag(y2) OVER w AS pv, (frame - lag(frame) OVER w) / fps AS dt, quantile_cont(y2 - y1, 0.5) OVER (PARTITION BY clip, track_id) AS h FROM z WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))", then=f"SELECT {KEY}, {r('sqrt((u - pu) * (u - pu) + (y2 - pv) * (y2 - pv)) / dt')} AS px_speed, CASE WHEN class = 'person' THEN {r('sqrt((u - pu) * (u - pu) + (y2 - pv) * (y2 - pv)) / dt / greatest(h, 1.0) * 1.7')} END AS approx_speed FROM g"))
def prv04_relative_speeds(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(B.relative_speeds(sized_boxes(spark, sf), F.col("fps")))


@query(sql(BOXES, SIZED, "g AS (SELECT clip, track_id FROM z WHERE NOT predicted GROUP BY ALL HAVING (max(frame) - min(frame)) / max(fps) >= 20.0 AND count(*) >= 20)", then="SELECT b.clip, b.track_id, b.frame FROM b SEMI JOIN g ON g.clip = b.clip AND g.track_id = b.track_id"))
def prv05_drawn_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return key(B.drawn_tracks(sized_boxes(spark, sf), F.col("fps"), 20.0, 20))


@query("SELECT clip, track_id, frame, x1, confidence FROM raw_boxes UNION ALL SELECT clip, track_id, frame, x1, NULL FROM raw_boxes WHERE confidence < 0.5")
def src18_all_boxes(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_boxes")
    return B.with_frames_between(raw.select("clip", "track_id", "frame", "x1", "confidence"), raw.where("confidence < 0.5").select("clip", "track_id", "frame", "x1"))
