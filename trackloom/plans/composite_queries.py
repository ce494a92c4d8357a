"""Queries of composites, kits and ground truth, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite as K
from ..operators import field as V
from ..operators import groundtruth as T
from ..sources.tables import table
from .aggregates import rnd
from .base import POINTS, points, r, sql
from .fields import CELL, MEASURED, SMOOTH, VALUES, bounds_sql, field_sql, fine, out_sql
from .ground_queries import cameras
from .registry import query

GROUPS = ["people", "cycles", "vehicles", "trains"]


@query(sql(POINTS, then="SELECT clip, CAST(track_id + 1000000 * dense_rank() OVER (ORDER BY clip) AS BIGINT) AS track_id, frame FROM p"))
def cmp01_united(spark: SparkSession, sf: str) -> DataFrame:
    return K.renumbered(points(spark, sf)).select("clip", F.col("track_id").cast("long").alias("track_id"), "frame")


@query(sql(POINTS, then="SELECT clip, count(*) AS n FROM p WHERE clip IN (SELECT clip FROM clips WHERE lower(coalesce(trim(grade), 'ok')) = 'ok') GROUP BY clip"))
def cmp02_graded(spark: SparkSession, sf: str) -> DataFrame:
    return K.graded(points(spark, sf), table(spark, sf, "clips")).groupBy("clip").agg(F.count("*").alias("n"))


@query()
def cmp03_footprints(spark: SparkSession, sf: str) -> DataFrame:
    return K.footprints(cameras(spark, sf), 4.0)


KEYS = ["site", "grp"]
_CLIPS = ["o AS (SELECT * FROM p WHERE NOT pred)", "og AS (SELECT o.* FROM o JOIN (SELECT site, grp, clip FROM o GROUP BY ALL HAVING count(DISTINCT track_id) >= 2) q USING (site, grp, clip))", *field_sql([*KEYS, "clip"], "og", bounds_sql(KEYS, "o"), bound_keys=KEYS)]


def clip_fields(spark: SparkSession, sf: str) -> DataFrame:
    return K.clip_fields(points(spark, sf), KEYS, CELL, SMOOTH, 2)


@query(sql(POINTS, *_CLIPS, then=out_sql([*KEYS, "clip"])))
def cmp05_clip_fields(spark: SparkSession, sf: str) -> DataFrame:
    return fine(clip_fields(spark, sf))


@query(sql(POINTS, *_CLIPS, "cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, grp, i, j ORDER BY round(weight, 9) DESC, clip) AS k FROM f) WHERE k = 1)", then=out_sql([*KEYS, "clip"], "cf")))
def cmp06_continuous_field(spark: SparkSession, sf: str) -> DataFrame:
    return fine(K.continuous(clip_fields(spark, sf), KEYS))


def _wrap(e: str) -> str:
    return f"abs(({e} + 180.0) - 360.0 * floor(({e} + 180.0) / 360.0) - 180.0)"


_CLEAR = "cl AS (SELECT *, count(*) OVER w AS n, sum(vx * weight) OVER w / sum(weight) OVER w AS mvx, sum(vy * weight) OVER w / sum(weight) OVER w AS mvy FROM f WHERE confidence >= 0.5 AND dominance >= 0.6 WINDOW w AS (PARTITION BY site, grp, i, j))"


@query(sql(POINTS, *_CLIPS, _CLEAR, then=f"SELECT site, grp, i, j, count(*) AS clips, string_agg(clip, ' ' ORDER BY clip) AS clip_names, {r('any_value(mvx)', 3)} AS vx, {r('any_value(mvy)', 3)} AS vy, {r('max(' + _wrap('degrees(atan2(vx, vy)) - degrees(atan2(mvx, mvy))') + ')', 2)} AS direction_spread_deg FROM cl WHERE n >= 2 GROUP BY site, grp, i, j"))
def cmp04_agreement_cells(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import rounded

    a = K.agreement_cells(clip_fields(spark, sf), KEYS)
    return a.select("site", "grp", "i", "j", "clips", "clip_names", rounded(F.col("vx"), 3).alias("vx"), rounded(F.col("vy"), 3).alias("vy"), rounded(F.col("direction_spread_deg"), 2).alias("direction_spread_deg"))


@query(sql(POINTS, *_CLIPS, "cl AS (SELECT * FROM f WHERE confidence >= 0.5 AND dominance >= 0.6)", f"pr AS (SELECT a.site, a.grp, a.clip AS clip_a, b.clip AS clip_b, {_wrap('degrees(atan2(a.vx, a.vy)) - degrees(atan2(b.vx, b.vy))')} AS angle, a.speed / greatest(b.speed, 1e-6) AS ratio FROM cl a JOIN cl b ON a.site = b.site AND a.grp = b.grp AND a.i = b.i AND a.j = b.j AND a.clip < b.clip)",
           then=f"SELECT site, grp, clip_a, clip_b, count(*) AS shared_cells, {r('quantile_cont(angle, 0.5)', 2)} AS median_angle_deg, {r('avg(CASE WHEN angle <= 30.0 THEN 1.0 ELSE 0.0 END)', 2)} AS agree_share, {r('quantile_cont(ratio, 0.5)', 2)} AS median_speed_ratio FROM pr GROUP BY ALL"))
def cmp04_agreement_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(K.agreement_pairs(clip_fields(spark, sf), KEYS), 2)


_MASTER = [MEASURED, *field_sql(["site"], "o", bounds_sql(["site"], "o")), *field_sql(["site", "grp"], "o", bounds_sql(["site"], "o"), prefix="g_", bound_keys=["site"]),
           "w AS (SELECT site, i, j, " + ", ".join(f"max(CASE WHEN grp = '{g}' THEN {c} END) AS {g}_{c}" for g in GROUPS for c in ("speed", "density")) + " FROM g_f GROUP BY ALL)"]
_DENS = [f"coalesce({g}_density, 0.0)" for g in GROUPS]


@query(sql(POINTS, *_MASTER, then=f"SELECT coalesce(f.site, w.site) AS site, coalesce(f.i, w.i) AS i, coalesce(f.j, w.j) AS j, {r('speed')} AS speed, {r('density', 5)} AS density, " + ", ".join(f"{r(f'{g}_speed')} AS {g}_speed" for g in GROUPS) + f", CASE " + " ".join(f"WHEN {d} = greatest({', '.join(_DENS)}) AND {d} > 0 THEN '{g}'" for g, d in zip(GROUPS, _DENS)) + " ELSE '' END AS dominant_group FROM f FULL JOIN w ON w.site = f.site AND w.i = f.i AND w.j = f.j"))
def cmp07_master_field(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import rounded

    m = K.master(points(spark, sf), ["site"], GROUPS, CELL, SMOOTH)
    return m.select("site", "i", "j", rounded(F.col("speed"), 4).alias("speed"), rounded(F.col("density"), 5).alias("density"), *[rounded(F.col(f"{g}_speed"), 4).alias(f"{g}_speed") for g in GROUPS], "dominant_group")


def seen(spark: SparkSession, sf: str) -> DataFrame:
    """Cells in view, here those any track of the clip's site was in."""
    p = points(spark, sf).select("clip", "site", F.floor(F.col("x") / CELL).alias("i"), F.floor(F.col("y") / CELL).alias("j"))
    return p.select("site", "i", "j").distinct().join(p.select("clip", "site").distinct(), "site")


def durations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clips").select("clip", ((F.col("end_frame") - F.col("start_frame")) / F.col("fps")).alias("duration_s"))


SEEN = ["ce AS (SELECT DISTINCT site, floor(x / 4.0) AS i, floor(y / 4.0) AS j FROM p)", "sn AS (SELECT ce.*, c.clip FROM ce JOIN (SELECT DISTINCT clip, site FROM p) c USING (site))",
        "cv AS (SELECT sn.site, i, j, sum((end_frame - start_frame) / CAST(fps AS DOUBLE)) AS seen_s, count(DISTINCT sn.clip) AS clips FROM sn JOIN clips c ON c.clip = sn.clip GROUP BY ALL)"]


@query(sql(POINTS, *SEEN, then=f"SELECT site, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('seen_s', 3)} AS seen_s, clips FROM cv"))
def cmp08_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(K.coverage(seen(spark, sf), durations(spark, sf), ["site"]), 3)


def _reflect(name: str, src: str, axis: str, other: str, value: str) -> str:
    lo, hi = f"{axis}0", f"{axis}1"
    q = f"({axis} + k - {lo}) - 2 * ({hi} - {lo} + 1) * floor(({axis} + k - {lo}) / (2 * ({hi} - {lo} + 1)))"
    return f"{name} AS (SELECT site, i0, i1, j0, j1, {other}, CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END + {lo} AS {axis}, sum({value} * g) AS {value} FROM (SELECT *, {hi} - {lo} + 1 AS n, {q} AS q FROM {src}, ker) GROUP BY ALL)"


@query(sql(POINTS, *SEEN, "ker AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in V.kernel(1.5)) + ") AS t(k, g))", "bn AS (SELECT site, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM cv GROUP BY site)",
           "a0 AS (SELECT site, floor(x / 4.0) AS i, floor(y / 4.0) AS j, i0, i1, j0, j1, sum(dt) AS v FROM p JOIN bn USING (site) GROUP BY ALL)", _reflect("a1", "a0", "i", "j", "v"), _reflect("a2", "a1", "j", "i", "v"),
           "b0 AS (SELECT site, i, j, i0, i1, j0, j1, seen_s AS v FROM cv JOIN bn USING (site))", _reflect("b1", "b0", "i", "j", "v"), _reflect("b2", "b1", "j", "i", "v"),
           then=f"SELECT b2.site, CAST(b2.i AS BIGINT) AS i, CAST(b2.j AS BIGINT) AS j, {r('b2.v', 3)} AS seen_s, {r('coalesce(a2.v, 0.0) / b2.v / 16.0', 6)} AS density FROM b2 LEFT JOIN a2 ON a2.site = b2.site AND a2.i = b2.i AND a2.j = b2.j WHERE b2.v >= 5.0"))
def cmp09_density_in_view(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import rounded

    p = points(spark, sf)
    occupied = p.groupBy("site", F.floor(F.col("x") / CELL).alias("i"), F.floor(F.col("y") / CELL).alias("j")).agg(F.sum("dt").alias("present_s"))
    d = K.density_in_view(occupied, K.coverage(seen(spark, sf), durations(spark, sf), ["site"]), ["site"], CELL, 6.0)
    return d.select("site", "i", "j", rounded(F.col("seen_s"), 3).alias("seen_s"), rounded(F.col("density"), 6).alias("density"))


@query(sql(POINTS, then="SELECT site, grp, count(DISTINCT track_id) AS tracks FROM p WHERE NOT pred GROUP BY ALL HAVING count(DISTINCT track_id) >= 5"))
def cmp10_enough_tracks(spark: SparkSession, sf: str) -> DataFrame:
    p = K.enough_tracks(points(spark, sf).where("not pred"), ["site", "grp"], 5)
    return p.groupBy("site", "grp").agg(F.count_distinct("track_id").alias("tracks"))


@query(sql(POINTS, "l AS (SELECT *, sqrt(x * x + y * y) <= 30.0 AS near, CASE WHEN sqrt(x * x + y * y) <= 30.0 THEN track_id % 1000000 ELSE track_id END AS line FROM p WHERE grp = 'people')", "n AS (SELECT *, row_number() OVER (PARTITION BY near, line ORDER BY clip, frame) - 1 AS n FROM l)", then="SELECT near, line, count(*) AS n, count(DISTINCT clip) AS clips FROM n WHERE CASE WHEN near THEN n % 3 = 0 ELSE n % 2 = 0 END GROUP BY near, line"))
def cmp11_web_paths(spark: SparkSession, sf: str) -> DataFrame:
    return K.web_paths(points(spark, sf))


@query(sql(POINTS, "n AS (SELECT clip, count(DISTINCT track_id) AS tracks, count(*) AS samples FROM p GROUP BY clip)", then="SELECT c.clip, site, lower(coalesce(trim(grade), 'ok')) AS grade, coalesce(tracks, 0) AS tracks, coalesce(samples, 0) AS samples, CAST(row_number() OVER (ORDER BY c.clip) AS INTEGER) AS camera FROM clips c LEFT JOIN n ON n.clip = c.clip"))
def cmp12_clip_table(spark: SparkSession, sf: str) -> DataFrame:
    return K.clip_table(points(spark, sf), table(spark, sf, "clips"))


@query(sql(POINTS, then=f"SELECT grp, count(DISTINCT track_id) AS tracks, count(*) AS samples, {r('quantile_cont(speed, 0.5)')} AS median_speed FROM p WHERE NOT pred GROUP BY grp"))
def cmp13_sample_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(K.sample_metrics(points(spark, sf)))


_FIELD = [MEASURED, *field_sql(["clip"], "o", bounds_sql(["clip"], "o"))]


def kit(spark: SparkSession, sf: str) -> DataFrame:
    return K.kit_frame(V.smooth_field(points(spark, sf), ["clip"], CELL, SMOOTH, F.col("dt")), CELL, (10.0, 20.0), 2.5)


@query(sql(POINTS, *_FIELD, then=f"SELECT clip, {r('cell_x - 10.0', 3)} AS x, {r('-(cell_y - 20.0)', 3)} AS z, {r('vx', 3)} AS vx, {r('-vy', 3)} AS vz, {r('speed', 3)} AS speed, {r('density', 3)} AS density, {r('confidence', 3)} AS confidence, 2.5::DOUBLE AS smax, 4.0::DOUBLE AS cell FROM f"))
def kit01_frame(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(kit(spark, sf), 3)


_MOD = ["xo AS (SELECT clip, cell_x - 10.0 AS x, -(cell_y - 20.0) AS z, speed, greatest(density, 0.0) + 1e-12 AS w FROM f)", "mo AS (SELECT clip, count(*) AS n, sum(x * w) / sum(w) AS cx, sum(z * w) / sum(w) AS cz, sum(speed * w) / sum(w) AS mean, greatest(max(x) - min(x), max(z) - min(z)) + 4.0 AS span FROM xo GROUP BY clip)"]
_MODOUT = f"SELECT clip, n, {r('cx', 3)} AS cx, {r('cz', 3)} AS cz, {r('mean', 3)} AS mean, {r('span', 3)} AS span, {r('least(greatest(1.2 * span / greatest(mean, 0.2), 4.0), 30.0)', 3)} AS life, {r('0.3 * greatest(mean, 0.2)', 3)} AS noise, {r('0.04 * greatest(mean, 0.2)', 3)} AS min_speed FROM mo"


@query(sql(POINTS, *_FIELD, *_MOD, then=_MODOUT))
def kit02_modules(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(K.kit_modules(kit(spark, sf), ["clip"]), 3)


@query(sql(POINTS, *_FIELD, *_MOD, then=_MODOUT + " ORDER BY n DESC, clip LIMIT 2"))
def kit03_largest_two(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(K.largest(K.kit_modules(kit(spark, sf), ["clip"])), 3)


_DRAW = ["wd0 AS (SELECT clip, i, j, sqrt(greatest(density, 0.0)) * confidence AS w FROM f)", "wd1 AS (SELECT *, sum(w) OVER (PARTITION BY clip ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER (PARTITION BY clip) AS b, w / sum(w) OVER (PARTITION BY clip) AS q FROM wd0)"]


@query(sql(POINTS, *_FIELD, *_DRAW, then="SELECT clip, i, j, CAST(floor(b * 1000 + 0.5 + 1e-9) - floor((b - q) * 1000 + 0.5 + 1e-9) AS BIGINT) AS drawn FROM wd1 WHERE floor(b * 1000 + 0.5 + 1e-9) - floor((b - q) * 1000 + 0.5 + 1e-9) > 0"))
def kit04_weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    f = V.smooth_field(points(spark, sf), ["clip"], CELL, SMOOTH, F.col("dt"))
    return K.weighted_draw(f, 1000, ["clip"]).select("clip", "i", "j", "drawn")


@query(sql(POINTS, *_CLIPS, "md AS (SELECT site, grp, quantile_cont(density, 0.5) AS m FROM f GROUP BY ALL)", "wd AS (SELECT f.*, least(greatest(density / m, 0.05), 20.0) AS w FROM f JOIN md USING (site, grp))".replace("f.*", "f.site, f.grp, f.i, f.j, f.vx, f.vy"), then=f"SELECT site, grp, i, j, {r('sum(vx * w) / sum(w)')} AS vx, {r('sum(vy * w) / sum(w)')} AS vy, count(*) AS modules FROM wd GROUP BY site, grp, i, j"))
def kit04_blended(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(K.blended(clip_fields(spark, sf), KEYS))


_RUNS = ["a AS (SELECT *, sum(CASE WHEN coalesce(speed > 0.4, false) THEN 0 ELSE 1 END) OVER (PARTITION BY clip, track_id ORDER BY frame) AS k FROM p)", "u AS (SELECT clip, track_id, k, count(*) AS rows, min(frame) AS first_frame, max(frame) AS last_frame FROM a WHERE speed > 0.4 GROUP BY ALL)", "rn AS (SELECT clip, track_id, first_frame, last_frame, rows FROM (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY rows DESC, first_frame) AS n FROM u) WHERE n = 1)"]


@query(sql(POINTS, *_RUNS, then="SELECT * FROM rn"))
def gt01_longest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return T.longest_runs(points(spark, sf))


@query(sql(POINTS, "l AS (SELECT *, lag(speed) OVER w AS b, lag(t) OVER w AS t0 FROM p WHERE speed IS NOT NULL WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))",
           then=f"SELECT clip, track_id, {r('arg_min(coalesce(t0 + (1.0 - b) / greatest(speed - b, 1e-12) * (t - t0), t), frame)')} AS time_s FROM l WHERE speed >= 1.0 GROUP BY ALL"))
def gt02_first_crossing(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(T.first_crossing(points(spark, sf), "speed", 1.0))


_WALK = [*_RUNS, """q AS (SELECT p.*, CASE WHEN frame < first_frame THEN 'a' WHEN frame > last_frame THEN 'b' ELSE 'w' END AS part FROM p JOIN rn ON rn.clip = p.clip AND rn.track_id = p.track_id)""",
         "wk0 AS (SELECT clip, track_id, count(*) AS n_samples, avg(CASE WHEN pred THEN 1.0 ELSE 0.0 END) AS predicted_share, avg(CASE WHEN part = 'w' THEN speed END) AS mean_walking_speed, max(CASE WHEN part = 'w' THEN t END) - min(CASE WHEN part = 'w' THEN t END) AS walking_time_s, "
         + ", ".join(f"CASE WHEN count(CASE WHEN part = '{s}' THEN 1 END) >= 3 THEN avg(CASE WHEN part = '{s}' THEN {c} END) ELSE {f}({c}, CASE WHEN part = 'w' THEN frame END) END AS {c}_{s}" for s, f in (("a", "arg_min"), ("b", "arg_max")) for c in "xy")
         + ", var_pop(CASE WHEN part = 'w' THEN x END) AS va, var_pop(CASE WHEN part = 'w' THEN y END) AS vb, covar_pop(CASE WHEN part = 'w' THEN x END, CASE WHEN part = 'w' THEN y END) AS vc FROM q GROUP BY clip, track_id)",
         "wk AS (SELECT *, sqrt((x_b - x_a) * (x_b - x_a) + (y_b - y_a) * (y_b - y_a)) AS length_m, sqrt(greatest((va + vb) / 2 - sqrt(((va - vb) / 2) * ((va - vb) / 2) + vc * vc), 0.0)) AS lateral_rms_m FROM wk0)"]
_WCOLS = ["predicted_share", "mean_walking_speed", "walking_time_s", "x_a", "y_a", "x_b", "y_b", "length_m", "lateral_rms_m"]


@query(sql(POINTS, *_WALK, then="SELECT clip, track_id, n_samples, " + ", ".join(f"{r(c, 3)} AS {c}" for c in _WCOLS) + " FROM wk"))
def gt03_walks(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(T.walks(points(spark, sf)), 3)


_ERR = "er AS (SELECT *, 100 * (length_m - 40.0) / 40.0 AS length_error_pct, 40.0 / 30.0 AS reference_speed, 100 * (mean_walking_speed - 40.0 / 30.0) / (40.0 / 30.0) AS speed_error_pct FROM wk)"


@query(sql(POINTS, *_WALK, _ERR, then=f"SELECT clip, track_id, {r('length_error_pct', 3)} AS length_error_pct, {r('speed_error_pct', 3)} AS speed_error_pct, CASE WHEN concat_ws('+', CASE WHEN lateral_rms_m >= 0.30 THEN 'lateral' END, CASE WHEN abs(length_error_pct) >= 3.0 THEN 'length' END, CASE WHEN abs(speed_error_pct) >= 5.0 THEN 'speed' END) = '' THEN 'pass' ELSE concat_ws('+', CASE WHEN lateral_rms_m >= 0.30 THEN 'lateral' END, CASE WHEN abs(length_error_pct) >= 3.0 THEN 'length' END, CASE WHEN abs(speed_error_pct) >= 5.0 THEN 'speed' END) END AS verdict FROM er"))
def gt04_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    known = p.select("clip", "track_id").distinct().withColumn("length_m", F.lit(40.0)).withColumn("time_s", F.lit(30.0))
    return rnd(T.verdicts(T.against(T.walks(p), known)).select("clip", "track_id", "length_error_pct", "speed_error_pct", "verdict"), 3)


#: A line from 1 m beside the first standing place to the last one, a length for every other track and a stopwatch for every third.
_SURVEYED = [
    "kn AS (SELECT clip, track_id, x_a + 1.0 AS lax, y_a AS lay, x_b AS lbx, y_b + 0.25 AS lby, CASE WHEN track_id % 2 = 0 THEN length_m * 1.02 END AS kl, CASE WHEN track_id % 3 = 0 THEN walking_time_s * 1.01 END AS sw FROM wk WHERE length_m > 2 AND walking_time_s > 0)",
    "fa AS (SELECT kn.*, wk.x_a, wk.y_a, wk.x_b, wk.y_b, wk.length_m, wk.walking_time_s, sqrt((lbx - lax) * (lbx - lax) + (lby - lay) * (lby - lay)) AS line, coalesce(kl, sqrt((lbx - lax) * (lbx - lax) + (lby - lay) * (lby - lay))) AS known_m, first_frame, last_frame FROM kn JOIN wk USING (clip, track_id) JOIN rn USING (clip, track_id))",
    "pu AS (SELECT p.clip, p.track_id, p.frame, p.t, p.x, p.y, p.speed, fa.* EXCLUDE (clip, track_id), ((x - x_a) * (x_b - x_a) + (y - y_a) * (y_b - y_a)) / greatest(length_m * length_m, 1e-9) AS u FROM p JOIN fa ON fa.clip = p.clip AND fa.track_id = p.track_id)",
    "pb AS (SELECT *, lag(u) OVER w AS ub, lag(t) OVER w AS tb FROM pu WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))",
    "cr AS (SELECT clip, track_id, " + ", ".join(f"arg_min(coalesce(tb + ({q} - ub) / greatest(u - ub, 1e-12) * (t - tb), t), frame) FILTER (WHERE u >= {q}) AS t{n}" for n, q in ((10, 0.1), (90, 0.9))) + " FROM pb GROUP BY clip, track_id)",
    "pm AS (SELECT pu.*, t10, t90, sw IS NULL AND coalesce(t90 > t10, false) AS mid, frame BETWEEN first_frame AND last_frame AS go, ((y - lay) * (lbx - lax) - (x - lax) * (lby - lay)) / line AS d FROM pu JOIN cr USING (clip, track_id))",
    "sv AS (SELECT clip, track_id, any_value(sqrt((x_a - lax) * (x_a - lax) + (y_a - lay) * (y_a - lay))) AS start_error_m, any_value(sqrt((x_b - lbx) * (x_b - lbx) + (y_b - lby) * (y_b - lby))) AS end_error_m, "
    "avg(d) FILTER (WHERE go) AS lateral_mean_m, sqrt(avg(d * d) FILTER (WHERE go)) AS lateral_rms_m, max(abs(d)) FILTER (WHERE go) AS lateral_max_m, stddev_pop(d) FILTER (WHERE go) AS lateral_own_rms_m, "
    "any_value(100 * (length_m - known_m) / known_m) AS length_error_pct, any_value(CASE WHEN sw IS NOT NULL THEN known_m / sw WHEN mid THEN 0.8 * known_m / (t90 - t10) ELSE known_m / walking_time_s END) AS reference_speed, "
    "avg(speed) FILTER (WHERE CASE WHEN mid THEN t BETWEEN t10 AND t90 ELSE go END) AS measured_speed FROM pm GROUP BY clip, track_id)",
]
_SURVEY_COLUMNS = ["start_error_m", "end_error_m", "lateral_mean_m", "lateral_rms_m", "lateral_max_m", "lateral_own_rms_m", "length_error_pct", "reference_speed", "measured_speed"]


def surveyed(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    w = T.walks(p).where("length_m > 2 and walking_time_s > 0")
    known = w.select("clip", "track_id", (F.col("x_a") + 1.0).alias("ax"), F.col("y_a").alias("ay"), F.col("x_b").alias("bx"), (F.col("y_b") + 0.25).alias("by"), F.when(F.col("track_id") % 2 == 0, F.col("length_m") * 1.02).alias("length_m"), F.when(F.col("track_id") % 3 == 0, F.col("walking_time_s") * 1.01).alias("stopwatch_s"))
    return T.surveyed(p, known)


@query(sql(POINTS, *_WALK, *_SURVEYED, then="SELECT clip, track_id, " + ", ".join(f"{r(c, 3)} AS {c}" for c in _SURVEY_COLUMNS) + " FROM sv"))
def gt03_surveyed_walks(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(surveyed(spark, sf).select("clip", "track_id", *_SURVEY_COLUMNS), 3)


_FAULTS = "concat_ws('+', CASE WHEN lateral_rms_m >= 0.30 THEN 'lateral' END, CASE WHEN abs(length_error_pct) >= 3.0 THEN 'length' END, CASE WHEN abs(100 * (measured_speed - reference_speed) / reference_speed) >= 5.0 THEN 'speed' END, CASE WHEN start_error_m >= 0.5 THEN 'start' END, CASE WHEN end_error_m >= 0.5 THEN 'end' END)"


@query(sql(POINTS, *_WALK, *_SURVEYED, then=f"SELECT clip, track_id, CASE WHEN {_FAULTS} = '' THEN 'pass' ELSE {_FAULTS} END AS verdict FROM sv"))
def gt04_surveyed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return T.verdicts(surveyed(spark, sf)).select("clip", "track_id", "verdict")


@query(sql(POINTS, "pp AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s, ((x + 20.0) * 40.0 + (y - 30.0) * 30.0) / 2500.0 AS u FROM p WHERE cls = 'person' WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame))",
           "g AS (SELECT clip, track_id, coalesce(sum(s), 0.0) AS path, max(u) - min(u) AS cover, quantile_cont(sqrt((x + 20.0 - least(greatest(u, 0.0), 1.0) * 40.0) * (x + 20.0 - least(greatest(u, 0.0), 1.0) * 40.0) + (y - 30.0 - least(greatest(u, 0.0), 1.0) * 30.0) * (y - 30.0 - least(greatest(u, 0.0), 1.0) * 30.0)), 0.5) AS off FROM pp GROUP BY ALL)",
           then="SELECT clip, track_id FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY CASE WHEN cover > 0.5 THEN 0 ELSE 1 END, CASE WHEN cover > 0.5 THEN off ELSE -path END, track_id) AS n FROM g) WHERE n = 1"))
def gt05_picked_track(spark: SparkSession, sf: str) -> DataFrame:
    ends = table(spark, sf, "clips").select("clip", F.lit(-20.0).alias("ax"), F.lit(30.0).alias("ay"), F.lit(20.0).alias("bx"), F.lit(60.0).alias("by"))
    return T.picked(points(spark, sf), ends)
