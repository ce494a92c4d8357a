"""Queries of the cleaning operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..session import cut_lineage, sized
from ..sources.tables import table
from .aggregates import rnd
from .base import POINTS, points, r, sql
from .registry import query

GAP_S = 2.0


def limits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "group_params").select(F.col("class").alias("cls"), F.col("max_speed"), F.col("jump_tol_m").alias("jump_tol"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).join(sized(limits(spark, sf)), "cls").select("clip", "track_id", "cls", "grp", "frame", "t", "x", "y", "pred", "fps", "dt", "max_speed", "jump_tol")


SAMPLES = 'k0 AS (SELECT clip, track_id, p.cls, grp, frame, t, x, y, pred, fps, dt, g.max_speed, g.jump_tol_m AS jump_tol FROM p JOIN group_params g ON g.class = p.cls)'


def _ok(a: str, b: str) -> str:
    return f"sqrt((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a})) <= max_speed * abs(t{b} - t{a}) + jump_tol"


def _pass(k: int) -> str:
    cols = "clip, track_id, cls, grp, frame, t, x, y, pred, fps, dt, max_speed, jump_tol"
    near = ", ".join(f"{f}({c}, {n}) OVER w AS {c}_{s}{n}" for c in "txy" for f, s in (("lag", "b"), ("lead", "a")) for n in (1, 2))
    inner = f"(t_b1 IS NOT NULL AND t_a1 IS NOT NULL AND NOT {_ok('_b1', '')} AND NOT {_ok('', '_a1')} AND {_ok('_b1', '_a1')})"
    first = f"(t_b1 IS NULL AND t_a2 IS NOT NULL AND NOT {_ok('', '_a1')} AND {_ok('_a1', '_a2')})"
    last = f"(t_a1 IS NULL AND t_b2 IS NOT NULL AND NOT {_ok('_b1', '')} AND {_ok('_b2', '_b1')})"
    return f"k{k} AS (SELECT {cols} FROM (SELECT *, {near}, count(*) OVER (PARTITION BY clip, track_id) AS n FROM k{k - 1} WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame)) WHERE NOT (n >= 3 AND coalesce({inner} OR {first} OR {last}, false)))"


SPIKES = [SAMPLES, _pass(1), _pass(2), _pass(3)]
SEGMENTS = [
    *SPIKES,
    f"""s0 AS (SELECT *, sum(CASE WHEN t - pt > {GAP_S} OR sqrt((x - px) * (x - px) + (y - py) * (y - py)) > max_speed * abs(t - pt) + jump_tol THEN 1 ELSE 0 END) OVER (PARTITION BY clip, track_id ORDER BY frame) AS seg
  FROM (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM k3 WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame)))""",
]


def despiked(spark: SparkSession, sf: str) -> DataFrame:
    return C.without_spikes(samples(spark, sf))


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_segments(despiked(spark, sf), GAP_S)


@query(sql(POINTS, SAMPLES, then="SELECT clip, track_id, frame FROM k0"))
def cln06_first_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("clip", "track_id", "frame")


@query(sql(POINTS, *SPIKES, then="SELECT clip, track_id, frame FROM k3"))
def cln07_without_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return despiked(spark, sf).select("clip", "track_id", "frame")


@query(sql(POINTS, *SEGMENTS, then="SELECT clip, track_id, frame, CAST(seg AS BIGINT) AS seg FROM s0"))
def cln08_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segmented(spark, sf).select("clip", "track_id", "frame", "seg")


@query(sql(POINTS, *SEGMENTS, "n AS (SELECT clip, track_id, seg, count(*) AS n FROM s0 GROUP BY ALL)", "q AS (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY n DESC, seg) AS k FROM n)", then="SELECT clip, track_id, CAST(seg AS BIGINT) AS seg, n, CAST(CASE WHEN k = 1 THEN track_id ELSE max(track_id) OVER (PARTITION BY clip) + sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY track_id, k) END AS BIGINT) AS new_id FROM q"))
def cln09_segment_ids(spark: SparkSession, sf: str) -> DataFrame:
    return C.segment_ids(segmented(spark, sf).groupBy("clip", "track_id", "seg").agg(F.count("*").alias("n")))


_ENDS = """n0 AS (SELECT *, min(t) OVER w AS a, max(t) OVER w AS b FROM s0 WINDOW w AS (PARTITION BY clip, track_id, seg)),
n1 AS (SELECT *, CASE WHEN t <= a + 1.6 THEN t - a END AS ta, CASE WHEN t >= b - 1.6 THEN t - b END AS tb FROM n0),
n2 AS (SELECT clip, track_id, seg, grp, max_speed, jump_tol, count(*) AS n, min(t) AS t0, max(t) AS t1, """ + ", ".join(
    f"CASE WHEN count(t{e}) >= 3 AND max(t{e}) > min(t{e}) THEN regr_intercept(CASE WHEN t{e} IS NOT NULL THEN {c} END, t{e}) ELSE {f}({c}, frame) END AS {c}{e}, CASE WHEN count(t{e}) >= 3 AND max(t{e}) > min(t{e}) THEN regr_slope(CASE WHEN t{e} IS NOT NULL THEN {c} END, t{e}) ELSE 0.0 END AS v{c}{e}"
    for e, f in (("a", "arg_min"), ("b", "arg_max"))
    for c in "xy"
) + " FROM n1 GROUP BY clip, track_id, seg, grp, max_speed, jump_tol)"
_ENDCOLS = ["t0", "t1", "xa", "vxa", "ya", "vya", "xb", "vxb", "yb", "vyb"]


def ends(spark: SparkSession, sf: str) -> DataFrame:
    return C.end_states(segmented(spark, sf), 1.6)


@query(sql(POINTS, *SEGMENTS, _ENDS, then="SELECT clip, track_id, CAST(seg AS BIGINT) AS seg, grp, n, " + ", ".join(f"{r(c, 3)} AS {c}" for c in _ENDCOLS) + " FROM n2"))
def cln10_end_states(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(ends(spark, sf).select("clip", "track_id", "seg", "grp", "n", *_ENDCOLS), 3)


_CAND = """c AS (SELECT * FROM (SELECT a.clip, a.track_id AS i_track, a.seg AS i_seg, b.track_id AS j_track, b.seg AS j_seg, b.t0 - a.t1 AS gap, a.max_speed, a.jump_tol,
    sqrt((b.xa - a.xb) * (b.xa - a.xb) + (b.ya - a.yb) * (b.ya - a.yb)) AS jump,
    sqrt((b.xa - a.xb - 0.5 * (a.vxb + b.vxa) * (b.t0 - a.t1)) * (b.xa - a.xb - 0.5 * (a.vxb + b.vxa) * (b.t0 - a.t1)) + (b.ya - a.yb - 0.5 * (a.vyb + b.vya) * (b.t0 - a.t1)) * (b.ya - a.yb - 0.5 * (a.vyb + b.vya) * (b.t0 - a.t1))) AS err
  FROM n2 a JOIN n2 b ON a.clip = b.clip AND a.grp = b.grp AND b.t0 > a.t1 AND b.t0 - a.t1 <= 8.0)
  WHERE jump <= max_speed * gap + jump_tol AND err <= 2.5 * (1 + gap))"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return C.stitch_candidates(ends(spark, sf), 8.0, 2.5)


@query(sql(POINTS, *SEGMENTS, _ENDS, _CAND, then=f"SELECT clip, i_track, CAST(i_seg AS BIGINT) AS i_seg, j_track, CAST(j_seg AS BIGINT) AS j_seg, {r('gap', 3)} AS gap, {r('err', 3)} AS err FROM c"))
def cln11_stitch_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(candidates(spark, sf).select("clip", F.col("i.track_id").alias("i_track"), F.col("i.seg").alias("i_seg"), F.col("j.track_id").alias("j_track"), F.col("j.seg").alias("j_seg"), "gap", "err"), 3)


def links(spark: SparkSession, sf: str) -> DataFrame:
    return C.greedy_matching(candidates(spark, sf))


#: Edges of a clip in order, taken one by one: what is taken at either end so far goes along as lists.
_MATCH = [
    "ed AS (SELECT clip, i_track, CAST(i_seg AS BIGINT) AS i_seg, j_track, CAST(j_seg AS BIGINT) AS j_seg, err, row_number() OVER (PARTITION BY clip ORDER BY err, i_track, i_seg, j_track, j_seg) AS n FROM c)",
    """mt AS (SELECT clip, 0::BIGINT AS n, []::VARCHAR[] AS ii, []::VARCHAR[] AS jj, false AS took, NULL::BIGINT AS i_track, NULL::BIGINT AS i_seg, NULL::BIGINT AS j_track, NULL::BIGINT AS j_seg, NULL::DOUBLE AS err FROM (SELECT DISTINCT clip FROM ed)
  UNION ALL
  SELECT clip, n, CASE WHEN free THEN list_append(ii, a) ELSE ii END, CASE WHEN free THEN list_append(jj, b) ELSE jj END, free, i_track, i_seg, j_track, j_seg, err FROM (
    SELECT ed.clip, ed.n, mt.ii, mt.jj, ed.i_track || '/' || ed.i_seg AS a, ed.j_track || '/' || ed.j_seg AS b,
      NOT list_contains(mt.ii, ed.i_track || '/' || ed.i_seg) AND NOT list_contains(mt.jj, ed.j_track || '/' || ed.j_seg) AS free, ed.i_track, ed.i_seg, ed.j_track, ed.j_seg, ed.err
    FROM mt JOIN ed ON ed.clip = mt.clip AND ed.n = mt.n + 1))""",
    "lk AS (SELECT clip, i_track, i_seg, j_track, j_seg, err FROM mt WHERE took)",
]
_CHAINS = [
    "sg AS (SELECT clip, track_id, CAST(seg AS BIGINT) AS seg, count(*) AS n, any_value(cls) AS cls FROM s0 GROUP BY clip, track_id, seg)",
    """ch AS (SELECT clip, track_id AS root, seg AS root_seg, track_id, seg, 0 AS place FROM sg WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.clip = sg.clip AND lk.j_track = sg.track_id AND lk.j_seg = sg.seg)
  UNION ALL SELECT ch.clip, root, root_seg, lk.j_track, lk.j_seg, place + 1 FROM ch JOIN lk ON lk.clip = ch.clip AND lk.i_track = ch.track_id AND lk.i_seg = ch.seg)""",
]


@query(sql(POINTS, *SEGMENTS, _ENDS, _CAND, *_MATCH, then=f"SELECT clip, i_track, i_seg, j_track, j_seg, {r('err', 3)} AS err FROM lk").replace("WITH ", "WITH RECURSIVE ", 1))
def cln12_matching(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(links(spark, sf).select("clip", F.col("i.track_id").alias("i_track"), F.col("i.seg").alias("i_seg"), F.col("j.track_id").alias("j_track"), F.col("j.seg").alias("j_seg"), "err"), 3)


def segment_table(spark: SparkSession, sf: str) -> DataFrame:
    return segmented(spark, sf).groupBy("clip", "track_id", "seg").agg(F.count("*").alias("n"), F.first("cls").alias("cls"), F.first("grp").alias("grp"))


@query(sql(POINTS, *SEGMENTS, _ENDS, _CAND, *_MATCH, *_CHAINS, then="SELECT clip, root AS track_id, root_seg AS seg, string_agg(CAST(track_id AS VARCHAR), '+' ORDER BY place) AS tracker_ids, arg_min(cls, -n * 1000 + place) AS cls, count(*) AS parts, CAST(sum(n) AS BIGINT) AS n FROM ch JOIN sg USING (clip, track_id, seg) GROUP BY clip, root, root_seg").replace("WITH ", "WITH RECURSIVE ", 1))
def cln13_chains(spark: SparkSession, sf: str) -> DataFrame:
    s = cut_lineage(segment_table(spark, sf))
    places = C.chains(s.select("clip", F.struct("track_id", "seg").alias("k")), links(spark, sf))
    return C.chain_labels(s, places).select("clip", F.col("root.track_id").alias("track_id"), F.col("root.seg").alias("seg"), "tracker_ids", "cls", "parts", "n")


@query(sql(POINTS, *SEGMENTS, "f AS (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM s0 WINDOW w AS (PARTITION BY clip, track_id, seg ORDER BY frame))", then="SELECT clip, track_id, CAST(seg AS BIGINT) AS seg, count(*) AS n FROM f GROUP BY clip, track_id, seg, grp HAVING grp NOT IN ('vehicles', 'trains') OR max(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) >= 5.0"))
def cln14_moving(spark: SparkSession, sf: str) -> DataFrame:
    least = F.when(F.col("grp").isin("vehicles", "trains"), 5.0).otherwise(0.0)
    return C.moving(segmented(spark, sf), least).groupBy("clip", "track_id", "seg").agg(F.count("*").alias("n"))


@query(sql(POINTS, *SEGMENTS, then="SELECT clip, track_id, CAST(seg AS BIGINT) AS seg, count(*) AS n FROM s0 GROUP BY clip, track_id, seg HAVING max(t) - min(t) >= 1.0 AND count(*) >= 2"))
def cln15_lasting(spark: SparkSession, sf: str) -> DataFrame:
    return C.lasting(segmented(spark, sf), 1.0).groupBy("clip", "track_id", "seg").agg(F.count("*").alias("n"))


_DENSE = """d0 AS (SELECT * FROM (SELECT *, count(*) OVER w AS cnt, max(t) OVER w - min(t) OVER w AS dur, min(frame) OVER w AS f0, max(frame) OVER w AS f1, CAST(round(dt * fps) AS BIGINT) AS stride FROM s0 WINDOW w AS (PARTITION BY clip, track_id, seg)) WHERE cnt >= 2 AND dur >= 1.0),
d1 AS (SELECT DISTINCT clip, track_id, seg, fps, dt, unnest(range(f0, f1 + 1, stride)) AS lf FROM d0),
d2 AS (SELECT d1.*, a.frame AS fa, a.x AS xa, a.y AS ya, a.pred, b.frame AS fb, b.x AS xb, b.y AS yb FROM d1
  ASOF JOIN d0 a ON a.clip = d1.clip AND a.track_id = d1.track_id AND a.seg = d1.seg AND d1.lf >= a.frame
  ASOF LEFT JOIN d0 b ON b.clip = d1.clip AND b.track_id = d1.track_id AND b.seg = d1.seg AND d1.lf <= b.frame),
d3 AS (SELECT clip, track_id, CAST(seg AS BIGINT) AS seg, lf AS frame, lf / fps AS t, dt, CASE WHEN fb > fa THEN xa + (xb - xa) * (lf - fa) / (fb - fa) ELSE xa END AS x, CASE WHEN fb > fa THEN ya + (yb - ya) * (lf - fa) / (fb - fa) ELSE ya END AS y,
  CASE WHEN lf = fa AND pred THEN 'predicted' WHEN lf = fa THEN 'detected' ELSE 'interpolated' END AS source FROM d2)"""


def dense(spark: SparkSession, sf: str) -> DataFrame:
    s = C.lasting(segmented(spark, sf), 1.0)
    return C.densified(s, F.round(F.col("dt") * F.col("fps")).cast("long"))


@query(sql(POINTS, *SEGMENTS, _DENSE, then=f"SELECT clip, track_id, seg, frame, {r('x', 3)} AS x, {r('y', 3)} AS y, source FROM d3"))
def cln16_densified(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(dense(spark, sf).select("clip", "track_id", "seg", "frame", "x", "y", "source"), 3)


@query(sql(POINTS, *SEGMENTS, _DENSE, then="SELECT clip, source, source <> 'detected' AS pred, count(*) AS n FROM d3 GROUP BY clip, source"))
def cln17_sources(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).groupBy("clip", "source", "pred").agg(F.count("*").alias("n"))


def smooth(spark: SparkSession, sf: str) -> DataFrame:
    d = dense(spark, sf)
    strides = table(spark, sf, "clips").select("clip", (F.col("vid_stride") / F.col("fps")).alias("dt"))
    return C.smoothed(d.join(sized(strides), "clip"), 5, F.col("dt"))


_SG_ROWS = """g0 AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY clip, track_id, seg) AS c FROM d3 WINDOW w AS (PARTITION BY clip, track_id, seg ORDER BY frame)),
g1 AS (SELECT *, CASE WHEN c >= 5 THEN 2 ELSE 1 END AS m FROM g0 WHERE c >= 3),
g2 AS (SELECT *, least(greatest(n, m), c - 1 - m) AS z FROM g1),
g3 AS (SELECT a.clip, a.track_id, a.seg, a.frame, a.n - a.z AS k, a.m, a.dt, sum(b.x) AS x0, sum(b.x * (b.n - a.z)) AS x1, sum(b.x * (b.n - a.z) * (b.n - a.z)) AS x2, sum(b.y) AS y0, sum(b.y * (b.n - a.z)) AS y1, sum(b.y * (b.n - a.z) * (b.n - a.z)) AS y2
  FROM g2 a JOIN g2 b ON a.clip = b.clip AND a.track_id = b.track_id AND a.seg = b.seg AND b.n BETWEEN a.z - a.m AND a.z + a.m GROUP BY ALL),
g4 AS (SELECT *, 2 * m + 1 AS q0, CASE m WHEN 2 THEN 10.0 ELSE 2.0 END AS q2, CASE m WHEN 2 THEN 34.0 ELSE 2.0 END AS q4 FROM g3),
g5 AS (SELECT *, """ + ", ".join(f"(q4 * {c}0 - q2 * {c}2) / (q0 * q4 - q2 * q2) AS {c}_a, {c}1 / q2 AS {c}_b, (q0 * {c}2 - q2 * {c}0) / (q0 * q4 - q2 * q2) AS {c}_c" for c in "xy") + " FROM g4)"


@query(sql(POINTS, *SEGMENTS, _DENSE, _SG_ROWS, then="SELECT clip, track_id, seg, frame, " + ", ".join(f"{r(f'{c}_a + k * ({c}_b + k * {c}_c)', 3)} AS {c}, {r(f'({c}_b + 2 * k * {c}_c) / dt', 3)} AS v{c}" for c in "xy") + " FROM g5"))
def cln18_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("clip", "track_id", "seg"))
    return rnd(smooth(spark, sf).withColumn("_n", n).where("_n >= 3").select("clip", "track_id", "seg", "frame", "x", "y", "vx", "vy"), 3)


def _local_sql(q: str, src: str, value: str, width: str, degree: str) -> list[str]:
    """CTEs that end in {q}s: value and slope of each row's window, by sums over the rows it holds."""
    w = f"least({width}, c - 1 + c % 2)"
    return [
        f"{q}w AS (SELECT clip, track_id, seg, frame, n, c, {value} AS v, {degree} AS dg, {w} AS ww, ({w} - 1) // 2 AS hh FROM {src})",
        f"{q}z AS (SELECT *, least(greatest(n, hh), c - 1 - hh) AS z FROM {q}w)",
        f"{q}m AS (SELECT a.clip, a.track_id, a.seg, a.frame, a.dg, a.ww, a.hh::DOUBLE AS h, (a.n - a.z)::DOUBLE AS k, any_value(a.v) AS v, sum(b.v) AS m0, sum(b.v * (b.n - a.z)) AS m1, sum(b.v * (b.n - a.z) * (b.n - a.z)) AS m2 FROM {q}z a JOIN {q}w b ON a.clip = b.clip AND a.track_id = b.track_id AND a.seg = b.seg AND b.n BETWEEN a.z - a.hh AND a.z + a.hh GROUP BY ALL)",
        f"{q}q AS (SELECT *, 2 * h + 1 AS q0, greatest(h * (h + 1) * (2 * h + 1) / 3, 1e-300) AS q2, h * (h + 1) * (2 * h + 1) / 3 * (3 * h * h + 3 * h - 1) / 5 AS q4 FROM {q}m)",
        f"{q}d AS (SELECT clip, track_id, seg, frame, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / greatest((CASE WHEN lead(v) OVER w IS NULL THEN 0 ELSE 1 END) + (CASE WHEN lag(v) OVER w IS NULL THEN 0 ELSE 1 END), 1) AS slope FROM {q}w WINDOW w AS (PARTITION BY clip, track_id, seg ORDER BY n))",
        f"{q}s AS (SELECT clip, track_id, seg, frame, CASE WHEN ww <= dg THEN v WHEN dg = 2 THEN (q4 * m0 - q2 * m2) / (q0 * q4 - q2 * q2) + k * m1 / q2 + k * k * (q0 * m2 - q2 * m0) / (q0 * q4 - q2 * q2) ELSE m0 / q0 + k * m1 / q2 END AS v, "
        f"CASE WHEN ww <= dg THEN slope WHEN dg = 2 THEN m1 / q2 + 2 * k * (q0 * m2 - q2 * m0) / (q0 * q4 - q2 * q2) ELSE m1 / q2 END AS s FROM {q}q JOIN {q}d USING (clip, track_id, seg, frame))",
    ]


_POLAR = [
    "p0 AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY clip, track_id, seg) AS c, sqrt(x * x + (y + 20.0) * (y + 20.0)) AS far, atan2(y + 20.0, x) AS th, atan2(y + 20.0, x) - lag(atan2(y + 20.0, x)) OVER w AS dth FROM d3 WINDOW w AS (PARTITION BY clip, track_id, seg ORDER BY frame))",
    "p1 AS (SELECT *, th - 2 * pi() * sum(coalesce(round(dth / (2 * pi())), 0.0)) OVER (PARTITION BY clip, track_id, seg ORDER BY frame) AS turn, least(greatest(pow(quantile_cont(sqrt(far * far + 144.0) / 12.0, 0.5) OVER (PARTITION BY clip, track_id, seg), 2.0 / 3.0), 1.0), 4.0) AS fac FROM p0)",
    "p2 AS (SELECT *, CASE WHEN fac > 1.5 THEN 1 ELSE 2 END AS deg, greatest(CAST(round_even(5 * fac, 0) AS BIGINT), CASE WHEN fac > 1.5 THEN 3 ELSE 4 END) AS lw FROM p1)",
    *_local_sql("r", "p2", "far", "(lw + 1 - lw % 2)", "deg"),
    *_local_sql("t", "p2", "turn", "5", "2"),
]


@query(sql(POINTS, *SEGMENTS, _DENSE, *_POLAR, then=f"SELECT clip, track_id, seg, p2.frame, p2.t, {r('rs.v * cos(ts.v)', 3)} AS x, {r('-20.0 + rs.v * sin(ts.v)', 3)} AS y, {r('(rs.s * cos(ts.v) - rs.v * ts.s * sin(ts.v)) / 0.5', 3)} AS vx, {r('(rs.s * sin(ts.v) + rs.v * ts.s * cos(ts.v)) / 0.5', 3)} AS vy FROM p2 JOIN rs USING (clip, track_id, seg, frame) JOIN ts USING (clip, track_id, seg, frame)".replace(f"p2.t, ", f"{r('p2.t', 3)} AS t, ", 1)))
def cln19_smoothed_radially(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(C.smoothed_radially(dense(spark, sf).select("clip", "track_id", "seg", "frame", "t", "x", "y"), 5, 0.5, (0.0, -20.0, 12.0)), 3)


@query(sql(POINTS, *SEGMENTS, _DENSE, _SG_ROWS, "h0 AS (SELECT clip, track_id, seg, frame, (x_b + 2 * k * x_c) / dt AS vx, (y_b + 2 * k * y_c) / dt AS vy FROM g5)", "h1 AS (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) >= 0.2 THEN degrees(atan2(vx, vy)) + 360.0 - 360.0 * floor((degrees(atan2(vx, vy)) + 360.0) / 360.0) END AS h FROM h0)", then="SELECT clip, track_id, seg, frame, " + r("coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY clip, track_id, seg ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(h IGNORE NULLS) OVER (PARTITION BY clip, track_id, seg ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 1) + " AS heading FROM h1"))
def cln20_headings(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("clip", "track_id", "seg"))
    return rnd(C.with_headings(smooth(spark, sf).withColumn("_n", n).where("_n >= 3")).select("clip", "track_id", "seg", "frame", "heading"), 1)


_FLOW = """SELECT CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, count(*) AS n, count(DISTINCT track_id) AS n_tracks, """ + r("avg(x)", 3) + " AS mean_x, " + r("avg(y)", 3) + " AS mean_y FROM k3 GROUP BY ALL"


@query(sql(POINTS, *SPIKES, then=_FLOW))
def flow_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    g = despiked(spark, sf).groupBy(F.floor("x").alias("i"), F.floor("y").alias("j"))
    return rnd(g.agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("n_tracks"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")), 3)
