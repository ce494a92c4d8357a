"""Queries of vector fields, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import field as V
from .aggregates import HEAD, rnd
from .base import POINTS, points, r, sql
from .registry import query

CELL, SMOOTH = 4.0, 4.0
VALUES = ["vx", "vy", "speed", "heading", "density", "weight", "confidence", "dominance"]
PLACES = {"heading": 1, "weight": 3, "dominance": 3, "density": 5}


def fine(df: DataFrame) -> DataFrame:
    """A field with each column rounded as it is published."""
    from ..functions import rounded

    return df.select(*[rounded(F.col(c), PLACES.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _kernel(sigma: float) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in V.kernel(sigma)) + ") AS t(k, g)"


def field_sql(keys: list[str], rows: str, bounds: str, cell: float = CELL, smooth: float = SMOOTH, bins: int = 8, prefix: str = "", bound_keys: list[str] | None = None) -> list[str]:
    """CTEs that end in {prefix}f: the field of rows by keys within bounds."""
    sigma = smooth / cell
    area = 2 * math.pi * sigma**2
    ks = "".join(f"{k}, " for k in keys)
    on = " AND ".join(f"b.{k} = d.{k}" for k in (keys if bound_keys is None else bound_keys)) or "true"
    h = "coalesce(heading, degrees(atan2(vx, vy)))"
    wrapped = f"({h} + {180.0 / bins}) - 360.0 * floor(({h} + {180.0 / bins}) / 360.0)"
    q = prefix
    return [
        f"{q}ker AS ({_kernel(sigma)})",
        f"{q}bnd AS ({bounds})",
        f"{q}d AS (SELECT {ks}floor(x / {cell}) AS i, floor(y / {cell}) AS j, CAST(floor(({wrapped}) / {360.0 / bins}) AS BIGINT) % {bins} AS s, count(*) AS w, sum(vx) AS sx, sum(vy) AS sy, max(dt) AS dt FROM {rows} WHERE vx IS NOT NULL AND vy IS NOT NULL GROUP BY ALL)",
        f"{q}a AS (SELECT d.*, b.i0, b.i1, b.j0, b.j1 FROM {q}d d JOIN {q}bnd b ON {on})",
        f"{q}b1 AS (SELECT {ks}s, i + k AS i, j, i0, i1, j0, j1, sum(w * g) AS w, sum(sx * g) AS sx, sum(sy * g) AS sy FROM {q}a, {q}ker WHERE i + k BETWEEN i0 AND i1 GROUP BY ALL)",
        f"{q}b2 AS (SELECT {ks}s, i, j + k AS j, sum(w * g) * {area!r} AS w, sum(sx * g) * {area!r} AS sx, sum(sy * g) * {area!r} AS sy FROM {q}b1, {q}ker WHERE j + k BETWEEN j0 AND j1 GROUP BY ALL)",
        f"{q}m AS (SELECT {ks}i, j, (s + o + {bins}) % {bins} AS s, sum(CASE WHEN o = 0 THEN w ELSE 0 END) AS own, sum(w * f) AS w, sum(sx * f) AS sx, sum(sy * f) AS sy FROM {q}b2, (VALUES (0, 1.0), (1, 0.5), (-1, 0.5)) t(o, f) GROUP BY ALL)",
        f"{q}n AS (SELECT *, sum(own) OVER (PARTITION BY {ks}i, j) AS weight, row_number() OVER (PARTITION BY {ks}i, j ORDER BY round(w * 1e6) DESC, s) AS n FROM {q}m)",
        f"{q}t AS (SELECT {ks}quantile_cont(dt, 0.5) AS dt FROM {rows} GROUP BY ALL)",
        f"{q}f AS (SELECT {ks}CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, (i + 0.5) * {cell} AS cell_x, (j + 0.5) * {cell} AS cell_y, sx / w AS vx, sy / w AS vy, sqrt((sx / w) * (sx / w) + (sy / w) * (sy / w)) AS speed, {HEAD.format('sx / w', 'sy / w')} AS heading, weight / {area!r} * dt / {cell * cell} AS density, weight, 1 - exp(-weight / 15.0) AS confidence, least(w / (weight + 1e-12), 1.0) AS dominance FROM {q}n "
        + (f"JOIN {q}t USING ({', '.join(keys)})" if keys else f"CROSS JOIN {q}t")
        + " WHERE n = 1 AND weight >= 0.05)",
    ]


def bounds_sql(keys: list[str], rows: str, cell: float = CELL, pad: float = 3 * SMOOTH) -> str:
    ks = "".join(f"{k}, " for k in keys)
    return f"SELECT {ks}floor((min(x) - {pad}) / {cell}) AS i0, floor((max(x) + {pad}) / {cell}) AS i1, floor((min(y) - {pad}) / {cell}) AS j0, floor((max(y) + {pad}) / {cell}) AS j1 FROM {rows} GROUP BY ALL"


def out_sql(keys: list[str], name: str = "f") -> str:
    return f"SELECT {''.join(f'{k}, ' for k in keys)}i, j, {r('cell_x')} AS cell_x, {r('cell_y')} AS cell_y, " + ", ".join(f"{r(v, PLACES.get(v, 4))} AS {v}" for v in VALUES) + f" FROM {name}"


MEASURED = "o AS (SELECT * FROM p WHERE NOT pred)"


def field(spark: SparkSession, sf: str) -> DataFrame:
    return V.smooth_field(points(spark, sf), ["clip"], CELL, SMOOTH, F.col("dt"))


@query(sql(POINTS, MEASURED, then=bounds_sql(["clip"], "o").replace("floor(", "CAST(floor(").replace(f" / {CELL}) AS", f" / {CELL}) AS BIGINT) AS")))
def fld01_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return V.grid_bounds(points(spark, sf).where("not pred"), ["clip"], CELL, 3 * SMOOTH)


@query(sql(POINTS, MEASURED, *field_sql(["clip"], "o", bounds_sql(["clip"], "o")), then=f"SELECT clip, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(s AS INTEGER) AS sector, CAST(w AS DOUBLE) AS w, {r('sx')} AS bx, {r('sy')} AS b_y FROM d"))
def fld02_deposit(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(V.deposit(points(spark, sf).where("not pred"), ["clip"], CELL, 8).select("clip", "i", "j", "sector", "w", "bx", "b_y"))


@query(sql(POINTS, MEASURED, f"ker AS ({_kernel(1.5)})", "c AS (SELECT clip, floor(x / 4.0) AS i, floor(y / 4.0) AS j, count(*) AS n FROM o GROUP BY ALL)", "c1 AS (SELECT clip, i + k AS i, j, sum(n * g) AS n FROM c, ker GROUP BY ALL)", then=f"SELECT clip, CAST(i AS BIGINT) AS i, CAST(j + k AS BIGINT) AS j, {r('sum(n * g)', 6)} AS n FROM c1, ker GROUP BY clip, i, j + k"))
def fld03_blurred(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).where("not pred")
    cells = p.groupBy("clip", F.floor(F.col("x") / 4.0).alias("i"), F.floor(F.col("y") / 4.0).alias("j")).agg(F.count("*").cast("double").alias("n"))
    return rnd(V.blurred(cells, ["clip"], ["n"], 1.5), 6)


@query(sql(POINTS, MEASURED, *field_sql(["clip"], "o", bounds_sql(["clip"], "o")), then=f"SELECT clip, i, j, CAST(s AS INTEGER) AS sector, {r('weight', 3)} AS weight FROM (SELECT clip, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, s, weight FROM n WHERE n = 1 AND weight >= 0.05)"))
def fld04_directions(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).where("not pred")
    spread = V.blurred(V.with_bounds(V.deposit(p, ["clip"], CELL, 8), ["clip"], CELL, 3 * SMOOTH), ["clip", "sector"], ["w"], SMOOTH / CELL, bounded=True, scale=2 * math.pi * (SMOOTH / CELL) ** 2)
    turn = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(m).alias("m")) for d, m in ((0, 1.0), (1, 0.5), (-1, 0.5))])
    mixed = spread.select("clip", "i", "j", "sector", "w", F.inline(turn)).groupBy("clip", "i", "j", F.pmod(F.col("sector") + F.col("d"), F.lit(8)).alias("sector")).agg(F.sum(F.when(F.col("d") == 0, F.col("w")).otherwise(0.0)).alias("own"), F.sum(F.col("w") * F.col("m")).alias("w"))
    best = mixed.groupBy("clip", "i", "j").agg(F.sum("own").alias("weight"), F.max_by("sector", F.struct(F.round("w", 9), -F.col("sector"))).alias("sector")).where("weight >= 0.05")
    return rnd(best, 3)


@query(sql(POINTS, MEASURED, *field_sql(["clip"], "o", bounds_sql(["clip"], "o")), then=out_sql(["clip"])))
def fld05_smooth_field(spark: SparkSession, sf: str) -> DataFrame:
    return fine(field(spark, sf))


_SLICED = ["u AS (SELECT p.*, t0 + floor((t - t0) / 60.0) * 60.0 AS t_start FROM p JOIN (SELECT clip, min(t) AS t0, max(t) AS t1 FROM p GROUP BY clip) q USING (clip) WHERE t0 + floor((t - t0) / 60.0) * 60.0 < t1)", "o AS (SELECT * FROM u WHERE NOT pred)", "o2 AS (SELECT * FROM p WHERE NOT pred)"]


def sliced(spark: SparkSession, sf: str) -> DataFrame:
    return V.time_sliced(points(spark, sf), ["clip"], 60.0, CELL, SMOOTH, dt=F.col("dt"))


@query(sql(POINTS, *_SLICED, *field_sql(["clip", "t_start"], "o", bounds_sql(["clip"], "o2"), bound_keys=["clip"]), then=out_sql(["clip"]).replace("SELECT clip, ", f"SELECT clip, {r('t_start')} AS t_start, {r('t_start + 60.0')} AS t_end, ")))
def fld06_time_sliced(spark: SparkSession, sf: str) -> DataFrame:
    return fine(sliced(spark, sf))


@query(sql(POINTS, MEASURED, *field_sql(["clip"], "o", bounds_sql(["clip"], "o")), "sp AS (SELECT clip, min(i) AS i0, max(i) AS i1 FROM f GROUP BY clip)", f"fr AS (SELECT clip, j, i0, unnest(range(i0, i1 + 1)) AS i FROM (SELECT DISTINCT clip, j FROM f) JOIN sp USING (clip))", then=f"SELECT fr.clip, fr.j, CAST(fr.i - fr.i0 AS INTEGER) AS k, {r('f.speed')} AS speed FROM fr LEFT JOIN f ON f.clip = fr.clip AND f.i = fr.i AND f.j = fr.j"))
def fld07_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return V.as_arrays(fine(field(spark, sf)), ["clip"], "speed").select("clip", "j", F.posexplode("row").alias("k", "speed"))


@query(sql(POINTS, "o AS (SELECT * REPLACE (g AS grp) FROM p, LATERAL (SELECT unnest([grp, 'all']) AS g) WHERE NOT pred)", *field_sql(["clip", "grp"], "o", bounds_sql(["clip", "grp"], "o")), then=out_sql(["clip", "grp"])))
def fld08_group_fields(spark: SparkSession, sf: str) -> DataFrame:
    return fine(V.smooth_field(V.with_all(points(spark, sf)), ["clip", "grp"], CELL, SMOOTH, F.col("dt")))


@query(sql(POINTS, MEASURED, *field_sql(["clip"], "o", bounds_sql(["clip"], "o")), "v AS (SELECT *, min(i) OVER (PARTITION BY clip) AS i0, max(j) OVER (PARTITION BY clip) AS j1 FROM f WHERE confidence >= 0.2)", then=f'SELECT clip, i - i0 AS "column", j1 - j AS row, {r("vx * confidence")} AS vx, {r("vy * confidence")} AS vy FROM v'))
def fld10_voxels(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(V.voxels(field(spark, sf), ["clip"], 0.2))


@query(sql(POINTS, *_SLICED, *field_sql(["clip", "t_start"], "o", bounds_sql(["clip"], "o2"), bound_keys=["clip"]), "z AS (SELECT * FROM f WHERE t_start <= 150.0 AND t_start + 60.0 > 150.0)", then=out_sql(["clip"], "z").replace("SELECT clip, ", f"SELECT clip, {r('t_start')} AS t_start, {r('t_start + 60.0')} AS t_end, ")))
def fld10_slice_at(spark: SparkSession, sf: str) -> DataFrame:
    return fine(V.slice_at(sliced(spark, sf), 150.0))


@query(sql(POINTS, f"ker AS ({_kernel(2.0)})", f"bnd AS ({bounds_sql(['clip'], 'p', 2.0, 0.0)})", "c AS (SELECT p.clip, floor(x / 2.0) AS i, floor(y / 2.0) AS j, i0, i1, j0, j1, sum(dt) AS d FROM p JOIN bnd USING (clip) GROUP BY ALL)",
           "c1 AS (SELECT clip, i0, i1, j0, j1, CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END + i0 AS i, j, sum(d * g) AS d FROM (SELECT *, i1 - i0 + 1 AS n, (i + k - i0) - 2 * (i1 - i0 + 1) * floor((i + k - i0) / (2 * (i1 - i0 + 1))) AS q FROM c, ker) GROUP BY ALL)",
           "c2 AS (SELECT clip, i, CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END + j0 AS j, sum(d * g) AS d FROM (SELECT *, j1 - j0 + 1 AS n, (j + k - j0) - 2 * (j1 - j0 + 1) * floor((j + k - j0) / (2 * (j1 - j0 + 1))) AS q FROM c1, ker) GROUP BY ALL)",
           then=f"SELECT clip, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('d / 4.0', 6)} AS density FROM c2"))
def agg10_occupancy_density(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(V.occupancy_density(points(spark, sf), ["clip"], 2.0, F.col("dt"), sigma_m=4.0), 6)
