"""From pixels to the ground: projective maps, lenses, raised planes, terrain, range and centre shifts.

All but the ray cast are column expressions, so they run inside generated code. Matrices are nine
columns or an array of nine doubles, row by row. Points behind the camera or beyond the horizon are
null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import apply_matrix, segment_distance
from ..session import sized


def cells(h: str | Column) -> list[Column]:
    """The nine entries of an array column."""
    c = F.col(h) if isinstance(h, str) else h
    return [F.get(c, k) for k in range(9)]


def to_ground(h: list[Column], u: Column, v: Column, w_sign: Column | int = 1) -> tuple[Column, Column]:
    """PRJ-05: ground position of a pixel; null unless w has the sign of the visible ground and isn't 0."""
    x, y, w = apply_matrix(h, u, v)
    s = w_sign if isinstance(w_sign, Column) else F.lit(w_sign)
    ok = (F.signum(w) == s) & (F.abs(w) > 1e-12)
    return F.when(ok, x / w), F.when(ok, y / w)


def inverse(h: list[Column]) -> list[Column]:
    """The adjugate, which maps back as the inverse does."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def to_pixel(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """PRJ-06: pixel of a ground position; null where it is at infinity."""
    u, v, w = apply_matrix(inverse(h), x, y)
    ok = F.abs(w) > 1e-12
    return F.when(ok, u / w), F.when(ok, v / w)


def sign_of_view(h: list[Column], width: Column, height: Column) -> Column:
    """Sign of w at the middle of the picture's bottom edge, where the ground is seen."""
    return F.signum(apply_matrix(h, width / 2, height)[2])


def registered(feet: DataFrame, matrices: DataFrame) -> DataFrame:
    """PRJ-03: u, v moved into the reference frame by the matrix (m, nine doubles) of (clip, frame); rows of
    frames without one are dropped."""
    j = feet.join(matrices.select("clip", "frame", "m"), ["clip", "frame"])
    x, y, w = apply_matrix(cells("m"), F.col("u"), F.col("v"))
    return j.withColumn("_u", x / w).withColumn("_v", y / w).drop("u", "v", "m").withColumnsRenamed({"_u": "u", "_v": "v"})


def undistorted(u: Column, v: Column, k: dict[str, float], rounds: int = 8) -> tuple[Column, Column]:
    """PRJ-04: pixel without the lens's distortion (fx, fy, cx, cy, k1, k2, p1, p2), by fixed-point rounds."""
    x0, y0 = (u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"]
    start = F.struct(x0.alias("x"), y0.alias("y"))

    def step(p: Column, _: Column) -> Column:
        x, y = p["x"], p["y"]
        r2 = x * x + y * y
        radial = 1 + k["k1"] * r2 + k["k2"] * r2 * r2
        dx = 2 * k["p1"] * x * y + k["p2"] * (r2 + 2 * x * x)
        dy = k["p1"] * (r2 + 2 * y * y) + 2 * k["p2"] * x * y
        return F.struct(((x0 - dx) / radial).alias("x"), ((y0 - dy) / radial).alias("y"))

    p = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return p["x"] * k["fx"] + k["cx"], p["y"] * k["fy"] + k["cy"]


def on_plane(x: Column, y: Column, cx: Column, cy: Column, height: Column, z: Column) -> tuple[Column, Column]:
    """PRJ-11: where the same ray meets a plane z above the ground, from a camera over (cx, cy)."""
    s = 1 - z / height
    return cx + (x - cx) * s, cy + (y - cy) * s


def fitted_plane(samples: DataFrame, segments: DataFrame, keys: list[str], heights: list[float], enough: int = 20) -> DataFrame:
    """PRJ-11: per keys the height above ground at which samples (x, y, cx, cy, height) lie nearest to the
    segments (keys, ax, ay, bx, by) in the median; the lower one on ties. The candidates are a short array
    beside each row, the segments a small dimension."""
    z = F.explode(F.array(*[F.lit(float(h)) for h in heights]))
    s = samples.withColumn("_id", F.monotonically_increasing_id()).withColumn("z", z)
    px, py = on_plane(*[F.col(c) for c in ("x", "y", "cx", "cy", "height", "z")])
    d = s.withColumn("px", px).withColumn("py", py).join(sized(segments), keys).groupBy(*keys, "_id", "z").agg(F.min(segment_distance(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")])).alias("d"))
    m = d.groupBy(*keys, "z").agg(F.percentile("d", 0.5).alias("median_m"), F.count("*").alias("n")).where(F.col("n") >= enough)
    return m.groupBy(*keys).agg(F.min(F.struct("median_m", "z")).alias("b")).select(*keys, "b.z", "b.median_m")


def precise_range(limit: Column, focal: Column, height: Column) -> Column:
    """PRJ-12: distance up to which a pixel stands for at most limit metres of depth."""
    h2 = height * height
    return F.sqrt(F.greatest(limit * focal * height - h2, h2))


def within_range(samples: DataFrame, reach: Column, x: str = "x", y: str = "y", far: float = 2.2) -> DataFrame:
    """PRJ-13: samples up to far times the range of the camera at (0, 0), flagged beyond_limit past the range
    itself; a null range is none."""
    d = F.sqrt(F.col(x) ** 2 + F.col(y) ** 2)
    s = samples.withColumn("_d", d).withColumn("_r", reach)
    return s.where(F.col("_r").isNull() | (F.col("_d") <= far * F.col("_r"))).withColumn("beyond_limit", F.coalesce(F.col("_d") > F.col("_r"), F.lit(False))).drop("_d", "_r")


def away(x: Column, y: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """PRJ-14: unit vector from the camera's foot to the position; null at the foot itself."""
    d = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    ok = F.when(d > 0, d)
    return (x - cx) / ok, (y - cy) / ok


def away_by_image(h: list[Column], u: Column, v: Column, step: float = 4.0) -> tuple[Column, Column]:
    """PRJ-14 without a camera: ground direction of a few pixels up the image."""
    x0, y0 = to_ground(h, u, v)
    x1, y1 = to_ground(h, u, v - step)
    return away(x1, y1, x0, y0)


def centred(points: DataFrame, half_length: Column, mode: str = "travel", half_width: float = 0.9, ax: Column | None = None, ay: Column | None = None) -> DataFrame:
    """PRJ-15: x, y moved from the box's foot to the vehicle's centre.

    travel: back along the heading; view: away from the camera (ax, ay) by the rectangle's support in
    that direction, by the mean of its halves where the heading is unknown. Half lengths of 0 move nothing.
    """
    t = F.radians("heading")
    tx, ty, known = F.sin(t), F.cos(t), F.col("heading").isNotNull()
    if mode == "travel":
        ox, oy = F.when(known, -half_length * tx).otherwise(0.0), F.when(known, -half_length * ty).otherwise(0.0)
    else:
        c = F.abs(ax * tx + ay * ty)
        s = F.sqrt(F.greatest(1 - c * c, F.lit(0.0)))
        m = F.when(known, half_length * c + half_width * s).otherwise((half_length + half_width) / 2)
        ox, oy = F.coalesce(m * ax, F.lit(0.0)), F.coalesce(m * ay, F.lit(0.0))
    go = half_length > 0
    return points.withColumn("x", F.when(go, F.col("x") + ox).otherwise(F.col("x"))).withColumn("y", F.when(go, F.col("y") + oy).otherwise(F.col("y")))


def with_elevation(points: DataFrame, terrain: DataFrame, left: float, top: float, res: float) -> DataFrame:
    """PRJ-09: z by bilinear interpolation of cell centres terrain(row, col, z); null outside or in a gap.

    The four corners meet the raster by one equi-join on exploded corners; points need a row id.
    """
    fx, fy = (F.col("x") - left) / res - 0.5, (top - F.col("y")) / res - 0.5
    p = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_c", F.floor(fx)).withColumn("_r", F.floor(fy)).withColumn("_fx", fx - F.floor(fx)).withColumn("_fy", fy - F.floor(fy))
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    e = p.select("_id", "_c", "_r", "_fx", "_fy", F.inline(corner)).withColumn("col", F.col("_c") + F.col("a")).withColumn("row", F.col("_r") + F.col("b"))
    w = F.when(F.col("a") == 1, F.col("_fx")).otherwise(1 - F.col("_fx")) * F.when(F.col("b") == 1, F.col("_fy")).otherwise(1 - F.col("_fy"))
    z = e.join(terrain.select("row", "col", "z").where("z is not null"), ["row", "col"]).groupBy("_id").agg(F.sum(w * F.col("z")).alias("z"), F.count("*").alias("_n")).where("_n = 4").drop("_n")
    return p.drop("_c", "_r", "_fx", "_fy").join(z, "_id", "left").drop("_id")


def filled_terrain(terrain: DataFrame) -> DataFrame:
    """SRC-11: gaps (null, or outside -100 .. 2000 m) take the nearest cell's height, however far it is."""
    from .aggregate import cell_means_filled

    t = terrain.select(F.lit(0).alias("k"), F.col("col").cast("long").alias("i"), F.col("row").cast("long").alias("j"), F.when(F.col("z").between(-100.0, 2000.0), F.col("z")).alias("z"))
    good, gaps = t.where("z is not null"), t.where("z is null")
    got = cell_means_filled(good, gaps, "z", ["k"])
    return good.unionByName(got.select("k", "i", "j", "z")).select(F.col("j").alias("row"), F.col("i").alias("col"), "z")


def ray_cast(rays: DataFrame, grid: np.ndarray, left: float, top: float, res: float, datum: float, max_range: float = 1500.0, step: float = 0.5, halvings: int = 8) -> DataFrame:
    """PRJ-08: gx, gy, gz where rays (ox, oy, oz, dx, dy, dz) first go below the terrain, else null.

    Steps are counted across the ground, from where a ray comes down to the highest ground to where it
    has passed the lowest; a level or rising ray is followed to max_range if it starts below the highest
    ground. A ray that starts underground has to surface first. The middle of the last halved step is
    the hit. The raster is small by its nature (one site) and travels with the function; outside of it
    the ground is the datum. All rays of a batch take a step together.
    """
    grid = np.asarray(grid, float)
    known = np.append(grid[np.isfinite(grid)], datum)
    lowest, highest = float(known.min()), float(known.max())

    def height(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        fx, fy = (x - left) / res - 0.5, (top - y) / res - 0.5
        c, r = np.floor(fx).astype(int), np.floor(fy).astype(int)
        ok = (c >= 0) & (r >= 0) & (c + 1 < grid.shape[1]) & (r + 1 < grid.shape[0])
        c, r = np.where(ok, c, 0), np.where(ok, r, 0)
        a, b = fx - c, fy - r
        z = (grid[r, c] * (1 - a) + grid[r, c + 1] * a) * (1 - b) + (grid[r + 1, c] * (1 - a) + grid[r + 1, c + 1] * a) * b
        return np.where(ok & np.isfinite(z), z, datum)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            o, d = f[["ox", "oy", "oz"]].to_numpy(float), f[["dx", "dy", "dz"]].to_numpy(float)
            # a metre across the ground
            d = d / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-9)[:, None]
            oz, slope = o[:, 2], d[:, 2]

            def above(n: np.ndarray, s: np.ndarray) -> np.ndarray:
                """How far rays n are above the ground at s metres across it."""
                return oz[n] + slope[n] * s - height(o[n, 0] + d[n, 0] * s, o[n, 1] + d[n, 1] * s)

            down = slope < 0
            fall = np.where(down, -slope, 1.0)
            enter = np.where(down, (oz - highest) / fall - step, 0.0).clip(0.0, max_range)
            leave = np.where(down, (oz - lowest) / fall + step, np.where(oz < highest, max_range, 0.0)).clip(0.0, max_range)
            lo, hi = np.full(len(f), np.nan), np.full(len(f), np.nan)
            live = np.flatnonzero(leave > enter)
            at = enter[live]
            out = above(live, at) >= -1e-6
            while len(live):
                on = np.minimum(at + step, leave[live])
                under = above(live, on) <= 0
                met = out & under
                lo[live[met]], hi[live[met]] = at[met], on[met]
                more = ~met & (on < leave[live])
                live, at, out = live[more], on[more], ~under[more]
            hit = np.flatnonzero(np.isfinite(hi))
            for _ in range(halvings):
                mid = (lo[hit] + hi[hit]) / 2
                up = above(hit, mid) > 0
                lo[hit], hi[hit] = np.where(up, mid, lo[hit]), np.where(up, hi[hit], mid)
            s = (lo + hi) / 2
            p = o + d * s[:, None]
            yield f.assign(gx=p[:, 0], gy=p[:, 1], gz=p[:, 2])

    schema = ", ".join(f"`{n}` {t}" for n, t in rays.dtypes) + ", gx double, gy double, gz double"
    out = rays.mapInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("gx", "gy", "gz")})
