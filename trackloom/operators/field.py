"""Smoothed vector fields, direction-aware, as sparse rows.

Samples are first summed to cells (and direction sectors), so what the kernel fans out is bounded by
the cells, not by the samples. The Gaussian is separable: two passes of an inline kernel table of
2r + 1 offsets, each followed by a sum per cell; no dense array is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import heading_of
from ..session import cut_lineage, sized
from .aggregate import measured


BOUNDS = ("i0", "i1", "j0", "j1")


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a normalised Gaussian cut off at truncate sigmas."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    return [(k, v / total) for k, v in zip(range(-r, r + 1), w)]


def blurred(cells: DataFrame, keys: list[str], values: list[str], sigma: float, bounded: bool = False, reflect: bool = False, scale: float = 1.0) -> DataFrame:
    """FLD-03: values of cells (keys, i, j) under a Gaussian of sigma cells; what is not there counts as 0.

    If bounded, cells carry i0, i1, j0, j1, which the keys determine: what leaves them is cut off, or
    with reflect folded back at the edge (d c b a | a b c d | d c b a).
    """
    taps = F.array(*[F.struct(F.lit(k).cast("long").alias("_k"), F.lit(w).alias("_w")) for k, w in kernel(sigma)])
    rest = list(BOUNDS) if bounded else []
    for axis, a, b in (("i", "i0", "i1"), ("j", "j0", "j1")):
        moved: Column = F.col(axis) + F.col("_k")
        out = cells.select(*keys, "i", "j", *rest, *values, F.inline(taps))
        if bounded and reflect:
            n = F.col(b) - F.col(a) + 1
            t = F.pmod(moved - F.col(a), 2 * n)
            moved = F.when(t < n, t).otherwise(2 * n - 1 - t) + F.col(a)
        out = out.withColumn(axis, moved.cast("long"))
        if bounded and not reflect:
            out = out.where((F.col(axis) >= F.col(a)) & (F.col(axis) <= F.col(b)))
        cells = out.groupBy(*keys, "i", "j", *rest).agg(*[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values])
    return cells.select(*keys, "i", "j", *[(F.col(v) * scale).alias(v) for v in values])


def with_bounds(cells: DataFrame, keys: list[str], cell: float, pad: float) -> DataFrame:
    """FLD-01 on deposited cells, which hold the extremes of their samples: i0, i1, j0, j1 by a window over the
    keys, so that bounds need no second pass over the samples and no join."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    edge = lambda f, c, s: F.floor((f(c).over(w) + s) / cell)
    return cells.withColumns({"i0": edge(F.min, "x0", -pad), "i1": edge(F.max, "x1", pad), "j0": edge(F.min, "y0", -pad), "j1": edge(F.max, "y1", pad)})


def grid_bounds(points: DataFrame, keys: list[str], cell: float, pad: float) -> DataFrame:
    """FLD-01: i0, i1, j0, j1 per keys."""
    edge = lambda f, c, s: F.floor((f(c) + s) / cell)
    return points.groupBy(*keys).agg(edge(F.min, "x", -pad).alias("i0"), edge(F.max, "x", pad).alias("i1"), edge(F.min, "y", -pad).alias("j0"), edge(F.max, "y", pad).alias("j1"))


def deposit(points: DataFrame, keys: list[str], cell: float, sectors: int, dt: Column | float = 0.5) -> DataFrame:
    """FLD-02, first part of FLD-04: samples and summed velocity per cell and sector of the held heading, with the
    samples' extremes and dt. Rows whose _in is false leave only their extremes."""
    h = F.coalesce("heading", F.degrees(F.atan2("vx", "vy")))
    sector = F.pmod(F.floor(F.pmod(h + 180.0 / sectors, F.lit(360.0)) / (360.0 / sectors)), F.lit(sectors)).cast("int") if sectors > 1 else F.lit(0)
    p = points.where("x is not null and y is not null and vx is not null and vy is not null")
    take = (lambda c: F.when(F.col("_in"), c)) if "_in" in points.columns else (lambda c: c)
    return p.groupBy(*keys, F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"), sector.alias("sector")).agg(
        F.count(take(F.lit(1))).cast("double").alias("w"), F.coalesce(F.sum(take(F.col("vx"))), F.lit(0.0)).alias("bx"), F.coalesce(F.sum(take(F.col("vy"))), F.lit(0.0)).alias("b_y"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max(dt if isinstance(dt, Column) else F.lit(dt)).alias("_dt"),
    )


def smooth_field(points: DataFrame, keys: list[str], cell: float = 1.0, smooth: float = 1.5, dt: Column | float = 0.5, include_predicted: bool = False, confidence_samples: float = 15.0, min_weight: float = 0.05, bound_keys: list[str] | None = None, sectors: int = 8) -> DataFrame:
    """FLD-05: keys, i, j, cell_x, cell_y, vx, vy, speed, heading, density, weight, confidence, dominance.

    Of each cell the direction with its two neighbours at half weight that weighs most gives the
    velocity (the lowest sector on ties); weight counts the samples under the kernel. Cells below
    min_weight are left out. dt may be a column of points that the keys determine. The grid's bounds are
    those of the samples of the same bound_keys, by default the keys.
    """
    p = measured(points, include_predicted)
    sigma = max(smooth / cell, 1e-6)
    area = 2 * math.pi * sigma**2
    cells = with_bounds(deposit(p, keys, cell, sectors, dt), keys if bound_keys is None else bound_keys, cell, 3 * smooth)
    cells = cells.withColumn("_dt", F.max("_dt").over(Window.partitionBy(*(keys or [F.lit(0)])))).where("w > 0")
    spread = blurred(cells, [*keys, "_dt", "sector"], ["w", "bx", "b_y"], sigma, bounded=True, scale=area)
    if sectors > 1:
        turn = F.array(*[F.struct(F.lit(d).alias("_d"), F.lit(m).alias("_m")) for d, m in ((0, 1.0), (1, 0.5), (-1, 0.5))])
        mixed = spread.select("*", F.inline(turn)).withColumn("own", F.when(F.col("_d") == 0, F.col("w")).otherwise(0.0)).withColumn("sector", F.pmod(F.col("sector") + F.col("_d"), F.lit(sectors)))
        mixed = mixed.groupBy(*keys, "_dt", "i", "j", "sector").agg(F.sum("own").alias("own"), *[F.sum(F.col(v) * F.col("_m")).alias(v) for v in ("w", "bx", "b_y")])
    else:
        mixed = spread.withColumn("own", F.col("w"))
    # one number orders by weight, then by sector, so that the aggregate hashes fixed-width buffers; weights that
    # differ by rounding alone are ties
    best = F.round(F.col("w") * 1e6).cast("long") * max(sectors, 1) - F.col("sector")
    out = mixed.groupBy(*keys, "_dt", "i", "j").agg(F.sum("own").alias("weight"), *[F.max_by(c, best).alias(f"_{c}") for c in ("w", "bx", "b_y")]).where(F.col("weight") >= min_weight)
    out = out.withColumn("vx", F.col("_bx") / F.col("_w")).withColumn("vy", F.col("_b_y") / F.col("_w"))
    return out.select(
        *keys, "i", "j", ((F.col("i") + 0.5) * cell).alias("cell_x"), ((F.col("j") + 0.5) * cell).alias("cell_y"), "vx", "vy", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2).alias("speed"),
        heading_of(F.col("vx"), F.col("vy")).alias("heading"), (F.col("weight") / area * F.col("_dt") / (cell * cell)).alias("density"), "weight",
        (1 - F.exp(-F.col("weight") / max(confidence_samples, 1e-9))).alias("confidence"), F.least(F.col("_w") / (F.col("weight") + 1e-12), F.lit(1.0)).alias("dominance"),
    )


def time_sliced(points: DataFrame, keys: list[str], window_s: float, cell: float = 1.0, smooth: float = 1.5, **kw) -> DataFrame:
    """FLD-06: a field per window [t_start, t_end) counted from the keys' first sample, predicted ones
    included, on one grid per keys. A last sample exactly on a window's end is in none."""
    span = cut_lineage(points.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1")))
    p = points.join(sized(span), keys)
    k = F.floor((F.col("t") - F.col("_t0")) / window_s)
    p = p.withColumn("t_start", F.col("_t0") + k * window_s).withColumn("_in", F.col("t_start") < F.col("_t1"))
    f = smooth_field(p, [*keys, "t_start"], cell, smooth, bound_keys=keys, **kw)
    return f.withColumn("t_end", F.col("t_start") + window_s)


def with_all(points: DataFrame, group: str = "grp") -> DataFrame:
    """FLD-08: every row for its group and for 'all'."""
    return points.withColumn(group, F.explode(F.array(F.col(group), F.lit("all"))))


def as_arrays(field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """FLD-07: per keys and row j: the lowest i and an array of values along i, null where there is no cell."""
    w = Window.partitionBy(*keys)
    f = field.withColumn("i0", F.min("i").over(w)).withColumn("i1", F.max("i").over(w))
    rows = f.groupBy(*keys, "j", "i0", "i1").agg(F.map_from_entries(F.collect_list(F.struct("i", value))).alias("_m"))
    return rows.select(*keys, "j", "i0", F.transform(F.sequence("i0", "i1"), lambda i: F.col("_m")[i]).alias("row"))


def occupancy_density(points: DataFrame, keys: list[str], res: float, dt: Column | float, include_predicted: bool = True, sigma_m: float | None = None) -> DataFrame:
    """AGG-10: seconds of presence per square metre: summed time per cell, blurred with a reflecting edge."""
    p = measured(points, include_predicted).where("x is not null and y is not null").withColumn("_dt", dt if isinstance(dt, Column) else F.lit(dt))
    sigma = (sigma_m if sigma_m is not None else max(0.5, 2 * res)) / res
    cells = p.groupBy(*keys, F.floor(F.col("x") / res).alias("i"), F.floor(F.col("y") / res).alias("j")).agg(F.sum("_dt").alias("density"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return blurred(with_bounds(cells, keys, res, 0.0), keys, ["density"], sigma, bounded=True, reflect=True, scale=1 / (res * res))


def voxels(field: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """FLD-10: voxel columns and rows (rows run down from the top), velocity faded by confidence."""
    w = Window.partitionBy(*keys)
    f = field.where(F.col("confidence") >= least).withColumn("_i0", F.min("i").over(w)).withColumn("_j1", F.max("j").over(w))
    return f.select(*keys, (F.col("i") - F.col("_i0")).alias("column"), (F.col("_j1") - F.col("j")).alias("row"), (F.col("vx") * F.col("confidence")).alias("vx"), (F.col("vy") * F.col("confidence")).alias("vy"))


def slice_at(sliced: DataFrame, at: float) -> DataFrame:
    """FLD-10: the slice with t_start <= at < t_end."""
    return sliced.where((F.col("t_start") <= at) & (F.col("t_end") > at))
