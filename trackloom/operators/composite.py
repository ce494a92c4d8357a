"""Many clips together: union, agreement, continuous and master fields, coverage and kits.

Fields carry clip in their key, so all clips are one plan; pairs of clips meet cell by cell in an
equi-join, never all with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wrap180
from ..session import cut_lineage, sized
from . import field as V

#: Order of the groups in a master field.
ORDER = ["people", "cycles", "buses", "vehicles"]


def united(clips: list[DataFrame]) -> DataFrame:
    """CMP-01: points of several clips, ids moved apart by a million per clip, missing columns null."""
    moved = [c.withColumn("track_id", F.col("track_id") + (k + 1) * 1_000_000) for k, c in enumerate(clips)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), moved)


def renumbered(points: DataFrame) -> DataFrame:
    """CMP-01 on one table: ids of the k-th clip by name moved by k million."""
    # long: from the 2,148th clip on the product is beyond an int
    order = points.select("clip").distinct().withColumn("_k", F.row_number().over(Window.orderBy("clip")).cast("long"))
    return points.join(sized(order), "clip").withColumn("track_id", F.col("track_id") + F.col("_k") * 1_000_000).drop("_k")


def graded(points: DataFrame, clips: DataFrame, grade: str = "ok") -> DataFrame:
    """CMP-02: points of clips of the grade, whatever its case; a clip without grade counts as ok."""
    good = clips.where(F.lower(F.coalesce(F.trim("grade"), F.lit("ok"))) == grade).select("clip")
    return points.join(sized(good), "clip", "left_semi")


def enough_tracks(points: DataFrame, keys: list[str], least: int) -> DataFrame:
    """CMP-05, CMP-10: points of the keys that have at least so many tracks."""
    good = points.groupBy(*keys).agg(F.count_distinct("track_id").alias("_n")).where(F.col("_n") >= least).select(*keys)
    return points.join(sized(good), keys, "left_semi")


def clip_fields(points: DataFrame, keys: list[str], cell: float, smooth: float, least: int = 3) -> DataFrame:
    """CMP-05: each clip's field on one grid per keys (site, group), of clips with enough tracks."""
    p = points.where(~F.col("pred"))
    full = [*keys, "clip"]
    # tracks are counted from a narrow table; the grid's bounds rest on all samples
    good = cut_lineage(p.groupBy(*full).agg(F.count_distinct("track_id").alias("_t")).where(F.col("_t") >= least).select(*full, F.lit(True).alias("_in")))
    p = p.join(sized(good), full, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    return V.smooth_field(p, full, cell, smooth, F.col("dt"), bound_keys=keys)


def continuous(fields: DataFrame, keys: list[str]) -> DataFrame:
    """CMP-06: of each cell the row of the clip that weighs most, the first by name on ties."""
    w = Window.partitionBy(*keys, "i", "j").orderBy(F.round("weight", 9).desc(), "clip")
    return fields.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def agreement_cells(fields: DataFrame, keys: list[str]) -> DataFrame:
    """CMP-04: cells where two or more clips show a clear flow: weighted mean vector, largest angle to it."""
    f = fields.where("confidence >= 0.5 and dominance >= 0.6")
    w = Window.partitionBy(*keys, "i", "j")
    total = F.sum("weight").over(w)
    f = f.withColumn("_n", F.count("*").over(w)).withColumn("mvx", F.sum(F.col("vx") * F.col("weight")).over(w) / total).withColumn("mvy", F.sum(F.col("vy") * F.col("weight")).over(w) / total).where("_n >= 2")
    off = F.abs(wrap180(F.degrees(F.atan2("vx", "vy")) - F.degrees(F.atan2("mvx", "mvy"))))
    return f.groupBy(*keys, "i", "j").agg(F.count("*").alias("clips"), F.array_join(F.array_sort(F.collect_list("clip")), " ").alias("clip_names"), F.first("mvx").alias("vx"), F.first("mvy").alias("vy"), F.max(off).alias("direction_spread_deg"))


def agreement_pairs(fields: DataFrame, keys: list[str], agree_deg: float = 30.0) -> DataFrame:
    """CMP-04: per pair of clips: shared cells, median angle, share that agrees, median ratio of speeds."""
    f = fields.where("confidence >= 0.5 and dominance >= 0.6").select(*keys, "i", "j", "clip", "vx", "vy", "speed")
    a, b = (f.withColumnsRenamed({c: f"{c}_{s}" for c in ("clip", "vx", "vy", "speed")}) for s in "ab")
    j = a.join(b, [*keys, "i", "j"]).where("clip_a < clip_b")
    angle = F.abs(wrap180(F.degrees(F.atan2("vx_a", "vy_a")) - F.degrees(F.atan2("vx_b", "vy_b"))))
    j = j.withColumn("angle", angle).withColumn("ratio", F.col("speed_a") / F.greatest(F.col("speed_b"), F.lit(1e-6)))
    return j.groupBy(*keys, "clip_a", "clip_b").agg(F.count("*").alias("shared_cells"), F.percentile("angle", 0.5).alias("median_angle_deg"), F.avg((F.col("angle") <= agree_deg).cast("double")).alias("agree_share"), F.percentile("ratio", 0.5).alias("median_speed_ratio"))


def median_intervals(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _interval: the median of dt over the samples, from how often each of the few intervals occurs."""
    n = points.groupBy(*keys, "dt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("_to", F.sum("_n").over(w.orderBy("dt"))).withColumn("_all", F.sum("_n").over(w))
    # the two middle samples, which are one if their number is odd
    lower = F.min(F.when(F.col("_to") > F.floor((F.col("_all") - 1) / 2), F.col("dt")))
    upper = F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("dt")))
    return n.groupBy(*keys).agg(((lower + upper) / 2).alias("_interval"))


def master(points: DataFrame, keys: list[str], groups: list[str], cell: float, smooth: float) -> DataFrame:
    """CMP-07: the pooled field, each group's columns beside it (as an outer join gives them), and the group with most density.

    Groups are in the given order, which breaks ties; dominant_group is '' where none has density.
    """
    p = points.where(~F.col("pred") & F.col("grp").isin(groups))
    # one pass for the pool, as group '', and the groups
    p = p.withColumn("grp", F.explode(F.array(F.col("grp"), F.lit(""))))
    p = p.join(sized(median_intervals(p, [*keys, "grp"])), [*keys, "grp"])
    both = V.smooth_field(p, [*keys, "grp"], cell, smooth, F.col("_interval"), bound_keys=keys)
    columns = ("vx", "vy", "speed", "density", "confidence", "weight")
    out = both.groupBy(*keys, "i", "j").agg(*[F.max(F.when(F.col("grp") == g, F.col(c))).alias(f"{g}_{c}" if g else c) for g in ["", *groups] for c in columns])
    dens = [F.coalesce(f"{g}_density", F.lit(0.0)) for g in groups]
    most = F.greatest(*dens) if len(dens) > 1 else dens[0]
    name: Column = F.lit("")
    for g, d in reversed(list(zip(groups, dens))):
        name = F.when((d == most) & (most > 0), g).otherwise(name)
    return out.withColumn("dominant_group", name).withColumn("cell_x", (F.col("i") + 0.5) * cell).withColumn("cell_y", (F.col("j") + 0.5) * cell)


def footprints(cameras: DataFrame, cell: float, cap_m: float = 150.0, cap_per_height: float = 10.0) -> DataFrame:
    """CMP-03: clip, i, j: cells a clip's camera sees: the convex hull of a lattice of its pixels on the
    ground, cut by its range. cameras: clip, h (nine doubles), image_w, image_h, height_m, camera at (0, 0)."""

    def hull(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) < 3:
            return p

        def half(points: np.ndarray) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out

        return np.array(half(p)[:-1] + half(p[::-1])[:-1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c in f.itertuples():
                m = np.asarray(c.h, float).reshape(3, 3)
                u, v = np.meshgrid(np.linspace(0, c.image_w - 1, 120), np.linspace(0, c.image_h - 1, 68))
                g = m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
                s = np.sign(m[2] @ [c.image_w / 2, c.image_h, 1.0])
                ok = (np.sign(g[2]) == s) & (np.abs(g[2]) > 1e-12)
                x, y = g[0, ok] / g[2, ok], g[1, ok] / g[2, ok]
                reach = max(cap_m, cap_per_height * abs(c.height_m))
                near = np.hypot(x, y) <= reach
                p = hull(np.stack([x[near], y[near]], 1))
                if len(p) < 3:
                    continue
                i, j = (q.ravel() for q in np.meshgrid(np.arange(np.floor(p[:, 0].min() / cell), np.floor(p[:, 0].max() / cell) + 1), np.arange(np.floor(p[:, 1].min() / cell), np.floor(p[:, 1].max() / cell) + 1)))
                cx, cy = (i + 0.5) * cell, (j + 0.5) * cell
                inside = np.hypot(cx, cy) <= reach
                for a, b in zip(p, np.roll(p, -1, 0)):
                    inside &= (b[0] - a[0]) * (cy - a[1]) - (b[1] - a[1]) * (cx - a[0]) >= 0
                rows.append(pd.DataFrame({"clip": c.clip, "i": i[inside].astype(np.int64), "j": j[inside].astype(np.int64)}))
            yield pd.concat(rows) if rows else pd.DataFrame({"clip": [], "i": [], "j": []})

    return cameras.select("clip", "h", "image_w", "image_h", "height_m").mapInPandas(run, "clip string, i long, j long")


def coverage(seen: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """CMP-08: seconds in view per cell: seen (clip, keys, i, j) times each clip's duration_s."""
    return seen.join(sized(durations), "clip").groupBy(*keys, "i", "j").agg(F.sum("duration_s").alias("seen_s"), F.count_distinct("clip").alias("clips"))


def density_in_view(occupied: DataFrame, covered: DataFrame, keys: list[str], cell: float, sigma: float = 1.5, least_s: float = 5.0) -> DataFrame:
    """CMP-09: blurred seconds of presence over blurred seconds in view, per square metre, where those are at
    least least_s. occupied: keys, i, j, present_s, all of them in view; covered: keys, i, j, seen_s. The edge reflects."""
    both = covered.select(*keys, "i", "j", "seen_s").join(occupied.select(*keys, "i", "j", "present_s"), [*keys, "i", "j"], "left")
    w = Window.partitionBy(*keys)
    both = both.withColumns({"i0": F.min("i").over(w), "i1": F.max("i").over(w), "j0": F.min("j").over(w), "j1": F.max("j").over(w), "present_s": F.coalesce("present_s", F.lit(0.0))})
    b = V.blurred(both, keys, ["present_s", "seen_s"], sigma / cell, bounded=True, reflect=True)
    return b.where(F.col("seen_s") >= least_s).select(*keys, "i", "j", "seen_s", (F.col("present_s") / F.col("seen_s") / (cell * cell)).alias("density"))


def web_paths(points: DataFrame, near_m: float = 30.0) -> DataFrame:
    """CMP-11: people near the camera joined across clips by their number modulo a million, every third
    sample; the others per track, every second."""
    p = points.where("grp = 'people'").withColumn("near", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) <= near_m)
    line = F.when(F.col("near"), F.pmod("track_id", F.lit(1_000_000))).otherwise(F.col("track_id"))
    p = p.withColumn("line", line).withColumn("_n", F.row_number().over(Window.partitionBy("near", "line").orderBy("clip", "frame")) - 1)
    return p.where(F.when(F.col("near"), F.col("_n") % 3 == 0).otherwise(F.col("_n") % 2 == 0)).groupBy("near", "line").agg(F.count("*").alias("n"), F.count_distinct("clip").alias("clips"))


def clip_table(points: DataFrame, clips: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """CMP-12: clips with their number, tracks, samples and area in view."""
    n = points.groupBy("clip").agg(F.count_distinct("track_id").alias("tracks"), F.count("*").alias("samples"))
    c = clips.select("clip", "site", F.lower(F.coalesce(F.trim("grade"), F.lit("ok"))).alias("grade")).join(n, "clip", "left").withColumn("camera", F.row_number().over(Window.orderBy("clip")))
    c = c.withColumn("tracks", F.coalesce("tracks", F.lit(0))).withColumn("samples", F.coalesce("samples", F.lit(0)))
    return c if areas is None else c.join(areas, "clip", "left")


def sample_metrics(points: DataFrame) -> DataFrame:
    """CMP-13: per group: tracks, samples, median speed of the samples."""
    return points.where(~F.col("pred")).groupBy("grp").agg(F.count_distinct("track_id").alias("tracks"), F.count("*").alias("samples"), F.percentile("speed", 0.5).alias("median_speed"))


def kit_frame(field: DataFrame, cell: float, origin: tuple[float, float], top: dict[str, float] | float, group: str | None = None) -> DataFrame:
    """KIT-01: x, z relative to the origin with z to the south, velocities alike, top speed by group else the largest."""
    if isinstance(top, dict):
        s: Column = F.lit(max(top.values()))
        for g, v in top.items():
            s = F.when(F.col(group) == g, v).otherwise(s) if group else s
    else:
        s = F.lit(float(top))
    f = field.where(F.col("vx").isNotNull() & F.col("vy").isNotNull() & ~F.isnan("vx") & ~F.isnan("vy"))
    keep = [c for c in ("clip", "site", "grp") if c in field.columns]
    return f.select(*keep, (F.col("cell_x") - origin[0]).alias("x"), (-(F.col("cell_y") - origin[1])).alias("z"), "vx", (-F.col("vy")).alias("vz"), "speed", "density", "confidence", s.alias("smax"), F.lit(cell).alias("cell"))


def kit_modules(frames: DataFrame, keys: list[str]) -> DataFrame:
    """KIT-01, KIT-02: per module: cells, density-weighted centre and speed, span, and the defaults from them."""
    w = F.greatest(F.col("density"), F.lit(0.0)) + 1e-12
    m = frames.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum(F.col("x") * w) / F.sum(w)).alias("cx"), (F.sum(F.col("z") * w) / F.sum(w)).alias("cz"), (F.sum(F.col("speed") * w) / F.sum(w)).alias("mean"),
        (F.greatest(F.max("x") - F.min("x"), F.max("z") - F.min("z")) + F.max("cell")).alias("span"),
    )
    s = F.greatest(F.col("mean"), F.lit(0.2))
    return m.withColumn("life", F.least(F.greatest(1.2 * F.col("span") / s, F.lit(4.0)), F.lit(30.0))).withColumn("noise", 0.3 * s).withColumn("min_speed", 0.04 * s)


def largest(modules: DataFrame, k: int = 2) -> DataFrame:
    """KIT-03: the k modules with most cells, the first by name on ties."""
    return modules.orderBy(F.desc("n"), "clip").limit(k)


def weighted_draw(cells: DataFrame, draws: int, keys: list[str]) -> DataFrame:
    """KIT-04: draws cells with replacement by sqrt(density) * confidence, at evenly spaced places of the
    running sum of weights within keys: each cell says how many places lie in its stretch."""
    c = cells.withColumn("_w", F.sqrt(F.greatest(F.col("density"), F.lit(0.0))) * F.col("confidence"))
    w = Window.partitionBy(*keys)
    o = w.orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_b", F.sum("_w").over(o) / F.sum("_w").over(w)).withColumn("_a", F.col("_b") - F.col("_w") / F.sum("_w").over(w))
    # tiny differences of summation must not move a place
    n = F.floor(F.col("_b") * draws + 0.5 + 1e-9) - F.floor(F.col("_a") * draws + 0.5 + 1e-9)
    return c.withColumn("drawn", n).where("drawn > 0").drop("_w", "_a", "_b")


def blended(fields: DataFrame, keys: list[str]) -> DataFrame:
    """KIT-04: sum(w v) / sum(w) over the modules at each cell, w = density / median density within 0.05 .. 20."""
    med = fields.groupBy(*keys).agg(F.percentile("density", 0.5).alias("_m"))
    f = fields.join(sized(med), keys).withColumn("_w", F.least(F.greatest(F.col("density") / F.col("_m"), F.lit(0.05)), F.lit(20.0)))
    return f.groupBy(*keys, "i", "j").agg(*[(F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(v) for v in ("vx", "vy")], F.count("*").alias("modules"))
