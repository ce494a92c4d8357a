"""Aggregates, statistics and lookups over points and track summaries.

points: clip, track_id, cls, grp, frame, t, x, y, vx, vy, speed, heading, pred, source, dt.
Null measures are left out of means as in any SQL engine; empty inputs give no rows unless a
function says otherwise. Extra columns are ignored. Percentiles are exact and linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip_to, cross_side, heading_of, segment_distance
from ..session import cut_lineage, sized

TRACK = ["clip", "track_id"]


def measured(points: DataFrame, include_predicted: bool = False) -> DataFrame:
    return points if include_predicted else points.where(~F.col("pred"))


def grid(points: DataFrame, cell: float, keys: tuple[str, ...] = ("clip",), include_predicted: bool = False) -> DataFrame:
    """AGG-01: mean flow per square cell (i, j) of world-aligned edges."""
    p = measured(points, include_predicted).where("x is not null and y is not null and vx is not null and vy is not null")
    p = p.withColumn("i", F.floor(F.col("x") / cell)).withColumn("j", F.floor(F.col("y") / cell))
    g = p.groupBy(*keys, "i", "j").agg(
        F.avg("vx").alias("mean_vx"), F.avg("vy").alias("mean_vy"), F.avg("speed").alias("mean_speed"), F.count("*").alias("count"), F.count_distinct("track_id").alias("n_tracks")
    )
    flow = F.sqrt(F.col("mean_vx") ** 2 + F.col("mean_vy") ** 2)
    return g.select(
        *keys, "i", "j", ((F.col("i") + 0.5) * cell).alias("cell_x"), ((F.col("j") + 0.5) * cell).alias("cell_y"), "mean_vx", "mean_vy", "mean_speed", flow.alias("flow_speed"),
        heading_of(F.col("mean_vx"), F.col("mean_vy")).alias("heading"), F.when(F.col("mean_speed") > 0, flow / F.col("mean_speed")).otherwise(0.0).alias("coherence"), "count", "n_tracks",
    )


def with_steps(points: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """points with step: metres from the row before in its track, null for the first."""
    w = Window.partitionBy(*keys).orderBy("frame")
    return points.withColumn("step", F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2))


def summary(points: DataFrame) -> DataFrame:
    """CLN-22: one row per track."""
    ends = {k: F.col(k) for k in ("x", "y")}
    first = {f"start_{k}": F.min_by(c, "frame") for k, c in ends.items()} | {f"end_{k}": F.max_by(c, "frame") for k, c in ends.items()}
    s = with_steps(points).groupBy(*TRACK, "cls", "grp").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("n_points"),
        *[F.sum(F.when(F.col("source") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("predicted", "stitched", "interpolated")],
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length_m"), F.avg("speed").alias("mean_speed"), F.percentile("speed", 0.5).alias("median_speed"), F.max("speed").alias("max_speed"),
        *[c.alias(n) for n, c in first.items()],
    )
    straight = F.sqrt((F.col("end_x") - F.col("start_x")) ** 2 + (F.col("end_y") - F.col("start_y")) ** 2)
    s = s.withColumn("duration_s", F.col("end_s") - F.col("start_s")).withColumn("straight_dist_m", straight)
    return s.withColumn("straightness", F.when(F.col("path_length_m") > 0, F.col("straight_dist_m") / F.col("path_length_m")))


def stat_blocks(tracks: DataFrame, points: DataFrame, minutes: float) -> DataFrame:
    """AGG-02: scope (class or group), name, counts, rates and track statistics."""
    sets = tracks.groupingSets([["cls"], ["grp"]], "cls", "grp").agg(
        F.count("*").alias("n"), F.avg("mean_speed").alias("mean_speed"), F.percentile("mean_speed", 0.5).alias("median_speed"), F.percentile("mean_speed", 0.85).alias("p85_speed"),
        F.avg("straightness").alias("mean_straightness"), F.avg("duration_s").alias("mean_duration_s"), F.avg("path_length_m").alias("mean_path_m"),
    )
    samples = measured(points).groupingSets([["cls"], ["grp"]], "cls", "grp").agg(F.avg("speed").alias("mean_sample_speed"))
    label = [F.when(F.col("cls").isNotNull(), "class").otherwise("group").alias("scope"), F.coalesce("cls", "grp").alias("name")]
    a = sets.select(*label, "n", (F.col("n") / minutes).alias("n_per_min"), "mean_speed", "median_speed", "p85_speed", "mean_straightness", "mean_duration_s", "mean_path_m")
    return a.join(samples.select(*label, "mean_sample_speed"), ["scope", "name"], "left")


def flow_per_minute(tracks: DataFrame, start: float, minutes: int) -> DataFrame:
    """AGG-03: grp, minute, n: tracks by the minute in which they start, empty minutes as 0."""
    at = clip_to(F.floor((F.col("start_s") - start) / 60.0).cast("int"), 0, minutes - 1)
    counted = tracks.groupBy("grp", at.alias("minute")).agg(F.count("*").alias("n"))
    every = tracks.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("minute"))
    return every.join(counted, ["grp", "minute"], "left").select("grp", "minute", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(tracks: DataFrame, value: str, lo: float, hi: float, bins: int, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """AGG-04: bins of equal width over lo .. hi, values clipped into them, the last one closed."""
    w = (hi - lo) / bins
    k = F.least(F.floor((clip_to(F.col(value), lo, hi) - lo) / w), F.lit(bins - 1)).cast("int")
    return tracks.where(F.col(value).isNotNull()).groupBy(*keys, k.alias("bin")).agg(F.count("*").alias("n")).select(*keys, "bin", (lo + F.col("bin") * w).alias("bin_lo"), (lo + (F.col("bin") + 1) * w).alias("bin_hi"), "n")


def crossings(points: DataFrame, lines: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """AGG-05: line, track, time and direction (1 left to right) of each crossing of a finite line.

    lines: line, site or clip keys shared with points, ax, ay, bx, by. A sample exactly on a line is
    on neither side, so that passage isn't counted.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    steps = points.select("site", *keys, "cls", "grp", "frame", "t", "x", "y", F.lead("t").over(w).alias("t2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("t2 is not null")
    j = steps.join(sized(lines), "site")
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    s1, s2 = (cross_side(*a, *b, F.col(x), F.col(y)) for x, y in (("x", "y"), ("x2", "y2")))
    dx, dy, ex, ey = F.col("x2") - F.col("x"), F.col("y2") - F.col("y"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    den = dx * ey - dy * ex
    j = j.withColumn("s1", s1).where((s1 * s2 < 0) & (F.abs(den) >= 1e-12))
    s = ((F.col("ax") - F.col("x")) * ey - (F.col("ay") - F.col("y")) * ex) / den
    u = ((F.col("ax") - F.col("x")) * dy - (F.col("ay") - F.col("y")) * dx) / den
    return j.withColumn("s", s).withColumn("u", u).where("s between 0 and 1 and u between 0 and 1").select("line", *keys, "cls", "grp", (F.col("t") + F.col("s") * (F.col("t2") - F.col("t"))).alias("time_s"), F.col("s1").cast("int").alias("direction"))


def crossing_summary(crossed: DataFrame, minutes: float) -> DataFrame:
    """AGG-06: per line and class: left to right, right to left, both per minute."""
    return crossed.groupBy("line", "cls").agg(F.sum((F.col("direction") == 1).cast("long")).alias("left_to_right"), F.sum((F.col("direction") == -1).cast("long")).alias("right_to_left"), (F.count("*") / minutes).alias("per_min"))


def predicted_share(points: DataFrame) -> DataFrame:
    """AGG-07: per clip: samples, share not detected, first and last second."""
    return points.groupBy("clip").agg(F.count("*").alias("n"), F.avg(F.col("pred").cast("double")).alias("predicted_share"), F.min("t").alias("start_s"), F.max("t").alias("end_s"), (F.max("t") - F.min("t")).alias("duration_s"))


def unpivot_stats(blocks: DataFrame, metrics: list[str]) -> DataFrame:
    """AGG-08: scope, name, metric, value; null values are left out."""
    return blocks.unpivot(["scope", "name"], metrics, "metric", "value").where("value is not null")


def key_figures(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """AGG-09: figure, value: for all tracks, and with the group's name as suffix if there are several."""
    def figures(t: DataFrame) -> DataFrame:
        return t.agg(F.count("*").cast("double").alias("tracks"), F.percentile("mean_speed", 0.5).alias("median_speed"), F.sum("path_length_m").alias("path_total_m"), F.avg("straightness").alias("straightness"))

    names = ["tracks", "median_speed", "path_total_m", "straightness"]
    whole = figures(tracks).unpivot([], names, "figure", "value")
    count = Window.partitionBy()
    per = figures(tracks.groupBy("grp")).withColumn("_n", F.count("*").over(count)).where("_n > 1").drop("_n")
    per = per.unpivot("grp", names, "figure", "value").select(F.concat_ws("_", "figure", "grp").alias("figure"), "value")
    return whole.unionByName(per)


def weighted_share(tracks: DataFrame, share: str, weight: str, keys: list[str], warn: float = 0.3) -> DataFrame:
    """AGG-12: weighted mean of a share, and whether it is above warn."""
    s = tracks.where(F.col(share).isNotNull() & ~F.isnan(share)).groupBy(*keys).agg((F.sum(F.col(share) * F.col(weight)) / F.sum(weight)).alias("share"))
    return s.withColumn("warn", F.col("share") > warn)


def near_lines_share(points: DataFrame, segments: DataFrame, reach: float = 6.0) -> DataFrame:
    """AGG-13: per site: share of samples within reach of the nearest segment (site, ax, ay, bx, by)."""
    d = points.join(sized(segments), "site").groupBy("site", *[c for c in TRACK], "frame").agg(F.min(segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])).alias("d"))
    return d.groupBy("site").agg(F.count("*").alias("n"), F.avg((F.col("d") <= reach).cast("double")).alias("share"), F.percentile("d", 0.5).alias("median_m"))


def state_nearest(points: DataFrame, at: float) -> DataFrame:
    """AGG-14: of each track alive at the time, the sample nearest to it, the earlier one on ties."""
    alive = points.groupBy(*TRACK).agg(F.min("t").alias("_a"), F.max("t").alias("_b"), F.min_by(F.struct("frame", "x", "y", "speed"), F.struct(F.abs(F.col("t") - at), "frame")).alias("s"))
    return alive.where((F.col("_a") <= at) & (F.col("_b") >= at)).select(*TRACK, "s.*")


def state_next(points: DataFrame, at: float) -> DataFrame:
    """AGG-15: of each track alive at the time, its first sample at or after it."""
    alive = points.groupBy(*TRACK).agg(F.min("t").alias("_a"), F.min_by(F.struct("frame", "x", "y", "speed"), F.when(F.col("t") >= at, F.col("frame"))).alias("s"), F.max("t").alias("_b"))
    return alive.where((F.col("_a") <= at) & (F.col("_b") >= at)).select(*TRACK, "s.*")


def trails(points: DataFrame, at: float, tail: float) -> DataFrame:
    """AGG-16: of each track with at least two samples in the tail seconds before the time, the path."""
    t = points.where((F.col("t") <= at) & (F.col("t") >= at - tail)).groupBy(*TRACK).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))), lambda s: s["frame"]).alias("frames"))
    return t.where("n >= 2")


def sources_and_sinks(points: DataFrame) -> DataFrame:
    """AGG-17: first and last detected sample of each track."""
    e = measured(points).groupBy(*TRACK, "grp").agg(F.min_by(F.struct("frame", "x", "y"), "frame").alias("a"), F.max_by(F.struct("frame", "x", "y"), "frame").alias("b"))
    return e.select(*TRACK, "grp", F.lit("source").alias("kind"), "a.*").unionByName(e.select(*TRACK, "grp", F.lit("sink").alias("kind"), "b.*"))


def cell_means_filled(cells: DataFrame, wanted: DataFrame, value: str, keys: list[str], reach: int | None = None) -> DataFrame:
    """AGG-18: value of each wanted cell (keys, i, j), else that of the nearest cell of its keys, however far.

    Ties go to the smaller (i, j). Null is left only where no cell of the keys has a value. With a reach, only the
    square of so many cells on each side is looked at and the value is null beyond it.
    """
    if reach is None:
        return _nearest_filled(cells, wanted, value, keys)
    shifts = F.array(*[F.struct(F.lit(a).cast("long").alias("di"), F.lit(b).cast("long").alias("dj")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    near = wanted.select(*keys, "i", "j", F.inline(shifts)).withColumn("ci", F.col("i") + F.col("di")).withColumn("cj", F.col("j") + F.col("dj"))
    c = cells.select(*keys, F.col("i").alias("ci"), F.col("j").alias("cj"), F.col(value).alias("_v"))
    met = near.join(c, [*keys, "ci", "cj"], "left")
    order = F.when(F.col("_v").isNotNull(), F.struct(F.col("di") ** 2 + F.col("dj") ** 2, "ci", "cj"))
    return met.groupBy(*keys, "i", "j").agg(F.min_by("_v", order).alias(value))


def _nearest_filled(cells: DataFrame, wanted: DataFrame, value: str, keys: list[str], first: int = 4) -> DataFrame:
    """Rounds over blocks of 4, 16, 64 .. cells: a wanted cell meets the nine blocks around it, which hold all cells up
    to a block's side away, so a find within that is final and the others go to the next round. Only cells with a
    neighbour without a value can be nearest to another cell, so the inside of filled areas is never met."""
    c = cells.where(F.col(value).isNotNull()).select(*keys, F.col("i").cast("long").alias("ci"), F.col("j").cast("long").alias("cj"), F.col(value).alias("_v"))
    c = cut_lineage(c.groupBy(*keys, "ci", "cj").agg(F.min("_v").alias("_v")))
    want = wanted.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
    start = want.join(c.withColumnsRenamed({"ci": "i", "cj": "j"}), [*keys, "i", "j"], "left")
    start = cut_lineage(start.join(c.select(*keys).distinct().withColumn("_any", F.lit(True)), keys, "left"))
    out = start.where("_v is not null or _any is null").select(*keys, "i", "j", "_v")
    rest = start.where("_v is null and _any").select(*keys, "i", "j")
    sides = F.array(*[F.struct(F.lit(a).cast("long").alias("_a"), F.lit(b).cast("long").alias("_b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    beside = c.select(*keys, "ci", "cj", "_v", F.inline(sides)).withColumn("_ni", F.col("ci") + F.col("_a")).withColumn("_nj", F.col("cj") + F.col("_b"))
    taken = c.select(*keys, F.col("ci").alias("_ni"), F.col("cj").alias("_nj"))
    edge = cut_lineage(beside.join(taken, [*keys, "_ni", "_nj"], "left_anti").select(*keys, "ci", "cj", "_v").distinct())
    around = F.array(*[F.struct(F.lit(a).cast("long").alias("_a"), F.lit(b).cast("long").alias("_b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    side = first
    while not rest.isEmpty():
        block = lambda v: F.floor(F.col(v) / side)  # noqa: B023, E731
        e = edge.withColumn("_bi", block("ci")).withColumn("_bj", block("cj"))
        w = rest.select(*keys, "i", "j", F.inline(around)).withColumn("_bi", block("i") + F.col("_a")).withColumn("_bj", block("j") + F.col("_b"))
        d2 = (F.col("ci") - F.col("i")) * (F.col("ci") - F.col("i")) + (F.col("cj") - F.col("j")) * (F.col("cj") - F.col("j"))
        best = w.join(e, [*keys, "_bi", "_bj"]).groupBy(*keys, "i", "j").agg(F.min(F.struct(d2.alias("d2"), "ci", "cj", "_v")).alias("_s"))
        met = cut_lineage(rest.join(best, [*keys, "i", "j"], "left"))
        final = F.coalesce(F.col("_s.d2") <= side * side, F.lit(False))
        out = out.unionByName(met.where(final).select(*keys, "i", "j", F.col("_s._v").alias("_v")))
        rest = met.where(~final).select(*keys, "i", "j")
        side *= 4
    return out.withColumnRenamed("_v", value)


def speed_runs(points: DataFrame, lo: float, hi: float, bins: int = 12) -> DataFrame:
    """AGG-19: stretches of a track in one speed class; neighbours share their end sample."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    k = F.least(F.floor((clip_to(F.col("speed"), lo, hi) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    p = points.where("speed is not null").withColumn("k", k).withColumn("nxt", F.lead("frame").over(w))
    p = p.withColumn("run", F.sum(F.when(F.col("k") == F.lag("k").over(w), 0).otherwise(1)).over(w))
    return p.groupBy(*TRACK, "run", "k").agg(F.min("frame").alias("start_frame"), F.coalesce(F.max("nxt"), F.max("frame")).alias("end_frame"), F.count("*").alias("n"))


def thinned(points: DataFrame, most: int = 60_000) -> DataFrame:
    """AGG-20: every n-th sample of each track, n such that all tracks together stay near most."""
    step = max(1, -(-points.count() // most))
    w = Window.partitionBy(*TRACK).orderBy("frame")
    return points.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % step == 0).drop("_n")


def busiest_frame(boxes: DataFrame, fps: float, min_track_s: float = 1.0) -> DataFrame:
    """AGG-21: per clip the frame with most detected tracks that last, nearest to the middle on ties."""
    lasting = boxes.groupBy(*TRACK).agg((F.max("frame") - F.min("frame")).alias("_d")).where(F.col("_d") / fps >= min_track_s).select(*TRACK)
    seen = boxes.where(~F.col("predicted")).join(lasting, TRACK, "left_semi")
    per = seen.groupBy("clip", "frame").agg(F.count_distinct("track_id").alias("n"))
    mid = seen.groupBy("clip").agg(((F.min("frame") + F.max("frame")) / 2).alias("_mid"))
    best = per.join(mid, "clip").groupBy("clip").agg(F.min(F.struct(-F.col("n"), F.abs(F.col("frame") - F.col("_mid")), "frame")).alias("b"))
    return best.select("clip", F.col("b.frame").alias("frame"), (-F.col("b.col1")).alias("n"))


def robust_extent(points: DataFrame, keys: list[str], margin: float = 0.05, enough: int = 2000) -> DataFrame:
    """AGG-22: the box of 0.2 .. 99.8 % of the samples, of all where there are fewer than enough, widened."""
    q = points.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))], *[F.percentile(c, F.array(F.lit(0.002), F.lit(0.998))).alias(f"q_{c}") for c in ("x", "y")])
    out = q
    for c in ("x", "y"):
        lo = F.when(F.col("n") >= enough, F.col(f"q_{c}")[0]).otherwise(F.col(f"min_{c}"))
        hi = F.when(F.col("n") >= enough, F.col(f"q_{c}")[1]).otherwise(F.col(f"max_{c}"))
        out = out.withColumn(f"{c}0", lo - (hi - lo) * margin).withColumn(f"{c}1", hi + (hi - lo) * margin)
    return out.select(*keys, "n", "x0", "y0", "x1", "y1")


def groups_by_size(points: DataFrame) -> DataFrame:
    """AGG-23: groups in order of their number of tracks, the name on ties."""
    g = points.groupBy("grp").agg(F.count_distinct("track_id").alias("tracks"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("tracks"), "grp")))


def straight_tracks(points: DataFrame, min_rows: int = 10, min_chord: float = 25.0, min_ratio: float = 0.97) -> DataFrame:
    """AGG-24: straight tracks with chord, direction of their main axis and scatter about it."""
    s = summary(points.where("grp = 'vehicles'")).where((F.col("n_points") >= min_rows) & (F.col("straight_dist_m") >= min_chord) & (F.col("straightness") >= min_ratio))
    c = points.join(s.select(*TRACK, F.col("straight_dist_m").alias("chord")), TRACK).groupBy(*TRACK, "chord").agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    axis = 0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))
    low = (F.col("a") + F.col("b")) / 2 - F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    return c.select(*TRACK, "chord", F.degrees(axis).alias("axis_deg"), F.sqrt(F.greatest(low, F.lit(0.0))).alias("scatter_m"))


def axis_mean(straight: DataFrame, keys: list[str], enough: int = 5) -> DataFrame:
    """AGG-24: mean direction of axes by doubled angles, median scatter; of at least enough tracks."""
    two = F.radians(2 * F.col("axis_deg"))
    g = straight.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.cos(two)).alias("c"), F.avg(F.sin(two)).alias("s"), F.percentile("scatter_m", 0.5).alias("median_scatter_m"))
    return g.where(F.col("n") >= enough).select(*keys, "n", F.pmod(F.degrees(F.atan2("s", "c")) / 2 + 180.0, F.lit(180.0)).alias("mean_axis_deg"), "median_scatter_m")


def spaced_samples(boxes: DataFrame, k: int = 5, min_span_px: float = 40.0, min_rows: int = 8, most: int = 300) -> DataFrame:
    """AGG-25: k evenly spaced rows of each moving track; of more than most tracks per clip those first by hash."""
    u, v = (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    t = boxes.groupBy(*TRACK).agg(F.count("*").alias("rows"), F.greatest(F.max(u) - F.min(u), F.max(v) - F.min(v)).alias("span")).where((F.col("rows") >= min_rows) & (F.col("span") > min_span_px))
    t = t.withColumn("_o", F.row_number().over(Window.partitionBy("clip").orderBy(F.md5(F.col("track_id").cast("string")), "track_id"))).where(F.col("_o") <= most)
    n = boxes.withColumn("_k", F.row_number().over(Window.partitionBy(*TRACK).orderBy("frame")) - 1)
    wanted = t.select(*TRACK, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("rows") - 1) / (k - 1)).cast("int")))).alias("_k"))
    return n.join(wanted, [*TRACK, "_k"]).select(*TRACK, "frame", u.alias("u"), v.alias("v"))


def normal_fit(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-27: mean and sample deviation of track speeds."""
    return tracks.groupBy(*keys).agg(F.count("mean_speed").alias("n"), F.avg("mean_speed").alias("mean"), F.stddev_samp("mean_speed").alias("sd"))


def implied_heights(boxes: DataFrame, ground: DataFrame, min_box_px: float = 25.0, enough: int = 30) -> DataFrame:
    """AGG-11: heights of people that their boxes imply at their place, by five bands of distance.

    ground: clip, track_id, frame, distance of the foot point, f_px. With a pinhole of focal length f a box
    of h pixels at slant range d stands for h * d / f metres; implied heights of 0.3 .. 5 m count.
    """
    h = F.col("y2") - F.col("y1")
    b = boxes.where((~F.col("predicted")) & (F.col("class") == "person") & (h >= min_box_px)).join(ground, [*TRACK, "frame"])
    b = b.withColumn("height", h * F.col("distance") / F.col("f_px")).where("height between 0.3 and 5")
    edges = F.when(F.col("distance") < 15, 0).when(F.col("distance") < 30, 1).when(F.col("distance") < 60, 2).when(F.col("distance") < 120, 3).otherwise(4)
    return b.groupBy(edges.alias("band")).agg(F.count("*").alias("n"), F.percentile("height", 0.5).alias("median_m"), (F.percentile("height", 0.75) - F.percentile("height", 0.25)).alias("iqr_m")).where(F.col("n") >= enough)


def sample_counts(points: DataFrame) -> DataFrame:
    """AGG-26: samples, tracks and 1 m cells per clip."""
    return points.groupBy("clip").agg(F.count("*").alias("samples"), F.count_distinct("track_id").alias("tracks"), F.count_distinct(F.floor("x"), F.floor("y")).alias("cells"))

