"""Accuracy of measured walks against surveyed ones: every track of a table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segment_distance
from ..session import sized

TRACK = ["clip", "track_id"]
#: Largest errors for a pass: metres aside, per cent of length and speed, metres at the ends.
LATERAL_M, LENGTH_PCT, SPEED_PCT, ENDS_M = 0.30, 3.0, 5.0, 0.5


def longest_runs(points: DataFrame, moving: float = 0.4) -> DataFrame:
    """GT-01: per track the longest run of rows faster than moving, the first on ties: first and last frame, rows."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    fast = F.coalesce(F.col("speed") > moving, F.lit(False))
    p = points.withColumn("_f", fast).withColumn("_r", F.sum((~F.col("_f")).cast("long")).over(w)).where("_f")
    runs = p.groupBy(*TRACK, "_r").agg(F.count("*").alias("rows"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return runs.groupBy(*TRACK).agg(F.min(F.struct(-F.col("rows"), "first_frame", "last_frame")).alias("b")).select(*TRACK, F.col("b.first_frame").alias("first_frame"), F.col("b.last_frame").alias("last_frame"), (-F.col("b.col1")).alias("rows"))


def first_crossing(points: DataFrame, value: str, level: float) -> DataFrame:
    """GT-02: per track the time at which value first is at or above level, between rows; a track that begins there gives its first time."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    p = points.where(F.col(value).isNotNull()).withColumn("_b", F.lag(value).over(w)).withColumn("_t", F.lag("t").over(w)).where(F.col(value) >= level)
    at = F.col("_t") + (level - F.col("_b")) / F.greatest(F.col(value) - F.col("_b"), F.lit(1e-12)) * (F.col("t") - F.col("_t"))
    return p.groupBy(*TRACK).agg(F.min_by(F.coalesce(at, F.col("t")), "frame").alias("time_s"))


def walks(points: DataFrame) -> DataFrame:
    """GT-03: per track: standing places (means of at least three rows, else the walk's ends), length between
    them, walking time, mean speed, and scatter about the walk's main axis."""
    r = longest_runs(points).select(*TRACK, "first_frame", "last_frame")
    p = points.join(r, TRACK)
    part = F.when(F.col("frame") < F.col("first_frame"), "a").when(F.col("frame") > F.col("last_frame"), "b").otherwise("w")
    p = p.withColumn("_p", part)
    inside = F.col("_p") == "w"
    agg = [F.count("*").alias("n_samples"), F.avg(F.col("pred").cast("double")).alias("predicted_share"), F.avg(F.when(inside, F.col("speed"))).alias("mean_walking_speed"), (F.max(F.when(inside, F.col("t"))) - F.min(F.when(inside, F.col("t")))).alias("walking_time_s")]
    for s, end in (("a", F.min_by), ("b", F.max_by)):
        here = F.col("_p") == s
        for c in ("x", "y"):
            agg.append(F.when(F.count(F.when(here, 1)) >= 3, F.avg(F.when(here, F.col(c)))).otherwise(end(F.col(c), F.when(inside, F.col("frame")))).alias(f"{c}_{s}"))
    x, y = F.when(inside, F.col("x")), F.when(inside, F.col("y"))
    agg += [F.var_pop(x).alias("_a"), F.var_pop(y).alias("_b"), F.covar_pop(x, y).alias("_c")]
    g = p.groupBy(*TRACK).agg(*agg)
    low = (F.col("_a") + F.col("_b")) / 2 - F.sqrt(((F.col("_a") - F.col("_b")) / 2) ** 2 + F.col("_c") ** 2)
    length = F.sqrt((F.col("x_b") - F.col("x_a")) ** 2 + (F.col("y_b") - F.col("y_a")) ** 2)
    return g.withColumn("length_m", length).withColumn("lateral_rms_m", F.sqrt(F.greatest(low, F.lit(0.0)))).drop("_a", "_b", "_c")


def against(walked: DataFrame, known: DataFrame) -> DataFrame:
    """GT-03: errors of length and speed against known (clip, track_id, length_m, time_s)."""
    k = known.select(*TRACK, F.col("length_m").alias("_l"), F.col("time_s").alias("_t"))
    w = walked.join(k, TRACK)
    ref = F.col("_l") / F.col("_t")
    return w.withColumn("length_error_pct", 100 * (F.col("length_m") - F.col("_l")) / F.col("_l")).withColumn("reference_speed", ref).withColumn("speed_error_pct", 100 * (F.col("mean_walking_speed") - ref) / ref).drop("_l", "_t")


def surveyed(points: DataFrame, known: DataFrame) -> DataFrame:
    """GT-03 with a surveyed line: known (clip, track_id, ax, ay, bx, by, length_m, stopwatch_s; the last two may be null).

    Per track: start_error_m and end_error_m of the standing places; of the walk's rows the signed mean,
    root mean square, largest and own scatter of the distance from the line; length_error_pct against
    length_m, else the line's length; and the measured speed against a reference speed. That is the
    length by the stopwatch, else 80 % of it by the time between 10 and 90 % of the way from one
    standing place to the other, which the smoothed start and stop don't touch, else the length by the
    walking time. Tracks that never move are left out.
    """
    w = walks(points).select(*TRACK, "x_a", "y_a", "x_b", "y_b", "walking_time_s", F.col("length_m").alias("measured_m"))
    k = known.select(*TRACK, "ax", "ay", "bx", "by", "length_m", "stopwatch_s")
    line = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    facts = w.join(k, TRACK).join(longest_runs(points).drop("rows"), TRACK).withColumn("_line", line).withColumn("known_m", F.coalesce("length_m", "_line")).drop("length_m")
    p = points.select(*TRACK, "frame", "t", "x", "y", "speed").join(facts, TRACK)
    way = ((F.col("x") - F.col("x_a")) * (F.col("x_b") - F.col("x_a")) + (F.col("y") - F.col("y_a")) * (F.col("y_b") - F.col("y_a"))) / F.greatest(F.col("measured_m") ** 2, F.lit(1e-9))
    p = p.withColumn("_u", way)
    w_ = Window.partitionBy(*TRACK).orderBy("frame")
    before, earlier = F.lag("_u").over(w_), F.lag("t").over(w_)
    p = p.withColumn("_ub", before).withColumn("_tb", earlier)
    walking = F.col("frame").between(F.col("first_frame"), F.col("last_frame"))
    whole = Window.partitionBy(*TRACK)
    for name, level in (("_t10", 0.1), ("_t90", 0.9)):
        at = F.coalesce(F.col("_tb") + (level - F.col("_ub")) / F.greatest(F.col("_u") - F.col("_ub"), F.lit(1e-12)) * (F.col("t") - F.col("_tb")), F.col("t"))
        p = p.withColumn(name, F.min_by(F.when(F.col("_u") >= level, at), F.when(F.col("_u") >= level, F.col("frame"))).over(whole))
    middle = F.col("stopwatch_s").isNull() & F.coalesce(F.col("_t90") > F.col("_t10"), F.lit(False))
    counted = F.when(middle, F.col("t").between(F.col("_t10"), F.col("_t90"))).otherwise(walking)
    aside = ((F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) - (F.col("x") - F.col("ax")) * (F.col("by") - F.col("ay"))) / F.col("_line")
    aside = F.when(walking, aside)
    g = p.groupBy(*TRACK, *[c for c in facts.columns if c not in TRACK]).agg(
        F.avg(aside).alias("lateral_mean_m"), F.sqrt(F.avg(aside * aside)).alias("lateral_rms_m"), F.max(F.abs(aside)).alias("lateral_max_m"), F.stddev_pop(aside).alias("lateral_own_rms_m"),
        F.avg(F.when(counted, F.col("speed"))).alias("measured_speed"), F.max(F.when(middle, F.col("_t90") - F.col("_t10"))).alias("_middle_s"),
    )
    reference = F.when(F.col("stopwatch_s").isNotNull(), F.col("known_m") / F.col("stopwatch_s")).when(F.col("_middle_s").isNotNull(), 0.8 * F.col("known_m") / F.col("_middle_s")).otherwise(F.col("known_m") / F.col("walking_time_s"))
    far = lambda s, e: F.sqrt((F.col(f"x_{s}") - F.col(f"{e}x")) ** 2 + (F.col(f"y_{s}") - F.col(f"{e}y")) ** 2)
    g = g.withColumn("reference_speed", reference)
    return g.select(
        *TRACK, far("a", "a").alias("start_error_m"), far("b", "b").alias("end_error_m"), "lateral_mean_m", "lateral_rms_m", "lateral_max_m", "lateral_own_rms_m", F.col("measured_m").alias("length_m"),
        (100 * (F.col("measured_m") - F.col("known_m")) / F.col("known_m")).alias("length_error_pct"), "reference_speed", "measured_speed",
        (100 * (F.col("measured_speed") - F.col("reference_speed")) / F.col("reference_speed")).alias("speed_error_pct"),
    )


def verdicts(errors: DataFrame) -> DataFrame:
    """GT-04: pass if the errors of lateral, length, speed and, where known, both ends lie below their limits; else what doesn't."""
    faults = [F.when(F.col("lateral_rms_m") >= LATERAL_M, "lateral"), F.when(F.abs("length_error_pct") >= LENGTH_PCT, "length"), F.when(F.abs("speed_error_pct") >= SPEED_PCT, "speed")]
    faults += [F.when(F.col(f"{end}_error_m") >= ENDS_M, end) for end in ("start", "end") if f"{end}_error_m" in errors.columns]
    faults = F.array_compact(F.array(*faults))
    return errors.withColumn("verdict", F.when(F.size(faults) == 0, "pass").otherwise(F.array_join(faults, "+")))


def picked(points: DataFrame, ends: DataFrame) -> DataFrame:
    """GT-05: per clip the person track that follows its line (clip, ax, ay, bx, by) best in the median and
    covers more than half of it; where none does, the longest one."""
    p = points.where("cls = 'person'")
    j = p.join(sized(ends), "clip")
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    along = ((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))) / length
    j = j.withColumn("_u", along / length).withColumn("_d", segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")]))
    g = j.groupBy(*TRACK).agg((F.max("_u") - F.min("_u")).alias("cover"), F.percentile("_d", 0.5).alias("off"))
    w = Window.partitionBy(*TRACK).orderBy("frame")
    path = p.withColumn("_s", F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)).groupBy(*TRACK).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("path"))
    c = path.join(g, TRACK, "left").withColumn("follows", F.coalesce(F.col("cover") > 0.5, F.lit(False)))
    best = F.min(F.struct(~F.col("follows"), F.when(F.col("follows"), F.col("off")).otherwise(-F.col("path")), "track_id"))
    return c.groupBy("clip").agg(best.alias("b")).select("clip", "b.track_id")
