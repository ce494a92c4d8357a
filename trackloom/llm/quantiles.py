"""Percentiles of very large numeric columns, from mergeable sketches.

A sketch is a hierarchy of compactors: each level holds values of one weight; when it is full it is
sorted and every other value, from a random first one, moves a level up with twice the weight
(Karnin, Lang, Liberty 2016). Spark's own KLL aggregate builds them before the shuffle, so a group
with a third of all rows arrives as one sketch per task; merging joins level by level, whatever the
split into partitions, clips or days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nearby import GROUPS, track_labels
from ..operators.slices import rows_that_count
from ..operators.spikes import CLASSES
from ..session import cut_lineage, sized

#: Size of the top compactor. rank_error says 0.0044 of the count for it.
K = 1024
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """Bound of the error of a rank as a share of the count, which 99 of 100 answers keep.

    Fixed values: the published fit for single ranks of this sketch, 2.296 / k ** 0.9021.
    """
    return 2.296 / k**0.9021


def sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch of value per keys: keys, n, sketch. Null and NaN values are left out; null keys form a group."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged(sketched: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser keys from those of finer ones."""
    return sketched.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def answers(sketched: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, k: int = K) -> DataFrame:
    """The sketch column answered: p05, p25 ..., and rank_error (0 while nothing was compacted)."""
    columns = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{round(100 * p):02d}") for p in percentiles]
    return sketched.select("*", *columns, F.when(F.col("n") <= k, 0.0).otherwise(rank_error(k)).alias("rank_error")).drop("sketch")


def labelled_speeds(points: DataFrame) -> DataFrame:
    """clip, group, class, speed of the rows that count; group and class are those that most rows of the track name, else 'unknown'."""
    labels = sized(cut_lineage(track_labels(points)))
    rows = rows_that_count(points, ["clip"], {"speed": F.col("speed")}).join(labels, "track_id")
    group, name = F.lit("unknown"), F.lit("unknown")
    for i, g in enumerate(GROUPS, 1):
        group = F.when(F.col("g") == i, g).otherwise(group)
    for i, c in enumerate(CLASSES, 1):
        name = F.when(F.col("kind") == i, c).otherwise(name)
    return rows.select("clip", group.alias("group"), name.alias("class"), "speed")


def speed_percentiles(points: DataFrame, clips: DataFrame, k: int = K) -> DataFrame:
    """level, clip, day, group, class, n, p05 .. p99, rank_error of speed.

    level is clip, day or all; at each there are rows per group (class null) and per class (group
    null). Group and class are those that most rows of the track name, 'unknown' if none does.
    Day is the date on which the clip started, null for clips that aren't named. All levels come
    from the same sketches per clip. Repeated rows count once; null and NaN speeds are left out,
    impossible ones are kept as recorded. An empty table gives no rows.
    """
    base = sketches(labelled_speeds(points), ["clip", "group", "class"], "speed", k)
    days = clips.where(F.col("clip").isNotNull()).groupBy("clip").agg(F.max(F.to_date("started_at")).alias("day"))
    base = cut_lineage(base.join(sized(days), "clip", "left").select("clip", "day", "group", "class", "n", "sketch"))
    out = None
    for level, keys in (("clip", ["clip", "day"]), ("day", ["day"]), ("all", [])):
        for label in ("group", "class"):
            part = merged(base, [*keys, label], k)
            null = F.lit(None).cast("string")
            part = part.select(
                F.lit(level).alias("level"),
                F.col("clip") if "clip" in keys else null.alias("clip"),
                F.col("day") if "day" in keys else F.lit(None).cast("date").alias("day"),
                F.col("group") if label == "group" else null.alias("group"),
                F.col("class") if label == "class" else null.alias("class"),
                "n",
                "sketch",
            )
            out = part if out is None else out.unionByName(part)
    return answers(out, PERCENTILES, k)


def within_bound(points: DataFrame, clips: DataFrame, times: float = 2.0, k: int = K) -> DataFrame:
    """label, name, percentile, n, within: whether each answer over all rows has a true rank within times the stated error.

    The true ranks are counted over all rows; rows equal to the answer give an interval of ranks.
    """
    rows = labelled_speeds(points).where("speed is not null and not isnan(speed)")
    names = [f"p{round(100 * p):02d}" for p in PERCENTILES]
    found = cut_lineage(speed_percentiles(points, clips, k).where("level = 'all'"))
    out = None
    for label in ("group", "class"):
        # one answer per group or class: a dozen rows
        given = found.where(F.col(label).isNotNull()).select(F.col(label).alias("_name"), "rank_error", *[F.col(c).alias(f"_{c}") for c in names])
        met = rows.join(sized(given), rows[label] == given["_name"])
        counts = [F.sum((F.col("speed") < F.col(f"_{c}")).cast("long")).alias(f"lt_{c}") for c in names] + [F.sum((F.col("speed") <= F.col(f"_{c}")).cast("long")).alias(f"le_{c}") for c in names]
        per = met.groupBy("_name").agg(F.count("*").alias("n"), F.max("rank_error").alias("e"), *counts)
        e = F.col("e") * times + 1.0 / F.col("n")
        each = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), ((F.col(f"lt_{c}") / F.col("n") - e <= p) & (F.col(f"le_{c}") / F.col("n") + e >= p)).alias("within")) for p, c in zip(PERCENTILES, names)])
        part = per.select(F.lit(label).alias("label"), F.col("_name").alias("name"), "n", F.inline(each))
        out = part if out is None else out.unionByName(part)
    return out
