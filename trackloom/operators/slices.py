"""Rows that count, and time slices of tracks: the common ground of the track operators.

A track may be endless or hold a third of all rows, so no operator gathers a track. Rows are cut
into (track, slice) groups of a fixed span of time plus a halo of rows copied from the slices beside
it; every group is bounded by the span, and what crosses a border is joined up afterwards on the
few pieces that touch it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized

#: Seconds of a slice. A slice of a 30 fps track has at most 54,000 rows.
SLICE_S = 1800.0
#: Rows that a kernel gets at once, in whole groups.
CHUNK_ROWS = 60_000


def clip_rates(clips: DataFrame) -> DataFrame:
    """(clip, fps) with one row per clip; clips without a positive fps are left out."""
    return clips.where(F.col("clip").isNotNull() & (F.col("fps") > 0)).groupBy("clip").agg(F.max("fps").cast("double").alias("fps"))


def with_fps(points: DataFrame, clips: DataFrame) -> DataFrame:
    """points with fps of their clip; where clips doesn't name it, what frame / time_s says, else null."""
    own = F.round(F.col("frame") / F.when(F.col("time_s") > 0, F.col("time_s")))
    rates = sized(clip_rates(clips)).withColumnRenamed("fps", "_rate")
    return points.join(rates, "clip", "left").withColumn("fps", F.coalesce("_rate", own)).drop("_rate")


def rows_that_count(points: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per (track_id, frame): the values of the row with the earliest arrived_at.

    keys are further columns that depend on the track alone (clip, site, fps). A null arrived_at
    counts as the latest. Rows without track_id or frame have no place and are left out.
    values must be numbers or dates: the aggregate then runs in fixed-width hash buffers, copies
    are combined before the shuffle, and the shuffle key spreads any single track.
    """
    # NaN stays a value; a null one is kept as null by min_by.
    came = F.coalesce(F.col("arrived_at").cast("timestamp"), F.lit("9999-01-01").cast("timestamp"))
    names = list(values)
    kept = points.where(F.col("track_id").isNotNull() & F.col("frame").isNotNull())
    kept = kept.select("track_id", "frame", *keys, came.alias("_came"), *[c.alias(n) for n, c in values.items()])
    return kept.groupBy("track_id", "frame", *keys).agg(*[F.min_by(n, "_came").alias(n) for n in names])


def cut_slices(df: DataFrame, halo_s: float, slice_s: float = SLICE_S) -> DataFrame:
    """df with slice and own: each row once in its own slice, and as a copy (own = false) in the
    slices within halo_s of it. Rows without fps are left out."""
    t = F.col("frame") / F.col("fps")
    own = F.floor(t / slice_s)
    into = t - own * slice_s
    before = F.when(into <= halo_s, own - 1)
    after = F.when(slice_s - into <= halo_s, own + 1)
    near = F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct(before.alias("slice"), F.lit(False).alias("own")), F.struct(after.alias("slice"), F.lit(False).alias("own")))
    return df.where(F.col("fps") > 0).select("*", F.inline(F.filter(near, lambda s: s["slice"].isNotNull())))


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups (rows that follow each other with the same keys) of about rows rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            v = table[k].combine_chunks()
            v = v.to_numpy(zero_copy_only=False) if not pa.types.is_string(v.type) else v.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if len(at):
            last = int(at[-1]) + 1
            yield table.slice(0, last).combine_chunks()
            rest = table.slice(last).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
        else:
            held = table.combine_chunks().to_batches()
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """True where a group of equal keys begins."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def map_slices(df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, keys: tuple[str, ...] = ("track_id", "slice"), order: tuple[str, ...] = ("frame",), rows: int = CHUNK_ROWS) -> DataFrame:
    """kernel applied to whole groups of keys, many at a time, each in the given order.

    One shuffle on the keys, one sort within partitions, Arrow in and out. The kernel gets columns
    as arrays (nulls of numbers as NaN) and gives columns of the schema.
    """
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    names = out.fieldNames()
    kinds = {f.name: {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in out}
    target = pa.schema([(n, kinds[n]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, list(keys), rows):
            got = kernel({n: table[n].to_numpy() for n in table.column_names})
            if len(got[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=kinds[n]) for n in names], schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def map_columns(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table], dict[str, np.ndarray]], doubles: list[str], keep: str | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """df with the columns doubles as kernel gives them for whole groups of keys, many at a time, each in the given order.

    All other columns go through as they are, nulls and all. keep names a boolean column, of df or of
    what kernel gives, by which rows are kept; it is dropped.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [c for c in df.columns if c != keep] + [c for c in doubles if c not in df.columns]
    kinds = {f.name: f for f in df.schema}
    out = StructType([StructField(n, DoubleType()) if n in doubles else kinds[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, keys, rows):
            for n, v in kernel(table).items():
                v = pa.array(v)
                at = table.schema.get_field_index(n)
                table = table.append_column(n, v) if at < 0 else table.set_column(at, n, v)
            if keep:
                table = table.filter(table[keep])
            yield from table.select(names).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a group of equal keys begins."""
    out = np.ones(table.num_rows, bool)
    out[1:] = False
    for k in keys:
        v = table[k].combine_chunks()
        v = v.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
    return out
