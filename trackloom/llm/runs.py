"""Runs of repeated consecutive events, by backreferences over strings of symbols.

The canonical event of a row is the cell its position lies in, a little wider than twice the step
that still counts as the same place; each cell has a code point of the supplementary planes. Near
positions may lie on both sides of a cell's edge, so there are four strings, of grids that are
shifted by half a cell in x, in y, and in both: two positions within the step of each other share a
cell in at least one of them. The symbols of whole slices are concatenated and a backreference finds
the repetitions in each string. Only pairs of rows inside a match go on to the exact check of
distance and time; rows linked by it are a run, whose span maps back to frames. Slices overlap by
max_gap_s, so each knows whether its first row repeats the last row before it; runs that cross
slices are joined on the pieces that touch a border.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.slices import SLICE_S, cut_slices, map_slices, rows_that_count, starts_of, with_fps
from ..session import cut_lineage

#: The alphabet is the supplementary planes, which hold no surrogates.
FIRST, ALPHABET = 0x10000, 0x100000
REPEAT = re.compile(r"(.)\1+", re.DOTALL)
PIECES = "track_id bigint, start_frame bigint, end_frame bigint, n_rows bigint, fps double, x double, y double, back boolean, ahead boolean"
#: Metres for what doubles can't hold.
HAIR = 1e-6


def symbols(x: np.ndarray, y: np.ndarray, cell: float, shift_x: float, shift_y: float) -> str:
    """The canonical event of every row as one character: its cell of the shifted grid. Cells far apart may share one."""
    i, j = (np.clip(np.floor((v + s) / cell), -1e15, 1e15).astype(np.int64) for v, s in ((x, shift_x), (y, shift_y)))
    with np.errstate(over="ignore"):
        mixed = i * np.int64(0x1E3779B97F4A7C15) + j * np.int64(0x42B2AE3D27D4EB4F)
    return (FIRST + ((mixed >> np.int64(17)) & np.int64(ALPHABET - 1))).astype("<u4").tobytes().decode("utf-32-le")


def repetitions(x: np.ndarray, y: np.ndarray, max_step_m: float) -> np.ndarray:
    """Whether a row stands right after another one in a match of any of the four strings."""
    cell = 2 * (max_step_m + 2 * HAIR)
    bounds = np.zeros(len(x) + 1, np.int64)
    for shift_x in (0.0, cell / 2):
        for shift_y in (0.0, cell / 2):
            spans = [m.span() for m in REPEAT.finditer(symbols(x, y, cell, shift_x, shift_y))]
            if spans:
                first, last = np.array(spans, np.int64).T
                np.add.at(bounds, first + 1, 1)
                np.add.at(bounds, last, -1)
    return np.cumsum(bounds)[:-1] > 0


def slice_runs(rows: dict[str, np.ndarray], max_step_m: float, max_gap_s: float) -> dict[str, np.ndarray]:
    """Runs of two or more own rows of whole slices, and single rows that a border separates from their run."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    ok = np.isfinite(rows["x"]) & np.isfinite(rows["y"])
    if not ok.any():
        return {n: np.array([], object) for n in names}
    track, piece, frame, fps, x, y, own = (rows[k][ok] for k in ("track_id", "slice", "frame", "fps", "x", "y", "own"))
    own = own.astype(bool)
    # the exact check, of what the strings found alone
    linked = repetitions(x, y, max_step_m) & ~starts_of(track, piece)
    at = np.flatnonzero(linked)
    linked[at] = (np.hypot(x[at] - x[at - 1], y[at] - y[at - 1]) <= max_step_m + HAIR) & (frame[at] - frame[at - 1] <= max_gap_s * fps[at] + 1e-9)
    # halo rows stand apart: their own slices report them
    border = np.zeros(len(track), bool)
    border[1:] = own[1:] != own[:-1]
    start = np.flatnonzero(~linked | border)
    end = np.append(start[1:], len(track)) - 1
    back = linked[start] & border[start]
    ahead = np.append(back[1:], False)
    mine = own[start] & ((end > start) | back | ahead)
    start, end, back, ahead = start[mine], end[mine], back[mine], ahead[mine]
    return {"track_id": track[start], "start_frame": frame[start], "end_frame": frame[end], "n_rows": end - start + 1, "fps": fps[start], "x": x[start], "y": y[start], "back": back, "ahead": ahead}


def collapse_runs(points: DataFrame, clips: DataFrame, max_step_m: float = 0.03, max_gap_s: float = 2.0, slice_s: float = SLICE_S) -> DataFrame:
    """track_id, start_frame, end_frame, n_rows, duration_s, x, y: the longest possible runs of two or more rows.

    Rows with null or NaN x or y are left out before runs are looked for; repeated rows count once,
    with the values that arrived first; rows without track_id or frame, or of unknown rate, are left
    out. x, y are the run's first position. An empty table gives no rows; columns of other names are
    ignored.
    """
    rows = rows_that_count(with_fps(points, clips), ["fps"], {"x": F.col("x"), "y": F.col("y")})
    # written once, as both halves below read them; runs are few beside rows
    pieces = cut_lineage(map_slices(cut_slices(rows, max_gap_s + 1e-6, slice_s), lambda r: slice_runs(r, max_step_m, max_gap_s), PIECES))
    w = Window.partitionBy("track_id").orderBy("start_frame")
    joined = pieces.where("back or ahead").withColumn("_run", F.sum(F.when(F.col("back"), 0).otherwise(1)).over(w))
    joined = joined.groupBy("track_id", "_run").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("n_rows").alias("n_rows"), F.max("fps").alias("fps"), F.min_by("x", "start_frame").alias("x"), F.min_by("y", "start_frame").alias("y")
    )
    both = pieces.where("not back and not ahead").drop("back", "ahead").unionByName(joined.drop("_run"))
    return both.where("n_rows >= 2").select("track_id", "start_frame", "end_frame", "n_rows", ((F.col("end_frame") - F.col("start_frame")) / F.col("fps")).alias("duration_s"), "x", "y")
