"""Trips and stops from location pings, by hidden semi-Markov decoding.

Each bounded slice of a track is cut where rows are missing for longer than max_gap_s, reduced to
medians over short bins (which outlast scattered readings that can't be true), and decoded into
segments of two states with explicit duration distributions:

* stop: bins scatter about one unknown centre (its likelihood comes from running sums, so each
  candidate segment costs O(1)), duration shifted exponential from a minimum;
* travel: bins are spread over what a mover covers, duration gamma of shape 2.

Mean durations and scatter are fitted to each sequence by hard expectation maximisation: it is decoded
with the prior means, they are estimated anew from its own segments (the prior counts as a few segments),
and it is decoded again. All sequences of a chunk are decoded together, one array step per bin. A decoded
stop is then laid on the rows: the centre is the median of its rows, the ends are the outermost rows
that still lie within the radius, up to the stops beside it, and it holds if it lasts min_stop_s. Pieces
that meet at a slice border are joined by a window over the pieces that touch one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .slices import cut_slices, map_slices, rows_that_count, starts_of, with_fps

BIN_S = 2.0
HALO_S = 90.0
#: Prior means: seconds of a stop beyond the least one and of travel, scatter of a bin in a stop in metres; and for how
#: many segments, or bins of a stop, of a sequence they count.
STOP_S, TRAVEL_S, SCATTER_M, PRIOR_SEGMENTS, PRIOR_BINS = 60.0, 40.0, 0.55, 4.0, 60.0
#: Scatter stays within these metres: beyond them a stop of the radius asked for can't be told from travel.
SCATTER_RANGE = (0.3, 0.8)

PIECES = "track_id bigint, kind string, start_s double, end_s double, cx double, cy double, distance_m double, n_rows bigint, back boolean, ahead boolean"


def _medians(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Median of values for each of n groups; group is ascending and without holes."""
    order = np.lexsort((values, group))
    v = values[order]
    first = np.searchsorted(group, np.arange(n))
    count = np.diff(np.append(first, len(group)))
    lo, hi = first + (count - 1) // 2, first + count // 2
    return (v[lo] + v[hi]) / 2


def _despike(x: np.ndarray, y: np.ndarray, seq: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Single bins farther than reach from both neighbours, which agree, take the neighbours' mean."""
    x, y = x.copy(), y.copy()
    if len(x) < 3:
        return x, y
    a, b, c = slice(None, -2), slice(1, -1), slice(2, None)
    ab, bc, ac = (np.hypot(x[p] - x[q], y[p] - y[q]) for p, q in ((a, b), (b, c), (a, c)))
    odd = (seq[a] == seq[c]) & (np.minimum(ab, bc) > reach) & (ac < np.minimum(ab, bc) / 2)
    at = np.flatnonzero(odd) + 1
    x[at], y[at] = (x[at - 1] + x[at + 1]) / 2, (y[at - 1] + y[at + 1]) / 2
    return x, y


def decode(x: np.ndarray, y: np.ndarray, t: np.ndarray, lengths: np.ndarray, means: np.ndarray | None = None, bin_s: float = BIN_S, min_s: float = 16.0, spread_m: float = 3.0) -> np.ndarray:
    """The most likely state of each bin: 0 for travel, else 1 + the bin at which its stop begins.

    x, y, t hold the bins of all sequences, one after another; lengths how many each has. means has a
    row for each sequence: seconds of a stop beyond min_s, seconds of travel, scatter of a bin in a stop.
    spread_m is the radius over which travel spreads a bin.
    """
    out = np.zeros(len(x), np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    if means is None:
        means = np.tile([STOP_S, TRAVEL_S, SCATTER_M], (len(lengths), 1))
    travel = -np.log(np.pi * spread_m**2)
    for group in np.array_split(np.argsort(lengths, kind="stable"), max(1, len(lengths) // 128)):
        if not len(group):
            continue
        n, m = len(group), int(lengths[group].max())
        at = np.minimum(np.arange(m), (lengths[group] - 1)[:, None]) + first[group][:, None]
        px, py, pt = x[at], y[at], t[at]
        px, py = px - px[:, :1], py - py[:, :1]
        zero = np.zeros((n, 1))
        sx, sy, sq = (np.concatenate((zero, np.cumsum(v, 1)), 1) for v in (px, py, px * px + py * py))
        # best[k]: score of the first k bins when they end in that state; from_: where the last segment begins
        best_s, best_t = np.full((n, m + 1), -1e18), np.full((n, m + 1), -1e18)
        from_s, from_t = np.zeros((n, m + 1), np.int32), np.zeros((n, m + 1), np.int32)
        best_s[:, 0] = best_t[:, 0] = -np.log(2)
        rows = np.arange(n)
        stop_s, travel_s, sigma = (means[group, k : k + 1] for k in range(3))
        rate_s, rate_t, twice = 1 / stop_s, 2 / travel_s, 1 / (2 * sigma**2)
        unit, new_s, new_t = -np.log(2 * np.pi * sigma**2), -np.log(stop_s), 2 * np.log(rate_t)
        for e in range(1, m + 1):
            count = e - np.arange(e)
            d = pt[:, e - 1 : e] - pt[:, :e] + bin_s
            dx, dy = sx[:, e : e + 1] - sx[:, :e], sy[:, e : e + 1] - sy[:, :e]
            scatter = sq[:, e : e + 1] - sq[:, :e] - (dx * dx + dy * dy) / count
            stop = best_t[:, :e] + count * unit - scatter * twice + new_s - (d - min_s) * rate_s
            stop[d < min_s] = -1e18
            go = best_s[:, :e] + count * travel + new_t + np.log(d) - d * rate_t
            i, j = stop.argmax(1), go.argmax(1)
            best_s[:, e], from_s[:, e] = stop[rows, i], i
            best_t[:, e], from_t[:, e] = go[rows, j], j
        # all sequences of the group go back together, a segment at a step
        e = lengths[group].astype(np.int64)
        still = best_s[rows, e] > best_t[rows, e]
        while (e > 0).any():
            b = np.where(still, from_s[rows, e], from_t[rows, e])
            b = np.where(e > 0, b, 0)
            for r in np.flatnonzero(still & (e > 0)):
                out[first[group[r]] + b[r] : first[group[r]] + e[r]] = 1 + first[group[r]] + b[r]
            e, still = b, ~still
    return out


def fitted_means(x: np.ndarray, y: np.ndarray, t: np.ndarray, seq: np.ndarray, state: np.ndarray, n: int, bin_s: float = BIN_S, min_s: float = 16.0) -> np.ndarray:
    """The means of n sequences as their decoded segments show them, shrunk towards the prior; one row each, as in decode."""
    new = starts_of(seq, state)
    segment = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(t)) - 1
    lasts, of, still = t[tail] - t[head] + bin_s, seq[head], state[head] > 0
    size = np.bincount(segment)
    mx, my = np.bincount(segment, x) / size, np.bincount(segment, y) / size
    square = np.bincount(segment, (x - mx[segment]) ** 2 + (y - my[segment]) ** 2) / 2
    out = np.empty((n, 3))
    for k, (here, prior, value) in enumerate(((still, STOP_S, np.maximum(lasts - min_s, 0.0)), (~still, TRAVEL_S, lasts))):
        out[:, k] = (PRIOR_SEGMENTS * prior + np.bincount(of[here], value[here], n)) / (PRIOR_SEGMENTS + np.bincount(of[here], minlength=n))
    variance = (PRIOR_BINS * SCATTER_M**2 + np.bincount(of[still], square[still], n)) / (PRIOR_BINS + np.bincount(of[still], size[still], n))
    out[:, 2] = np.clip(np.sqrt(variance), *SCATTER_RANGE)
    return out


def slice_pieces(rows: dict[str, np.ndarray], radius_m: float, min_stop_s: float, max_gap_s: float) -> dict[str, np.ndarray]:
    """Stops and trips of whole slices; a piece that a border cuts ends at the border."""
    ok = np.isfinite(rows["x"]) & np.isfinite(rows["y"])
    track, piece, own = rows["track_id"][ok], rows["slice"][ok], rows["own"][ok].astype(bool)
    t = rows["frame"][ok] / rows["fps"][ok]
    x, y = rows["x"][ok], rows["y"][ok]
    names = [f.split()[0] for f in PIECES.split(", ")]
    empty = {n: np.array([], object) for n in names}
    if not len(t):
        return empty
    late = np.zeros(len(t), bool)
    late[1:] = np.diff(t) > max_gap_s
    new = starts_of(track, piece) | late
    seq = np.cumsum(new) - 1
    origin = np.flatnonzero(new)
    x0, y0 = _medians(x, seq, len(origin)), _medians(y, seq, len(origin))
    lx, ly = x - x0[seq], y - y0[seq]
    # bins of each sequence
    tick = np.floor((t - t[origin][seq]) / BIN_S).astype(np.int64)
    binned = starts_of(seq, tick)
    of = np.cumsum(binned) - 1
    nb = of[-1] + 1
    bx, by = _medians(lx, of, nb), _medians(ly, of, nb)
    bseq = seq[binned]
    bt = t[origin][bseq] + tick[binned] * BIN_S
    bx, by = _despike(np.clip(bx, -1e5, 1e5), np.clip(by, -1e5, 1e5), bseq, 2 * radius_m)
    lengths = np.bincount(bseq, minlength=len(origin))
    state = decode(bx, by, bt, lengths)
    state = decode(bx, by, bt, lengths, fitted_means(bx, by, bt, bseq, state, len(origin)))[of]

    # stops laid on the rows
    found: list[tuple[int, int, float, float]] = []
    kind = np.zeros(len(t), np.int64)
    starts = np.flatnonzero(starts_of(state, seq) & (state > 0))
    last = np.append(origin[1:], len(t))
    ends = np.flatnonzero(np.append(starts_of(state, seq)[1:], True)) + 1
    ends = ends[np.searchsorted(ends, starts, "right")]
    # how far a stop may grow: the next stop of its sequence, or the sequence's end
    follows = np.append(starts[1:], len(t)) if len(starts) else starts
    follows = np.minimum(follows, last[seq[starts]])
    for s, e, hi in zip(starts.tolist(), ends.tolist(), follows.tolist()):
        lo = int(origin[seq[s]])
        # the spot: medians of the bins of the segment, so that dense rows don't outweigh
        cx, cy = np.median(lx[s:e]), np.median(ly[s:e])
        if found and found[-1][1] > lo:
            p = found[-1]
            if np.hypot(cx - p[2], cy - p[3]) <= radius_m and t[s] - t[p[1] - 1] <= max_gap_s:
                s = p[0]
                cx, cy = np.median(lx[s:e]), np.median(ly[s:e])
                found.pop()
            else:
                # rows that the stop before took in stay with it
                lo = p[1]
                s = max(s, lo)
                if s >= e:
                    continue
        near = np.hypot(lx[lo:hi] - cx, ly[lo:hi] - cy) <= radius_m
        # outermost rows: out from the segment while rows, but for single ones, stay near
        far = np.flatnonzero(~near[1:] & ~near[:-1])
        i, j = s - lo, e - lo - 1
        k = int(np.searchsorted(far, i - 1, "left"))
        a = int(far[k - 1]) + 2 if k else 0
        k = int(np.searchsorted(far, j + 1, "left"))
        b = int(far[k]) - 1 if k < len(far) else len(near) - 1
        inside = np.flatnonzero(near[a : b + 1])
        if not len(inside):
            continue
        s, e = lo + a + int(inside[0]), lo + a + int(inside[-1]) + 1
        if t[e - 1] - t[s] >= min_stop_s - 1e-6:
            found.append((s, e, cx, cy))
    for n, (s, e, _, _) in enumerate(found):
        kind[s:e] = n + 1

    step = np.zeros(len(t))
    if len(t) > 1:
        # path over rows that can be true: a row far from both neighbours is passed over
        sx, sy = _despike(lx, ly, seq, 5 * radius_m)
        step[1:] = np.where(new[1:], 0, np.hypot(np.diff(sx), np.diff(sy)))
    # pieces of own rows
    part = starts_of(kind, seq, own)
    number = np.cumsum(part) - 1
    head = np.flatnonzero(part)
    tail = np.append(head[1:], len(t)) - 1
    mine = own[head]
    which = kind[head]
    still = which > 0
    centre = np.array([(0.0, 0.0), *[(cx, cy) for _, _, cx, cy in found]])[which]
    out = {
        "track_id": track[head],
        "kind": np.where(still, "stop", "trip").astype(object),
        "start_s": t[head],
        "end_s": t[tail],
        "cx": np.where(still, centre[:, 0] + x0[seq[head]], x[head]),
        "cy": np.where(still, centre[:, 1] + y0[seq[head]], y[head]),
        "distance_m": np.where(still, 0.0, np.bincount(number, step)),
        "n_rows": tail - head + 1,
        # goes on in a neighbouring slice: the row beside it is a halo row of the same sequence
        "back": np.append(False, ~own[head[1:] - 1] & (seq[head[1:] - 1] == seq[head[1:]])),
        "ahead": np.append(~own[tail[:-1] + 1] & (seq[tail[:-1] + 1] == seq[tail[:-1]]), False),
    }
    return {k: v[mine] for k, v in out.items()}


def stops_and_trips(points: DataFrame, clips: DataFrame, radius_m: float = 2.0, min_stop_s: float = 20.0, max_gap_s: float = 30.0) -> DataFrame:
    """track_id, kind (stop or trip), start_s, end_s, duration_s, distance_m, cx, cy, n_rows.

    A stop is at least min_stop_s within radius_m of one spot (cx, cy); rows missing for up to
    max_gap_s don't end it if the spot is the same afterwards. A trip is what lies between, cut at
    longer absences; its distance is the path over its rows. Null and NaN positions are left out;
    a track without positions gives no row; an empty table gives none. Repeated rows count once,
    with the values that arrived first. Columns of other names are ignored.
    """
    rows = rows_that_count(with_fps(points, clips), ["fps"], {"x": F.col("x"), "y": F.col("y")})
    cut = cut_slices(rows, HALO_S)
    # written once, as both halves below read them; pieces are few beside rows
    pieces = cut_lineage(map_slices(cut, lambda r: slice_pieces(r, radius_m, min_stop_s, max_gap_s), PIECES))
    w = Window.partitionBy("track_id").orderBy("start_s", "end_s")
    last = F.lag(F.struct("kind", "end_s", "cx", "cy")).over(w)
    same = F.col("back") & (F.col("kind") == last["kind"]) & (F.col("start_s") - last["end_s"] <= max_gap_s)
    spot = F.sqrt(F.pow(F.col("cx") - last["cx"], 2) + F.pow(F.col("cy") - last["cy"], 2)) <= radius_m
    goes_on = same & ((F.col("kind") == "trip") | spot)
    run = pieces.where("back or ahead").withColumn("_new", F.when(goes_on, 0).otherwise(1))
    run = run.withColumn("_run", F.sum("_new").over(w))
    joined = run.groupBy("track_id", "_run", "kind").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by("cx", "start_s").alias("cx"), F.min_by("cy", "start_s").alias("cy"),
        F.sum("distance_m").alias("distance_m"), F.sum("n_rows").alias("n_rows"),
    )
    whole = pieces.where("not back and not ahead").drop("back", "ahead").unionByName(joined.drop("_run"))
    return whole.select("track_id", "kind", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "distance_m", "cx", "cy", "n_rows").where((F.col("kind") == "trip") | (F.col("duration_s") >= min_stop_s - 1e-6))
