"""Readings that can't be true: spikes, stuck values and impossible ranges, per track.

The normal behaviour of a source (a track) is what its profiles of a day share. A profile is PROFILE
rows that follow each other without an absence: positions, centred on their median, or departures of
the speed from what the positions imply. The matrix of a day's profiles is never gathered: each time
slice adds the products of its profiles (12 x 12, profiles with about unit length, so that one spiky
profile can't turn the subspace) to those of the day, and the leading directions of their sum are the
low-rank part. What all tracks of the same class do counts as PRIOR profiles more, which steadies
short tracks. With the day's directions, each slice splits its profiles into the low-rank part and
sparse spikes by alternating projection and thresholding at a level that falls to the floor. Only
readings that stand out in the sparse part are candidates; an exact check against the sound rows on
both sides follows for them. Constant runs and ranges are tested separately, on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, sized
from .slices import SLICE_S, cut_slices, map_slices, rows_that_count, starts_of, with_fps

#: Rows of a profile, by how many the next one begins later, directions of the low-rank part, profiles for which the class counts.
PROFILE, STEP, RANK, PRIOR = 12, 3, 2, 100.0
HALO_S, DAY_S = 60.0, 86_400.0
#: Bounds of the national grid of EPSG:27700 in metres, and of speeds in m/s.
MAP_X, MAP_Y, SPEED_MAX = (0.0, 700_000.0), (0.0, 1_300_000.0), 200.0
#: Beyond so many metres from the origin of its site, a position is off the site's map.
OFF_SITE_M = 10_000.0
#: The frame of the row that brings a slice the directions of its day; it sorts before all others.
BASIS_ROW = -(1 << 62)

FLAGS = "track_id bigint, frame bigint, position boolean, speed boolean, stuck boolean, range boolean"
GRAMS = "track_id bigint, slice bigint, day bigint, kind int, gram binary"
#: What a kernel gives: flagged rows (signal -1), and the first and last constant run of every slice and signal.
FOUND = FLAGS + ", signal int, slice bigint, first boolean, last boolean, n bigint, value double, other_first double, other_last double, frames binary"
#: Codes of the classes of group_params.
CLASSES = ["person", "bicycle", "car", "truck", "bus", "motorcycle", "train"]
FAST = {3, 4, 5, 6, 7}
UPPER = np.triu_indices(PROFILE)
CELLS = len(UPPER[0])


def class_code(name: str | Column = "class") -> Column:
    """1.. for the known classes, whatever their case and blanks; 0 for others and null."""
    c = F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
    out = F.lit(0)
    for k, v in enumerate(CLASSES, 1):
        out = F.when(c == v, k).otherwise(out)
    return out.cast("int")


def _whole(upper: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper triangles."""
    out = np.zeros((*upper.shape[:-1], PROFILE, PROFILE))
    out[..., UPPER[0], UPPER[1]] = upper
    out[..., UPPER[1], UPPER[0]] = upper
    return out


def _leading(gram: np.ndarray) -> np.ndarray:
    """The RANK leading directions of each symmetric matrix, as columns."""
    return np.linalg.eigh(gram)[1][..., -RANK:]


def _unsteady(gram: np.ndarray) -> np.ndarray:
    """gram without the constant direction: a steady departure of the speed is never normal."""
    centre = np.eye(PROFILE) - 1.0 / PROFILE
    return centre @ gram @ centre


def sparse_part(m: np.ndarray, seen: np.ndarray, basis: np.ndarray, floor: np.ndarray, rounds: int = 5) -> np.ndarray:
    """|m - low rank| of profiles m, given the directions of each.

    seen marks cells that hold a reading; floor is the last threshold of each profile.
    """
    s, low = np.zeros_like(m), np.zeros_like(m)
    level = np.maximum(np.abs(m).max(1), floor)
    for k in range(rounds):
        z = np.where(seen, m - s, low)
        low = np.matmul(basis, np.matmul(z[:, None, :], basis).transpose(0, 2, 1))[:, :, 0]
        rest = m - low
        s = np.where(seen & (np.abs(rest) > np.maximum(floor, level * 0.4 ** (k + 1))[:, None]), rest, 0)
    return np.where(seen, np.abs(m - low), 0)


def _profiles(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(profiles x PROFILE) row numbers and whether the cell is seen. seq: stretches, ascending."""
    first = np.flatnonzero(starts_of(seq))
    count = np.diff(np.append(first, len(seq)))
    per = -(-np.maximum(count - PROFILE, 0) // STEP) + 1
    which = np.repeat(np.arange(len(first)), per)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
    # the last profile of a stretch ends with it
    begin = np.minimum(nth * STEP, np.maximum(count - PROFILE, 0)[which])
    at = first[which][:, None] + begin[:, None] + np.arange(PROFILE)
    end = (first + count)[which][:, None]
    return np.minimum(at, end - 1), at < end


def _centred(v: np.ndarray, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Profiles of v less their medians; 0 where nothing is seen."""
    m = np.sort(np.where(seen, v[at], np.nan), 1)
    held = seen.sum(1)
    r = np.arange(len(m))
    mid = (m[r, (held - 1) // 2] + m[r, held // 2]) / 2
    return np.clip(np.where(seen, v[at] - mid[:, None], 0), -500, 500)


def _plain(v: np.ndarray, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return np.clip(np.where(seen, v[at], 0), -500, 500)


def _residual(matrices: list[np.ndarray], at: np.ndarray, seen: np.ndarray, basis: np.ndarray, floor: np.ndarray, n: int) -> np.ndarray:
    """Distance of each of n rows from the low-rank part over the given matrices, in the profile in which it is nearest to the middle."""
    total = sum(sparse_part(m, seen, basis, floor) ** 2 for m in matrices)
    out = np.zeros(n)
    # from the edges to the middle: what is written last holds
    for k in sorted(range(PROFILE), key=lambda k: -abs(k - (PROFILE - 1) / 2)):
        out[at[seen[:, k], k]] = np.sqrt(total[seen[:, k], k])
    return out


class _Slices:
    """The rows of whole slices with what both passes need: groups, limits, and positions in time order."""

    def __init__(self, rows: dict[str, np.ndarray], tol: float, tol_fast: float, sound_s: float) -> None:
        self.sound_s = sound_s
        self.n = len(rows["track_id"])
        self.group = np.cumsum(starts_of(rows["track_id"], rows["slice"])) - 1
        self.groups = int(self.group[-1]) + 1
        self.t = rows["frame"] / rows["fps"]
        x, y, self.speed = (rows[k].astype(float) for k in ("x", "y", "speed"))
        votes = np.zeros((self.groups, len(CLASSES) + 1))
        np.add.at(votes, (self.group, np.nan_to_num(rows["kind"].astype(float)).astype(int)), 1)
        self.kind = np.where(votes[:, 1:].max(1) > 0, votes[:, 1:].argmax(1) + 1, 0)
        self.limit = np.where(np.isin(self.kind, list(FAST)), tol_fast, tol)[self.group]
        self.pos = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        self.spd = np.flatnonzero(np.isfinite(self.speed))
        self.x, self.y = x[self.pos], y[self.pos]
        self.lost = rows["off"][self.pos].astype(bool)
        self.at, self.of = self.t[self.pos], self.group[self.pos]

    def stretches(self, rows: np.ndarray) -> np.ndarray:
        """Number of the stretch without absence of each of the given rows, ascending."""
        gap = np.zeros(len(rows), bool)
        gap[1:] = np.diff(self.t[rows]) > self.sound_s
        return np.cumsum(starts_of(self.group[rows]) | gap) - 1

    def sides(self, sound: np.ndarray, tt: np.ndarray, gg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For readings at tt of groups gg: the sound positions before and after, and whether both are near."""
        key = np.flatnonzero(sound)
        if not len(key):
            z = np.zeros(len(tt), int)
            return z, z, np.zeros(len(tt), bool)
        # times of a chunk lie far apart from group to group on one line
        line = 4 * (np.abs(self.t).max() + 1)
        order, want = self.of[key] * line + self.at[key], gg * line + tt
        b = np.searchsorted(order, want, "left") - 1
        a = np.searchsorted(order, want, "right")
        near = (b >= 0) & (a < len(key))
        b, a = key[np.clip(b, 0, len(key) - 1)], key[np.clip(a, 0, len(key) - 1)]
        near &= (self.of[b] == gg) & (self.of[a] == gg) & (tt - self.at[b] <= self.sound_s + 1e-9) & (self.at[a] - tt <= self.sound_s + 1e-9)
        return b, a, near

    def departures(self, sound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every speed: its distance from what the sound positions on both sides imply (0 without them), and whether there are any."""
        if not len(self.pos):
            return np.zeros(len(self.spd)), np.zeros(len(self.spd), bool)
        b, a, near = self.sides(sound, self.t[self.spd], self.group[self.spd])
        implied = np.hypot(self.x[a] - self.x[b], self.y[a] - self.y[b]) / np.maximum(self.at[a] - self.at[b], 1e-9)
        return np.where(near, self.speed[self.spd] - implied, 0.0), near


def slice_grams(rows: dict[str, np.ndarray], tol: float, tol_fast: float, sound_s: float) -> dict[str, np.ndarray]:
    """For every slice the sums of products of its profiles, of positions and of departures, as float32 bytes."""
    s = _Slices(rows, tol, tol_fast, sound_s)
    sums = np.zeros((s.groups, 2, CELLS))
    keep = np.flatnonzero(~s.lost)
    signals = []
    if len(keep):
        signals.append((0, s.pos[keep], [s.x[keep], s.y[keep]], _centred))
    if len(s.spd):
        signals.append((1, s.spd, [s.departures(~s.lost)[0]], _plain))
    for k, where, values, shape in signals:
        at, seen = _profiles(s.stretches(where))
        source = s.group[where[at[:, 0]]]
        first = np.flatnonzero(starts_of(source))
        for v in values:
            m = shape(v, at, seen)
            # about unit length; what is small beside the limit hardly counts
            unit = m / np.sqrt((m * m).sum(1) + (s.limit[where[at[:, 0]]] / 4) ** 2)[:, None]
            sums[source[first], k] += np.add.reduceat(unit[:, UPPER[0]] * unit[:, UPPER[1]], first, 0)
    head = np.flatnonzero(starts_of(s.group))
    day = np.floor_divide(rows["slice"][head], int(DAY_S // SLICE_S))
    return {"track_id": rows["track_id"][head], "slice": rows["slice"][head], "day": day, "kind": s.kind, "gram": np.array([v.astype("<f4").tobytes() for v in sums], object)}


def class_grams(grams: DataFrame) -> np.ndarray:
    """(classes + 1) x 2 x 12 x 12: what the tracks of each class share, summed by task, then by class; each of trace 1, or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            kinds = b.column("kind").to_numpy()
            values = np.frombuffer(b"".join(b.column("gram").to_pylist()), "<f4").reshape(len(kinds), -1).astype(float)
            for k in np.unique(kinds):
                sums[int(k)] = sums.get(int(k), 0.0) + values[kinds == k].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in sums.values()], pa.binary())], names=["kind", "gram"])

    per_task = grams.select("kind", "gram").mapInArrow(run, "kind int, gram binary")
    out = np.zeros((len(CLASSES) + 1, 2, CELLS))
    for r in per_task.repartition(len(CLASSES) + 1, "kind").mapInArrow(run, "kind int, gram binary").collect():
        out[r["kind"]] += np.frombuffer(r["gram"], "<f4").reshape(2, CELLS)
    whole = _whole(out)
    trace = np.trace(whole, axis1=2, axis2=3)[..., None, None]
    return np.where(trace > 0, whole / np.where(trace > 0, trace, 1), 0)


def day_bases(rows: dict[str, np.ndarray], prior: np.ndarray) -> dict[str, np.ndarray]:
    """For every slice of whole days the directions of its day: 2 x 12 x RANK float32 as bytes."""
    new = starts_of(rows["track_id"], rows["day"])
    day = np.cumsum(new) - 1
    grams = np.frombuffer(b"".join(rows["gram"]), "<f4").reshape(len(day), 2, CELLS).astype(float)
    sums = _whole(np.add.reduceat(grams, np.flatnonzero(new), 0)) + prior[rows["kind"][new]]
    basis = np.stack([_leading(sums[:, 0]), _leading(_unsteady(sums[:, 1]))], 1).astype("<f4")
    return {"track_id": rows["track_id"], "slice": rows["slice"], "basis": np.array([b.tobytes() for b in basis], object)[day]}


def _constant(value: np.ndarray, other: np.ndarray | None, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of the runs in which each value equals the one before, and other (or without it, 0) doesn't."""
    new = starts_of(group)
    new[1:] |= (value[1:] != value[:-1]) | ((value[1:] == 0) if other is None else (other[1:] == other[:-1]))
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(value)))


def flag_rows(rows: dict[str, np.ndarray], run_rows: int, tol: float, tol_fast: float, sound_s: float) -> dict[str, np.ndarray]:
    """Flags of the own rows of whole slices that have any, and the constant runs at both ends of each slice."""
    mark = rows["frame"] == BASIS_ROW
    bases = np.frombuffer(b"".join(rows["basis"][mark]), "<f4").reshape(-1, 2, PROFILE, RANK).astype(float)
    rows = {k: v[~mark] for k, v in rows.items() if k != "basis"}
    s = _Slices(rows, tol, tol_fast, sound_s)
    own = rows["own"].astype(bool)
    position, fast, stuck, ranged = (np.zeros(s.n, bool) for _ in range(4))

    # (d) ranges
    ranged[s.spd] = (s.speed[s.spd] < 0) | (s.speed[s.spd] > SPEED_MAX)
    ranged[s.pos] |= s.lost
    bad = s.lost.copy()
    if len(s.pos) and not s.lost.all():
        # (a) candidates: positions that stand out of the low-rank part; those that stand out most nearby are the first to be doubted
        keep = np.flatnonzero(~s.lost)
        where = s.pos[keep]
        at, seen = _profiles(s.stretches(where))
        limit = s.limit[s.pos]
        off = np.zeros(len(s.pos))
        off[keep] = _residual([_centred(s.x[keep], at, seen), _centred(s.y[keep], at, seen)], at, seen, bases[s.group[where[at[:, 0]]], 0], s.limit[where[at[:, 0]]] / 4, len(keep))
        peak = off.copy()
        for k in range(1, PROFILE // 2 + 1):
            peak[k:] = np.maximum(peak[k:], off[:-k])
            peak[:-k] = np.maximum(peak[:-k], off[k:])
        bad = s.lost | (off > np.maximum(limit / 3, peak / 2))
        c = np.flatnonzero(s.lost | (off > limit / 3))
        # the exact check, again as long as it finds other sound neighbours
        for _ in range(5):
            if not len(c):
                break
            b, a, near = s.sides(~bad, s.at[c], s.of[c])
            share = (s.at[c] - s.at[b]) / np.maximum(s.at[a] - s.at[b], 1e-9)
            away = np.hypot(s.x[b] + share * (s.x[a] - s.x[b]) - s.x[c], s.y[b] + share * (s.y[a] - s.y[b]) - s.y[c])
            case = near & (away > limit[c])
            position[s.pos] = False
            position[s.pos[c]] = case
            again = bad.copy()
            again[c] = case | s.lost[c] | (~near & bad[c])
            if (again == bad).all():
                break
            bad = again

    # (b) candidates: speeds whose departure stands out of its low-rank part
    if len(s.spd):
        gone, near = s.departures(~bad)
        at, seen = _profiles(s.stretches(s.spd))
        lim = s.limit[s.spd]
        out = _residual([_plain(gone, at, seen)], at, seen, bases[s.group[s.spd[at[:, 0]]], 1], lim[at[:, 0]] / 4, len(s.spd))
        c = np.flatnonzero(out > lim / 3)
        fast[s.spd[c]] = near[c] & (np.abs(gone[c]) > lim[c])

    # (c) runs of own rows; the first and last of a slice may go on in the next one
    ends: list[dict[str, np.ndarray]] = []
    mine = own[s.pos]
    for signal, where, value, other in ((0, s.spd[own[s.spd]], s.speed[s.spd[own[s.spd]]], None), (1, s.pos[mine], s.x[mine], s.y[mine]), (2, s.pos[mine], s.y[mine], s.x[mine])):
        if not len(where):
            continue
        group = s.group[where]
        first, n = _constant(value, other, group)
        if signal == 0:
            n_here = np.where(value[first] == 0, 0, n)
        else:
            n_here = n
        stuck[where] |= np.repeat(n_here >= run_rows, n)
        begins = starts_of(group[first])
        finishes = np.append(begins[1:], True)
        k = np.flatnonzero(begins | finishes)
        last = first[k] + n[k] - 1
        second = value if other is None else other
        frames = [rows["frame"][where[a : a + m]].astype("<i8").tobytes() if m < run_rows else b"" for a, m in zip(first[k], n[k])]
        ends.append({"track_id": rows["track_id"][where[first[k]]], "frame": rows["frame"][where[first[k]]], "signal": np.full(len(k), signal), "slice": rows["slice"][where[first[k]]], "first": begins[k], "last": finishes[k], "n": n[k], "value": value[first[k]], "other_first": second[first[k]], "other_last": second[last], "frames": np.array(frames, object)})

    keep = own & (position | fast | stuck | ranged)
    flags = {"track_id": rows["track_id"][keep], "frame": rows["frame"][keep], "position": position[keep], "speed": fast[keep], "stuck": stuck[keep], "range": ranged[keep], "signal": np.full(int(keep.sum()), -1)}
    out = {}
    for f in FOUND.split(", "):
        name, kind = f.split()
        parts = []
        for p in [flags, *ends]:
            size = len(p["track_id"])
            parts.append(p[name] if name in p else np.full(size, None, object) if kind == "binary" else np.zeros(size, {"boolean": bool, "double": float}.get(kind, np.int64)))
        out[name] = np.concatenate(parts)
    return out


def across_borders(pieces: DataFrame, run_rows: int) -> DataFrame:
    """(track_id, frame) of the rows of constant runs that are long enough only with what lies in the slices beside.

    pieces: the first and last run of every slice and signal. Runs of run_rows and more have flagged
    their own rows; shorter ones bring their frames along, fewer than run_rows each.
    """
    w = Window.partitionBy("track_id", "signal").orderBy("slice", "last", "frame")
    before = F.lag(F.struct("slice", "last", "value", "other_last")).over(w)
    changes = F.when(F.col("signal") == 0, F.col("value") != 0).otherwise(F.col("other_first") != before["other_last"])
    goes_on = F.col("first") & before["last"] & (F.col("slice") > before["slice"]) & (F.col("value") == before["value"]) & changes
    runs = pieces.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    whole = Window.partitionBy("track_id", "signal", "_run")
    runs = runs.withColumn("_rows", F.sum("n").over(whole)).where((F.col("_rows") >= run_rows) & (F.col("n") < run_rows))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(v, "<i8") for v in b.column("frames").to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("track_id").to_numpy(), [len(g) for g in got])), pa.array(np.concatenate(got))], names=["track_id", "frame"])

    # a standing value 0 is no case, however long
    return runs.where("signal > 0 or value != 0").select("track_id", "frames").mapInArrow(frames, "track_id bigint, frame bigint")


def implausible_rows(points: DataFrame, clips: DataFrame, calibrations: DataFrame | None = None, run_rows: int = 6, tol_m: float = 5.0, tol_fast_m: float = 12.0, sound_s: float = 3.0, slice_s: float = SLICE_S) -> DataFrame:
    """track_id, frame and which test flags the row: position, speed, stuck, range.

    Null and NaN readings are never flagged and are no neighbours; a row without sound rows on
    both sides within sound_s can be flagged by stuck or range alone. Repeated rows count once, with
    the values that arrived first. A position is out of range off the national grid, or farther than
    OFF_SITE_M from its site's origin where calibrations (site, origin_e, origin_n) names it. An empty
    table gives no rows; columns of other names are ignored.
    """
    p = with_fps(points, clips)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    read = ~F.isnan(x) & ~F.isnan(y)
    off = read & ((x <= MAP_X[0]) | (x > MAP_X[1]) | (y <= MAP_Y[0]) | (y > MAP_Y[1]))
    if calibrations is not None:
        origins = calibrations.where(F.col("site").isNotNull()).groupBy("site").agg(F.max("origin_e").alias("_e"), F.max("origin_n").alias("_n"))
        p = p.join(sized(origins), "site", "left")
        dx, dy = x - F.col("_e"), y - F.col("_n")
        off = off | F.coalesce(read & (F.sqrt(dx * dx + dy * dy) > OFF_SITE_M), F.lit(False))
        x, y = F.coalesce(dx, x), F.coalesce(dy, y)
    counted = rows_that_count(p, ["fps"], {"x": x, "y": y, "speed": F.col("speed").cast("double"), "kind": class_code(), "off": F.coalesce(off, F.lit(False))})
    cut = cut_slices(counted, HALO_S, slice_s)
    grams = cut_lineage(map_slices(cut, lambda r: slice_grams(r, tol_m, tol_fast_m, sound_s), GRAMS))
    prior = PRIOR * class_grams(grams)
    bases = map_slices(grams, lambda r: day_bases(r, prior), "track_id bigint, slice bigint, basis binary", keys=("track_id", "day"), order=("slice",))
    nan = F.lit(float("nan"))
    fixed = {"frame": F.lit(BASIS_ROW), "fps": F.lit(1.0), "x": nan, "y": nan, "speed": nan, "kind": F.lit(0), "off": F.lit(False), "own": F.lit(False)}
    marked = bases.select("track_id", "slice", "basis", *[c.alias(n) for n, c in fixed.items()])
    both = cut.withColumn("basis", F.lit(None).cast("binary")).unionByName(marked)
    # written once, as flags and the runs at borders are read apart; both are few beside rows
    found = cut_lineage(map_slices(both, lambda r: flag_rows(r, run_rows, tol_m, tol_fast_m, sound_s), FOUND))
    flags = found.where("signal < 0").select("track_id", "frame", "position", "speed", "stuck", "range")
    no = F.lit(False)
    more = across_borders(found.where("signal >= 0"), run_rows).select("track_id", "frame", no.alias("position"), no.alias("speed"), F.lit(True).alias("stuck"), no.alias("range"))
    return flags.unionByName(more).groupBy("track_id", "frame").agg(*[F.max(c).alias(c) for c in ("position", "speed", "stuck", "range")])
