"""Tracks near other tracks, and zones that contain a position.

Both sides rest on one idea: cover a region by cells, tell the cells that lie wholly inside it from
those that its boundary crosses, accept matches of the former by an equality alone and test only
the latter exactly.

* A zone is covered adaptively, from cells of about its own size on: a square cell that the polygon's
  boundary misses is kept whole (interior) or dropped (exterior), one that it crosses is split by four
  each way, down to the finest size.
  Positions meet the cover by an equi-join on (site, level, cell).
* The disc about a position is covered by cells whose diagonal is the distance: the position's own
  cell is interior, the 24 around it are boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, sized
from .slices import map_slices, rows_that_count, starts_of, with_fps
from .spikes import CLASSES, class_code

#: A cover has cells of 4 ** level metres. Boundary cells are split down to the finest level, or until
#: a polygon has so many of them; all of them are tested exactly, whatever their size.
FINEST, BOUNDARY_CELLS = 0, 4_000
#: Pairs of a cell and an edge that are looked at in one go.
BLOCK = 500_000
#: Tiles within which near rows are looked for: metres and seconds.
TILE_M, TILE_S = 64.0, 32.0
#: The groups and the group of each class.
GROUPS = ["people", "cycles", "vehicles", "trains"]
GROUP_OF = {"person": "people", "bicycle": "cycles", "car": "vehicles", "truck": "vehicles", "bus": "vehicles", "motorcycle": "vehicles", "train": "trains"}

NEAR = "clip string, id_a bigint, id_b bigint"


def group_code(group: str = "group") -> Column:
    """1.. for the known groups whatever their case and blanks, else null."""
    g = F.lower(F.trim(F.col(group)))
    out = F.lit(None).cast("int")
    for k, v in enumerate(GROUPS, 1):
        out = F.when(g == v, k).otherwise(out)
    return out


def track_labels(points: DataFrame) -> DataFrame:
    """(track_id, g, kind): codes of the group and the class that most rows of the track name.

    Ties go to the first of GROUPS and CLASSES. Where no row names a group, that of the class holds;
    0 stands for neither. Counts are combined before the shuffle, so a hot track costs nothing.
    """
    named, classed = group_code(), class_code()
    sums = [F.sum((named == k).cast("long")).alias(f"_g{k}") for k in range(1, len(GROUPS) + 1)]
    sums += [F.sum((classed == k).cast("long")).alias(f"_c{k}") for k in range(1, len(CLASSES) + 1)]
    votes = points.where(F.col("track_id").isNotNull()).groupBy("track_id").agg(*sums)

    def best(prefix: str, n: int) -> Column:
        counts = [F.coalesce(F.col(f"{prefix}{k}"), F.lit(0)) for k in range(1, n + 1)]
        most = F.greatest(*counts)
        out = F.lit(0)
        for k in reversed(range(1, n + 1)):
            out = F.when((counts[k - 1] == most) & (most > 0), k).otherwise(out)
        return out

    of_class = F.lit(0)
    for k, c in enumerate(CLASSES, 1):
        of_class = F.when(F.col("kind") == k, GROUPS.index(GROUP_OF[c]) + 1).otherwise(of_class)
    voted = votes.select("track_id", best("_g", len(GROUPS)).cast("int").alias("g"), best("_c", len(CLASSES)).cast("int").alias("kind"))
    return voted.withColumn("g", F.when(F.col("g") > 0, F.col("g")).otherwise(of_class).cast("int"))


# -- zones ---------------------------------------------------------------------------------------


def _touches(x0: np.ndarray, y0: np.ndarray, size: float, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whether the edge a-b touches the square cell (with a hair's margin), pair by pair: slab clipping."""
    pad = 1e-6
    lo, hi = np.zeros(len(x0)), np.ones(len(x0))
    for p, q, low in ((ax, bx, x0 - pad), (ay, by, y0 - pad)):
        high = low + size + 2 * pad
        d = q - p
        flat = d == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            s, e = (low - p) / d, (high - p) / d
        s, e = np.minimum(s, e), np.maximum(s, e)
        lo = np.maximum(lo, np.where(flat, 0.0, s))
        hi = np.where(flat & ((p < low) | (p > high)), -1.0, np.minimum(hi, np.where(flat, 1.0, e)))
    return lo <= hi


def _inside(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Even-odd rule for points against the edges a-b."""
    px, py = px[:, None], py[:, None]
    up = (ay > py) != (by > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (bx - ax) * (py - ay) / (by - ay) + ax
    return (up & (px < at)).sum(1) % 2 == 1


def cover(ring_x: np.ndarray, ring_y: np.ndarray, finest: int = FINEST, most: int = BOUNDARY_CELLS) -> list[tuple[int, int, int, bool]]:
    """(level, i, j, interior): cells of 4 ** level metres that cover a polygon; fewer than three finite corners give none.

    Begins with the few cells of about the size of the polygon's box. A cell that no edge touches is
    kept whole or dropped; one that edges touch is split by four each way, and its parts are tested
    against its own edges alone.
    """
    x, y = np.asarray(ring_x, float), np.asarray(ring_y, float)
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < 3:
        return []
    bx, by = np.roll(x, -1), np.roll(y, -1)
    extent = max(x.max() - x.min(), y.max() - y.min(), 1e-9)
    level = max(finest, int(np.ceil(np.log(extent) / np.log(4.0))) - 1)
    size = 4.0**level
    i, j = (v.ravel() for v in np.meshgrid(*[np.arange(np.floor((v.min() - 1e-6) / size), np.floor((v.max() + 1e-6) / size) + 1) for v in (x, y)]))
    # pairs of a cell, by number, and an edge that may touch it
    cell, edge = np.repeat(np.arange(len(i)), len(x)), np.tile(np.arange(len(x)), len(i))
    out: list[tuple[int, int, int, bool]] = []
    while True:
        parts = [slice(k, k + BLOCK) for k in range(0, len(cell), BLOCK)]
        hit = np.concatenate([_touches(i[cell[p]] * size, j[cell[p]] * size, size, x[edge[p]], y[edge[p]], bx[edge[p]], by[edge[p]]) for p in parts]) if parts else np.zeros(0, bool)
        cell, edge = cell[hit], edge[hit]
        cut = np.zeros(len(i), bool)
        cut[cell] = True
        clear = np.flatnonzero(~cut)
        for k in range(0, len(clear), max(1, BLOCK // len(x))):
            c = clear[k : k + max(1, BLOCK // len(x))]
            c = c[_inside((i[c] + 0.5) * size, (j[c] + 0.5) * size, x, y, bx, by)]
            out += zip([level] * len(c), i[c].astype(np.int64).tolist(), j[c].astype(np.int64).tolist(), [True] * len(c))
        i, j = i[cut], j[cut]
        cell = (np.cumsum(cut) - 1)[cell]
        if level <= finest or len(i) > most:
            break
        level, size = level - 1, size / 4
        di, dj = (v.ravel() for v in np.meshgrid(np.arange(4), np.arange(4)))
        i, j = (i[:, None] * 4 + di).ravel(), (j[:, None] * 4 + dj).ravel()
        cell, edge = (cell[:, None] * 16 + np.arange(16)).ravel(), np.repeat(edge, 16)
    out += zip([level] * len(i), i.astype(np.int64).tolist(), j.astype(np.int64).tolist(), [False] * len(i))
    return out


def zone_cover(zones: DataFrame) -> DataFrame:
    """zone_id, site, level, i, j, interior: the cover of every zone."""
    names = ["zone_id", "site", "level", "i", "j", "interior"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for z, s, rx, ry in zip(f["zone_id"], f["site"], f["ring_x"], f["ring_y"]):
                cells = cover(rx, ry) if rx is not None and ry is not None else []
                if cells:
                    yield pd.DataFrame([(z, s, *c) for c in cells], columns=names)

    named = zones.where(F.col("zone_id").isNotNull() & F.col("site").isNotNull()).select("zone_id", "site", "ring_x", "ring_y")
    return named.mapInPandas(run, "zone_id bigint, site string, level int, i bigint, j bigint, interior boolean")


def in_ring(x: Column, y: Column, ring_x: Column, ring_y: Column) -> Column:
    """Even-odd rule; the ring may run either way round and be closed or left open."""
    n = F.least(F.size(ring_x), F.size(ring_y))

    def edge(odd: Column, k: Column) -> Column:
        nxt = F.when(k + 1 == n, 0).otherwise(k + 1)
        ax, ay, bx, by = F.get(ring_x, k), F.get(ring_y, k), F.get(ring_x, nxt), F.get(ring_y, nxt)
        hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)
        return odd != F.coalesce(hit, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), edge)


def rows_in_zones(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, track_id), each pair once: tracks with a row inside a zone of the row's site.

    rows: track_id, site, x, y. A zone without site or ring contains nothing.
    """
    cells = cut_lineage(zone_cover(zones))
    # a level for every fourfold size between a metre and the largest zone: a dozen span the earth
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    if not levels:
        return rows.select(F.lit(0).cast("long").alias("zone_id"), "track_id").where("false")
    cells = sized(cells)
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / 4.0**k).alias("i"), F.floor(F.col("y") / 4.0**k).alias("j")) for k in levels])
    keyed = rows.select("track_id", "site", "x", "y", F.inline(keys))
    met = keyed.join(cells, ["site", "level", "i", "j"])
    rings = sized(zones.where(F.col("zone_id").isNotNull()).select("zone_id", "ring_x", "ring_y"))
    # equal pairs go before the shuffle; of boundary matches only those whose position is inside
    inner = met.where("interior").select("zone_id", "track_id")
    tested = met.where(~F.col("interior")).join(rings, "zone_id").where(in_ring(F.col("x"), F.col("y"), F.col("ring_x"), F.col("ring_y"))).select("zone_id", "track_id")
    return inner.unionByName(tested).distinct()


# -- near tracks ---------------------------------------------------------------------------------


def near_rows(rows: dict[str, np.ndarray], distance: float, seconds: float, block: int = 1_000_000) -> dict[str, np.ndarray]:
    """Pairs of tracks of different groups with near rows, within whole tiles, each once per tile."""
    tile = np.cumsum(starts_of(rows["clip"], rows["tx"], rows["ty"], rows["tt"])) - 1
    clip, track, g, frame, x, y = (rows[k] for k in ("clip", "track_id", "g", "frame", "x", "y"))
    reach = np.floor(rows["fps"] * seconds + 1e-9)
    none = {"clip": np.array([], object), "id_a": np.array([], np.int64), "id_b": np.array([], np.int64)}
    # tiles of one group have no pair
    n = tile[-1] + 1 if len(tile) else 0
    lo, hi = np.full(n, 99), np.full(n, -1)
    np.minimum.at(lo, tile, g)
    np.maximum.at(hi, tile, g)
    keep = np.flatnonzero((lo < hi)[tile]) if n else np.array([], int)
    # of the others, rows whose coarse surroundings have one group
    if len(keep):
        bits = (1 << g[keep].astype(np.int64))
        side = 8 * distance
        places = []
        for dx in (-distance, distance):
            for dy in (-distance, distance):
                places.append(np.stack([tile[keep], np.floor((x[keep] + dx) / side).astype(np.int64), np.floor((y[keep] + dy) / side).astype(np.int64)], 1))
        _, code = np.unique(np.concatenate(places), axis=0, return_inverse=True)
        code = code.ravel()
        seen = np.zeros(code.max() + 1, np.int64)
        np.bitwise_or.at(seen, code, np.tile(bits, 4))
        around = np.bitwise_or.reduce(seen[code].reshape(4, -1), 0)
        keep = keep[(around & ~bits) != 0]
    if not len(keep):
        return none
    tile, track, g, frame, x, y, reach = tile[keep], track[keep], g[keep], frame[keep], x[keep], y[keep], reach[keep]
    size = distance / np.sqrt(2)
    cx, cy = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
    cx, cy = cx - cx.min() + 2, cy - cy.min() + 2
    w, h = int(cx.max()) + 3, int(cy.max()) + 3
    cell = (tile.astype(np.int64) * w + cx) * h + cy
    order = np.lexsort((frame, cell))
    tile, track, g, frame, x, y, reach, cell = (v[order] for v in (tile, track, g, frame, x, y, reach, cell))
    # cells by rank, so that (cell, frame) fits one sortable number
    cells, rank = np.unique(cell, return_inverse=True)
    span = int(frame.max() - frame.min() + 2 * reach.max() + 3)
    f0 = int(frame.min() - reach.max() - 1)
    key = rank * span + (frame - f0)
    got: list[np.ndarray] = []
    for dx in range(-2, 3):
        for dy in range(-2, 3):
            if (dx, dy) < (0, 0):
                continue
            other = cell + dx * h + dy
            r = np.searchsorted(cells, other)
            r[r == len(cells)] = 0
            rows_here = np.flatnonzero(cells[r] == other)
            if not len(rows_here):
                continue
            base = r[rows_here] * span + (frame[rows_here] - f0)
            a = np.searchsorted(key, base - reach[rows_here].astype(np.int64), "left")
            b = np.searchsorted(key, base + reach[rows_here].astype(np.int64), "right")
            if (dx, dy) == (0, 0):
                a = np.maximum(a, rows_here + 1)
            count = np.maximum(b - a, 0)
            for part in np.array_split(np.arange(len(count)), max(1, int(count.sum() // block) + 1)):
                c = count[part]
                if not c.sum():
                    continue
                i = np.repeat(rows_here[part], c)
                j = np.repeat(a[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                fit = (g[i] != g[j]) & (g[i] > 0) & (g[j] > 0)
                i, j = i[fit], j[fit]
                if (dx, dy) != (0, 0):
                    # boundary cells: the exact test; the own cell is interior
                    fit = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= distance**2 + 1e-9
                    i, j = i[fit], j[fit]
                if len(i):
                    got.append(np.unique(np.stack([tile[i], np.minimum(track[i], track[j]), np.maximum(track[i], track[j])], 1), axis=0))
    if not got:
        return none
    pairs = np.unique(np.concatenate(got), axis=0)
    first = dict(zip(*np.unique(tile, return_index=True)))
    name = clip[keep][order][[first[t] for t in pairs[:, 0]]]
    return {"clip": name, "id_a": pairs[:, 1], "id_b": pairs[:, 2]}


def near_pairs(rows: DataFrame, distance: float = 1.5, seconds: float = 1.0) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: tracks of different groups in one clip with rows at most
    distance metres and seconds apart, each pair once.

    rows: clip, track_id, g (0: no group, never paired), frame, fps, x, y. Rows go to tiles of
    (clip, place, time), copied to the tiles beside only where they are that near to the border.
    """
    t = F.col("frame") / F.col("fps")

    def spans(v: Column, size: float, pad: float) -> Column:
        return F.sequence(F.floor(v / size), F.floor((v + pad) / size))

    tiled = (
        rows.where(F.col("g") > 0)
        .withColumn("tx", F.explode(spans(F.col("x"), TILE_M, distance)))
        .withColumn("ty", F.explode(F.sequence(F.floor((F.col("y") - distance) / TILE_M), F.floor((F.col("y") + distance) / TILE_M))))
        .withColumn("tt", F.explode(spans(t, TILE_S, seconds + 1e-6)))
    )
    pairs = map_slices(tiled, lambda r: near_rows(r, distance, seconds), NEAR, keys=("clip", "tx", "ty", "tt"), order=("frame",))
    return pairs.select("id_a", "id_b").distinct()


def near_and_inside(points: DataFrame, clips: DataFrame, calibrations: DataFrame, zones: DataFrame, distance: float = 1.5, seconds: float = 1.0, site_reach: float = 1000.0) -> DataFrame:
    """kind, id_a, id_b: 'near' pairs of tracks and 'zone' pairs of a zone and a track.

    Rows with null or NaN x or y, or farther than site_reach from their site's origin, don't
    count; rows of a site without origin don't either. Repeated rows count once, with the values
    that arrived first. Empty tables give no rows; columns of other names are ignored.
    """
    origins = sized(calibrations.where(F.col("site").isNotNull()).groupBy("site").agg(F.max("origin_e").alias("_e"), F.max("origin_n").alias("_n")))
    groups = cut_lineage(track_labels(points).select("track_id", "g"))
    rows = rows_that_count(with_fps(points, clips), ["clip", "site", "fps"], {"x": F.col("x"), "y": F.col("y")})
    rows = rows.join(origins, "site").where(F.sqrt(F.pow(F.col("x") - F.col("_e"), 2) + F.pow(F.col("y") - F.col("_n"), 2)) <= site_reach)
    rows = rows.where(~F.isnan("x") & ~F.isnan("y")).drop("_e", "_n")
    near = near_pairs(rows.where(F.col("fps") > 0).join(sized(groups), "track_id").drop("site"), distance, seconds)
    inside = rows_in_zones(rows, zones)
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(inside.select(F.lit("zone").alias("kind"), F.col("zone_id").alias("id_a"), F.col("track_id").alias("id_b")))
