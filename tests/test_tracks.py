"""Stops, spikes and nearness on made-up tracks: truth by construction, hostile rows, slice borders."""

import itertools
import math
from datetime import datetime

import numpy as np
import pytest

from trackloom.operators.nearby import cover, near_and_inside
from trackloom.operators.slices import rows_that_count
from trackloom.operators.spikes import implausible_rows
from trackloom.operators.stops import stops_and_trips

POINTS = "site string, clip string, track_id long, class string, frame long, time_s double, x double, y double, speed double, `group` string, arrived_at timestamp"
CLIPS = "clip string, site string, fps int"
AT = datetime(2025, 1, 1)


def row(track, frame, x, y, speed=0.0, cls="person", group="people", at=AT, clip="c", site="s"):
    return (site, clip, track, cls, frame, None if frame is None else frame / 10, x, y, speed, group, at)


@pytest.fixture
def clips(spark):
    return spark.createDataFrame([("c", "s", 10), ("d", "s", 10)], CLIPS)


def walk(track=1, seconds=300, still=((100, 160),), speed=1.4, noise=0.2, seed=1, offset=0.0):
    """Rows every half second; still: stretches (from, to) in seconds in which the track stands."""
    rng = np.random.default_rng(seed)
    x, out = offset, []
    for k in range(int(seconds * 2)):
        t = k / 2
        stands = any(a <= t < b for a, b in still)
        x += 0 if stands else speed / 2
        out.append(row(track, k * 5, x + rng.normal(0, noise), rng.normal(0, noise), 0.0 if stands else speed))
    return out


def stops(df):
    return sorted((r.track_id, r.start_s, r.end_s) for r in df.where("kind = 'stop'").collect())


def test_stops(spark, clips):
    rows = walk(1, still=((0, 40), (100, 160), (270, 300))) + walk(2, still=(), seed=2) + walk(3, still=((50, 62),), seed=3)
    got = stops(stops_and_trips(spark.createDataFrame(rows, POINTS), clips))
    assert [g[0] for g in got] == [1, 1, 1]
    for (_, a, b), (c, d) in zip(got, ((0, 40), (100, 160), (270, 300))):
        assert abs(a - c) <= 3 and abs(b - d) <= 3


def test_stop_survives_spikes_and_short_absence_not_a_long_one(spark, clips):
    rows = walk(1, still=((50, 120),))
    rows = [r if k % 17 else row(1, r[4], r[6] + 40, r[7]) for k, r in enumerate(rows)]
    short = [r for r in rows if not 800 <= r[4] < 1000]
    assert len(stops(stops_and_trips(spark.createDataFrame(short, POINTS), clips))) == 1
    long = [r for r in walk(1, seconds=400, still=((50, 200),)) if not 1000 <= r[4] < 1400]
    assert len(stops(stops_and_trips(spark.createDataFrame(long, POINTS), clips))) == 2


def test_one_endless_track_is_cut_and_joined(spark, clips):
    """A track over many slices, standing across their borders."""
    rows = walk(1, seconds=6000, still=((1700, 1900), (3500, 5500)))
    got = stops(stops_and_trips(spark.createDataFrame(rows, POINTS), clips))
    assert len(got) == 2 and abs(got[0][1] - 1700) <= 3 and abs(got[0][2] - 1900) <= 3 and abs(got[1][2] - 5500) <= 3
    trips = stops_and_trips(spark.createDataFrame(rows, POINTS), clips).where("kind = 'trip'").collect()
    assert abs(sum(t.distance_m for t in trips) / (1.4 * (6000 - 2200)) - 1) < 0.2


def test_ends_are_the_same_at_any_rate(spark):
    """One movement seen at 5 and at 50 rows a second: a long slow drift into the stop, which grows by many rows."""
    rates = spark.createDataFrame([("c", "s", 5), ("d", "s", 50)], CLIPS)
    ends = []
    for track, clip, fps in ((1, "c", 5), (2, "d", 50)):
        rows = []
        for f in range(0, 400 * fps):
            t = f / fps
            x = 1.4 * (t - 100) if t < 100 else 0.02 * (t - 100) if t < 200 else 2.0 + 1.4 * (t - 200)
            rows.append(("s", clip, track, "person", f, t, 5000.0 + x, 5000.0, 0.0, "people", AT))
        ends.append(stops(stops_and_trips(spark.createDataFrame(rows, POINTS), rates)))
    (a,), (b,) = ends
    assert abs(a[1] - b[1]) <= 1.0 and abs(a[2] - b[2]) <= 1.0


def test_stops_side_by_side(spark, clips):
    """Creeping back and forth about several spots: every stop stays within reach of its spot, and none overlap."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        x = 0.0
        for f in range(0, 6000, 5):
            x += 0.1 * math.sin(f / (150.0 + 20 * k)) + rng.normal(0, 0.05)
            rows.append(row(k, f, float(x), float(20 * math.cos(f / 900.0)), 0.1))
    got = stops_and_trips(spark.createDataFrame(rows, POINTS), clips).orderBy("track_id", "start_s").collect()
    for a, b in itertools.pairwise(got):
        assert a.track_id != b.track_id or a.end_s <= b.start_s + 1e-9
    assert all(r.duration_s >= 20 for r in got if r.kind == "stop")


def hostile():
    return [row(None, 5, 1.0, 1.0), row(1, None, 1.0, 1.0), row(9, 5, None, None), row(9, 10, math.nan, 1.0, math.nan, None, None), row(8, 5, 1.0, 1.0, None, None, None, None), row(8, 5, 1.0, 1.0, None, None, None, None), row(7, 5, 1.0, 1.0, clip=None, site=None), row(6, 5, 2.0, 2.0, clip="unknown")]


def others(spark):
    k = spark.createDataFrame([("s", 0.0, 0.0), (None, 1.0, 1.0)], "site string, origin_e double, origin_n double")
    z = spark.createDataFrame([(1, "s", [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), (2, "s", None, None), (3, None, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), (4, "s", [0.0, 1.0], [0.0, 1.0])], "zone_id long, site string, ring_x array<double>, ring_y array<double>")
    return k, z


@pytest.mark.parametrize("rows", [[], hostile(), hostile() * 2])
def test_hostile_rows(spark, clips, rows):
    p = spark.createDataFrame(rows, POINTS).selectExpr("*", "1 as fps", "2 as slice", "'x' as own", "3 as g", "4 as kind")
    k, z = others(spark)
    assert stops_and_trips(p.drop("fps"), clips).where("kind = 'stop'").count() == 0
    assert implausible_rows(p.drop("fps"), clips).count() == 0
    got = near_and_inside(p.drop("fps"), clips, k, z).collect()
    # the unknown clip's row has no rate of its own but stands in the zone, as the row without group does
    assert {(r.kind, r.id_a, r.id_b) for r in got} == ({("zone", 1, 6), ("zone", 1, 8)} if rows else set())


def test_first_arrival_counts(spark):
    rows = [row(1, 5, 1.0, 1.0, at=datetime(2025, 1, 2)), row(1, 5, 2.0, 2.0, at=AT), row(1, 5, 2.0, 2.0, at=AT), row(1, 5, 3.0, 3.0, at=None)]
    from pyspark.sql import functions as F

    got = rows_that_count(spark.createDataFrame(rows, POINTS), ["clip"], {"x": F.col("x")}).collect()
    assert [(r.frame, r.x) for r in got] == [(5, 2.0)]


def test_spikes(spark, clips):
    base = [(*r[:6], r[6] + 5000.0, r[7] + 5000.0, *r[8:]) for r in walk(1, seconds=200, still=((50, 120),))]
    bad = {40: (15.0, 0.0), 150: (0.0, -30.0), 151: (0.0, -31.0), 152: (1.0, -30.0), 300: (8.0, 0.0)}
    rows = [row(1, r[4], r[6] + bad.get(k, (0, 0))[0], r[7] + bad.get(k, (0, 0))[1], r[8]) for k, r in enumerate(base)]
    rows[220] = row(1, rows[220][4], rows[220][6], rows[220][7], 9.0)
    rows[250] = row(1, rows[250][4], rows[250][6], rows[250][7], -1.0)
    rows[360] = row(1, rows[360][4], 0.0, 0.0, 1.4)
    for k in range(330, 337):
        rows[k] = row(1, rows[k][4], rows[330][6], rows[k][7], rows[k][8])
    got = {r.frame // 5: r for r in implausible_rows(spark.createDataFrame(rows, POINTS), clips).collect()}
    constant = {k for k, r in enumerate(rows) if k not in (220, 250) and r[8] != 0}
    assert {k for k, r in got.items() if r.position} == {40, 150, 151, 152, 300, 360}
    assert {k for k, r in got.items() if r.range} == {250, 360}
    assert 220 in {k for k, r in got.items() if r.speed}
    assert {k for k, r in got.items() if r.stuck} - constant == set() and set(range(330, 337)) <= {k for k, r in got.items() if r.stuck}


@pytest.mark.parametrize("slice_s", [60.0, 400.0, 1800.0])
def test_stuck_runs_across_borders(spark, clips, slice_s):
    """Runs of sparse rows: any number of slices, absences longer than the halo; the same rows at any slicing."""
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for track in range(4):
        frames = np.cumsum(rng.choice([5, 700, 2500], 300)).tolist()
        speed = rng.choice([0.0, 1.0, 1.5, 2.0], 300, p=[0.3, 0.5, 0.1, 0.1])
        x = np.repeat(rng.uniform(4000, 4300, 50), 6) if track % 2 else rng.uniform(4000, 4300, 300)
        for f, v, a in zip(frames, speed, x):
            rows.append(row(track, int(f), float(a), float(rng.uniform(4000, 4300)), float(v)))
        for value, zero in ((speed, False), (x, True)):
            k = 0
            while k < 300:
                n = k
                while n < 300 and value[n] == value[k]:
                    n += 1
                if n - k >= 6 and (zero or value[k] != 0):
                    want |= {(track, int(f)) for f in frames[k:n]}
                k = n
    got = implausible_rows(spark.createDataFrame(rows, POINTS), clips, slice_s=slice_s).where("stuck")
    assert {(r.track_id, r.frame) for r in got.collect()} == want and len(want) > 100


def test_without_the_sparse_part_nothing_is_a_spike(spark, clips, monkeypatch):
    """Candidates come from the decomposition alone."""
    from trackloom.operators import spikes

    rows = [(*r[:6], r[6] + 5000.0, r[7] + 5000.0, *r[8:]) for r in walk(1, seconds=200)]
    rows[40] = row(1, rows[40][4], rows[40][6] + 15, rows[40][7], 1.4)
    rows[220] = row(1, rows[220][4], rows[220][6], rows[220][7], 9.0)
    part = {"track_id": np.ones(len(rows), np.int64), "slice": np.zeros(len(rows), np.int64), "frame": np.array([r[4] for r in rows]), "fps": np.full(len(rows), 10.0), "x": np.array([r[6] for r in rows]), "y": np.array([r[7] for r in rows])}
    part |= {"speed": np.array([r[8] for r in rows]), "kind": np.ones(len(rows), int), "off": np.zeros(len(rows), bool), "own": np.ones(len(rows), bool)}
    grams = spikes.slice_grams(part, 5.0, 12.0, 3.0)
    basis = spikes.day_bases(grams, np.zeros((8, 2, 12, 12)))["basis"]
    first = {k: np.concatenate(([{"frame": spikes.BASIS_ROW, "track_id": 1}.get(k, 0)], v)) for k, v in part.items()}
    first["basis"] = np.array([basis[0]] + [None] * len(rows), object)
    found = spikes.flag_rows(first, 6, 5.0, 12.0, 3.0)
    assert 200 in found["frame"][found["position"]] and 1100 in found["frame"][found["speed"]]
    monkeypatch.setattr(spikes, "sparse_part", lambda m, seen, basis, floor: np.zeros_like(m))
    found = spikes.flag_rows(first, 6, 5.0, 12.0, 3.0)
    assert not found["position"].any() and not found["speed"].any()


def test_near_and_inside_against_brute_force(spark, clips):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(40):
        x, y = rng.uniform(-80, 80, 2)
        g = ["people", "cycles", "vehicles"][t % 3]
        for f in range(0, 400, 5):
            x, y = x + rng.normal(0, 1), y + rng.normal(0, 1)
            rows.append(row(t, f, float(x), float(y), group=g.upper() if f % 3 else f" {g} ", clip="cd"[t % 2]))
    k, _ = others(spark)
    ring = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (15.0, 10.0), (0.0, 30.0)]
    z = spark.createDataFrame([(1, "s", [p[0] for p in ring], [p[1] for p in ring]), (2, "s", [p[0] for p in ring[::-1]] + [0.0], [p[1] for p in ring[::-1]] + [30.0])], "zone_id long, site string, ring_x array<double>, ring_y array<double>")
    got = {(r.kind, r.id_a, r.id_b) for r in near_and_inside(spark.createDataFrame(rows, POINTS), clips, k, z).collect()}
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[2] != b[2] and a[1] == b[1] and a[2] % 3 != b[2] % 3 and abs(a[4] - b[4]) <= 10 and math.hypot(a[6] - b[6], a[7] - b[7]) <= 1.5:
            want.add(("near", min(a[2], b[2]), max(a[2], b[2])))
    for r in rows:
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > r[7]) != (by > r[7]) and r[6] < (bx - ax) * (r[7] - ay) / (by - ay) + ax:
                odd = not odd
        if odd:
            want |= {("zone", 1, r[2]), ("zone", 2, r[2])}
    assert got == want and any(w[0] == "near" for w in want)


def test_cover_is_exact_and_disjoint():
    ring = np.array([(0.0, 0.0), (30.0, 3.0), (25.0, 30.0), (12.0, 9.0), (-4.0, 22.0)])
    from trackloom.operators.nearby import _inside

    cells = cover(ring[:, 0], ring[:, 1])
    rng = np.random.default_rng(1)
    p = rng.uniform(-10, 40, (4000, 2))
    b = np.roll(ring, -1, 0)
    truth = _inside(p[:, 0], p[:, 1], ring[:, 0], ring[:, 1], b[:, 0], b[:, 1])
    hits = np.zeros(len(p), int)
    sure = np.zeros(len(p), bool)
    for level, i, j, interior in cells:
        s = 4.0**level
        here = (np.floor(p[:, 0] / s) == i) & (np.floor(p[:, 1] / s) == j)
        hits += here
        sure |= here & interior
    assert hits.max() <= 1 and not (truth & (hits == 0)).any() and truth[sure].all() and sure.sum() > truth.sum() / 2


@pytest.mark.parametrize(("radius", "corners", "most"), [(3000.0, 400, 60_000), (50_000.0, 4, 120_000), (0.3, 5, 20)])
def test_cover_of_large_and_tiny_regions(radius, corners, most):
    """Few cells whatever the size, and every point of the region in exactly one of them."""
    from trackloom.operators.nearby import _inside

    a = np.linspace(0, 2 * math.pi, corners, endpoint=False) + 0.3
    x, y = 4e5 + radius * np.cos(a), 3e5 + radius * np.sin(a)
    cells = np.array(cover(x, y), dtype=[("level", int), ("i", int), ("j", int), ("interior", bool)])
    assert 0 < len(cells) < most
    rng = np.random.default_rng(2)
    px, py = 4e5 + rng.uniform(-1.2, 1.2, 3000) * radius, 3e5 + rng.uniform(-1.2, 1.2, 3000) * radius
    truth = _inside(px, py, x, y, np.roll(x, -1), np.roll(y, -1))
    hits, sure = np.zeros(len(px), int), np.zeros(len(px), bool)
    for level in np.unique(cells["level"]):
        c = cells[cells["level"] == level]
        known = dict(zip(zip(c["i"].tolist(), c["j"].tolist()), c["interior"].tolist()))
        got = [known.get(k) for k in zip(np.floor(px / 4.0**level).astype(int).tolist(), np.floor(py / 4.0**level).astype(int).tolist())]
        hits += np.array([g is not None for g in got])
        sure |= np.array([bool(g) for g in got])
    assert hits.max() <= 1 and not (truth & (hits == 0)).any() and truth[sure].all()
